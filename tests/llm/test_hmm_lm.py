"""The language model against plain recursions and counts."""

import itertools
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from starloom.llm import hmm_lm

SCHEMA = "doc_id long, text string, score double"


def small_model(states, symbols, seed=0):
    rng = np.random.default_rng(seed)
    emit = np.zeros((50, states))
    emit[:symbols] = rng.random((symbols, states))
    rows = lambda m: m / m.sum(axis=-1, keepdims=True)
    return hmm_lm.Model(rows(rng.random(states)), rows(rng.random(states)), rows(rng.random((states, states))), emit / emit.sum(axis=0))


def paths(model, codes, start):
    for path in itertools.product(range(len(start)), repeat=len(codes)):
        p = start[path[0]] * model.emit[codes[0], path[0]]
        for t in range(1, len(codes)):
            p *= model.move[path[t - 1], path[t]] * model.emit[codes[t], path[t]]
        yield path, p


def test_forward_recursion_sums_all_paths():
    model = small_model(3, 5)
    rng = np.random.default_rng(1)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 6, 6)]
    found = hmm_lm.log_likelihoods(model, sequences)
    for codes, log10 in zip(sequences, found):
        assert log10 == pytest.approx(math.log10(sum(p for _, p in paths(model, codes, model.start))))
    long = rng.integers(0, 5, 20_000).astype(np.uint16)  # scaling keeps it from underflow
    assert np.isfinite(hmm_lm.log_likelihoods(model, [long])).all()


def test_counts_are_those_of_all_paths():
    model = small_model(3, 4)
    rng = np.random.default_rng(2)
    windows = [rng.integers(0, 4, n).astype(np.uint16) for n in (3, 5, 1, 4)]
    first = np.array([True, False, True, False])
    counts = hmm_lm.Counts(3, 50)
    counts.add(model, windows, first)
    start, inner, move, emit = np.zeros(3), np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for codes, begins in zip(windows, first):
        own = model.start if begins else model.inner
        whole = sum(p for _, p in paths(model, codes, own))
        for path, p in paths(model, codes, own):
            (start if begins else inner)[path[0]] += p / whole
            for t, state in enumerate(path):
                emit[codes[t], state] += p / whole
                if t:
                    move[path[t - 1], state] += p / whole
    for found, expected in ((counts.start, start), (counts.inner, inner), (counts.move, move), (counts.emit[:4], emit)):
        assert np.allclose(found, expected)


def test_scores(spark):
    rng = random.Random(3)
    kinds = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]]
    texts = [" ".join(rng.choice(kinds[i % 2][: rng.randint(1, 40)]) for _ in range(rng.randint(5, 60))) for i in range(200)] + [None, "", "A0 a0\x0bB1", "never seen", texts_long(rng)]
    texts += [" ".join(f"w{800 * i + j} a{j % 40}" for j in range(800)) for i in range(90)]  # more words than have symbols of their own
    rows = [(i, t, 0.0) for i, t in enumerate(texts)] + [(3, texts[3], 0.0), (None, "a1", 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = hmm_lm.hmm_scores(frame).collect()
    tokens = {t: [*(t or "").encode().lower().split(), None] for _, t, _ in rows}
    counts = Counter(w for i, t, _ in rows if crc32(str("" if i is None else i).encode()) % 7 != 2 for w in tokens[t])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, t, _ in rows:
        r = by[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[t]), sum(counts[w] > 0 for w in tokens[t]), n)
        assert r.held_out == (crc32(str("" if i is None else i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[t])) and r.score < 0
    assert len(counts) > hmm_lm.FREQUENT + 2000
    held = [r for r in found if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    nothing = hmm_lm.hmm_scores(frame.where("doc_id = 3"), folds=1, held_out_fold=0).collect()  # no training texts
    assert {(r.train_tokens, r.n_known, round(r.base_score, 6)) for r in nothing} == {(0, 0, 0.0)}
    assert hmm_lm.hmm_scores(frame.limit(0)).count() == 0


def test_scores_against_a_plain_recursion(spark, monkeypatch):
    """The end-to-end formula: symbols of their own, rare classes with a discount, unknown words."""
    rng = random.Random(4)
    models, train = [], hmm_lm.train
    monkeypatch.setattr(hmm_lm, "train", lambda *a: models.append(train(*a)) or models[-1])
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.choice([1, 1, 2]) for _ in range(rng.randint(1, 30))) for _ in range(60)] + [None, "never seen before a"]
    rows = [(i, t, 0.0) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in hmm_lm.hmm_scores(spark.createDataFrame(rows, SCHEMA), states=3, frequent_words=12, rare_classes=5).collect()}
    (model,) = models
    counts = Counter(w for i, t, _ in rows if not found[i].held_out for w in hmm_lm.words_of(t))
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[:12]
    rare = [Counter({w: c for w, c in counts.items() if w not in frequent and crc32(w) % 5 == k}) for k in range(5)]
    once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    for i, t, _ in rows:
        symbols, inside = [], 0.0
        for w in hmm_lm.words_of(t):
            if w in frequent:
                symbols.append(frequent.index(w))
                continue
            own = rare[crc32(w) % 5]
            symbols.append(12 + crc32(w) % 5)
            share = own[w] - discount if w in own else discount * len(own) if own else 1.0
            inside += math.log10(share / max(1, sum(own.values())))
        alpha = model.start * model.emit[symbols[0]] if symbols else model.start * model.emit[17]
        for s in [*symbols[1:], 17] if symbols else []:
            alpha = (alpha @ model.move) * model.emit[s]
        assert found[i].score == pytest.approx(math.log10(alpha.sum()) + inside), t


def test_the_model_does_not_change_with_the_files(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(20)), 0.0) for i in range(100)]
    one = {r.doc_id: r.score for r in hmm_lm.hmm_scores(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    other = {r.doc_id: r.score for r in hmm_lm.hmm_scores(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()}
    assert all(one[i] == pytest.approx(other[i]) for i in one)


def texts_long(rng):
    return " ".join(rng.choice(["a1", "a2", "b3"]) for _ in range(5000))


