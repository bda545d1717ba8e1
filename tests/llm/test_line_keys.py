"""The wide search for near lines against all pairs."""

import random
import string
from itertools import combinations

import corpus_pipeline
import numpy as np
from starloom.llm import edit_distance, line_dedup
from starloom.llm.line_keys import signs_of
from test_operators import groups_by_pairs

SCHEMA = "doc_id long, text string"


def near(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return edit_distance.distance(a, b, most) <= most


def lines_of(rng, sizes, per_size):
    """Lines of so many words, each with copies in which a word or a few are changed, put in or left out."""
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(3000)]
    for n in sizes:
        for _ in range(per_size):
            words = rng.choices(vocabulary, k=n)
            yield " ".join(words)
            for _ in range(2):
                changed = list(words)
                for _ in range(rng.randint(1, max(1, n // 8))):
                    at = rng.randrange(len(changed))
                    changed[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [changed[at], rng.choice(vocabulary)], [changed[at][:-1] + "x"]])
                yield " ".join(changed)


def test_candidates_against_all_pairs():
    for sizes in ((3, 4, 5), (6, 8, 9), (10, 12, 15), (20, 30, 40), (60, 100)):
        names = sorted(set(lines_of(random.Random(sizes[0]), sizes, 40)))
        signs = signs_of(names)
        held = [set() for _ in names]
        for k, i in zip(signs.keys.tolist(), np.repeat(signs.line, signs.sizes).tolist()):
            held[i].add(k)
        pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if near(names[i], names[j])]
        assert len(pairs) > 30 and sum(bool(held[i] & held[j]) for i, j in pairs) >= 0.97 * len(pairs), sizes


def test_wide_search(spark):
    rng = random.Random(4)
    names = sorted(set(lines_of(rng, (4, 9, 12, 25, 50), 8)))
    frame = spark.createDataFrame([(i, f"{x.upper()}!\n{x}") for i, x in enumerate(names)], SCHEMA)
    group = groups_by_pairs(names, near)
    keeper = {g: i for i, g in reversed([(i, group[x]) for i, x in enumerate(names)])}
    found = line_dedup.judge_lines(frame, wide=True).collect()
    assert {(r.doc_id, r.line): r.kept for r in found} == {(i, k): k == 0 and keeper[group[x]] == i for i, x in enumerate(names) for k in (0, 1)}
    assert len({group[x] for x in names}) < len(names) // 2 < line_dedup.judge_lines(frame).where("kept").count()
    assert {r.doc_id for r in line_dedup.dedup_lines(frame, wide=True).collect()} == {keeper[group[x]] for x in names}


def test_short_and_spaceless_lines(spark, tmp_path):
    rng = random.Random(9)
    slug = "".join(rng.choices(string.ascii_lowercase + string.digits, k=60))
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    lines = ["Les", "les!", "and ornd", "and ornt", "other", slug, slug[:30] + "q" + slug[31:], han, han[:20] + han[21:], "...", "7", "8"]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.kept for r in line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {0: True, 1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: False, 10: True, 11: True}
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {0, 2, 4, 5, 7, 9, 10, 11}


def test_distances_side_by_side(monkeypatch):
    """Pairs of one to several blocks, alike and unlike, at once and in halves, agree with distances one by one."""
    draw = random.Random(5)
    pairs = []
    for _ in range(300):
        letters, most = draw.choice(["ab", "abcdefgh ", "abé漢\U0001f600"]), draw.choice([1, 63, 64, 65, 128, 129, 300])
        a = "".join(draw.choices(letters, k=draw.randint(1, most)))
        b = "".join(c for c in a if draw.random() > 0.1) + "z" if draw.random() < 0.5 else "".join(draw.choices(letters, k=draw.randint(1, most)))
        pairs.append(tuple(sorted((a, b), key=len)))
    exact = [edit_distance.distance(a, b) for a, b in pairs]
    assert edit_distance.distances(pairs).tolist() == exact
    most = [draw.randint(0, 60) for _ in pairs]
    expected = [d <= m for d, m in zip(exact, most)]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert edit_distance.all_similar(left, right, most).tolist() == expected
    monkeypatch.setattr(edit_distance, "PLACES", 2000)
    monkeypatch.setattr(edit_distance, "WORDWISE", 20)
    assert edit_distance.all_similar(left, right, most).tolist() == expected
