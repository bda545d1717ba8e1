"""Line dedup's rounds, shared keys and components: no more work than the pairs ask for, whatever the portions."""

import random

import numpy as np
from starloom.llm import components, line_dedup
from starloom.llm.line_keys import agree


def test_no_rounds_for_sketches_apart(spark, monkeypatch):
    """A key of many forms whose sketches agree nowhere leaves nothing to compare and calls for no further round."""
    dice, names, made = random.Random(3), [f"line number {i}" for i in range(60)], []
    signed = line_dedup.signed_lines(spark.createDataFrame(list(enumerate(names)), "id long, text string"), "text", 1, True, keep_text=False)
    sketches = [sum((i >> 2 * (j % 3) & 3) << 2 * j for j in range(1, 32)) & ((1 << 63) - 4) | 1 for i in range(60)]
    dice.shuffle(sketches)
    keyed = spark.createDataFrame([(n, 14, s, 8 * k + 1) for n, s in zip(line_dedup.digests(names).tolist(), sketches) for k in range(3)], "form long, size int, sketch long, key long")
    write = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda frame, name: made.append(name) or write(frame, name))
    apart = lambda a, b: agree(a, b) & (a == b)
    assert line_dedup._near_forms(signed, keyed, apart, 0.8).count() == 0
    assert made.count("star-pairs") == 1


def test_shared_pairs_in_portions():
    """Portions of a part, with what is kept between them, tell each form of each shared key."""
    dice = random.Random(4)
    rows = [(dice.randrange(40), dice.randrange(50), 0) for _ in range(90)]
    by_key = {}
    for key, form, _ in rows:
        by_key.setdefault(key, set()).add(form)
    expected = {(key, form) for key, own in by_key.items() if len(own) > 1 for form in own}
    assert expected and len(expected) < len(set(rows))
    for portion in (1, 7, 90):
        kept, found = np.empty((0, 3), np.int64), set()
        for at in range(0, 90, portion):
            told, kept = line_dedup._shared_pairs(np.concatenate([kept, np.array(rows[at : at + portion], np.int64)]))
            found |= {(key, form) for key, form, _ in told.tolist()}
            assert len(kept) == len({key for key, _, _ in rows[: at + portion]})
        assert found == expected, portion


def test_components_in_few_rounds(spark, monkeypatch):
    """A chain and a star hang together after two writes; with more links than a task takes the rounds of stars agree."""
    ids = random.Random(5).sample(range(10000), 400)
    links = [*zip(ids[:200], ids[1:200]), *((ids[200], x) for x in ids[201:]), (7, 7), (None, 1)]
    expected = {x: min(own) for own in (ids[:200], ids[200:]) for x in own}
    frame, made, write = spark.createDataFrame(links, "a long, b long").repartition(5), [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda *a: made.append(a[1]) or write(*a))
    assert dict(map(tuple, components.connected_components(frame).collect())) == expected
    assert len(made) == 2
    monkeypatch.setattr(components, "PART", 50)
    assert dict(map(tuple, components.connected_components(frame).collect())) == expected
