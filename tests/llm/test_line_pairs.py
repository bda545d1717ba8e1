"""How many pairs of lines are compared: those that drawn forms don't bring into one group, each once."""

import random

from starloom.llm import line_dedup


def _near_copies(spark):
    """Copies of a line with one or two of its eleven words replaced, some of them further apart than the similarity of 0.8."""
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base, texts = [word() for _ in range(11)], []
    for i in range(500):
        own = list(base)
        for place in dice.sample(range(11), dice.choice((1, 1, 2))):
            own[place] = word()
        texts.append((i, " ".join(own)))
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


def _judged(docs):
    found = line_dedup.judge_lines(docs, min_words=1, wide=True).select("doc_id", "line", "group", "kept")
    return sorted(map(tuple, found.collect()))


def test_few_pairs_each_once(spark, monkeypatch):
    docs, compared, left = _near_copies(spark), [], []
    similar, kind = line_dedup._similar, type(docs)
    distinct = kind.distinct

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    def watched(frame):
        if frame.columns == ["a", "b"]:
            left.append((frame.count(), distinct(frame).count()))
        return distinct(frame)

    monkeypatch.setattr(line_dedup, "_similar", counted)
    monkeypatch.setattr(kind, "distinct", watched)
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    found, once = _judged(docs), compared.copy()
    assert len(once) == 2 and left[-1][0] == left[-1][1] > 0  # what is left meets once, over two kinds of keys
    compared.clear()
    monkeypatch.setattr(line_dedup, "ROUNDS", 4)
    monkeypatch.setattr(line_dedup, "CROWDED", 0)
    assert _judged(docs) == found
    assert sum(compared) < sum(once)
