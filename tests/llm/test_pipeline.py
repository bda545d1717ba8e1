"""The pipeline's stages against the operators they call, on a small corpus with planted cases."""

import random

import corpus_pipeline
from starloom.llm import queries
from test_operators import SCHEMA, check_sequences, prose


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    item = "Nine silver foxes crossed the frozen lake before dawn, and nobody in the village heard them go."
    clean = [prose(rng, 120) for _ in range(20)]
    near = clean[0].replace("fox", "cat", 1) if "fox" in clean[0] else clean[0] + " Yes."
    texts = clean + [clean[0], near, clean[1] + "\n" + item, prose(rng, 100) + " " + item, "too short", None, "", " | ".join(["menu"] * 80), prose(rng, 9000)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(range(20)) <= set(kept[0]) and not {24, 25, 26, 27} & set(kept[0]) and 28 in kept[0]
    assert 20 not in kept[1] and all(kept[1][i] == texts[i] for i in range(20))
    assert set(range(20)) <= set(kept[2]) <= set(kept[1]) and {22, 23} & set(kept[2])
    assert set(range(20)) <= set(kept[3]) and not {22, 23} & set(kept[3])
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(kept[3]) and check_sequences(packed, 4096) >= 1
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_registry():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == sorted(queries.QUERIES, key=lambda n: int(n[2 : n.index("_")])) and len(queries.QUERIES) == 10
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_empty_and_repeated_rows_and_other_columns(spark, tmp_path):
    rng = random.Random(12)
    page = prose(rng, 120)
    rows = [(0, page, "en", "s", 1, "a"), (0, page, "en", "s", 1, "a"), (None, prose(rng, 120), None, None, None, None), (3, prose(rng, 130), "en", "s", 1, "b")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, SCHEMA + ", size string").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in found) == [-1, 0, 3]
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
