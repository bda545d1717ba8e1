"""Two-pass external shuffle: scatter rows into memory-sized buckets, Fisher-Yates each bucket, cut into shards."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import table, unsigned_crc32, without

OVERHEAD = 16


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): place i from the end swaps with a place drawn from 0 to i."""
    order = list(range(n))
    drawn = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = drawn[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def two_pass_shuffle(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, salt: Column | None = None) -> DataFrame:
    """docs in a seeded random order: columns bucket, shard, slot (0, 1, ... in each shard) and size added; the law is "rows".

    Pass 1 scatters rows by a seeded hash of id and salt into about ``total size / bucket_bytes`` buckets, whatever their
    source or text. Pass 2 puts a bucket's rows into a canonical order and shuffles them. The buckets one after another are
    the whole order, which is cut into shards whose row counts differ by one at most. Only bucket totals meet in one place.
    A row's size is its text's UTF-8 bytes plus 16; null texts have none. Null ids hash like a value; salt (a row's place in
    its file, say) parts repeated ids, which else share a bucket, and rows alike in all columns may swap places freely.
    Columns of docs that bear a result's name are replaced; an empty table gives no rows.
    """
    names = ["bucket", "shard", "slot", "size"]
    rows = without(docs, names)
    keep = rows.columns
    salt = F.lit(0) if salt is None else salt
    rows = rows.withColumn("size", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD).withColumn("__salt", salt)
    total, nbytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, ceil(nbytes / bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("__salt")), F.lit(buckets)))
    # bucket totals are a few bytes each; sums over blocks of 4096 buckets keep the running sum off a single task
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / 4096))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before_block"))
    offsets = counts.join(blocks, "block").select("bucket", (F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n") + F.col("before_block")).alias("__before"))

    def shuffled(group: pa.Table) -> pa.Table:
        hashes = [xxhash.xxh64_intdigest(t or "") for t in group[text_col].to_pylist()]
        keys = pa.table({"id": group[id_col], "salt": group["__salt"], "hash": pa.array(hashes, pa.uint64())})
        ordered = group.take(pc.sort_indices(keys, [("id", "ascending"), ("salt", "ascending"), ("hash", "ascending")]))
        bucket = ordered["bucket"][0].as_py()
        mixed = ordered.take(pa.array(fisher_yates(len(ordered), np.random.Generator(np.random.PCG64([seed, bucket])))))
        before = mixed["__before"][0].as_py()
        at = range(before, before + len(mixed))  # Python's integers: products can exceed 64 bits
        shard = [((x + 1) * shards - 1) // total for x in at]
        slot = [x - s * total // shards for x, s in zip(at, shard)]
        return mixed.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    columns = rows.join(offsets, "bucket").select(rows.columns + ["__before"])
    schema = T.StructType(columns.schema.fields + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    out = columns.groupBy("bucket").applyInArrow(shuffled, schema)
    return out.select(*keep, "bucket", "shard", "slot", "size")


def write_shards(shuffled: DataFrame, path: str, order: tuple[str, str] = ("shard", "slot")) -> None:
    """Write each shard's rows in slot order under path/shard=N. Rows are range-partitioned by shard and slot, so a large shard is several files, in order."""
    shuffled.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(order[0]).parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    docs = docs.select("doc_id", "text", place.alias("place"))
    out = two_pass_shuffle(docs, shards=40, salt=F.col("place"))
    return out.select("doc_id", "size", unsigned_crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket")
