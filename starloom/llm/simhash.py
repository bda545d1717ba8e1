"""SimHash near-duplicate detection with multi-index hashing.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints are linked if at
most ``radius`` bits differ. They are cut into ``segments`` pieces; of two linked fingerprints some piece differs in few
bits, so each fingerprint looks up small Hamming balls around its pieces in tables of pieces, and whole distances are
checked inside the join. Components come from star contraction over distinct fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import materialise, table
from starloom.llm.components import connected_components

SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    stops = (ends - 1)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprint_udf(words_per_shingle: int):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, words_per_shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of


def balls(radius: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, flips) of each segment. With radius = q * segments + a, the first a + 1 segments need balls of radius q, the others of q - 1: two words of at most that distance agree so far in one segment at least."""
    q, a = divmod(radius, segments)
    found, shift = [], 0
    for i in range(segments):
        width = 64 // segments + (i < 64 % segments)
        reach = q if i <= a else q - 1
        flips = [sum(1 << b for b in bits) for r in range(reach + 1) for bits in combinations(range(width), r)]
        if flips:
            found.append((shift, width, flips))
        shift += width
    return found


def _tables(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """A row (key, and prints' columns) for each piece of each fingerprint."""
    pieces = [F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1).bitwiseOR(F.lit(i << 40)) for i, (shift, width, _) in enumerate(balls(radius, segments))]
    return prints.select("*", F.explode(F.array(*pieces)).alias("key"))


def _probes(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """A row (key, and prints' columns) for each place of each ball around a piece of a fingerprint."""
    own = []
    for i, (shift, width, flips) in enumerate(balls(radius, segments)):
        piece = F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
        own.append(F.transform(F.array(*[F.lit(x | i << 40) for x in flips]), piece.bitwiseXOR))
    return prints.select("*", F.explode(F.concat(*own)).alias("key"))


def _near(a: str, b: str, radius: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def near_links(prints: DataFrame, radius: int = 4, segments: int = 3, group: str | None = None) -> DataFrame:
    """Rows (a, b), a < b, of distinct fingerprints (column fp) that differ in 1 to ``radius`` bits: every such pair, or every one whose columns ``group`` differ.

    Three segments of about 21 bits suit up to some 2**26 fingerprints; two segments of 32 bits make larger balls and
    shorter buckets for more. Either is exact. Distances are checked inside the join.
    """
    left = _probes(prints, radius, segments).withColumnsRenamed({"fp": "a", "key": "probe"} | ({group: "group_a"} if group else {}))
    right = _tables(prints, radius, segments).withColumnsRenamed({"fp": "b"} | ({group: "group_b"} if group else {}))
    near = (F.col("a") < F.col("b")) & _near("a", "b", radius)
    if group:
        near &= F.col("group_a") != F.col("group_b")
    return left.join(right.hint("shuffle_merge"), (F.col("probe") == F.col("key")) & near).select("a", "b").distinct()


def linked_components(prints: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Rows (node, component) of the distinct fingerprints that are linked to another.

    Fingerprints with a piece in common are first linked to the smallest and largest of them; then only near pairs that are
    not in one component yet are looked for. So a large group of near copies doesn't become all its pairs.
    """
    tables = _tables(prints, radius, segments)
    ends = tables.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    ends = ends.select("key", F.explode(F.array("low", "high")).alias("end"))
    stars = tables.join(ends, "key").where((F.col("fp") != F.col("end")) & _near("fp", "end", radius)).select(F.col("fp").alias("a"), F.col("end").alias("b"))
    stars = materialise(stars, "star-links")
    components = connected_components(stars)
    grouped = prints.join(components, prints["fp"] == components["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"))
    rest = materialise(near_links(materialise(grouped, "grouped-fingerprints"), radius, segments, "group"), "rest-links")
    return components if rest.isEmpty() else connected_components(stars.unionByName(rest))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """docs' id column, fingerprint (hex), fp (the same as a signed long) and component_id, a row for each row.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other; texts shorter than a
    shingle are one shingle. component_id is the smallest id among all rows that links reach; null ids take part but are
    never the smallest, and a component of null ids alone has a null component_id. Repeated rows and ties share a
    component. Only the two named columns are read, so other columns may have any names. An empty table gives no rows.
    """
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(words_per_shingle)(F.col(text_col)).alias("fp")), "fingerprints")
    least = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    comps = materialise(linked_components(least.select("fp"), radius, segments), "components")
    members = least.join(comps, least["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = members.join(members.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest id, and of equal ids the first as docs is written here. Null ids give way to others."""
    rows = materialise(docs.withColumns({"__fp": fingerprint_udf(words_per_shingle)(F.col(text_col)), "__row": F.monotonically_increasing_id()}), "fingerprinted")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    least = materialise(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(place).alias("place")), "distinct-fingerprints")
    comps = linked_components(least.select("fp"), radius, segments)
    members = least.join(comps, least["fp"] == comps["node"], "left").select("place", F.coalesce("component", "fp").alias("component"))
    keepers = members.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.row").alias("__row"))
    return rows.join(keepers, "__row", "left_semi").select(docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
