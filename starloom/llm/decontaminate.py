"""Benchmark decontamination by pigeonhole edit matching.

An item of length n may lie in a document with up to k = error_rate * n edits. It is cut into k + 1 pieces, so one piece
at least lies there untouched. An Aho-Corasick automaton finds every exact hit of a piece; a hit is widened to blocks of 2,
4, 8, ... pieces, of which one with j pieces has fewer than j edits if the whole has at most k, and the whole item is then
verified by Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import ceil

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import table
from starloom.llm.edit_distance import masks, search, within

ERROR_RATE = 0.1
#: Bytes of items that one scan of the documents looks for; more items are looked for in blocks of that size.
BLOCK_BYTES = 32 << 20
_WORD = re.compile(r"[^\W_]+")
#: ASCII letters and digits in lower case, any other byte a space.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> str:
    """Letters and digits in lower case; anything between is one space."""
    text = text or ""
    if text.isascii():
        return " ".join(text.encode().translate(_PLAIN).decode().split())
    return " ".join(_WORD.findall(text.lower()))


class Index:
    """The pieces of some items, given as (item, text)."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        self.items, self.siblings, places = [], [], {}
        for item_id, text in items:
            own = normalise(text)
            if not own:
                continue
            k = int(error_rate * len(own))
            cuts = [len(own) * j // (k + 1) for j in range(k + 2)]
            number = len(self.items)
            self.items.append((item_id, own, k, cuts))
            self.siblings.append([self._sibling(own, cuts, j) for j in range(k + 1)])
            for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                places.setdefault(own[a:b], []).append((number, j))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.block = lru_cache(maxsize=1 << 16)(self._block)

    @staticmethod
    def _sibling(own: str, cuts: list[int], j: int) -> tuple[int, int, str, str] | None:
        """Of the other piece of j's pair: start, stop and its halves. With one edit in it at most, a half is untouched and moved by one place at most."""
        other = j ^ 1
        if other >= len(cuts) - 1:
            return None
        a, b = cuts[other], cuts[other + 1]
        return a, b, own[a : (a + b) // 2], own[(a + b) // 2 : b]

    def _block(self, number: int, level: int, j: int) -> tuple[int, int, int, dict[str, int]]:
        """(start in the item, length, edits, masks) of the block of 2**level pieces that holds piece j."""
        _, own, _, cuts = self.items[number]
        first = j >> level << level
        last = min(first + (1 << level), len(cuts) - 1)
        return cuts[first], cuts[last] - cuts[first], last - first - 1, masks(own[cuts[first] : cuts[last]])

    def _survives(self, text: str, number: int, j: int, at: int) -> bool:
        """Whether the blocks around a hit of piece j match near it."""
        if sibling := self.siblings[number][j]:
            a, b, left, right = sibling
            near = text[max(0, at + a - 1) : at + b + 1]
            if left not in near and right not in near:
                return False
        pieces, level = len(self.items[number][3]) - 1, 1
        while 1 << level - 1 < pieces:
            start, length, edits, peq = self.block(number, level, j)
            begin = at + start - edits
            if not within(peq, length, text[max(0, begin) : begin + length + 2 * edits], edits):
                return False
            level += 1
        return True

    def find(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """Of each item (by number) in text, (distance, start, stop) of its best match in the normalised text, the first of equals."""
        text = normalise(text)
        found: dict[int, tuple[int, int, int]] = {}
        if not text or not self.items:
            return found
        seen: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, j in where:
                _, own, k, cuts = self.items[number]
                at = end + 1 - length - cuts[j]  # where the item would start
                if any(abs(at - s) <= k for s in seen.get(number, ())) or not self._survives(text, number, j, at):
                    continue
                seen.setdefault(number, []).append(at)
                base = max(0, at - 2 * k)
                match = search(own, self.block(number, 62, j)[3], text[base : at + len(own) + 3 * k + 1], k)
                if match:
                    match = match[0], match[1] + base, match[2] + base
                    found[number] = min(found.get(number, match), match)
        return found


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[int, str], ...], error_rate: float) -> Index:
    """One per Python worker and block of items."""
    return Index(list(items), error_rate)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Tuples of (id, text): all items, in blocks whose texts are about block_bytes long at most."""
    named = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = max(1, ceil((named.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) / block_bytes))
    for i in range(blocks):
        own = named if blocks == 1 else named.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        yield tuple(sorted(((r.id, r.text) for r in own.collect()), key=lambda x: (x[0] is None, x)))


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that lies in it: id, item, distance, start, stop and item_length, in normalised characters.

    Whole texts are searched, row by row; the documents are not shuffled. Items go to the tasks in blocks of bounded size,
    each with its own scan. Null and empty texts and items without a letter or digit match nothing; repeated rows and items
    each have their rows; items with a null id are reported under null. Only the named columns are read. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, distance int, start long, stop long, item_length int"
    found = None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def hits(batches, shared=shared):
            index = _index(shared.value, error_rate)
            for batch in batches:
                rows = [(doc_id, index.items[n][0], d, a, b, len(index.items[n][1])) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, (d, a, b) in sorted(index.find(text).items())]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        fields = spark.createDataFrame([], schema).schema
        from pyspark.sql.pandas.types import to_arrow_type

        types, names = [to_arrow_type(f.dataType) for f in fields], fields.names
        own = docs.select(id_col, text_col).mapInArrow(hits, schema)
        found = own if found is None else found.unionByName(own)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay as they are."""
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(block), error_rate)(F.col(text_col)))
    return docs


def _clean(shared, error_rate: float):
    def clean(texts: pd.Series) -> pd.Series:
        index = _index(shared.value, error_rate)
        return pd.Series([not index.find(t) for t in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
