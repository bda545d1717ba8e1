"""Fuzzy line deduplication: signatures of normalised lines, shared keys, edit similarity, one line of each group.

A line's normal form is its letters and digits in lower case, runs of anything else being one space. Lines of one normal
form are equal; distinct forms are linked if their 64-bit SimHash differs in at most ``BITS`` bits (candidates then share a
pigeonhole block) and their edit similarity (1 - distance / longer length) is ``SIMILARITY`` or more. In a wide search,
which the registered query and the pipeline make, candidates share a key of line_keys instead, their sketches agree, and
edit similarity alone decides. Of a connected group, the occurrence with the smallest (id, row, line number) stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import discard, materialise, release, table
from starloom.llm.components import connected_components
from starloom.llm.decontaminate import normalise
from starloom.llm.edit_distance import all_similar
from starloom.llm.line_keys import Signs, agree, signs_of

BITS, BLOCKS, SIMILARITY, MIN_WORDS = 3, 8, 0.8, 3
#: Places of the table that tells which lines' forms are asked for: 128 KB, whatever the input.
SIEVE = 1 << 20
#: Rounds of comparisons with drawn forms at most, and pairs left to compare for each form of a key that call for another.
ROUNDS, CROWDED = 4, 4


def forms(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, str]]:
    """(line number, normal form) of each line with at least min_words words in its form."""
    found = ((i, normalise(line)) for i, line in enumerate((text or "").split("\n")))
    return [(i, form) for i, form in found if form.count(" ") >= min_words - 1 and form]


def digests(lines: list[str]) -> np.ndarray:
    """64-bit numbers of normal forms, signed."""
    return np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines)).view(np.int64)


class _Signs(dict):
    """Words' numbers, given as they come, and a row of 64 signs for each."""

    def __init__(self):
        super().__init__()
        self.fresh, self.signs = [], np.empty((0, 64), np.int8)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(xxhash.xxh64_intdigest(word))
        return number

    def table(self) -> np.ndarray:
        if self.fresh:
            hashes, self.fresh = np.array(self.fresh, "<u8"), []
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            self.signs = np.concatenate([self.signs, bits.astype(np.int8) * 2 - 1])
        return self.signs


_signs = _Signs()


def simhashes(lines: list[str]) -> np.ndarray:
    """Signed 64-bit SimHashes of normal forms over their distinct words; a bit is set if more words have it than lack it. Repeats don't count: else the few commonest words of a language would settle the bits of every long line."""
    global _signs
    if not lines:
        return np.empty(0, np.int64)
    if len(_signs) > 1 << 16:  # bounded memory
        _signs = _Signs()
    split = [set(line.split(" ")) for line in lines]
    codes = np.fromiter(map(_signs.__getitem__, chain.from_iterable(split)), np.int64)
    signs = _signs.table()
    ends = np.cumsum([len(words) for words in split])
    starts = np.concatenate([[0], ends[:-1]])
    found, first = [], 0
    while first < len(lines):  # some 16384 words at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + 16384)))
        own = signs[codes[starts[first] : ends[last - 1]]]
        sums = np.add.reduceat(own, starts[first:last] - starts[first], axis=0, dtype=np.int16 if len(own) < 1 << 15 else np.int32)
        found.append(np.packbits(sums > 0, axis=1, bitorder="little").view("<i8").ravel())
        first = last
    return np.concatenate(found).astype(np.int64)


def _simhash_signs(lines: list[str]) -> Signs:
    """A SimHash for each line, without keys: blocks of its bits serve as keys."""
    return Signs(np.arange(len(lines)), simhashes(lines), np.zeros(len(lines), np.int64), np.empty(0, np.int64))


_LISTS = {"line": pa.int32(), "form": pa.int64(), "fresh": pa.int64(), "size": pa.int32(), "words": pa.string(), "owner": pa.int64(), "sketch": pa.int64(), "count": pa.int32()}
_STRUCT = pa.struct([*((name, pa.list_(kind)) for name, kind in _LISTS.items()), ("keys", pa.binary())])


def _signed_part(texts: list[str | None], min_words: int, sign, seen: set[int]) -> pa.StructArray:
    """Lists for some texts: their lines' numbers and form digests; digests, lengths and words of forms not seen before; and those forms' signs."""
    own = [forms(text, min_words) for text in texts]
    flat = [form for found in own for _, form in found]
    numbers, ends = digests(flat), np.cumsum([len(found) for found in own])
    fresh = []
    for i, n in enumerate(numbers.tolist()):
        if n not in seen:
            seen.add(n)
            fresh.append(i)
    words, fresh = [flat[i] for i in fresh], np.array(fresh, np.int64)
    signs = sign(words)
    order = np.argsort(signs.line, kind="stable")
    stops = np.cumsum(signs.sizes)
    starts = stops - signs.sizes
    keys = signs.keys[np.repeat(starts[order] - np.cumsum(signs.sizes[order]) + signs.sizes[order], signs.sizes[order]) + np.arange(len(signs.keys))]
    text_of = np.searchsorted(ends, fresh, "right")
    edges = lambda of: np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
    lines, news, entries = np.concatenate([[0], ends]).astype(np.int32), edges(text_of), edges(text_of[signs.line])
    values = {
        "line": (lines, np.array([i for found in own for i, _ in found], np.int32)), "form": (lines, numbers), "fresh": (news, numbers[fresh]),
        "size": (news, np.array([len(w) for w in words], np.int32)), "words": (news, words), "owner": (entries, numbers[fresh[signs.line[order]]]), "sketch": (entries, signs.sketch[order]), "count": (entries, signs.sizes[order].astype(np.int32)),
    }
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, _LISTS[name])) for name, (at, x) in values.items()]
    raw = keys.astype("<i8").tobytes()
    at = 8 * edges(text_of[signs.line[np.repeat(order, signs.sizes[order])]])
    blobs = pa.array([raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary())
    return pa.StructArray.from_arrays([*lists, blobs], fields=list(_STRUCT))


def signed_lines(docs: DataFrame, text_col: str, min_words: int = MIN_WORDS, wide: bool = False, keep_text: bool = True) -> DataFrame:
    """docs (less the text, if it isn't kept), written once, with __row (a number) and __lines: arrays of line numbers and form digests, and of signs of the forms that a task meets for the first time. Texts are taken apart here only."""
    sign = signs_of if wide else _simhash_signs

    def of(batches):
        seen: set[int] = set()
        for texts in batches:
            parts = []
            for at in range(0, len(texts), 256):
                parts.append(_signed_part(texts.slice(at, 256).to_pylist(), min_words, sign, seen))
                if len(seen) > 1 << 18:  # bounded memory; a form that comes again is signed again
                    seen.clear()
            yield pa.concat_arrays(parts) if parts else pa.array([], _STRUCT)

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    schema = "line array<int>, form array<long>, fresh array<long>, size array<int>, words array<string>, owner array<long>, sketch array<long>, count array<int>, keys binary"
    signed = docs.withColumns({"__lines": F.arrow_udf(of, schema)(F.col(text_col)), "__row": F.monotonically_increasing_id()})
    return materialise(signed if keep_text else signed.drop(text_col), "signed-lines")


def _asked_forms(signed: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (form, words) of the asked forms, one each. A sieve of bounded size keeps most other forms from being shuffled, a join keeps out the rest."""
    place = F.pmod("form", F.lit(SIEVE)) + 1
    maps = asked.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    whole = bytearray(SIEVE // 8)
    for r in maps.collect():  # SIEVE bits in all
        at = (r.part - 1) * len(r.bits)
        whole[at : at + len(r.bits)] = r.bits
    sieve = signed.sparkSession.sparkContext.broadcast(bytes(whole))

    def pick(batches):
        inside = np.unpackbits(np.frombuffer(sieve.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            numbers, words = batch.column(0).flatten(), batch.column(1).flatten()
            hits = pa.array(np.flatnonzero(inside[numbers.to_numpy() % SIEVE]))
            yield pa.RecordBatch.from_arrays([numbers.take(hits), words.take(hits)], names=["form", "words"])

    picked = signed.where(F.size("__lines.fresh") > 0).select("__lines.fresh", "__lines.words").mapInArrow(pick, "form long, words string")
    return picked.join(asked, "form", "left_semi").groupBy("form").agg(F.first("words").alias("words"))


def _similar(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of forms with that edit similarity."""

    def verify(batches):
        def judged(rows: pa.Table) -> list[pa.RecordBatch]:
            left, right = rows["wa"].to_pylist(), rows["wb"].to_pylist()
            near = all_similar(left, right, [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(left, right)])
            return rows.select(["a", "b"]).filter(pa.array(near)).combine_chunks().to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > 64 << 20:
                yield from judged(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from judged(pa.Table.from_batches(held))

    left, right = words.select(F.col("form").alias("a"), F.col("words").alias("wa")), words.select(F.col("form").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long")


def choices(blocks: int, bits: int) -> list[tuple[int, ...]]:
    """Sets of blocks such that, whatever ``bits`` blocks differ, some set has none of them.

    In general all sets of blocks - bits. For eight blocks and three bits the 14 planes of the affine space of three binary
    dimensions do: three points lie in one plane, and the plane beside it has none of them. Each has half of the bits.
    """
    if (blocks, bits) == (8, 3):
        planes = [tuple(x for x in range(8) if (x & a).bit_count() % 2 == side) for a in range(1, 8) for side in (0, 1)]
        return planes
    return list(combinations(range(blocks), blocks - bits))


def _plane_keys(signed: DataFrame, bits: int, blocks: int) -> DataFrame:
    """Rows (form, size, sketch, key). Differing bits touch at most that many of the blocks, so two near SimHashes agree in some choice of the others; each choice is a key."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [F.shiftrightunsigned("sketch", a).bitwiseAND((1 << b - a) - 1) for a, b in zip(edges, edges[1:])]
    keys = []
    for tag, chosen in enumerate(choices(blocks, bits)):
        key = F.lit(tag).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(pieces[i])
        keys.append(key)
    signs = signed.select(F.explode(F.arrays_zip("__lines.fresh", "__lines.size", "__lines.sketch")).alias("s"))
    signs = signs.select(F.col("s.fresh").alias("form"), F.col("s.size").alias("size"), F.col("s.sketch").alias("sketch"))
    return _shared(signs.withColumn("key", F.explode(F.array(*keys))))


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows (form, key, ...) whose key another form has too, one each."""
    own = Window.partitionBy("key")
    crowded = keyed.withColumns({"low": F.min("form").over(own), "high": F.max("form").over(own)}).where("low < high").drop("low", "high")
    return crowded.dropDuplicates(["key", "form"])


def _packed(kind: int, found: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, kind, found) of a matrix of longs: its rows, dealt by their first column, a hash, to that many parts, as bytes."""
    part = (found[:, 0].view(np.uint64) >> np.uint64(2)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    found, part = found[order], part[order]
    starts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))) if len(part) else np.empty(0, np.int64)
    blobs = [found[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(found)])]
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "found"])


_PACKED = "part long, kind int, found binary"


def _dealt(frame: DataFrame, kind: int, rows, parts: int) -> DataFrame:
    """What rows() makes of batches, a matrix each, packed."""

    def deal(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                yield _packed(kind, rows(batch.slice(at, 2048)), parts)

    return frame.mapInArrow(deal, _PACKED)


def _unpacked(blobs: list[bytes], columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, columns)


def _shared_pairs(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (key, form, told): those not told whose key another form has too, and what is to be kept of all: one row a key, told if the key is shared."""
    held = held[np.lexsort((held[:, 2], held[:, 1], held[:, 0]))]
    same = np.diff(held[:, 0]) == 0
    repeated = np.append(False, same & (np.diff(held[:, 1]) == 0))  # a told row comes last: what is new of its form is told once more
    held = held[~repeated | (held[:, 2] == 1)]
    starts = np.flatnonzero(np.append(True, np.diff(held[:, 0]) != 0)) if len(held) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(held)))
    if not len(held):
        return held, held
    told = np.maximum.reduceat(held[:, 2], starts) == 1
    shared = told | (np.minimum.reduceat(held[:, 1], starts) < np.maximum.reduceat(held[:, 1], starts))
    kept = held[starts].copy()
    kept[:, 2] = shared
    return held[np.repeat(shared, sizes) & (held[:, 2] == 0)], kept


def _wide_keys(signed: DataFrame) -> DataFrame:
    """Rows (form, size, sketch, key) of the forms' keys that another form has too. Keys are dealt out in blocks and compared with their like in arrays; what is left is dealt by form and meets the forms' sketches and sizes, dealt in the same way."""
    parts = 8 * int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keys_of(batch):
        owner, count = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
        keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8")
        return np.stack([keys, np.repeat(owner, count)], axis=1)

    def shared(batches):
        kept, held, size = {}, {}, 0
        for batch in chain(batches, [None]):
            if batch is not None:
                for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.setdefault(part, []).append(found)
                size += batch.nbytes
            if batch is None or size > max(64 << 20, sum(x.nbytes for x in kept.values())):  # however many forms a key has, one row of it is kept
                for part, blobs in held.items():
                    found = _unpacked(blobs, 2)
                    found = np.column_stack([found, np.zeros(len(found), np.int64)])
                    told, left = _shared_pairs(np.concatenate([kept[part], found]) if part in kept else found)
                    if batch is not None:
                        kept[part] = left
                    yield _packed(1, told[:, [1, 0]], parts)
                held, size = {}, 0

    def signs_in(batch):
        fresh, size, owner, sketch = (batch.column(i).flatten().to_numpy() for i in range(4))
        order = np.argsort(fresh, kind="stable")
        return np.column_stack([owner, sketch, size[order[np.searchsorted(fresh, owner, sorter=order)]] if len(owner) else owner])

    def met(batches):
        blobs = {1: [], 2: []}
        for batch in batches:
            for kind, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blobs[kind].append(found)
        keys, signs = _unpacked(blobs[1], 2), _unpacked(blobs[2], 3)
        if len(keys):
            names, at = np.unique(signs[:, 0], return_inverse=True)
            sketches, sizes = np.zeros((len(names), 4), np.int64), np.zeros(len(names), np.int32)
            sketches[at, signs[:, 1] & 3], sizes[at] = signs[:, 1], signs[:, 2]
            for own in np.array_split(keys, len(keys) // (1 << 16) + 1):
                of = np.searchsorted(names, own[:, 0])
                columns = own[:, 0], sizes[of], sketches[of, own[:, 1] & 3], own[:, 1]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["form", "size", "sketch", "key"])

    some = signed.where(F.length("__lines.keys") > 0)
    keys = _dealt(some.select("__lines.owner", "__lines.count", "__lines.keys"), 0, keys_of, parts).repartition("part").select("part", "found").mapInArrow(shared, _PACKED)
    both = keys.unionByName(_dealt(some.select("__lines.fresh", "__lines.size", "__lines.owner", "__lines.sketch"), 2, signs_in, parts))
    return both.repartition("part").select("kind", "found").mapInArrow(met, "form long, size int, sketch long, key long")


def _near_forms(signed: DataFrame, keyed: DataFrame, near: Callable[[Column, Column], Column], similarity: float) -> DataFrame:
    """Rows (form, group) of the forms that are linked to others. keyed: form, size, sketch, key; near tells from two sketches of one kind whether a pair may be.

    Each form is first compared with one form of each of its keys, drawn by a hash of both, so that a large group of near
    copies soon hangs together. While keys hold many pairs whose sketches agree and that aren't in one group yet, each form is compared with
    another form, drawn anew, of each of its keys: most of what belongs together then does. Of the other pairs, only those
    whose ends are not yet in one group are left, each once: at the least key that its ends share in the first kind of keys
    (their last two bits) whose sketches let it through.
    """
    keyed = materialise(keyed, "crowded-keys")
    release(signed.sparkSession)
    side = lambda frame, s: frame.withColumnsRenamed({c: f"{c}_{s}" for c in ("form", "size", "sketch", "group", "keys", "kind0", "kind1", "kind2") if c in frame.columns})
    may = (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9) & near(F.col("sketch_a"), F.col("sketch_b"))
    pair = [F.least("form_a", "form_b").alias("a"), F.greatest("form_a", "form_b").alias("b")]
    left, done, rounds = keyed.withColumn("group", F.col("form")), [keyed], 0
    stars = links = None
    while True:
        columns = ["form", "size", "sketch", "group"]
        draw = F.xxhash64("form", "key", *[F.lit(rounds)] * (rounds > 0))
        drawn = left.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), *columns)).alias("d")).select("key", *[f"d.{c}" for c in columns])
        new = side(left, "a").join(side(drawn, "b"), "key").where((F.col("group_a") != F.col("group_b")) & may).select(*pair).distinct()
        new = materialise(new if stars is None else new.join(stars, ["a", "b"], "left_anti"), "star-pairs")
        linked = materialise(_similar(new, _words_of(signed, new), similarity), "links")
        done += [new, linked]
        stars = new if stars is None else stars.unionByName(new)
        groups = connected_components(linked if links is None else links.unionByName(linked))
        links = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        grouped = left.drop("group").join(groups, left["form"] == groups["node"], "left").select("key", "form", "size", "sketch", F.coalesce("component", "form").alias("group"))
        mixed = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
        left = materialise(grouped.join(mixed, "key", "left_semi"), "mixed-keys")
        done.append(left)
        release(signed.sparkSession)
        rounds += 1
        if rounds == ROUNDS or not _crowded(left, may):
            break
    kinds = left.repartition("form").groupBy("form", "size", "group", "sketch", F.col("key").bitwiseAND(3).alias("kind")).agg(F.collect_set("key").alias("keys"))
    of_kind = [F.max(F.when(F.col("kind") == j, F.struct("sketch", "keys"))).alias(f"kind{j}") for j in range(3)]
    kinds = kinds.groupBy("form", "size", "group").agg(F.collect_list(F.struct("kind", "sketch", "keys")).alias("kinds"), *of_kind).withColumn("k", F.explode("kinds"))
    own = kinds.select("form", "size", "group", "k.sketch", "k.keys", *[F.when(F.col("k.kind") > j, F.col(f"kind{j}")).alias(f"kind{j}") for j in range(3)])
    own = own.withColumn("key", F.explode("keys"))
    one, other = side(own, "a"), side(own, "b")
    met = [near(F.col(f"kind{j}_a.sketch"), F.col(f"kind{j}_b.sketch")) & F.arrays_overlap(f"kind{j}_a.keys", f"kind{j}_b.keys") for j in range(3)]  # in an earlier kind
    apart = (one["key"] == other["key"]) & (F.col("form_a") < F.col("form_b")) & (F.col("group_a") != F.col("group_b")) & may
    apart = apart & (one["key"] == F.array_min(F.array_intersect("keys_a", "keys_b"))) & ~F.coalesce(met[0], F.lit(False)) & ~F.coalesce(met[1], F.lit(False)) & ~F.coalesce(met[2], F.lit(False))
    rest = one.join(other, apart).select(*pair).distinct().join(stars, ["a", "b"], "left_anti")
    rest = materialise(rest, "rest-pairs")
    done.append(rest)
    if not rest.isEmpty():
        linked = materialise(_similar(rest, _words_of(signed, rest), similarity), "links")  # one task, one Python worker
        done.append(linked)
        groups = connected_components(links.unionByName(linked))
    found = materialise(groups.select(F.col("node").alias("form"), F.col("component").alias("group")), "near-forms")
    for table_ in done:
        discard(table_)
    release(signed.sparkSession)
    return found


def _crowded(left: DataFrame, may: Column) -> bool:
    """Whether the keys hold many more pairs left to compare than forms: pairs of forms of different groups, of those keys where two groups' drawn forms may be one."""
    member = F.struct(F.xxhash64("key", "form").alias("draw"), "size", "sketch")
    groups = left.groupBy("key", "group").agg(F.count("*").alias("n"), F.min(member).alias("m"))
    own = F.struct(F.xxhash64("key", "group").alias("draw"), "m.size", "m.sketch")
    keys = groups.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.min(own).alias("a"), F.max(own).alias("b"))
    keys = keys.select("n", "own", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("size", "sketch")])
    pairs, forms = keys.agg(F.sum(F.when(may, (F.col("n") * F.col("n") - F.col("own")) / 2).otherwise(0)), F.sum("n")).first()
    return pairs is not None and pairs > CROWDED * forms


def _words_of(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    asked = pairs.select(F.explode(F.array("a", "b")).alias("form")).distinct()
    return materialise(_asked_forms(signed, asked), "forms")


def _judged(signed: DataFrame, id_col: str, bits: int, blocks: int, similarity: float, wide: bool = False) -> DataFrame:
    lines = signed.select(F.col(id_col).alias("id"), F.col("__row").alias("row"), F.explode(F.arrays_zip("__lines.line", "__lines.form")).alias("l"))
    lines = lines.select("id", "row", F.col("l.line").alias("line"), F.col("l.form").alias("form"))
    place = F.struct("id", "row", "line")
    if wide:
        near = _near_forms(signed, _wide_keys(signed), agree, similarity)
    else:
        near = _near_forms(signed, _plane_keys(signed, bits, blocks), lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= bits, similarity)
    near = near.withColumnRenamed("form", "near")
    firsts = lines.groupBy("form").agg(F.min(place).alias("place"))
    grouped = materialise(firsts.join(near, firsts["form"] == near["near"]).select("near", "group", "place"), "near-places")
    keepers = grouped.select("near", "group").join(grouped.groupBy("group").agg(F.min("place").alias("keeper")), "group")
    named = firsts.join(keepers, firsts["form"] == keepers["near"], "left")
    named = named.select("form", F.coalesce("group", "form").alias("group"), F.when(F.col("near").isNull(), F.col("place")).otherwise(F.col("keeper")).alias("keeper"))
    return lines.join(named, "form").select("id", "row", "line", "group", place.eqNullSafe(F.col("keeper")).alias("kept"))


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, bits: int = BITS, blocks: int = BLOCKS, similarity: float = SIMILARITY, wide: bool = False) -> DataFrame:
    """A row for each line with at least min_words words (1: every line with a letter or digit): id, row (a number of docs' row), line (from 0), group, kept.

    Lines with fewer words, null and empty texts have no rows here and are left alone. Repeated rows are further occurrences;
    null ids sort first. Forms are known by 64-bit numbers. Only the two named columns are read. An empty table gives no rows.
    wide: candidates come from line_keys, without a limit of bits.
    """
    signed = signed_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", min_words, wide, keep_text=False)
    return _judged(signed, "id", bits, blocks, similarity, wide).withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, bits: int = BITS, blocks: int = BLOCKS, similarity: float = SIMILARITY, wide: bool = False, most_lost: float = 1.0) -> DataFrame:
    """docs with the lines that are not kept taken out of the text; documents left without a word go, and so do those that lose more than the share ``most_lost`` of their characters, which are copies but for a few lines.

    Columns are those of docs, n_chars follows the text. Null and empty texts and lines without a letter or digit stay as
    they are. Of repeated rows the first as docs is written keeps the text; null ids come first. An empty table gives no rows.
    """
    signed = signed_lines(docs, text_col, min_words, wide)
    verdicts = _judged(signed, id_col, bits, blocks, similarity, wide)
    gone = verdicts.where("not kept").groupBy(F.col("row").alias("__row")).agg(F.collect_set("line").alias("__gone"))

    def left(text: pa.Array, gone: pa.Array) -> pa.Array:
        found = []
        for t, out in zip(text.to_pylist(), gone.to_pylist()):
            if out:
                out = set(out)
                t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in out)
            found.append(t)
        return pa.array(found, pa.string())

    left.__annotations__ = {"text": pa.Array, "gone": pa.Array, "return": pa.Array}
    out = signed.drop("__lines").join(gone, "__row", "left").withColumn("__left", F.arrow_udf(left, "string").asNondeterministic()(F.col(text_col), F.col("__gone")))
    lost = F.length(text_col) - F.length("__left") > most_lost * F.length(text_col)
    out = out.where(F.col("__gone").isNull() | F.col("__left").rlike("[^\\x20\\x09-\\x0D]") & ~lost).withColumn(text_col, F.col("__left"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_lines(table(spark, sf_dir, "documents"), min_words=1, wide=True).select("doc_id", "line", F.col("group").alias("group_id"), "kept")
