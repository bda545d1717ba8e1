"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import unicodedata
from bisect import bisect_left, insort
from functools import cache
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import materialise, table

MAX_TOKENS, END_ID = 4096, 1
#: Distinct words, and parts of words, that a Python worker remembers; of words, twice as many for a while.
REMEMBERED = 1 << 17


class WordTokenizer:
    """Ids of texts under word_bpe_49k.json: its tokens never span white space, so each distinct word is encoded once and remembered.

    A word is put into NFC and lower case and cut by the tokenizer's own pattern; the model then merges each part. Words
    for which that could differ (special tokens, capital sigma) go through the whole tokenizer.
    """

    #: Fixed value: the pattern in the tokenizer's file.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.words, self.older, self.parts = self.tokenizer.model, {}, {}, {}
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        alphabet = sorted(ByteLevel.alphabet())
        plain = {ord(c) for c in alphabet if ord(c) < 256}
        self.alphabet = dict(zip((b for b in range(256) if b not in plain), range(256, 512)))

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.alphabet))
            found = self.parts[part] = np.array([t.id for t in tokens], "<u4").tobytes()
        return found

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        if "<|" in word or "\u03a3" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        word = word.lower()
        if word.isalpha():
            return self._part(word)
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join(map(self._part, self.PARTS.findall(word)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id behind them."""
        end = np.array([END_ID], "<u4").tobytes()
        found = []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()
            if len(self.words) > REMEMBERED:
                self.words, self.older = {}, self.words
            for w in set(words).difference(self.words):
                self.words[w] = self.older.get(w) or self._word(w)
            found.append(b"".join([*map(self.words.__getitem__, words), end]))
        return found


@cache
def tokenizer_of(path: str | None) -> WordTokenizer:
    """One per Python worker, so that words stay known from task to task."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, and ids (binary) if asked for. Only texts of more than max_tokens ids are cut."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        tokenizer = tokenizer_of(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids, piece, start, length, crc, raw = [], [], [], [], [], []
                for doc_id, encoded in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist())):
                    for i, b in enumerate(range(0, len(encoded), 4 * max_tokens)):
                        own = encoded[b : b + 4 * max_tokens]
                        ids.append(doc_id), piece.append(i), start.append(b // 4), length.append(len(own) // 4), crc.append(crc32(own))
                        if keep_ids:
                            raw.append(own)
                columns = [pa.array(ids, part.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, order, assigned: np.ndarray, room: list[tuple[int, int]], next_bin: int, capacity: int) -> int:
    """Put the items of order, one by one, into the bin with the least room that takes them. room: (space left, bin), sorted. Returns the next unused bin."""
    for i in order:
        size = int(lengths[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b, next_bin = capacity, next_bin, next_bin + 1
        assigned[i] = b
        if left > size:
            insort(room, (left - size, b))
    return next_bin


def pack(lengths: np.ndarray, order, capacity: int) -> np.ndarray:
    assigned = np.empty(len(lengths), np.int32)
    best_fit(lengths, order, assigned, [], 0, capacity)
    return assigned


def fitness(lengths: np.ndarray, assigned: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins, and less the mean square of their fill: less is better."""
    fill = np.bincount(assigned, weights=lengths)
    return len(fill), -float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def crossover(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """taker with whole well-filled bins of giver: bins of taker that held one of their items go, and what else they held is put back by best fit."""
    fill = np.bincount(giver, weights=lengths)
    good = np.flatnonzero(fill >= max(0.97 * capacity, np.median(fill)))
    if not len(good):
        good = np.array([fill.argmax()])
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, size=rng.integers(1, max(2, len(good) // 4 + 1)), replace=False)] = True
    injected = chosen[giver]
    broken = np.zeros(taker.max() + 1, bool)
    broken[taker[injected]] = True
    displaced = np.flatnonzero(broken[taker] & ~injected)
    child = np.full(len(lengths), -1, np.int32)
    stays = ~broken[taker]
    child[stays] = np.unique(taker[stays], return_inverse=True)[1]
    bins = int(child.max()) + 1
    child[injected] = np.unique(giver[injected], return_inverse=True)[1] + bins
    bins += int(chosen.sum())
    fill = np.bincount(child[child >= 0], weights=lengths[child >= 0], minlength=bins).astype(np.int64)
    room = sorted((int(capacity - f), b) for b, f in enumerate(fill.tolist()) if f < capacity)
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    best_fit(lengths, displaced.tolist(), child, room, bins, capacity)
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, size: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population, best first, after some generations. Best-fit decreasing and noisy best fits fill it up to size; it ends early at the least number of bins that can be."""
    least = ceil(int(lengths.sum()) / capacity)
    while len(population) < size:
        noise = lengths * (1 + 0.15 * rng.standard_normal(len(lengths))) if population else lengths
        population.append(pack(lengths, np.argsort(-noise, kind="stable").tolist(), capacity))
        if fitness(lengths, population[-1], capacity)[0] <= least:
            break
    scored = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for _ in range(generations):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        children = []
        for _ in range(size):
            a, b = rng.choice(len(scored), 2, replace=False, p=_weights(len(scored)))
            child = crossover(lengths, scored[a][2], scored[b][2], capacity, rng)
            children.append((fitness(lengths, child, capacity), len(scored) + len(children), child))
        pool = sorted(scored + children, key=lambda x: x[:2])
        scored = [(f, i, p) for i, (f, _, p) in enumerate({x[0]: x for x in reversed(pool)}.values())]
        scored = sorted(scored, key=lambda x: x[0])[:size]
    return [p for _, _, p in scored]


def _weights(n: int) -> np.ndarray:
    rank = np.arange(n, 0, -1, dtype=float)
    return rank / rank.sum()


def pack_pieces(pieces: DataFrame, capacity: int = MAX_TOKENS, block_items: int = 8192, islands: int = 2, population: int = 6, generations: int = 5, epochs: int = 2, seed: int = 42) -> DataFrame:
    """pieces (column length) with sequence_id and offset added.

    Full pieces are sequences by themselves. The rest is dealt by a hash of a row's number, not of its key, into blocks of
    about ``block_items``. Each block evolves on ``islands`` tasks; after an epoch an island's elite (its two best packings)
    also goes to the next island. The block's best packing wins; it's never worse than best-fit decreasing. A piece has at
    least one token. Repeated rows and ids are items of their own; an empty table gives no rows.
    """
    rows = materialise(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    small = rows.where(F.col("length") < capacity)
    blocks = max(1, ceil(small.count() / block_items))
    small = small.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(blocks)))
    names = ["block", "island", "lengths", "assigned"]
    schema = "block long, island int, lengths binary, assigned binary"

    def rng(block: int, island: int, epoch: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64([seed, block, island, epoch]))

    def elites(block: int, island: int, lengths: np.ndarray, found: list[np.ndarray]) -> pa.Table:
        best = found[:2]
        return pa.table([pa.array([block] * len(best), pa.int64()), pa.array([island] * len(best), pa.int32()), pa.array([lengths.astype("<i4").tobytes()] * len(best), pa.binary()), pa.array([b.astype("<i4").tobytes() for b in best], pa.binary())], names=names)

    def first(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        block, island = key[0].as_py(), key[1].as_py()
        lengths = np.sort(group["length"].to_numpy())[::-1].astype(np.int64)
        return elites(block, island, lengths, evolve(lengths, [], capacity, population, generations, rng(block, island, 0)))

    def later(epoch: int):
        def go(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            block, island = key[0].as_py(), key[1].as_py()
            lengths = np.frombuffer(group["lengths"][0].as_py(), "<i4").astype(np.int64)
            own = sorted({b.as_py() for b in group["assigned"]})
            return elites(block, island, lengths, evolve(lengths, [np.frombuffer(b, "<i4") for b in own], capacity, population, generations, rng(block, island, epoch)))

        return go

    state = small.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "length").groupBy("block", "island").applyInArrow(first, schema)
    for epoch in range(1, epochs):
        routes = F.explode(F.array("island", ((F.col("island") + 1) % islands).cast("int")))
        state = state.withColumn("to", routes).select("block", F.col("to").alias("island"), "lengths", "assigned").groupBy("block", "island").applyInArrow(later(epoch), schema)

    def place(key: tuple[pa.Scalar, ...], items: pa.Table, packed: pa.Table) -> pa.Table:
        items = items.sort_by([("length", "descending"), ("uid", "ascending")])
        lengths = items["length"].to_numpy()
        assigned = min((np.frombuffer(b.as_py(), "<i4") for b in packed["assigned"]), key=lambda a: (*fitness(lengths, a, capacity), a.tobytes()))
        order = np.argsort(assigned, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        starts = np.concatenate([[True], assigned[order][1:] != assigned[order][:-1]])
        base = before[starts][np.cumsum(starts) - 1]
        offset = np.empty(len(lengths), np.int64)
        offset[order] = before - base
        out = items.drop_columns(["block"])
        return out.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 24) + assigned.astype(np.int64))).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long"
    packed = small.groupBy("block").cogroup(state.select("block", "assigned").groupBy("block")).applyInArrow(place, fields)
    full = rows.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full).drop("uid")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer_path: str | None = None, keep_ids: bool = False, **options) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most max_tokens.

    Null and empty texts are one piece with the end id alone. Only the id and text columns are read; null and repeated ids
    are kept as they are. No cap and no sample: every document's every id is in one piece.
    """
    return pack_pieces(token_pieces(docs, id_col, text_col, max_tokens, tokenizer_path, keep_ids), max_tokens, **options)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
