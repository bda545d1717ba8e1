"""Hidden Markov language model: Baum-Welch counts from all partitions, scaled forward likelihoods of whole texts.

Tokens are the words of the text, A-Z in lower case, and one end. The commonest training words and the end are symbols of
their own; each other word belongs to one of ``RARE`` symbols by its crc32, so the model has a bounded size however large
the vocabulary grows. A state emits a symbol. Under a rare symbol a word that stands c times in the training texts has
(c - D) / C, where C counts all tokens with that symbol; what the discount D leaves is for the unknown words with that
symbol, together. The likelihood of a text is thus a product of exact conditional probabilities.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import id_remainder, materialise, table

STATES, FREQUENT, RARE, SEED = 8, 56_000, 8192, 42
#: Baum-Welch passes over all training texts; parts that the texts are in for the stepwise pass before; tokens of a training window.
PASSES, PARTS, WINDOW = 2, 16, 512


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass(frozen=True)
class Model:
    """start: state probabilities of a text's first token; inner: of a later training window's; move: of transitions; emit: symbols by states."""

    start: np.ndarray
    inner: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _time_major(sequences: list[np.ndarray]):
    """Sequences by falling length: (their order, symbols joined, where each begins, and how many are still alive at each step)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order]) if len(sequences) else np.empty(0, np.uint16)
    sorted_lengths = lengths[order]
    begin = np.cumsum(sorted_lengths) - sorted_lengths
    alive = np.searchsorted(-sorted_lengths, -np.arange(sorted_lengths[0] if len(order) else 0), side="left")
    return order, flat, begin, alive


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence (one token or more), by the forward recursion scaled at every step."""
    order, flat, begin, alive = _time_major(sequences)
    total = np.zeros(len(order))
    alpha = None
    for t, n in enumerate(alive.tolist()):
        seen = model.emit[flat[begin[:n] + t]]
        alpha = seen * model.start if alpha is None else (alpha[:n] @ model.move) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


class Counts:
    """Expected counts of one or many texts under a model."""

    def __init__(self, states: int, symbols: int):
        self.start, self.inner, self.move, self.emit = np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))

    def add(self, model: Model, windows: list[np.ndarray], first: np.ndarray) -> None:
        """Forward and backward over windows; first tells which of them begin a text."""
        order, flat, begin, alive = _time_major(windows)
        first = first[order]
        states, alphas, scales, emitted = len(model.start), [], [], []
        for t, n in enumerate(alive.tolist()):
            seen = model.emit[flat[begin[:n] + t]]
            alpha = seen * np.where(first[:, None], model.start, model.inner) if t == 0 else (alphas[-1][:n] @ model.move) * seen
            scale = alpha.sum(axis=1)
            alphas.append(alpha / scale[:, None]), scales.append(scale), emitted.append(seen)
        gammas = np.empty((len(flat), states))
        beta = np.ones((alive[-1], states))
        for t in range(len(alive) - 1, -1, -1):
            n = int(alive[t])
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), states))])
            gammas[begin[:n] + t] = alphas[t] * beta
            if t:
                onward = emitted[t] * beta / scales[t][:, None]
                self.move += model.move * (alphas[t - 1][:n].T @ onward)
                beta = onward @ model.move.T
        self.start += gammas[begin[first]].sum(axis=0)
        self.inner += gammas[begin[~first]].sum(axis=0)
        for k in range(states):
            self.emit[:, k] += np.bincount(flat, gammas[:, k], len(self.emit))

    def blended(self, other: Counts, rate: float) -> Counts:
        """(1 - rate) of these counts and rate of the others."""
        out = Counts(len(self.start), len(self.emit))
        for name in ("start", "inner", "move", "emit"):
            setattr(out, name, (1 - rate) * getattr(self, name) + rate * getattr(other, name))
        return out

    def model(self, unigram: np.ndarray) -> Model:
        rows = lambda m: (m + 0.1) / (m + 0.1).sum(axis=-1, keepdims=True)
        types = 1 + np.minimum(self.emit, 1).sum(axis=0)  # Witten and Bell: as much weight for the unigram as a state has kinds of symbols
        emit = (self.emit + types * unigram[:, None]) / (self.emit.sum(axis=0) + types)
        return Model(rows(self.start), rows(self.inner), rows(self.move), emit)


def windows_of(codes: np.ndarray) -> list[np.ndarray]:
    return [codes[i : i + WINDOW] for i in range(0, len(codes), WINDOW)]


def expected(model: Model, texts) -> Counts:
    """Counts of all windows of texts (symbol arrays), some thousand windows at a time."""
    counts, own, first, tokens = Counts(len(model.start), len(model.emit)), [], [], 0
    for codes in texts:
        parts = windows_of(codes)
        own += parts
        first += [True] + [False] * (len(parts) - 1)
        tokens += len(codes)
        if tokens > 1 << 19:
            counts.add(model, own, np.array(first))
            own, first, tokens = [], [], 0
    if own:
        counts.add(model, own, np.array(first))
    return counts


def first_model(unigram: np.ndarray, states: int, seed: int) -> Model:
    """States that tend to stay, told apart by noise on the unigram."""
    rng = np.random.Generator(np.random.PCG64(seed))
    even = np.full(states, 1 / states)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    emit = unigram[:, None] * np.exp(0.5 * rng.standard_normal((len(unigram), states)))
    return Model(even, even, move, emit / emit.sum(axis=0))


def train(training: DataFrame, unigram: np.ndarray, states: int, passes: int, seed: int) -> Model:
    """Stepwise Baum-Welch: a first pass goes through all texts (columns codes, part) part by part, and each part's counts, which stand for the whole, move the model a little less than those before; then come full passes. Every text counts alike, whole, in windows."""
    model, total = first_model(unigram, states, seed), None
    for part in range(PARTS):
        own = _tallied(training.where(F.col("part") == part), model)
        own = own.blended(Counts(states, len(unigram)), 1 - PARTS)  # PARTS times as much
        total = own if total is None else total.blended(own, (part + 2) ** -0.7)
        model = total.model(unigram)
    for _ in range(passes):
        model = _tallied(training, model).model(unigram)
    return model


class Symbols:
    """Words to symbols; with the unigram's log10 for those that have symbols of their own."""

    def __init__(self, frequent: list[bytes], room: int, rare: int):
        """room: symbols that frequent words may have, of which the list may use fewer; rare: symbols of all other words; the end comes last."""
        self.known, self.room, self.rare = {w: i for i, w in enumerate(frequent)}, room, rare

    def of(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """(symbols of all tokens, the words without a symbol of their own)."""
        words, get, rare = words_of(text), self.known.get, []
        codes = [get(w, -1) for w in words]
        if -1 in codes:
            for i, c in enumerate(codes):
                if c < 0:
                    rare.append(words[i])
                    codes[i] = self.room + crc32(words[i]) % self.rare
        return np.array([*codes, self.room + self.rare], np.uint16), rare


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (word, c): how often each word stands in the texts; counted by task first, in tables of bounded size."""

    def count(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > 1 << 19:
                    yield flush()
                    counts.clear()
        yield flush()

    return docs.select(text_col).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2, states: int = STATES, passes: int = PASSES, seed: int = SEED, frequent_words: int = FREQUENT, rare_classes: int = RARE) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of docs.

    Counts of all words, and Baum-Welch counts of all tokens, come from every text outside the held-out fold, whole. Training
    runs over windows of 512 tokens; scores are of whole texts. Null texts
    count as empty: the end alone. Null ids fall into the fold of the empty text. Repeated rows count and are scored each.
    The ``frequent_words`` commonest training words have emissions of their own, all others share those of ``rare_classes``
    classes (65,535 in all at most); each word of a class has its share of the class by a count of its own.
    Without training texts, N and V are 0 and every token is unknown. Only the two named columns are read; an empty table
    gives no rows.
    """
    end = frequent_words + rare_classes
    if rare_classes < 1 or end > 65_535:
        raise ValueError("there must be a rare class, and symbols of 16 bits")
    spark = docs.sparkSession
    held_out = (id_remainder(F.col(id_col), folds) == held_out_fold).alias("held_out")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out)
    vocabulary = materialise(word_counts(rows.where("not held_out"), "text"), "vocabulary")
    texts = rows.where("not held_out").count()
    n_words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + texts, distinct + (texts > 0)
    whole = float(n + v + 1)

    top = vocabulary.orderBy(F.desc("c"), "word").limit(frequent_words).collect()  # bounded: the model's own words
    frequent = [bytes(r.word) for r in top]
    tokens, kinds = np.zeros(rare_classes), np.zeros(rare_classes)  # of each rare symbol
    for r in vocabulary.groupBy(F.pmod(F.crc32("word"), F.lit(rare_classes)).alias("symbol")).agg(F.sum("c"), F.count("*")).collect():
        tokens[r[0]], kinds[r[0]] = r[1], r[2]
    for r in top:
        tokens[crc32(r.word) % rare_classes] -= r.c
        kinds[crc32(r.word) % rare_classes] -= 1
    once, twice = vocabulary.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    unknown_log = np.log10(np.where(kinds > 0, discount * kinds, 1.0))
    unigram = np.zeros(end + 1)
    unigram[: len(top)] = [r.c for r in top]
    unigram[frequent_words:end] = tokens + 1
    unigram[end] = texts + 1
    unigram /= unigram.sum()
    own_log = np.zeros(end + 1)  # log10 p0 of symbols that are one token
    own_log[: len(top)] = np.log10((np.array([r.c for r in top]) + 1) / whole)
    own_log[end] = np.log10((texts + 1) / whole)
    shared_words = spark.sparkContext.broadcast(frequent)

    def encode(batches):
        symbols = Symbols(shared_words.value, frequent_words, rare_classes)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                codes, rare, tokens, known, base = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    own, others = symbols.of(text)
                    codes.append(own.tobytes()), rare.append(b" ".join(others)), tokens.append(len(own))
                    known.append(len(own) - len(others) - (texts == 0)), base.append(float(own_log[own].sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(codes, pa.binary()), pa.array(rare, pa.binary()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64())], names=["id", "held_out", "codes", "rare", "n_tokens", "known", "base"])

    id_type = docs.schema[id_col].dataType.simpleString()
    encoded = rows.mapInArrow(encode, f"id {id_type}, held_out boolean, codes binary, rare binary, n_tokens long, known long, base double")
    # parts by what a row says, not by where it stands: the model doesn't change with the files' layout
    encoded = encoded.withColumns({"row": F.monotonically_increasing_id(), "part": F.pmod(F.xxhash64("id", "codes"), F.lit(PARTS)).cast("int")})
    encoded = materialise(encoded, "encoded", by="part")
    model = train(encoded.where("not held_out"), unigram, states, passes, seed) if texts else first_model(unigram, states, seed)

    # words without symbols of their own: their counts come by a join, however many words there are
    rare = encoded.where(F.length("rare") > 0).select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("word"))
    seen = rare.join(vocabulary.select(F.col("word").cast("string").alias("word"), "c"), "word", "left")
    # a row for each rare symbol: rare_classes rows, whatever the input
    symbols = F.broadcast(spark.createDataFrame(list(enumerate(unknown_log.tolist())), "symbol long, unknown_log double"))
    seen = seen.withColumn("symbol", F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(rare_classes))).join(symbols, "symbol")
    inside = F.coalesce(F.log10(F.col("c") - discount), F.col("unknown_log"))
    looked_up = seen.groupBy("row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(whole))).alias("rare_base"), F.count("c").alias("rare_known"), F.sum(inside).alias("inside"))
    rare_log = np.zeros(end + 1)
    rare_log[frequent_words:end] = np.log10(np.maximum(tokens, 1))
    shared = spark.sparkContext.broadcast((model, rare_log))

    def forward(batches):
        model, rare_log = shared.value
        for rows_, codes in _groups(batches):
            found = log_likelihoods(model, codes) - np.array([rare_log[c].sum() for c in codes])
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.int64()), pa.array(found, pa.float64())], names=["row", "symbols"])

    forwarded = encoded.select("row", "codes").mapInArrow(forward, "row long, symbols double")
    out = encoded.select("row", "id", "held_out", "n_tokens", "known", "base").join(forwarded, "row").join(looked_up, "row", "left")
    rare_base, rare_known, inside = F.coalesce("rare_base", F.lit(0.0)), F.coalesce("rare_known", F.lit(0)), F.coalesce("inside", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + rare_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base).alias("base_score"), (F.col("symbols") + inside).alias("score"),
    )


def _groups(batches, most: int = 1 << 22):
    """(rows, symbol arrays) of some million tokens at a time, so that texts of like length run side by side."""
    rows, codes, tokens = [], [], 0
    for batch in batches:
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows.append(row), codes.append(np.frombuffer(raw, np.uint16))
            tokens += len(codes[-1])
            if tokens > most:
                yield rows, codes
                rows, codes, tokens = [], [], 0
    if rows:
        yield rows, codes


def _tallied(training: DataFrame, model: Model) -> Counts:
    """Expected counts of all texts under a model: a task adds up its texts' counts, and rows of counts are summed by symbol. The sums are bounded by the number of symbols."""
    spark, states, symbols = training.sparkSession, len(model.start), len(model.emit)
    shared = spark.sparkContext.broadcast(model)

    def tally(batches):
        texts = (np.frombuffer(raw, np.uint16) for batch in batches for raw in batch.column(0).to_pylist())
        counts = expected(shared.value, texts)
        used = np.flatnonzero(counts.emit.any(axis=1))
        table = np.concatenate([counts.emit[used], counts.move, counts.start[None], counts.inner[None]])
        symbol = np.concatenate([used, symbols + np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int32()), *(pa.array(table[:, k], pa.float64()) for k in range(states))], names=["symbol"] + [f"s{k}" for k in range(states)])

    fields = [f"s{k}" for k in range(states)]
    sums = training.select("codes").mapInArrow(tally, "symbol int, " + ", ".join(f"{f} double" for f in fields))
    sums = sums.groupBy("symbol").agg(*[F.sum(f).alias(f) for f in fields]).toArrow()
    shared.destroy()
    total = np.zeros((symbols + states + 2, states))
    total[sums["symbol"].to_numpy()] = np.stack([sums[f].to_numpy() for f in fields], axis=1)
    counts = Counts(states, symbols)
    counts.emit, counts.move, counts.start, counts.inner = total[:symbols], total[symbols : symbols + states], total[-2], total[-1]
    return counts


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))
