"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact scaled forward scores.

States emit symbols: the commonest training words (at most ``head``, cut where counts differ), the end of a text, and classes that share the rarer words by
their first and last two bytes. A rarer word costs its class in the HMM and, inside the class, (c + 0.1) /
(N_class + 0.1 * (V_class + 1)), where the remainder is an unknown word's; so the probabilities of all texts sum to one.
Counts of all training words are summed in Spark and joined to the rarer words of the texts; only the
head and the classes, bounded by parameters, are broadcast. Expectation steps are incremental first: the training texts are
dealt into shares (a ``SAMPLE_SHARE`` of them, at least ``sample_texts``), and a step renews the counts of one share and
goes on with those of all shares seen so far, round after round until ``sample_steps`` are done. A round takes every
training text once. ``full_steps`` over all texts follow.

Defined results: null text is empty, i.e. the end alone; a null id falls into the held-out fold (crc of the empty text
is 0); without training rows N is 0 and the smoothed formulas still hold; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm.common import fold, mapped, shared_folder, saved, table, texts_of

HEAD = 32_768
CLASSES = 1024
STATES = 12
SAMPLE_TEXTS = 2000
SAMPLE_SHARE = 1 / 32
SAMPLE_STEPS = 8
FULL_STEPS = 2
SMOOTH = 0.1
COUNTER = 300_000  # distinct words a task holds before it passes them on
CELLS = 300_000  # positions a task steps through together


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[:2] + b"|" + word[-2:]) % CLASSES


def word_classes(words: pa.Array) -> np.ndarray:
    """``word_class`` of every word."""
    ends = pc.binary_join_element_wise(pc.binary_slice(words, 0, 2), pc.binary_slice(words, -2), pa.scalar(b"|", words.type)).dictionary_encode()
    return np.array([zlib.crc32(x) % CLASSES for x in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]


def words_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (as ``tokens`` gives them) of a batch, their positions in it by token, and the bounds of its texts."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().cast(pa.large_binary()).dictionary_encode()
    at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    solid = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # outer spaces leave empty words
    held = solid[at] if len(at) else np.empty(0, bool)
    edges = np.concatenate([[0], np.cumsum(held)])[split.offsets.to_numpy()]
    return words.filter(pa.array(solid)), (np.cumsum(solid) - 1)[at[held]], edges


def word_counts(docs: DataFrame, learn) -> DataFrame:
    """word, cls, c over all training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for text in texts_of(batch):
                held.update(tokens(text))
            if len(held) > COUNTER:
                yield out()
                held.clear()
        yield out()

    counted = docs.filter(learn).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    cls = F.expr(f"cast(crc32(concat(substring(word, 1, 2), cast('|' as binary), substring(word, -2, 2))) % {CLASSES} as int)")  # as ``word_class``
    return saved(counted.select("word", cls.alias("cls"), "c"), "hmm-words")


class Vocabulary:
    """Head words with their counts, totals, and per-class totals of the rarer words."""

    def __init__(self, words: DataFrame, n_texts: int, head: int = HEAD):
        sums = words.agg(F.sum("c"), F.count("*")).first()
        # counts by 1/64 of a power of two: a few thousand rows whatever the corpus, from which the head's least count follows
        steps = words.groupBy(F.floor(F.log2("c") * 64).alias("b")).agg(F.count("*").alias("v"), F.min("c").alias("c"))
        held, self.least = 0, None
        for r in steps.orderBy(F.desc("b")).collect():
            held += r["v"]
            if held > head:
                break
            self.least = r["c"]
        top = sorted((bytes(r["word"]), r["c"]) for r in self._head(words).collect())  # at most ``head`` rows
        self.head = {w: i for i, (w, _) in enumerate(top)}
        self.head_counts = np.array([c for _, c in top], float)
        self.tokens = (sums[0] or 0) + n_texts
        self.distinct = sums[1] + (n_texts > 0)
        self.n_texts = n_texts
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in self.tail(words).groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
            self.class_n[r["cls"]], self.class_v[r["cls"]] = r["n"], r["v"]

    @property
    def end(self) -> int:
        return len(self.head)

    @property
    def symbols(self) -> int:
        return len(self.head) + 1 + CLASSES

    def _head(self, words: DataFrame) -> DataFrame:
        return words.filter(F.lit(False) if self.least is None else F.col("c") >= self.least)

    def tail(self, words: DataFrame) -> DataFrame:
        return words if self.least is None else words.filter(F.col("c") < self.least)

    def class_mass(self) -> np.ndarray:
        return self.class_n + SMOOTH * (self.class_v + 1)

    def unigram(self) -> np.ndarray:
        mass = np.concatenate([self.head_counts + SMOOTH, [self.n_texts + SMOOTH], self.class_mass()])
        return mass / mass.sum()

    def base_divisor(self) -> float:
        return self.tokens + SMOOTH * (self.distinct + 1)


def encoded(docs: DataFrame, vocabulary: Vocabulary, held_out) -> DataFrame:
    """One row per text: _uid, symbols as 16-bit ids, base score and known tokens of the head, its rarer words."""
    known = docs.sparkSession.sparkContext.broadcast((
        vocabulary.head, vocabulary.end, vocabulary.n_texts,
        np.log10((np.append(vocabulary.head_counts, vocabulary.n_texts) + SMOOTH) / vocabulary.base_divisor())))
    state: dict[str, int] = {}
    kind = pa.struct([("word", pa.binary()), ("cls", pa.int32()), ("n", pa.int32())])

    def run(batch: pa.RecordBatch) -> dict:
        head, end, n_texts, logs = known.value
        start = state.get("n", 0) + (TaskContext.get().partitionId() << 36)
        state["n"] = state.get("n", 0) + batch.num_rows
        out: dict[str, list] = {k: [] for k in ("n_tokens", "sym", "head_known", "head_base")}
        words, at, edges = words_of(batch)
        of = np.fromiter((head.get(w, -1) for w in words.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words))
        rare = np.flatnonzero(of < 0)
        classes = np.zeros(len(words), np.int64)
        classes[rare] = word_classes(words.take(pa.array(rare)))
        of[rare] = classes[rare] + end + 1
        symbols = of[at]
        for a, b in zip(edges[:-1], edges[1:]):
            ids = np.append(symbols[a:b], end)
            in_head = ids[ids <= end]
            out["head_known"].append(len(in_head) - (n_texts == 0))
            out["head_base"].append(float(logs[in_head].sum()))
            out["n_tokens"].append(len(ids))
            out["sym"].append(ids.astype("<u2").tobytes())
        # rarer words of every text, each once with its count
        where = np.flatnonzero(symbols > end)
        text = np.searchsorted(edges, where, side="right") - 1
        pairs, counts = np.unique(text * max(1, len(words)) + at[where], return_counts=True)
        text, which = np.divmod(pairs, max(1, len(words)))
        offsets = np.searchsorted(text, np.arange(batch.num_rows + 1))
        tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [words.take(pa.array(which)).cast(pa.binary()), pa.array(classes[which], pa.int32()), pa.array(counts, pa.int32())], fields=list(kind)))
        return out | {"_uid": np.arange(start, start + batch.num_rows), "doc_id": batch.column("doc_id"),
                      "held_out": batch.column("held_out"), "tail": tail}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    path = shared_folder(docs.sparkSession, "hmm-texts")
    mapped(rows, run, "_uid long, doc_id long, held_out boolean, n_tokens long, sym binary, head_known long, "
                      "head_base double, tail array<struct<word: binary, cls: int, n: int>>"
           ).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


class Parameters:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray | None = None):
        self.start, self.move, self.emit = start, move, emit  # emit: symbols x states
        self.counts = counts  # what they were made from

    @staticmethod
    def initial(unigram: np.ndarray, states: int, seed: int = 7) -> Parameters:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states)))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return Parameters(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(counts: np.ndarray, unigram: np.ndarray, states: int) -> Parameters:
        """Rows of counts: symbols, then moves by state, then the start."""
        s = len(unigram)
        emit = counts[:s] + 50.0 * unigram[:, None]
        move, start = counts[s:s + states] + SMOOTH, counts[s + states] + SMOOTH
        return Parameters(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), counts)


def _lockstep(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
    """Groups of sequences, longest first: their positions, symbols in order of time, bounds of the times.

    A group holds ``CELLS`` symbols, so the few long sequences of a batch step together; the sequences still active at a
    time are the first of their group.
    """
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        end, held = at, 0
        while end < len(order) and (end == at or held + len(seqs[order[end]]) <= CELLS):
            held += len(seqs[order[end]])
            end += 1
        part = order[at:end]
        at = end
        lengths = np.array([len(seqs[i]) for i in part])
        times = np.arange(held) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        by_time = np.argsort(times.astype(np.min_scalar_type(lengths[0])), kind="stable")
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        yield part, np.concatenate([seqs[i] for i in part])[by_time], [0, *np.cumsum(active).tolist()]


def forward(seqs: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Exact natural-log likelihood of each sequence by scaled forward recursion."""
    out = np.zeros(len(seqs))
    one = np.ones(len(p.start))
    for part, symbols, bounds in _lockstep(seqs):
        emit, logs, alpha = p.emit[symbols], np.zeros(len(part)), None
        for a, b in zip(bounds[:-1], bounds[1:]):
            alpha = (p.start if alpha is None else alpha[:b - a] @ p.move) * emit[a:b]
            total = alpha @ one
            logs[:b - a] += np.log(total)
            alpha /= total[:, None]
        out[part] = logs
    return out


def expected(seqs: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Expected counts as in ``Parameters.from_counts``."""
    states = len(p.start)
    counts = np.zeros((len(p.emit) + states + 1, states))
    moves = np.zeros((states, states))
    one, back = np.ones(states), np.ascontiguousarray(p.move.T)
    for _, symbols, bounds in _lockstep(seqs):
        spans = list(zip(bounds[:-1], bounds[1:]))
        emit = p.emit[symbols]
        alpha, beta, total = np.empty_like(emit), np.ones_like(emit), np.empty(len(emit))
        for t, (a, b) in enumerate(spans):
            ahead = (alpha[spans[t - 1][0]:][:b - a] @ p.move if t else p.start) * emit[a:b]
            total[a:b] = ahead @ one
            np.divide(ahead, total[a:b, None], out=alpha[a:b])
        emit /= total[:, None]
        for (before, _), (a, b) in zip(spans[-2::-1], spans[:0:-1]):
            emit[a:b] *= beta[a:b]
            np.matmul(emit[a:b], back, out=beta[before:before + b - a])
        width = spans[0][1]
        sizes = np.diff(bounds)
        came = np.arange(width, len(emit)) - np.repeat(sizes[:-1], sizes[1:])  # each symbol's predecessor
        moves += alpha[came].T @ emit[width:]
        alpha *= beta
        for k in range(states):
            counts[:len(p.emit), k] += np.bincount(symbols, alpha[:, k], len(p.emit))
        counts[-1] += alpha[:width].sum(axis=0)
    counts[len(p.emit):-1] = moves * p.move
    return counts


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("sym").to_pylist()]


def _partial_counts(rows: DataFrame, p: Broadcast, names: list[str]) -> DataFrame:
    """Counts by task: a core sums what it holds of the texts, so the tables to be added are as many as cores, not as files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = expected(_sequences(batch), p.value)
                total = found if total is None else total + found
        if total is not None:
            some = np.flatnonzero(total.sum(axis=1) > 0)
            yield pa.RecordBatch.from_pydict({"i": pa.array(some, pa.int32())} | {
                n: pa.array(total[some, k]) for k, n in enumerate(names)})

    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.select("sym").coalesce(cores).mapInArrow(run, "i int, " + ", ".join(f"{n} double" for n in names))


def step(rows: DataFrame, p: Parameters, unigram: np.ndarray) -> Parameters:
    """One expectation step over rows, summed by Spark, and the parameters that follow."""
    states = len(p.start)
    held = rows.sparkSession.sparkContext.broadcast(Parameters(p.start, p.move, p.emit))
    names = [f"k{k}" for k in range(states)]
    sums = _partial_counts(rows, held, names).groupBy("i").agg(
        *[F.sum(n).alias(n) for n in names]).toPandas()  # one row per symbol and state
    counts = np.zeros((len(unigram) + states + 1, states))
    counts[sums["i"].to_numpy()] = sums[names].to_numpy()
    held.unpersist()
    return Parameters.from_counts(counts, unigram, states)


def train(rows: DataFrame, vocabulary: Vocabulary, states: int = STATES, sample_texts: int = SAMPLE_TEXTS,
          sample_steps: int = SAMPLE_STEPS, full_steps: int = FULL_STEPS) -> Parameters:
    unigram = vocabulary.unigram()
    p = Parameters.initial(unigram, states)
    learn = rows.filter("NOT held_out")
    if vocabulary.n_texts:
        shares = max(1, int(1 / min(1.0, max(SAMPLE_SHARE, sample_texts / vocabulary.n_texts))))
        rounds = -(-sample_steps // shares)
        dealt = _dealt(learn, shares)
        total, latest = 0, {}
        for i in range(rounds * shares):
            found = step(dealt(i % shares), p, unigram).counts
            total = total + found - latest.get(i % shares, 0)
            if i < (rounds - 1) * shares:  # renewed in the next round
                latest[i % shares] = found
            p = Parameters.from_counts(np.maximum(total, 0), unigram, states)
        for _ in range(full_steps):
            p = step(learn, p, unigram)
    return p


def _dealt(learn: DataFrame, shares: int) -> Callable[[int], DataFrame]:
    """The training texts by share, stored so that a step reads one share only."""
    if shares == 1:
        return lambda k: learn
    path = shared_folder(learn.sparkSession, "hmm-shares")
    dealt = learn.select("sym", F.pmod(F.xxhash64("_uid"), F.lit(shares)).cast("int").alias("share"))
    dealt.write.partitionBy("share").option("compression", "zstd").parquet(path)
    schema = learn.select("sym").schema
    held = {r["share"] for r in learn.sparkSession.read.parquet(path).select("share").distinct().collect()}
    return lambda k: (learn.sparkSession.read.schema(schema).parquet(f"{path}/share={k}") if k in held
                      else learn.select("sym").limit(0))


def scored(rows: DataFrame, words: DataFrame, vocabulary: Vocabulary, p: Parameters) -> DataFrame:
    """The contract's columns: HMM likelihood plus the joined counts of rarer words."""
    held = rows.sparkSession.sparkContext.broadcast(p)

    def run(batch: pa.RecordBatch) -> dict:
        logs = forward(_sequences(batch), held.value) / np.log(10)
        return {n: batch.column(n) for n in ("_uid", "doc_id", "held_out", "n_tokens", "head_known", "head_base")} | {"hmm": logs}

    main = mapped(rows.drop("tail"), run, "_uid long, doc_id long, held_out boolean, n_tokens long, head_known long, "
                                          "head_base double, hmm double")
    mass = F.array(*[F.lit(float(x)) for x in vocabulary.class_mass()])
    rare = rows.select("_uid", F.explode("tail").alias("t")).select("_uid", "t.*")
    rare = rare.join(vocabulary.tail(words).select("word", "c").hint("shuffle_hash"), "word", "left")  # sorting words costs more
    c = F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)
    sums = rare.groupBy("_uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10(c / F.lit(vocabulary.base_divisor()))).alias("tail_base"),
        F.sum(F.col("n") * F.log10(c / F.element_at(mass, F.col("cls") + 1))).alias("tail_in_class"))
    out = main.join(sums, "_uid", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(vocabulary.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", zero)).alias("base_score"),
        (F.col("hmm") + F.coalesce("tail_in_class", zero)).alias("score"))


def modelled(docs: DataFrame, held_out, head: int = HEAD, **training) -> DataFrame:
    """Train on the texts that ``held_out`` does not mark and score all."""
    words = word_counts(docs, ~held_out)
    vocabulary = Vocabulary(words, docs.filter(~held_out).select("doc_id").count(), head)
    rows = encoded(docs, vocabulary, held_out)
    return scored(rows, words, vocabulary, train(rows, vocabulary, **training))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelled(table(spark, sf_dir, "documents", "doc_id", "text"), fold(10) == 0)
