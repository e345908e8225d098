"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of up to ``order`` preceding bytes, with counts frozen after training. A byte
costs -log2(c / (n + d)) in the longest known context that has seen it (n symbols, d distinct ones); each longer known
context that has not adds an escape of -log2(d / (n + d)); below order 0 all bytes cost 8 bits. A text gets the
language with the shortest code; the score is the posterior of that language under equal priors, from the
code lengths divided by ``TEMPERATURE`` (bytes of a text are not independent draws).

Trees are fitted on a hash sample of ``CHUNK``-byte chunks of all training texts (``train_chars`` characters a language, at
most a chunk more), which bounds the broadcast tables whatever the size of a text and leaves out no language; every text is scored whole. All cost vectors of known n-grams are computed once; a
position is looked up in an open-addressing table per order, longest first.

Defined results: ``und`` with score 0 if the text is null, empty or without a letter, or nothing was learned; ties
go to the first language in code point order; rows with null ids belong to the training fold unless their crc says
otherwise; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapline.llm.common import fold, mapped, mix64, table, texts_of

ORDER = 3
TRAIN_CHARS = 1_500_000
CHUNK = 4096
TEMPERATURE = 8.0
SLICE = 1 << 18  # positions scored at once
_LETTER = re.compile(r"[^\W\d_]").search


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Codes of all n-byte windows: the bytes as a big-endian number."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for i in range(n):
        out = out << np.uint64(8) | data[i:i + len(out)]
    return out


def training_counts(docs: DataFrame, learn, order: int = ORDER, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """lang, n, code, count of the windows of up to order + 1 bytes that begin in the sampled chunks."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = known.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"),
                                      F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row per language
    wanted = {r["lang"]: train_chars * r["bytes"] / r["chars"] for r in sizes if r["chars"]}
    if not wanted:
        return docs.sparkSession.createDataFrame([], "lang string, n int, code long, count long")
    # somewhat more than wanted is drawn, 16 chunks at least, and cut to what is wanted
    share = {r["lang"]: min(1.0, (1.25 * wanted[r["lang"]] + 16 * CHUNK) / r["bytes"]) for r in sizes if r["chars"]}

    def draw(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"lang": [], "draw": [], "size": [], "text": []}
        for text, lang, row in zip(texts_of(batch), batch.column("lang").to_pylist(), batch.column("row").to_pylist()):
            keys = mix64(mix64(np.array([row + 1], np.uint64)) + np.arange(-(-len(text) // CHUNK), dtype=np.uint64))
            keys = (keys >> np.uint64(2)).astype(np.int64)
            for j in np.flatnonzero(keys < share[lang] * 2.0 ** 62) if len(text) else ():
                out["lang"].append(lang)
                out["draw"].append(int(keys[j]))
                out["size"].append(min(CHUNK, len(text) - int(j) * CHUNK))
                out["text"].append(text[int(j) * CHUNK:(int(j) + 1) * CHUNK + order])
        return out

    drawn = mapped(known.withColumn("row", F.monotonically_increasing_id()), draw, "lang string, draw long, size int, text binary")
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1))
    most = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    sample = drawn.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most[F.col("lang")])
    sample = sample.select("lang", "size", "text")

    def count(batch: pa.RecordBatch) -> dict:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        for text, lang, size in zip(texts_of(batch), batch.column("lang").to_pylist(), batch.column("size").to_pylist()):
            data = np.frombuffer(text, np.uint8)
            for n in range(1, order + 2):
                held.setdefault((lang, n), []).append(grams(data[:size + n - 1], n))
        out: dict[str, list] = {"lang": [], "n": [], "code": [], "count": []}
        for (lang, n), parts in held.items():
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            out["lang"] += [lang] * len(codes)
            out["n"] += [n] * len(codes)
            out["code"] += codes.astype(np.int64).tolist()
            out["count"] += counts.tolist()
        return out

    return mapped(sample, count, "lang string, n int, code long, count long").groupBy("lang", "n", "code").agg(
        F.sum("count").alias("count"))


class Table:
    """Codes to row numbers by open addressing, looked up for whole arrays."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, int(len(codes) * 4).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.codes = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(codes)), (mix64(codes) & self.mask).astype(np.int64)
        while len(left):
            free = self.rows[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.rows[slots], self.codes[slots] = put, codes[put]
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, at = left[rest], (at[rest] + 1) & int(self.mask)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for unknown codes."""
        at = (mix64(codes) & self.mask).astype(np.int64)
        rows = self.rows[at]
        wrong = np.flatnonzero((rows >= 0) & (self.codes[at] != codes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            rows[wrong] = self.rows[at[wrong]]
            wrong = wrong[(rows[wrong] >= 0) & (self.codes[at[wrong]] != codes[wrong])]
        return rows


class Model:
    """Cost vectors (bits per language) of known windows, and escape costs of known contexts."""

    def __init__(self, counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.order = sorted({lang for lang, _ in counts}), order
        k = len(self.langs)
        self.tables: dict[int, Table] = {}
        self.costs: dict[int, np.ndarray] = {0: np.full((1, k), 8.0)}
        self.escapes: dict[int, tuple[Table | None, np.ndarray]] = {}
        none = (np.empty(0, np.uint64), np.empty(0))
        for n in range(1, order + 2) if self.langs else ():
            own = [counts.get((lang, n), none) for lang in self.langs]
            contexts = np.unique(np.concatenate([c >> np.uint64(8) for c, _ in own]))
            windows = np.unique(np.concatenate([c for c, _ in own]))
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            for j, (codes, c) in enumerate(own):
                at = np.searchsorted(contexts, codes >> np.uint64(8))
                total[:, j] = np.bincount(at, c, len(contexts))
                kinds[:, j] = np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            self.escapes[n] = (Table(contexts), escape)
            below = self._shorter(windows, n)
            cost = escape[np.searchsorted(contexts, windows >> np.uint64(8))] + below
            for j, (codes, c) in enumerate(own):
                at = np.searchsorted(contexts, codes >> np.uint64(8))
                cost[np.searchsorted(windows, codes), j] = -np.log2(c / (total[at, j] + kinds[at, j]))
            self.tables[n], self.costs[n] = Table(windows), cost

    def _shorter(self, windows: np.ndarray, n: int) -> np.ndarray:
        """Costs of the last bytes of windows in contexts of fewer than n - 1 bytes."""
        if n == 1:
            return np.repeat(self.costs[0], len(windows), axis=0)
        codes = windows & np.uint64((1 << 8 * (n - 1)) - 1)
        rows = self.tables[n - 1].find(codes)
        out = self.costs[n - 1][rows]
        lost = rows < 0
        if lost.any():
            table_, escape = self.escapes[n - 1]
            at = table_.find(codes[lost] >> np.uint64(8))
            out[lost] = np.where((at >= 0)[:, None], escape[at], 0.0) + self._shorter(codes[lost], n - 1)
        return out

    def cost(self, windows: np.ndarray, n: int) -> np.ndarray:
        return self._shorter(windows, n + 1)

    def bits(self, text: bytes) -> np.ndarray:
        """Exact code length of a text in every language."""
        data, out = np.frombuffer(text, np.uint8), np.zeros(len(self.langs))
        width = self.order + 1
        for n in range(1, min(width, len(data) + 1)):  # the first bytes have short contexts
            out += self.cost(grams(data[:n], n), n)[0]
        for at in range(0, max(0, len(data) - width + 1), SLICE):
            out += self.cost(grams(data[at:at + SLICE + width - 1], width), width).sum(axis=0)
        return out

    def many_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of many texts, in few passes over their joined bytes."""
        out = np.zeros((len(texts), len(self.langs)))
        width, at = self.order + 1, 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= SLICE):
                held += len(texts[end])
                end += 1
            if end == at + 1:
                out[at] = self.bits(texts[at])
            else:
                data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
                ends = np.cumsum([len(t) for t in texts[at:end]])
                codes, owner = grams(data, width), np.repeat(np.arange(end - at), [len(t) for t in texts[at:end]])
                inside = owner[:len(codes)] == owner[width - 1:]
                cost, who = self.cost(codes[inside], width), owner[:len(codes)][inside]
                for j in range(len(self.langs)):
                    out[at:end, j] = np.bincount(who, cost[:, j], end - at)
                begins = np.concatenate([[0], ends[:-1]])
                for n in range(1, width):
                    some = np.flatnonzero(ends - begins >= n)
                    codes = np.zeros(len(some), np.uint64)
                    for i in range(n):
                        codes = codes << np.uint64(8) | data[begins[some] + i]
                    out[at + some] += self.cost(codes, n)
            at = end
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, float | None]]:
        """Language, posterior, and bits per byte of each text."""
        bits = self.many_bits(texts) if self.langs else np.zeros((len(texts), 0))
        found = []
        for text, b in zip(texts, bits):
            if not len(b) or not _LETTER(text.decode("utf-8", "replace")):
                found.append(("und", 0.0, None))
                continue
            best = int(np.argmin(b))
            weight = np.exp2((b[best] - b) / TEMPERATURE)
            found.append((self.langs[best], float(1 / weight.sum()), float(b[best] / len(text))))
        return found


def fit(docs: DataFrame, learn, order: int = ORDER, train_chars: int = TRAIN_CHARS) -> Model:
    """Collects the counts of the bounded sample: at most languages x train_chars x (order + 1) windows."""
    held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    pdf = training_counts(docs, learn, order, train_chars).toPandas()
    for (lang, n), part in pdf.groupby(["lang", "n"]):
        held[lang, int(n)] = (part["code"].to_numpy().astype(np.uint64), part["count"].to_numpy().astype(float))
    return Model(held, order)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = held.value.predict(texts_of(batch))
        return {"doc_id": batch.column("doc_id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                "bits_per_byte": [f[2] for f in found]}

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run,
                  "doc_id long, lang_pred string, score double, bits_per_byte double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs, fold(4) != 2)
    return identified(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
