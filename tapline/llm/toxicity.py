"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings that training rows tie to the label (two-proportion z and lift). Document
frequencies count all documents. Examples with a vector are sorted into blocks of similar ones; a block keeps each term's
largest weight, so a query bounds every block, visits blocks from the best bound down and stops when no block
can still change its neighbours: the neighbours are exact. Votes are weighted by distance and by how the
classes were sampled, then calibrated by monotone regression on leave-one-out votes of the examples.

The classifier is fitted on at most ``per_class`` labelled rows of either label (smallest id hashes), which bounds
the broadcast index; everything else covers all rows.

Defined results: null and empty texts, and texts without a term, get the label rate of such examples; several labels
of a doc_id count as toxic if one is; null ids are never labelled; without two classes every score is the
label rate (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm.common import fold, mapped, saved, table, texts_of

PER_CLASS = 8192
TERMS = 2048
MIN_Z = 6.0
MIN_LIFT = 4.0
MIN_SHARE = 0.01
BEGINNINGS = (4, 5, 6, 8)  # bytes of a word
NEIGHBOURS = 16
BLOCK = 64
REJECT = 0.7
_LETTERS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-case runs of letters, digits and non-ASCII bytes."""
    return text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()


def beginnings(word: bytes) -> list[bytes]:
    return [word[:n] + b"*" for n in BEGINNINGS if len(word) > n]


def terms(text: bytes) -> set[bytes]:
    """Distinct words and word beginnings."""
    found = set(words(text))
    return found.union(*map(beginnings, found))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn, per_class: int = PER_CLASS) -> tuple[DataFrame, dict]:
    """Texts of a bounded hash sample per label, and how many labelled rows stand behind each label."""
    known = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(learn)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    def smallest(y: int) -> DataFrame:
        """A hash threshold first, so that few more rows than wanted are sorted."""
        share = min(1.0, (1.5 * per_class + 100) / max(1, sizes.get(y, 0)))
        few = known.filter((F.col("toxic") == y) & (F.shiftrightunsigned(F.xxhash64("doc_id"), 34) <= int(share * (1 << 30))))
        return few.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(per_class)

    picked = [smallest(y) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * per_class rows
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), sizes


def select_terms(sample: DataFrame, n_terms: int = TERMS) -> list[bytes]:
    """Terms that mark toxic examples, strongest first."""
    def count(batch: pa.RecordBatch) -> dict:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(texts_of(batch), batch.column("toxic").to_pylist()):
            seen[y].update(terms(text))
        keys = list(seen[0].keys() | seen[1].keys())
        return {"term": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]}

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    sums = mapped(sample, count, "term binary, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p = (F.col("c") + F.col("t")) / (n0 + n1)
    z = (F.col("t") / n1 - F.col("c") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + F.lit(1e-12))
    lift = F.col("t") / n1 >= MIN_LIFT * F.col("c") / n0
    best = sums.filter((F.col("t") >= max(3, MIN_SHARE * n1)) & lift).withColumn("z", z).filter(F.col("z") >= MIN_Z)
    return [bytes(r["term"]) for r in best.orderBy(F.desc("z"), "term").limit(n_terms).select("term").collect()]


def vectors(df: DataFrame, chosen: list[bytes], keep: str) -> DataFrame:
    """The columns of ``keep`` and, per row, ids and counts of the chosen terms in its text."""
    at = df.sparkSession.sparkContext.broadcast(lookup(chosen))
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        ids, counts = [], []
        for text in texts_of(batch):
            found = _counts(text, at.value)
            ids.append(sorted(found))
            counts.append([found[i] for i in ids[-1]])
        return {n: batch.column(n) for n in names} | {"ids": ids, "counts": counts}

    return mapped(df.select(*names, "text"), run, keep + ", ids array<int>, counts array<int>")


def lookup(chosen: list[bytes]) -> dict:
    """Term to id; under None the first four bytes of all terms, which most words fail."""
    return {t: i for i, t in enumerate(chosen)} | {None: {t[:4] if len(t) < 5 else t.rstrip(b"*")[:4] for t in chosen}}


def _counts(text: bytes, at: dict) -> dict[int, int]:
    """Counts of the chosen terms in a text."""
    found = words(text)
    distinct = set(found)
    hit = {w: [at[k] for k in (w, *beginnings(w)) if k in at] for w in distinct if w[:4] in at[None]}
    out: dict[int, int] = {}
    if hit:
        for w in found:
            for i in hit.get(w, ()):
                out[i] = out.get(i, 0) + 1
    return out


class Index:
    """Block-max inverted index over unit vectors of the examples, and the calibrated vote."""

    def __init__(self, rows: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray, class_weight: tuple[float, float],
                 k: int = NEIGHBOURS):
        self.idf, self.k = idf, k
        empty = [y for _, y, ids, _ in rows if not ids]
        mass = [class_weight[y] * sum(e == y for e in empty) for y in (0, 1)]
        self.none = (mass[1] + 0.5) / (sum(mass) + 1.0) if empty else 0.0
        full = [(d, y, np.array(i), self._unit(i, c)) for d, y, i, c in rows if i]
        full.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), -float(r[3].max()), r[0]))
        self.doc = np.array([r[0] for r in full], np.int64)
        self.y = np.array([r[1] for r in full], np.int64)
        self.weight = np.where(self.y == 1, class_weight[1], class_weight[0])
        self.blocks = []
        self.most = np.zeros((len(idf), -(-len(full) // BLOCK)))
        for b in range(self.most.shape[1]):
            part = full[b * BLOCK:(b + 1) * BLOCK]
            cols = np.unique(np.concatenate([r[2] for r in part]))
            dense = np.zeros((len(part), len(cols)))
            for i, r in enumerate(part):
                dense[i, np.searchsorted(cols, r[2])] = r[3]
            self.most[cols, b] = dense.max(axis=0)
            self.blocks.append((cols, dense))
        self.steps = None
        if full:
            votes = np.array([self._vote(*self.nearest(r[2], r[3], skip=i)) for i, r in enumerate(full)])
            self.steps = _monotone(votes, self.y.astype(float), self.weight)

    def _unit(self, ids, counts) -> np.ndarray:
        v = (1.0 + np.log(np.asarray(counts, float))) * self.idf[np.asarray(ids)]
        return v / np.sqrt((v * v).sum())

    def nearest(self, ids: np.ndarray, unit: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples; ties go to the smaller doc_id."""
        bound = unit @ self.most[ids]
        dense = np.zeros(len(self.idf))
        dense[ids] = unit
        at, cos = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(at) >= self.k and bound[b] < cos[self.k - 1] - 1e-12:
                break
            cols, block = self.blocks[b]
            sims = block @ dense[cols]
            here = np.arange(b * BLOCK, b * BLOCK + len(sims))
            some = (sims > 0) & (here != skip)
            at, cos = np.concatenate([at, here[some]]), np.concatenate([cos, sims[some]])
            order = np.lexsort((self.doc[at], -np.round(cos, 12)))[:self.k]
            at, cos = at[order], cos[order]
        return at, cos

    def _vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        if not len(at):
            return 0.0
        w = self.weight[at] / (1.05 - np.minimum(cos, 1.0))
        return float((w * self.y[at]).sum() / w.sum())

    def score(self, ids, counts) -> tuple[float, list[int], list[float]]:
        """Calibrated score, then doc_ids and cosines of the three nearest examples as evidence."""
        if not len(ids) or self.steps is None:
            return float(self.none), [], []
        at, cos = self.nearest(np.asarray(ids), self._unit(ids, counts))
        if not len(at):
            return float(self.none), [], []
        vote = self._vote(at, cos)
        score = 0.98 * float(np.interp(vote, *self.steps)) + 0.02 * vote
        return min(1.0, max(0.0, score)), self.doc[at[:3]].tolist(), cos[:3].tolist()


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted monotone regression of y on x, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, learn, per_class: int = PER_CLASS) -> tuple[list[bytes], DataFrame, Index]:
    """Chosen terms, the saved vectors of all documents, and the index."""
    sample, sizes = labelled_sample(docs, labels, learn, per_class)
    chosen = select_terms(sample)
    all_rows = saved(vectors(docs.withColumn("_row", F.col("doc_id").cast("bigint")).select(
        F.col("_row").alias("doc_id"), "text"), chosen, "doc_id long"), "toxicity-vectors")
    n = all_rows.count()
    df = np.zeros(len(chosen))
    for r in all_rows.select(F.explode("ids").alias("i")).groupBy("i").count().collect():  # one row per chosen term
        df[r["i"]] = r["count"]
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = [(r["doc_id"], r["toxic"], r["ids"], r["counts"])
            for r in vectors(sample, chosen, "doc_id long, toxic int").collect()]  # the bounded sample
    have = [max(1, sum(r[1] == y for r in rows)) for y in (0, 1)]
    weight = tuple(sizes.get(y, 0) / have[y] or 1.0 for y in (0, 1))
    return chosen, all_rows, Index(rows, idf, weight)


def scored(rows: DataFrame, index: Index) -> DataFrame:
    """doc_id, score and evidence from saved vectors."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> dict:
        found = [held.value.score(i, c) for i, c in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist())]
        return {"doc_id": batch.column("doc_id"), "score": [f[0] for f in found],
                "evidence_ids": [f[1] for f in found], "evidence_cosines": [f[2] for f in found]}

    return mapped(rows, run, "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>")


def score_column(spark: SparkSession, chosen: list[bytes], index: Index):
    """The score as a function of a text column, for rows that must keep their other columns."""
    held = spark.sparkContext.broadcast((lookup(chosen), index))

    @F.pandas_udf("double")
    def score(texts):
        at, found = held.value[0], []
        for text in texts:
            got = _counts((text or "").encode(), at)
            ids = sorted(got)
            found.append(held.value[1].score(ids, [got[i] for i in ids])[0])
        return type(texts)(found, dtype="float64")

    return score


def training_rows():
    return fold(3) != 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    _, rows, index = fit(docs, labels, training_rows())
    return scored(rows, index).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"),
        "evidence_ids", "evidence_cosines")
