"""Near duplicates: an n-gram Jaccard join by chosen paths.

A text is the set of its runs of five lower-cased words (shorter texts: one run of all words). Equal sets are joined first
and go on as one set with a count. In each of R runs a set chooses shared tokens by hash, on average
``CHOICES`` / similarity of them, and every choice is a bucket. A bucket above ``SPLIT`` sets is split on further chosen
tokens, up to three deep, unless its sets are alike: when most of what a split would deal out stays together (judged on a
probe), the bucket is dense and all its sets are joined at once. Small buckets are compared by brute force on the chosen tokens alone, whose
overlap estimates the similarity; what cannot be excluded is linked into families. Families are compared exactly, on
whole sets, in blocks of ``PART`` x ``PART`` sets per task, which emit link counts and a spanning forest, never all pairs.
R follows from the target recall: a run finds a pair of the threshold similarity with chance at least
(1 - exp(-CHOICES))^depth.

Defined results: texts without a word are alone in their class with no links; the class id is the smallest doc_id
of the class (null ids count as larger); links counts other documents of similarity >= 0.8, equal ones included;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm.common import fitting, mapped, mix64, saved, table, texts_of
from tapline.llm.graph import components, forest, streamed_groups

WORDS = 5
SIMILARITY = (4, 5)
CHOICES = 3.0
DEPTH = 3
TARGET = 0.9999
RUNS = math.ceil(math.log(1 - TARGET) / math.log(1 - (1 - math.exp(-CHOICES)) ** DEPTH))
SPLIT = 256
PART = 512
ALIKE = 0.5  # share of chosen tokens; sets of similarity 0.8 are some five standard deviations above it
DENSE = 0.6
PROBE = 256
SLICE = 1 << 19  # bytes of text hashed together
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_SEED = _RNG.integers(1, 1 << 63, (3, 8), dtype=np.uint64)
_SUMS = _RNG.integers(1, 1 << 63, 2, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of every word of ASCII-lower-cased bytes."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, np.uint64), at
    begins = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    lengths = np.diff(np.append(begins, len(at)))
    offset = np.arange(len(at)) - np.repeat(begins, lengths)
    rest = (offset >> 12).astype(np.uint64)  # beyond 4,096 bytes of one word
    value = (data[at].astype(np.uint64) + np.uint64(1) + (rest << np.uint64(8))) * _ODD[offset & 4095]
    return mix64(np.add.reduceat(mix64(value), begins)), at[begins]


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 40-bit hashes of the word runs of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < SLICE):
            held += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\n".join(t.lower() for t in texts[at:end]) + b"\n", np.uint8)
        hashes, where = word_hashes(data)
        edges = np.searchsorted(where, np.cumsum([0] + [len(t) + 1 for t in texts[at:end]]))
        runs = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            runs += hashes[k:k + len(runs)] * _ODD[k]
        runs = mix64(runs) >> np.uint64(24)
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a >= WORDS:
                out.append(np.unique(runs[a:b - WORDS + 1]))
            elif b > a:
                short = (hashes[a:b] * _ODD[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix64(np.array([short], np.uint64)) >> np.uint64(24))
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def chosen(sets: list[np.ndarray]) -> list[list[list[int]]]:
    """Per level and set the chosen tokens as keys whose low three bits are the run."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    chance = np.minimum(1.0, CHOICES * SIMILARITY[1] / SIMILARITY[0] / np.maximum(sizes, 1))
    limit = np.repeat((chance * float(1 << 53)).astype(np.uint64), sizes)
    out = []
    for level in range(DEPTH):
        keys, who = [], []
        for run in range(RUNS):
            drawn = mix64(tokens ^ _SEED[level, run])
            hit = np.flatnonzero((drawn >> np.uint64(11)) < limit)
            keys.append((mix64(drawn[hit]) & ~np.uint64(7)) | np.uint64(run))
            who.append(owner[hit])
        keys, who = np.concatenate(keys).view(np.int64), np.concatenate(who)
        order = np.argsort(who, kind="stable")
        ends = np.searchsorted(who[order], np.arange(len(sets) + 1))
        out.append([keys[order[a:b]].tolist() for a, b in zip(ends[:-1], ends[1:])])
    return out


def described(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """One row per document: _uid (the column ``uid`` or new), size, key of the set, the set, chosen tokens per level and all of them packed."""
    state: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> dict:
        start = state.get("n", 0) + (TaskContext.get().partitionId() << 36)
        state["n"] = state.get("n", 0) + batch.num_rows
        sets = sets_of(texts_of(batch))
        sums = [[int(mix64(s ^ seed).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for seed in _SUMS]
        levels = chosen(sets)
        sketch = [np.sort(np.array(a + b + c, np.int64)).tobytes() for a, b, c in zip(*levels)]
        return {"_uid": batch.column("_uid") if uid else np.arange(start, start + batch.num_rows),
                "doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "k1": sums[0], "k2": sums[1],
                "tokens": [packed(s) for s in sets], "l1": levels[0], "l2": levels[1], "l3": levels[2], "sketch": sketch}

    given = [F.col(uid).alias("_uid")] if uid else []
    return saved(mapped(
        docs.select(*given, F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run,
        "_uid long, doc_id long, n long, k1 long, k2 long, tokens binary, l1 array<long>, l2 array<long>, "
        "l3 array<long>, sketch binary"), "near-sets", "zstd")


def _alike(rows: list[tuple]) -> list[tuple[int, int]]:
    """Forest of the pairs of a bucket whose chosen tokens overlap enough. Rows: bucket, i, j, part, uid, n, sketch."""
    i, j = rows[0][1], rows[0][2]
    n = np.array([r[5] for r in rows])
    drawn = [np.frombuffer(r[6], np.int64) for r in rows]
    shared = _overlap(drawn)
    most = np.maximum.outer(*[np.array([len(d) for d in drawn])] * 2)
    ok = (shared >= ALIKE * most) & (SIMILARITY[1] * np.minimum.outer(n, n) >= SIMILARITY[0] * np.maximum.outer(n, n))
    return _forest_of(ok, rows, i, j)


def _forest_of(ok: np.ndarray, rows: list[tuple], i: int, j: int) -> list[tuple[int, int]]:
    part, uid = np.array([r[3] for r in rows]), [r[4] for r in rows]
    if i != j:
        ok = ok & (part[:, None] != part[None, :])
    a, b = np.nonzero(np.triu(ok, 1))
    return forest(zip([uid[x] for x in a], [uid[x] for x in b]))


def _overlap(sets: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Sizes of all intersections, from the tokens that at least two sets hold."""
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rank = np.cumsum(counts > 1) - 1
    keep = counts[at] > 1
    owner, at = owner[keep], rank[at[keep]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, [first, first + columns])
        grid = np.zeros((len(sets), columns), np.float32)
        grid[owner[a:b], at[a:b] - first] = 1
        out += grid @ grid.T
    return out


def _in_parts(df: DataFrame, key: str, size: str, part: int) -> DataFrame:
    """Rows once per pair of parts of their group that they belong to: columns i, j, part."""
    n = F.ceil(F.col(size) / part).cast("int")
    df = df.withColumn("part", F.pmod(F.xxhash64("uid"), n).cast("int"))
    return (df.withColumn("_o", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumns({"i": F.least("part", "_o"), "j": F.greatest("part", "_o")}).drop("_o"))


def _dense(big: DataFrame, sets: DataFrame) -> DataFrame:
    """Buckets whose sets are alike, judged by how the next tokens would deal some ``PROBE`` of them.

    The probe only decides how a bucket is worked on: a dense one is joined whole, any other is split whole.
    """
    probe = big.filter(F.pmod(F.xxhash64("uid", "bucket"), F.col("m")) < PROBE).select("uid", "bucket", "run")
    drawn = sets.join(fitting(probe), "uid").select("bucket", F.expr("filter(tokens, t -> (t & 7L) = run)").alias("tokens")).filter(
        F.size("tokens") > 0)
    sizes = drawn.select("bucket", F.explode("tokens").alias("token")).groupBy("bucket", "token").agg(F.count("*").alias("c"))
    n = drawn.groupBy("bucket").agg(F.count("*").alias("n"))
    stays = F.sum(F.when(F.col("c") * 2 >= F.col("n"), F.col("c")).otherwise(0)) / F.sum("c")
    return saved(sizes.join(n, "bucket").groupBy("bucket").agg(stays.alias("stays")).filter(
        F.col("stays") >= DENSE).select("bucket"), "near-dense")


def _dealt_anew(further: DataFrame, again: DataFrame, level: int) -> DataFrame:
    """bucket, uid: the tokens of the sets of a run that are in a bucket still too large, each once whatever those buckets hold.

    ``further`` has the tokens of a set as an array (uid, tokens), or one a row. A set is joined once, with all its runs.
    """
    if "tokens" not in further.columns:
        further = further.groupBy("uid").agg(F.collect_set("token").alias("tokens"))
    runs = saved(again.groupBy("uid").agg(F.expr("bit_or(1L << int(run))").alias("runs")), "near-split")
    rows = further.join(fitting(runs), "uid").select(
        "uid", F.expr("explode(filter(tokens, t -> ((runs >> int(t & 7L)) & 1L) = 1L))").alias("token"))
    return rows.select(F.expr(f"(xxhash64({level}, token) & ~7L) | (token & 7L)").alias("bucket"), "uid")


def families(reps: DataFrame) -> DataFrame:
    """node, root: sets that may be similar, by chosen paths."""
    now = reps.select(F.explode("l1").alias("bucket"), F.col("_uid").alias("uid"))
    small, edges = [], []
    for level in range(2, DEPTH + 2):
        counted = now.groupBy("bucket").agg(
            F.count("*").alias("m"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("s"),
            F.min("uid").alias("least")).filter("m > 1")
        # buckets of the same sets are the same work: the first stands for all
        kept = saved(counted.groupBy("m", "s").agg(F.min("bucket").alias("bucket"), F.min("least").alias("least")).drop("s"),
                     "near-buckets")
        few, many = kept.agg(F.count_if(F.col("m") <= SPLIT), F.count_if(F.col("m") > SPLIT)).first()
        if level > DEPTH or not many:
            small.append(now.join(fitting(kept, counted=few + many), "bucket").select("bucket", "uid", "m"))
            break
        small.append(now.join(fitting(kept.filter(F.col("m") <= SPLIT), counted=few), "bucket").select("bucket", "uid", "m"))
        big = saved(now.join(fitting(kept.filter(F.col("m") > SPLIT), counted=many), "bucket").withColumn("run", F.expr("bucket & 7L")),
                    "near-big")
        sets = reps.select(F.col("_uid").alias("uid"), F.col(f"l{level}").alias("tokens"))
        dense = _dense(big, sets)
        edges.append(big.join(dense, "bucket", "left_semi").select(F.col("uid").alias("u"), F.col("least").alias("v")))
        now = _dealt_anew(sets, big.join(dense, "bucket", "left_anti").select("uid", "run"), level)
    members = small[0]
    for more in small[1:]:
        members = members.unionByName(more)
    rows = members.join(reps.select(F.col("_uid").alias("uid"), "n", "sketch"), "uid")
    rows = _in_parts(rows, "bucket", "m", SPLIT).select("bucket", "i", "j", "part", "uid", "n", "sketch")
    found = streamed_groups(rows, ["bucket", "i", "j"], _alike, "u long, v long")
    for more in edges:
        found = found.unionByName(more)
    return components(found)


def _verified(rows: list[tuple]) -> list[tuple]:
    """Links of a block of a family. Rows: root, i, j, part, uid, n, copies, tokens. Out: u, v or u, null, links."""
    i, j = rows[0][1], rows[0][2]
    n, copies = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    shared = _overlap([unpacked(r[7]) for r in rows])
    ok = SIMILARITY[1] * shared >= SIMILARITY[0] * (np.add.outer(n, n) - shared)
    np.fill_diagonal(ok, False)
    part = np.array([r[3] for r in rows])
    if i != j:
        ok &= part[:, None] != part[None, :]
    links = ok @ copies
    return [(a, b, 0) for a, b in _forest_of(ok, rows, i, j)] + [(r[4], None, int(k)) for r, k in zip(rows, links) if k]


def _slot(uid: str):
    """Sixteen slots, so that the rows of one large group meet in many tasks."""
    return F.pmod(F.xxhash64(uid), F.lit(16)).cast("int")


def near_duplicates(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """_uid, doc_id, class_id, links, first (the document of the class that stays), n_shingles."""
    rows = described(docs, uid)
    groups = saved(rows.filter("n > 0").groupBy("n", "k1", "k2").agg(
        F.min("_uid").alias("rep"), F.count("*").alias("copies")), "near-groups")
    many = groups.filter("copies > 1")
    salted = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<int>")))
    again = saved(rows.select("_uid", "n", "k1", "k2", _slot("_uid").alias("_salt")).join(
        salted, ["n", "k1", "k2", "_salt"]).filter("_uid <> rep").select("_uid"), "near-again")
    reps = rows.filter("n > 0").join(fitting(again), "_uid", "left_anti")
    family = saved(families(reps).withColumnRenamed("node", "uid"), "near-families")
    sizes = family.groupBy("root").agg(F.count("*").alias("m"))
    member = saved(family.join(sizes, "root").join(many.select(F.col("rep").alias("uid"), "copies"), "uid", "left").withColumn(
        "copies", F.coalesce("copies", F.lit(1))), "near-members")
    whole = reps.select(F.col("_uid").alias("uid"), "n", "tokens").join(fitting(member), "uid")
    whole = _in_parts(whole, "root", "m", PART).select("root", "i", "j", "part", "uid", "n", "copies", "tokens")
    found = saved(streamed_groups(whole, ["root", "i", "j"], _verified, "u long, v long, links long"), "near-links")
    classes = components(found.filter("v IS NOT NULL").select("u", "v"))
    links = found.filter("v IS NULL").groupBy("u").agg(F.sum("links").alias("_links"))
    known = groups.join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left").join(
        links.withColumnRenamed("u", "rep"), "rep", "left").select(
        F.col("n").alias("_n"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "copies",
        F.coalesce("root", "rep").alias("_class"), F.coalesce("_links", F.lit(0)).alias("_links"))
    busy = known.filter("copies > 1 OR _links > 0").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = rows.select("_uid", "doc_id", "n", "k1", "k2").withColumn("_slot", _slot("_uid")).join(
        busy, (F.col("n") == F.col("_n")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
        & (F.col("_slot") == F.col("_salt")), "left")
    out = out.withColumn("_class", F.coalesce("_class", "_uid"))
    firsts = out.groupBy("_class").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_uid").alias("u"))).alias("_first"),
        F.count("*").alias("class_size")).filter("class_size > 1")
    salted = firsts.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<int>")))
    out = out.join(salted, ["_class", "_slot"], "left")
    return out.select(
        "_uid", "doc_id", F.when(F.col("_first").isNull(), F.col("doc_id")).otherwise(F.col("_first.d")).alias("class_id"),
        (F.coalesce("_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("bigint").alias("links"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        F.coalesce(F.col("_first.u") == F.col("_uid"), F.lit(True)).alias("first"), F.col("n").alias("n_shingles"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "links", "class_size", "n_shingles")
