"""Phrase collocation mining over FM-indexes of word ids, one per shard of a language's text.

Tasks cut texts into pieces and pack the pieces of a language into shards of some ``SHARD`` bytes. Words frequent over
all shards get ids in the shard, others become gaps, and the shard's ids are indexed in both reading directions: the
Burrows-Wheeler transforms of the text and of its reverse, sorted by four words, which is as deep as phrases go.
A phrase is a pair of intervals of one size. Extending it to the left takes the next words from the transform
(new interval: C[word] + rank) and moves the reverse interval by the smaller words; to the right the roles are
swapped. All intervals of a level are extended at once with array operations. Words are extended to the left,
two-word phrases to the right, three-word phrases to the left; the reverse index is built where it is used.

Counts are summed across shards. A phrase reaches ``least`` only if all its parts do, so a shard indexes the words that
are frequent over all shards, extends the two-word intervals that are, and reports a longer phrase only if all its
two-word parts are; nothing is estimated and no count of one shard decides. What a shard learns comes back by joins,
whose sizes Spark sees at run time.

Defined results: null text is empty, a null lang is ``und`` (and joins a lang of that name); repeated rows count again;
a piece is never cut, so a shard exceeds its size by at most one piece; ties end as the contract says; an empty table
gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tapline.llm.common import saved, table

LEAST = 30
LONGEST = 4
TOP = 2000
COVER = 80
SHARD = 16 << 20
#: Rows of a table that may be broadcast.
SMALL = 1_000_000
#: Shard sizes of text that a task holds for all languages before it closes the largest shard.
HELD = 4
CUTS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if i in CUTS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: A word of a shard, or (at is null) its ids.
WORDS = pa.schema({"shard": pa.int64(), "lang": pa.string(), "at": pa.int32(), "gram": pa.string(), "c": pa.int64(), "ids": pa.binary()})
#: A phrase of a shard as two pairs of word numbers, or (at is null) its index.
PHRASES = pa.schema({"shard": pa.int64(), "at": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "c": pa.int64(), "ids": pa.binary(), "words": pa.binary()})


# --- one shard ---------------------------------------------------------------------------------

def packed(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.astype("<i4").tobytes())


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<i4")


def tokens(text: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids of the words (0 between pieces), the words of ids 1.., and their counts."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    known[b"\n"], known[b""] = 0, 1
    parts = text.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(known.__getitem__, parts), np.int32, len(parts))
    ids = ids[ids != 1]
    ids = np.where(ids > 0, ids - 1, 0).astype(np.int32)
    return ids, list(known)[2:], np.bincount(ids, minlength=len(known) - 1)[1:]


def gapped(ids: np.ndarray) -> np.ndarray:
    """A gap at both ends, and one instead of several."""
    ids = np.concatenate([[0], ids, [0]]).astype(np.int64)
    return ids[(ids != 0) | np.concatenate([[True], ids[:-1] != 0])]


def transform(ids: np.ndarray) -> np.ndarray:
    """The words before all positions, positions sorted by the four words they begin (the text is a ring)."""
    width = int(ids.max()) + 1
    two = np.unique(ids * width + np.roll(ids, -1), return_inverse=True)[1]
    order = np.argsort(two * (int(two.max()) + 1) + np.roll(two, -2), kind="stable")
    return ids[order - 1]


class Index:
    """A transform with the row that every row's word leads to."""

    def __init__(self, bwt: np.ndarray, width: int) -> None:
        self.bwt, self.width = bwt, width
        self.start = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=width))])
        self.leads = np.empty(len(bwt), np.int64)
        self.leads[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))

    def extended(self, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-word extensions of intervals: (parent, word, low, low in the other index, size)."""
        if not len(low):
            return (np.zeros(0, np.int64),) * 5
        parent = np.repeat(np.arange(len(low)), size)
        begin = np.cumsum(size) - size
        rows = np.arange(len(parent)) - np.repeat(begin - low, size)
        pair, first, count = np.unique(parent * self.width + self.bwt[rows], return_index=True, return_counts=True)
        parent, word = pair // self.width, pair % self.width
        smaller = np.cumsum(count) - count  # words before this one, of this and earlier parents
        smaller -= begin[parent]
        keep = word > 0
        parent, word, count = parent[keep], word[keep], count[keep]
        return parent, word, self.leads[rows[first[keep]]], other[parent] + smaller[keep], count


def within(low: np.ndarray, known_low: np.ndarray, known_size: np.ndarray) -> np.ndarray:
    """Whether intervals lie in one of some disjoint intervals."""
    if not len(known_low):
        return np.zeros(len(low), bool)
    order = np.argsort(known_low)
    at = np.searchsorted(known_low[order], low, "right") - 1
    at_ = order[np.maximum(at, 0)]
    return (at >= 0) & (low < known_low[at_] + known_size[at_])


def two_words(fwd: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Phrases of two words: (word ids, low, low in the reverse index, size)."""
    left = Index(fwd, width)
    begin, size = left.start[1:width], np.diff(left.start)[1:]
    parent, word, low, other, count = left.extended(begin, begin, size)
    return np.column_stack([word, parent + 1]), low, other, count


def longer(fwd: np.ndarray, rev: np.ndarray, width: int, chosen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word ids, counts) of the phrases of three and of four words whose two-word parts are all ``chosen`` of `two_words`."""
    chosen = np.sort(chosen)
    grams, low, other, size = (x[chosen] for x in two_words(fwd, width))
    out = []
    for index, at, opposite in ((Index(rev, width), other, low), (Index(fwd, width), None, None)):
        if at is not None:  # to the right: its last words, read backwards, must be chosen
            parent, word, new_other, new_low, count = index.extended(at, opposite, size)
            ok = within(new_other, other, size)
            new = np.column_stack([grams[parent], word])
        else:  # to the left: its first words must be
            parent, word, new_low, new_other, count = index.extended(low, other, size)
            ok = within(new_low, low, size)
            new = np.column_stack([word, grams[parent]])
        grams, low, other, size = new[ok], new_low[ok], new_other[ok], count[ok]
        out.append((grams, size))
    return out


# --- shards as rows ------------------------------------------------------------------------------

def _rows(schema: pa.Schema, cols: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def _listed(schema: pa.Schema, shard: int, counts: np.ndarray, **cols) -> Iterator[pa.RecordBatch]:
    n = len(counts)
    whole = _rows(schema, {"shard": np.full(n, shard), "at": np.arange(n), "c": counts, **cols}, n)
    for i in range(0, n, 50_000):
        yield whole.slice(i, 50_000)


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """Per shard its words with counts, and one row (at is null) with its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, words, counts = tokens(b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            if len(words):
                yield from _listed(WORDS, number, counts, gram=pa.array(words, pa.binary()).cast(pa.string()), lang=[lang] * len(words))
                yield _rows(WORDS, {"shard": [number], "lang": [lang], "ids": [packed(ids)]}, 1)
                number += 1

        def add(lang: str, part: bytes) -> Iterator[pa.RecordBatch]:
            held.setdefault(lang, []).append(part)
            sizes[lang] = sizes.get(lang, 0) + len(part)
            if sizes[lang] >= size:
                yield from close(lang)
            elif sum(sizes.values()) >= HELD * size:
                yield from close(max(sizes, key=sizes.get))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                text, at = text.translate(_PLAIN), 0
                while len(text) - at > size:  # a huge text is dealt out at the ends of pieces
                    end = text.rfind(b"\n", at, at + size)
                    end = end if end > at else text.find(b"\n", at + size)
                    if end < 0:
                        break
                    yield from add(lang, text[at:end])
                    at = end
                yield from add(lang, text[at:])
        for lang in list(held):
            yield from close(lang)

    rows = docs.filter(F.col("text") != "").select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return saved(rows.mapInArrow(run, from_arrow_schema(WORDS)), "phrase-shards", "zstd")


def fitting(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def frequent_words(rows: DataFrame, least: int) -> DataFrame:
    """lang, gram, f and a dense number of the words that reach ``least`` over all shards."""
    sums = rows.filter("at IS NOT NULL").groupBy("lang", "gram").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    at = saved(sums.withColumn("_at", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted(tuple(r) for r in at.groupBy(part.alias("p")).count().collect())  # a number per partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(total).cast("long")]
        total += n
    offset = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return saved(at.withColumn("number", offset + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), "phrase-words")


def frequent(rows: DataFrame, least: int, *key: str) -> DataFrame:
    """Phrases that reach ``least`` over all shards."""
    sums = rows.filter("at IS NOT NULL").groupBy(*key).agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    return saved(sums, "phrases")


def shared_pairs(rows: DataFrame, least: int) -> DataFrame:
    """shard, at, k1, f of the two-word phrases that reach ``least`` over all shards.

    The rows of a phrase, one a shard at most, meet once: the same shuffle gives the sum and tells the shards.
    """
    f = F.sum("c").over(Window.partitionBy("k1"))
    held = rows.filter("at IS NOT NULL").select("shard", "at", "k1", "c").withColumn("f", f).filter(F.col("f") >= least)
    return saved(held.drop("c"), "phrase-pairs", "zstd")


def indexed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The text of every shard over frequent words, and its phrases of two words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = batch.column("found")[k].values
                at, numbers = np.asarray(found.field("at")), np.asarray(found.field("number"))
                old = unpacked(batch.column("ids")[k].as_py())
                new = np.zeros(int(max(old.max(), at.max() + 1)) + 1, np.int64)
                new[at + 1] = np.arange(1, len(at) + 1)
                ids, shard = gapped(new[old]), batch.column("shard")[k].as_py()
                yield _rows(PHRASES, {"shard": [shard], "ids": [packed(ids)], "words": [packed(numbers)]}, 1)
                grams, _, _, counts = two_words(transform(ids), len(numbers) + 1)
                yield from _phrases(shard, numbers, grams, counts)

    here = rows.filter("at IS NOT NULL").select("shard", "at", "lang", "gram").join(
        fitting(known.select("lang", "gram", "number")), ["lang", "gram"])
    flags = here.groupBy("shard").agg(F.collect_list(F.struct("at", "number")).alias("found"))
    return _next(rows.select("shard", "ids", "at"), flags, run, "phrases-2")


def extended(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases of three and four words over the frequent ones of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, numbers = unpacked(batch.column("ids")[k].as_py()).astype(np.int64), unpacked(batch.column("words")[k].as_py())
                chosen = np.asarray(batch.column("found")[k].values.field("at"))
                for grams, counts in longer(transform(ids), transform(ids[::-1]), len(numbers) + 1, chosen):
                    yield from _phrases(batch.column("shard")[k].as_py(), numbers, grams, counts)

    flags = pairs.groupBy("shard").agg(F.collect_list(F.struct("at")).alias("found"))
    return _next(rows.select("shard", "ids", "words", "at"), flags, run, "phrases-4")


def _next(index: DataFrame, flags: DataFrame, run, name: str) -> DataFrame:
    """Shards and what they learned meet by a shuffle at every size: both grow with the text."""
    held = index.filter("at IS NULL").drop("at").join(flags.hint("shuffle_hash"), "shard")
    return saved(held.mapInArrow(run, from_arrow_schema(PHRASES)), name, "zstd")


def _phrases(shard: int, numbers: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases as pairs of word numbers; the fourth number is one more, so that none is zero."""
    if len(grams):
        words = [numbers.astype(np.int64)[g - 1] for g in grams.T]
        pairs = {"k1": words[0] << 32 | words[1]}
        if len(words) > 2:
            pairs["k2"] = words[2] << 32 | (words[3] + 1 if len(words) > 3 else 0)
        yield from _listed(PHRASES, shard, counts, **pairs)


# --- scores --------------------------------------------------------------------------------------

def counted(docs: DataFrame, least: int = LEAST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang and n; words with f and number; phrases of two to four words with f, as numbers)."""
    spark = docs.sparkSession
    text = shards(docs, size)
    totals = saved(text.filter("at IS NOT NULL").groupBy("lang").agg(F.sum("c").alias("n")), "phrase-totals")
    words = frequent_words(text, least)
    two = indexed(text, words)
    given_up(spark, text)
    pairs = shared_pairs(two, least)
    given_up(spark)
    more = extended(two, pairs)
    given_up(spark, two)
    found = saved(pairs.groupBy("k1").agg(F.first("f").alias("f")), "phrases")
    given_up(spark, pairs)
    known = found.withColumn("k2", F.lit(None).cast("long")).unionByName(frequent(more, least, "k1", "k2"))
    given_up(spark, more)
    return totals, words, known


def given_up(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove stored tables that are read no more, and let the session drop the shuffles of finished queries."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    spark.sparkContext._jvm.System.gc()


def spelled(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, its words and a."""
    low = F.lit((1 << 32) - 1)
    numbers = F.filter(F.array(
        F.shiftright("k1", 32), F.col("k1").bitwiseAND(low), F.shiftright("k2", 32),
        F.when(F.col("k2").bitwiseAND(low) > 0, F.col("k2").bitwiseAND(low) - 1)), lambda x: x.isNotNull())
    long = phrases.select("k1", "k2", "f", F.posexplode(numbers).alias("pos", "number")).join(
        words.select("number", "lang", "gram"), "number")
    return long.groupBy("k1", "k2", "f").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("_p")).select(
        "lang", F.transform("_p", lambda x: x["gram"]).alias("_w"), F.col("f").alias("a")).withColumn("phrase", F.array_join("_w", " "))


def _part(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("_w", first, length), " ")


def scored(totals: DataFrame, words: DataFrame, phrases: DataFrame, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Candidates by their lowest-scoring cut, without covered ones, the first ``top`` of every language."""
    phrases = saved(spelled(words, phrases), "phrases")
    parts = words.select("lang", "gram", "f").unionByName(phrases.select("lang", F.col("phrase").alias("gram"), F.col("a").alias("f")))
    whole = "decimal(20,0)"
    cuts = (phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)))
            .withColumns({"_l": _part(F.lit(1), F.col("k")), "_r": _part(F.col("k") + 1, F.size("_w") - F.col("k"))})
            .join(parts.select("lang", F.col("gram").alias("_l"), F.col("f").alias("l")), ["lang", "_l"])
            .join(parts.select("lang", F.col("gram").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
            .withColumn("score", F.expr(f"cast((cast(2000000 as decimal(8,0)) * cast(a as {whole})) div (cast(l as {whole}) + cast(r as {whole})) as bigint)")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    inner = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]),
                     lambda s: (s["i"] + s["n"] - 1 <= F.size("_w")) & (s["n"] < F.size("_w")))
    longer = (phrases.withColumn("_s", F.explode(inner)).select("lang", _part(F.col("_s.i"), F.col("_s.n")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("_longer")))
    covered = F.col("_longer").cast(whole) * 100 >= F.col("a").cast(whole) * cover
    kept = best.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).select(
        "lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
    in_order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the strongest phrases of every language."""
    return scored(*counted(docs, least, size), top, cover)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "text", "lang")).withColumn("rank", F.col("rank").cast("long"))


SQL = r"""
WITH p AS (SELECT lang, row_number() OVER () AS u, piece FROM (
             SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
             FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram, count(*) AS f
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS m, gram AS phrase, f AS a, string_split(gram, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
x AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS lp, array_to_string(list_slice(w, k + 1, m), ' ') AS rp
      FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
cut AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * x.a) // (l.f + r.f))::BIGINT AS score
        FROM x JOIN g l ON l.lang = x.lang AND l.gram = x.lp JOIN g r ON r.lang = x.lang AND r.gram = x.rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, w, a, s, unnest(generate_series(1, m - s + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN sub ON sub.lang = b.lang AND sub.phrase = b.phrase
         WHERE sub.longer IS NULL OR 100::HUGEINT * sub.longer < 80::HUGEINT * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""
