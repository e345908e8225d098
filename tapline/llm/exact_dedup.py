"""Exact duplicates by composable polynomial fingerprints, confirmed by chunkwise comparison.

A normalised text is cut into chunks of 64 KiB. Each chunk has a polynomial hash over two prime bases; chunk hashes
combine by length-shifted arithmetic, H(ab) = H(a) * B^|b| + H(b), so parts of a huge document can be hashed
apart: texts of ``LONG`` bytes and more send their chunks to many tasks, and an aggregate combines the hashes in order.
Copies inside one task are compared at once and only the first sends its text on, so a group that holds a third of all
rows sends about one text per task. Texts of a fingerprint that several such rows have then meet sorted in one task
(above ``HOT`` of them in salted parts, whose heads meet), which streams them and compares chunk by chunk with the
distinct texts it has seen. A group is a fingerprint and the variant that this comparison gave; SHA-256 is output only.

Defined results: null text counts as empty; empty texts form one group; a null doc_id is larger than any other; of
rows with the same text and doc_id exactly one stays; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapline.llm.common import fitting, mapped, saved, struct_of, table, texts_of

CHUNK = 1 << 16
PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353 % PRIME)
SPACE = b" \t\n\x0b\x0c\r"
SALTS = 32
LONG = 1 << 22  # bytes from which the chunks of a text are hashed by many tasks
HOT = 1024
SEEN_BYTES = 1 << 25
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    """base^(CHUNK-1) .. base^0 modulo PRIME, by doubling."""
    if base not in _POWERS:
        up = np.ones(1, np.uint64)
        while len(up) < CHUNK:
            up = np.concatenate([up, up * np.uint64(pow(base, len(up), PRIME)) % np.uint64(PRIME)])
        _POWERS[base] = up[:CHUNK][::-1].copy()
    return _POWERS[base]


def chunk_hash(part: bytes, base: int) -> int:
    data = np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)
    return int(np.dot(data, _powers(base)[CHUNK - len(part):]) % PRIME) if part else 0


def combine(left: tuple[int, int], right: tuple[int, int], base: int) -> tuple[int, int]:
    """(hash, length) of a concatenation from those of its parts; associative."""
    return (left[0] * pow(base, right[1], PRIME) + right[0]) % PRIME, left[1] + right[1]


def fingerprint(text: bytes) -> int:
    """62 bits: both hashes of the whole text."""
    sums = []
    for base in BASES:
        whole = (0, 0)
        for at in range(0, len(text), CHUNK):
            part = text[at:at + CHUNK]
            whole = combine(whole, (chunk_hash(part, base), len(part)), base)
        sums.append(whole[0])
    return sums[0] << 31 | sums[1]


def normalise(text: bytes) -> bytes:
    """Every run of white space becomes one space."""
    if not text:
        return text
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return (b" " if text[0] in SPACE else b"") + inner + (b" " if text[-1] in SPACE else b"")


def same(a: bytes, b: bytes) -> bool:
    """Chunk by chunk, ending at the first difference."""
    return len(a) == len(b) and all(a[i:i + CHUNK] == b[i:i + CHUNK] for i in range(0, len(a), CHUNK))


def fingerprinted(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: _uid, doc_id, fp, text_sha256, _like, first and, for first rows, norm.

    _like is the _uid of an earlier row of the same task that was compared and is equal, or the row's own; such rows
    of their own are first. Norm is the normalised text; it is left out where the text is among the carried columns.
    """
    kept = [F.struct(*carry).alias("_carry")] if carry else []
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *kept)
    state = {"n": 0}
    seen = Recent(SEEN_BYTES)

    def run(batch: pa.RecordBatch) -> dict:
        start = state["n"] + (TaskContext.get().partitionId() << 36)
        state["n"] += batch.num_rows
        texts = [normalise(t) for t in texts_of(batch)]
        prints = [fingerprint(t) if len(t) < LONG else None for t in texts]
        uids = range(start, start + batch.num_rows)
        like = [seen.first(~len(t) if p is None else p, t, u) for p, t, u in zip(prints, texts, uids)]
        first = [a == u for a, u in zip(like, uids)]
        norm = [t if f and "text" not in carry else None for f, t in zip(first, texts)]
        out = {"_uid": uids, "doc_id": batch.column("doc_id"), "fp": prints,
               "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "_like": like, "first": first, "norm": norm}
        return out | ({"_carry": batch.column("_carry")} if carry else {})

    schema = "_uid long, doc_id long, fp long, text_sha256 string, _like long, first boolean, norm binary"
    rows = saved(mapped(source, run, schema, struct_of(docs, carry) if carry else None), "fingerprints", "zstd")
    long = long_fingerprints(rows)
    late = rows.filter("fp IS NULL").drop("fp").join(fitting(long), "_like").select(rows.columns)
    return rows.filter("fp IS NOT NULL").unionByName(late)


def _norm(rows: DataFrame):
    """The text of first rows, as stored or carried."""
    if "_carry" in rows.columns and "text" in rows.schema["_carry"].dataType.names:
        return F.coalesce(F.col("_carry.text").cast("binary"), F.lit(b""))
    return F.col("norm")


def long_fingerprints(rows: DataFrame) -> DataFrame:
    """_like, fp of the first rows that have no fingerprint yet: their chunks are hashed apart and combined in order."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("_uid").to_pylist(), batch.column("norm").to_pylist()):
                text = normalise(text)
                for at in range(0, len(text), CHUNK * 64):
                    parts = [text[i:i + CHUNK] for i in range(at, min(at + CHUNK * 64, len(text)), CHUNK)]
                    yield pa.RecordBatch.from_pydict({"_like": [uid] * len(parts), "k": [at // CHUNK + i for i in range(len(parts))],
                                                      "part": pa.array(parts, pa.binary())})

    def hashes(batch: pa.RecordBatch) -> dict:
        parts = batch.column("part").to_pylist()
        return {"_like": batch.column("_like"), "k": batch.column("k"),
                **{f"h{i}": [chunk_hash(p, base) for p in parts] for i, base in enumerate(BASES)},
                **{f"s{i}": [pow(base, len(p), PRIME) for p in parts] for i, base in enumerate(BASES)}}

    texts = rows.filter("fp IS NULL AND first").select("_uid", _norm(rows).alias("norm"))
    chunks = texts.mapInArrow(cut, "_like long, k long, part binary").repartition(F.col("_like"), F.col("k"))
    chunks = mapped(chunks, hashes, "_like long, k long, h0 long, h1 long, s0 long, s1 long")
    lists = chunks.groupBy("_like").agg(F.sort_array(F.collect_list(F.struct("k", "h0", "h1", "s0", "s1"))).alias("c"))

    def joined(i: int):
        return F.aggregate("c", F.lit(0).cast("bigint"), lambda left, c: F.pmod(left * c[f"s{i}"] + c[f"h{i}"], F.lit(PRIME)))

    return saved(lists.select("_like", F.shiftleft(joined(0), 31).bitwiseOR(joined(1)).alias("fp")), "fingerprints-long")


class Recent:
    """Texts by key, the latest used up to a number of bytes; what falls out is compared in the next step instead."""

    def __init__(self, room: int):
        self.room, self.held, self.texts = room, 0, OrderedDict()

    def first(self, key: int, text: bytes, uid: int) -> int:
        """The uid kept for an equal text, else ``uid``, which is kept then unless another text has the key."""
        known = self.texts.get(key)
        if known is not None:
            self.texts.move_to_end(key)
            return known[1] if same(known[0], text) else uid
        self.texts[key] = text, uid
        self.held += len(text) + 200
        while self.held > self.room and len(self.texts) > 1:
            self.held -= len(self.texts.popitem(last=False)[1][0]) + 200
        return uid


def compared(texts: DataFrame) -> DataFrame:
    """_uid, fp, head (the first row of an equal text), variant, norm: texts of a (fp, salt) meet sorted in one task.

    The task streams them and holds the distinct texts of one fingerprint; norm goes on for heads of salted fingerprints.
    """
    schema = "_uid long, fp long, hot boolean, head long, variant int, norm binary"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, []
        for batch in batches:
            out = []
            names = ("_uid", "fp", "salt", "hot", "norm")
            for uid, fp, salt, hot, text in zip(*(batch.column(c).to_pylist() for c in names)):
                text = normalise(text)
                if (fp, salt) != key:
                    key, seen = (fp, salt), []
                variant = next((i for i, (known, _) in enumerate(seen) if same(text, known)), len(seen))
                if variant == len(seen):
                    seen.append((text, uid))
                head = seen[variant][1]
                out.append((uid, fp, hot, head, variant, text if hot and head == uid else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields) \
                if out else fields.empty_table().to_batches()[0]

    return texts.repartition("fp", "salt").sortWithinPartitions("fp", "salt").mapInArrow(run, schema)


def variants(rows: DataFrame) -> DataFrame:
    """_uid, variant of the rows that the comparison set apart from the first text of their fingerprint: none, as a rule.

    Fingerprints that one first row alone has need no comparison beyond that of its task. Those that more than
    ``HOT`` first rows have are compared in salted parts first, the heads of the parts then.
    """
    firsts = rows.filter("first").select("_uid", "fp", _norm(rows).alias("norm"))
    shared = saved(firsts.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1"), "fingerprints-shared")
    texts = firsts.join(fitting(shared), "fp").select(
        "_uid", "fp", "norm", F.pmod(F.xxhash64("_uid"), F.ceil(F.col("c") / HOT)).alias("salt"), (F.col("c") > HOT).alias("hot"))
    known = saved(compared(texts), "fingerprints-compared", "zstd")
    heads = known.filter("hot AND head = _uid").select(
        "_uid", "fp", "norm", F.lit(0).cast("bigint").alias("salt"), F.lit(False).alias("hot"))
    heads = saved(compared(heads), "fingerprints-heads").select(F.col("_uid").alias("head"), F.col("variant").alias("v"))
    judged = known.filter("NOT hot").select(F.col("_uid").alias("_like"), "fp", "variant").unionByName(
        known.filter("hot").join(heads, "head").select(F.col("_uid").alias("_like"), "fp", F.col("v").alias("variant")))
    apart = saved(judged.filter("variant > 0").select("_like", "variant"), "fingerprints-apart")
    return saved(rows.select("_uid", "_like").join(fitting(apart), "_like").select("_uid", "variant"), "fingerprints-variants")


def grouped(rows: DataFrame) -> DataFrame:
    """Add keep_id, group_size and kept to rows of ``fingerprinted``: groups are what the comparison found equal."""
    rows = rows.drop("norm").join(fitting(variants(rows)), "_uid", "left").withColumn(
        "variant", F.coalesce("variant", F.lit(0)))
    sums = rows.groupBy("fp", "variant").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_uid").alias("u"))).alias("_first"))
    groups = sums.filter("group_size > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.lit(SALTS)).cast("int")).join(
        groups, ["fp", "variant", "_salt"], "left")
    return out.withColumns({
        "keep_id": F.when(F.col("_first").isNull(), F.col("doc_id")).otherwise(F.col("_first.d")),
        "kept": F.coalesce(F.col("_first.u") == F.col("_uid"), F.lit(True)),
        "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprinted(table(spark, sf_dir, "documents", "doc_id", "text"))
    return grouped(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
