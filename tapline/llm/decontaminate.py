"""Benchmark decontamination: an Aho-Corasick automaton over normalised test items, one scan of every text.

Texts are lower-cased (A-Z) and read as words of ASCII letters, digits and all characters beyond ASCII. A window is
ten consecutive words of an item, or all words of a shorter one; the automaton holds every window as `` w1 .. wn ``
with a blank on both sides, so that matches begin and end at words. A document is normalised byte by byte, so offsets
of words lead back to the original text (`hits`).

The automaton is built in the workers from broadcast windows. Windows are counted first: beyond ``BLOCK`` (window,
item) pairs they are dealt by hash into blocks, each a bounded broadcast and one more scan, and a document's blocks
are merged by its row id. Documents are only mapped, never shuffled, while one block holds the benchmark.

Defined results: null text has no words and is not hit; a null item text gives no window, a null item_id is the item
``null``; repeated item rows are one item per id, and several items of one window all count; empty tables give empty
results or clean documents; rows are judged one by one, repeated doc_ids included.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm.common import mapped, saved, struct_of, table, texts_of

WORDS = 10
#: (window, item) pairs of one automaton: some sixty nodes of fifty bytes each.
BLOCK = 50_000
_LETTERS = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
_BUILT: dict[str, tuple] = {}


def plain(text: bytes) -> bytes:
    """The text with the same number of bytes: letters in lower case, everything that is no word a blank."""
    return text.lower().translate(_LETTERS)


def windows_of(words: list, n: int = WORDS) -> list:
    return [words[i:i + n] for i in range(len(words) - n + 1)] if len(words) > n else [words] if words else []


def windows(benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """item, window: the distinct windows of every item."""
    def run(batch: pa.RecordBatch) -> dict:
        items, found = [], []
        for item, text in zip(batch.column("item").to_pylist(), texts_of(batch)):
            own = {b" ".join(w) for w in windows_of(plain(text).split(), n)}
            items += [item] * len(own)
            found += [w.decode() for w in own]
        return {"item": items, "window": found}

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return saved(mapped(rows, run, "item string, window string").distinct(), "benchmark-windows")


def automaton(pairs: Broadcast) -> tuple:
    """(automaton or None, items of every pattern), built once per worker and block."""
    key, rows = pairs.value
    if key not in _BUILT:
        _BUILT.clear()  # one block at a time
        owners: dict[str, list[str]] = {}
        for item, window in rows:
            owners.setdefault(window, []).append(item)
        built = ahocorasick.Automaton()
        for k, window in enumerate(owners):
            built.add_word(f" {window.encode().decode('latin-1')} ", k)
        built.make_automaton()
        _BUILT[key] = (built if owners else None, list(owners.values()), [len(w.encode()) + 2 for w in owners])
    return _BUILT[key]


def matches(text: bytes, built: tuple) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of a text, its hit runs of words [first, end) in ascending order, and the items found."""
    words = plain(text).split()
    automaton_, owners, length = built
    if automaton_ is None or not words:
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    ends, kinds = [], []
    for end, k in automaton_.iter(line.decode("latin-1")):
        ends.append(end), kinds.append(k)
    if not ends:
        return len(words), [], set()
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(blanks, ends)
    first = np.searchsorted(blanks, np.array(ends) - np.array([length[k] for k in kinds]) + 1)
    return len(words), merged(zip(first.tolist(), last.tolist())), {i for k in set(kinds) for i in owners[k]}


def merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit runs of words as [start, end) code points of the original text."""
    if not runs:
        return []
    data = np.frombuffer(text, np.uint8)
    inside = np.frombuffer(plain(text), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in runs]


def scan(docs: DataFrame, pairs: Broadcast, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: n_words, runs (hit words), spans (of the original text), items, and the carried columns."""
    def run(batch: pa.RecordBatch) -> dict:
        built = automaton(pairs)
        out = {"n_words": [], "runs": [], "spans": [], "items": []}
        for text in texts_of(batch):
            n, runs, items = matches(text, built)
            out["n_words"].append(n)
            out["runs"].append([{"a": a, "b": b} for a, b in runs])
            out["spans"].append([{"a": a, "b": b} for a, b in spans(text, runs)])
            out["items"].append(sorted(items))
        return out | {"_carry": batch.column("_carry")}

    pair = "array<struct<a:long,b:long>>"
    rows = docs.select("text", F.struct(*carry).alias("_carry"))
    return mapped(rows, run, f"n_words long, runs {pair}, spans {pair}, items array<string>", struct_of(docs, carry))


def _merge(parts: list[DataFrame]) -> DataFrame:
    """The blocks' findings of a document as one row."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    union = F.udf(lambda runs: [{"a": a, "b": b} for a, b in merged((r["a"], r["b"]) for part in runs for r in part)],
                  "array<struct<a:long,b:long>>")
    return both.groupBy("_carry").agg(
        F.max("n_words").alias("n_words"), union(F.collect_list("runs")).alias("runs"), union(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, runs, spans and items of every document."""
    spark = docs.sparkSession
    pairs = windows(benchmark, n)
    blocks = max(1, math.ceil(pairs.count() / block))
    of = F.pmod(F.xxhash64("item", "window"), F.lit(blocks))
    sent = [spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in pairs.filter(of == i).collect()])) for i in range(blocks)]
    if blocks == 1:
        return scan(docs, sent[0], ("doc_id",)).select("_carry.doc_id", "n_words", "runs", "spans", "items")
    rows = saved(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_at")), "contaminated")
    found = _merge([saved(scan(rows, b, ("_at", "doc_id")), "contaminated-block") for b in sent])
    return found.select("_carry.doc_id", "n_words", "runs", "spans", "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
      FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM q),
g AS (SELECT u, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
      FROM (SELECT u, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)),
m AS (SELECT g.u, g.i, g.k, q.item FROM g JOIN q USING (k, win)),
h AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT u, i, k FROM m)) GROUP BY u),
s AS (SELECT u, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (u) LEFT JOIN s USING (u)
"""
