"""Personal data: pattern spans, and terms that the corpus shows to reveal them.

Protected entities are e-mail addresses, IP addresses, payment cards and phone numbers. For every word that shares a
document with an entity, documents are counted that hold both (c(t, e)), the entity (c(e)) and the word (c(t), over the
whole corpus). A word discloses an entity if P(e | t) = c(t, e) / (c(t) + ``PRIOR``) reaches ``POSTERIOR`` and
log2(P(e | t) / P(e)) reaches ``BITS``. The prior discounts small counts without cutting them: a word of one document
discloses an entity of that document (2/3), one of two documents needs the entity in both. Disclosing words become spans
wherever they occur; ``sanitised`` generalises them to a mark and removes those of ``REMOVE_BITS`` or more. Words are runs
of ASCII letters, digits and non-ASCII characters of any length, ASCII-lower-cased, those inside mentions too. Disclosing
words reach the tasks in broadcast blocks of at most ``BLOCK_TERMS``. A document costs its entities times its words.

Defined results: null and empty texts have no spans; a word span that touches a pattern span is dropped; repeated
rows count as documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm.common import mapped, saved, table, texts_of

KINDS = ("email", "ip", "card", "phone", "term")
PRIOR = 0.5  # documents without the entity that every word is taken to have besides its own
POSTERIOR = 0.5
BITS = 4.0
REMOVE_BITS = 12.0
BLOCK_TERMS = 500_000
COUNTER = 300_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # as the contract's; never starts inside a number
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]").search
_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else double[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Pattern spans by kind, then start."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    if _DIGIT(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255
                                                                  for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def plain_words(data: bytes) -> list[bytes]:
    return data.translate(_PLAIN).split()


def entity(text: str, span: Span) -> int:
    """A hash of the kind and the normalised value."""
    value = text[span[1]:span[2]].lower()
    if span[0] > 1:
        value = "".join(c for c in value if c.isdigit())
    return int.from_bytes(hashlib.blake2b(f"{span[0]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def mention_counts(docs: DataFrame) -> DataFrame:
    """entity, term (null: the entity itself), docs: documents that hold the entity and the term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "entity": pa.array([k[0] for k in held], pa.int64()), "term": pa.array([k[1] for k in held], pa.binary()),
                "docs": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for data in texts_of(batch):
                text = data.decode("utf-8", "replace")
                spans = base_spans(text)
                found = {None, *plain_words(data)} if spans else ()
                for e in {entity(text, span) for span in spans}:
                    held.update((e, w) for w in found)
                    if len(held) > COUNTER:
                        yield out()
                        held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "entity long, term binary, docs long").groupBy("entity", "term").agg(
        F.sum("docs").alias("docs"))


def document_counts(docs: DataFrame) -> DataFrame:
    """term, df over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"term": pa.array(list(held), pa.binary()),
                                               "df": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for text in texts_of(batch):
                held.update(set(plain_words(text)))
            if len(held) > COUNTER:
                yield out()
                held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(docs: DataFrame) -> DataFrame:
    """term, bits: words that reveal a protected entity, with the most they reveal."""
    counts = saved(mention_counts(docs), "pii-mentions")
    n = max(1, docs.select(F.lit(1)).count())
    # an entity in more documents than this cannot reach BITS whatever the word
    own = counts.filter("term IS NULL").filter(F.col("docs") * 2.0 ** BITS <= n).select("entity", F.col("docs").alias("own"))
    # of equal counts the rarest entity is disclosed most, so a word common to all entities keeps few rows
    pairs = counts.filter("term IS NOT NULL").join(own, "entity").groupBy("term", "docs").agg(F.min("own").alias("own"))
    posterior = F.col("docs") / (F.col("df") + F.lit(PRIOR))
    pairs = pairs.join(document_counts(docs), "term").withColumn("posterior", posterior)
    pairs = pairs.withColumn("bits", F.log2(F.col("posterior") / (F.col("own") / F.lit(n))))
    return saved(pairs.filter((F.col("posterior") >= POSTERIOR) & (F.col("bits") >= BITS)).groupBy("term").agg(
        F.max("bits").alias("bits")), "pii-terms")


def _blocks(terms: DataFrame) -> list:
    """Broadcasts of bounded size that together hold all disclosing terms."""
    n = -(-terms.count() // BLOCK_TERMS)
    out = []
    for i in range(n):
        part = terms.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == i) if n > 1 else terms
        out.append(terms.sparkSession.sparkContext.broadcast({bytes(r["term"]): r["bits"] for r in part.collect()}))
    return out


def term_spans(data: bytes, terms: dict[bytes, float], base: list[Span]) -> list[tuple[int, int, float]]:
    """Code-point spans of disclosing words outside the pattern spans."""
    if not terms or terms.keys().isdisjoint(data.translate(_PLAIN).split()):
        return []
    flat = data.translate(_PLAIN)
    found = [(*m.span(), terms[m.group()]) for m in _RUN.finditer(flat) if m.group() in terms]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    taken = np.zeros(int(points[-1]) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    spans = [(int(points[a]), int(points[b]), bits) for a, b, bits in found]
    return [s for s in spans if not taken[s[0]:s[1]].any()]


def _spans_of(text: bytes, blocks: list) -> tuple[list[Span], list[tuple[int, int, float]]]:
    base = base_spans(text.decode("utf-8", "replace"))
    return base, sorted(s for b in blocks for s in term_spans(text, b.value, base))


def spans(docs: DataFrame, blocks: list) -> DataFrame:
    """The contract's columns, and n_term."""
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans")}
        for text in texts_of(batch):
            base, more = _spans_of(text, blocks)
            kinds = Counter(s[0] for s in base)
            for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                out[name].append(kinds[k])
            out["n_term"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + [(4, a, b) for a, b, _ in more]))
        return out | {"doc_id": batch.column("doc_id")}

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run,
                  "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string")


def sanitised(docs: DataFrame, blocks: list) -> DataFrame:
    """doc_id and the text with pattern spans marked by kind, disclosing words marked or removed."""
    def clean(text: bytes) -> str:
        base, more = _spans_of(text, blocks)
        chars, out, at = text.decode("utf-8", "replace"), [], 0
        marks = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base]
        marks += [(a, b, "" if bits >= REMOVE_BITS else "[TERM]") for a, b, bits in more]
        for a, b, mark in sorted(marks):
            out.append(chars[at:a] + (mark if a >= at else ""))
            at = max(at, b)
        return "".join(out) + chars[at:]

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "text": [clean(t) for t in texts_of(batch)]}

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return spans(docs, _blocks(disclosing(docs)))
