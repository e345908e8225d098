"""Hash-chained evidence: one serial chain per key, continued from stored heads and verified in parallel.

A hash chain is serial by nature, so what runs in parallel is chosen by key columns (a day, a sensor), never by a
number of rows. Heads (count, last sequence, last hash of each chain) are chained themselves and let
`verify_chain` report rows removed from the end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapline.operators import ordered

GENESIS = "0" * 64
CHAIN_FIELDS = ["previous_hash", "evidence_hash", "chain_sequence"]
# Alert fields that may hold JSON text.
JSON_FIELDS = ["model_scores", "protocol_evidence", "feature_values", "top_features", "threat_intel",
               "vulnerability_context", "gateway_context", "diode_health", "explanation", "reasons"]
# Output name to alert field of the compact payload.
COMPACT = {"alert_id": "alert_id", "category": "attack_category", "dst_ip": "dst_ip", "risk_level": "risk_level",
           "src_ip": "src_ip", "timestamp": "timestamp"}


def column_payload(df: DataFrame, exclude: list[str] | None = None) -> Column:
    """Our canonical form: JSON of all columns by name, nulls kept, doubles with twelve places."""
    skip = set(CHAIN_FIELDS) | set(exclude or [])
    fields = []
    for f in sorted(df.schema.fields, key=lambda x: x.name):
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            c = F.format_string("%.12f", c.cast("double"))
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def sorted_json_payload(alert_json: Column) -> Column:
    """Canonical text of alerts kept as JSON documents: sorted keys, ASCII escapes, no spaces."""

    @F.pandas_udf("string")
    def canon(col: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            body = {k: v for k, v in json.loads(text).items() if k not in CHAIN_FIELDS}
            for name in JSON_FIELDS:
                if isinstance(body.get(name), str):
                    try:
                        body[name] = json.loads(body[name])
                    except ValueError:
                        pass
            return json.dumps(body, sort_keys=True, default=str, separators=(",", ":"))

        return col.map(one, na_action="ignore")

    return canon(alert_json)


def compact_payload() -> Column:
    """The short form over six fields, in key order."""
    return F.to_json(F.struct(*[F.col(src).alias(out) for out, src in sorted(COMPACT.items())]),
                     {"ignoreNullFields": "false"})


def digest(previous: Column, payload: Column, timestamp: Column, style: str = "full") -> Column:
    if style == "compact":
        return F.sha2(F.concat(previous, F.lit(":"), payload), 256)
    return F.sha2(F.concat(previous, payload, F.coalesce(timestamp, F.lit(""))), 256)


def append_chain(df: DataFrame, order: str, payload: Column, timestamp: Column, keys: tuple[str, ...] = (),
                 style: str = "full", heads: DataFrame | None = None) -> DataFrame:
    """Chain the rows of each key in the order of the column ``order``, after the stored ``heads`` if given.

    The rows of a key are streamed sorted through one task, which holds the last hash only.
    """
    sep = ":" if style == "compact" else ""
    work = df.withColumns({"_payload": payload, "_ts": F.lit("") if style == "compact" else F.coalesce(timestamp, F.lit(""))})
    if heads is None:
        work = work.withColumns({"_head": F.lit(GENESIS), "_base": F.lit(0).cast("bigint")})
    else:
        known = heads.select(*keys, F.col("head_hash").alias("_head"), F.col("head_sequence").cast("bigint").alias("_base"))
        work = work.join(known, list(keys), "left") if keys else work.crossJoin(F.broadcast(known.limit(1)))  # one head
        work = work.withColumns({"_head": F.coalesce("_head", F.lit(GENESIS)), "_base": F.coalesce("_base", F.lit(0))})
    work = work.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""))
    kept = [c for c in df.columns if c not in CHAIN_FIELDS]
    out_schema = StructType([work.schema[c] for c in kept] + StructType.fromDDL(
        "previous_hash string, evidence_hash string, chain_sequence bigint").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = None
        place = 0
        for batch in batches:
            links: tuple[list, list, list] = ([], [], [])
            for k, text, ts, head, base in zip(*(batch.column(c).to_pylist() for c in ("_key", "_payload", "_ts", "_head", "_base"))):
                if k != key:
                    key, last, place = k, head, base
                own = hashlib.sha256((last + sep + text + ts).encode()).hexdigest()
                place += 1
                for values, v in zip(links, (last, own, place)):
                    values.append(v)
                last = own
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(links[0], pa.string()), pa.array(links[1], pa.string()),
                 pa.array(links[2], pa.int64())], names=out_schema.names)

    placed = work.repartition("_key") if keys else work.coalesce(1)
    return placed.sortWithinPartitions("_key", order).mapInArrow(run, out_schema)


def chain_heads(chained: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key: rows, last sequence and last hash."""
    return chained.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("evidence_hash", "chain_sequence").alias("head_hash"),
        F.max("chain_sequence").alias("head_sequence"))


def head_chain(heads: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The heads as one chain over keys, counts, sequences and hashes: a lost or changed head breaks it."""
    order = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    payload = F.concat_ws("|", order, *[F.col(c).cast("string") for c in ("rows", "head_sequence", "head_hash")])
    return append_chain(heads.withColumn("_place", order), "_place", payload, F.lit("")).drop("_place")


def check_links(df: DataFrame, payload: Column, timestamp: Column, style: str = "full",
                chunk: int = 10_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per row: whether its link and its payload hold. Links compare neighbours in sequence order."""
    work = df.withColumn("_chunk", F.floor(F.coalesce("chain_sequence", F.lit(0)) / chunk))
    work = ordered.previous(work, "_chunk", "chain_sequence", {"_expected": "evidence_hash"}, keys)
    return work.withColumns({
        "link_ok": F.coalesce(F.col("previous_hash") == F.coalesce("_expected", F.lit(GENESIS)), F.lit(False)),
        "payload_ok": F.coalesce(F.col("evidence_hash") == digest(F.col("previous_hash"), payload, timestamp, style),
                                 F.lit(False)),
    }).drop("_expected")


def verify_chain(df: DataFrame, payload: Column, timestamp: Column, style: str = "full", chunk: int = 10_000,
                 keys: tuple[str, ...] = (), heads: DataFrame | None = None) -> DataFrame:
    """Per key (or one row): validity, length, and the first broken position with its reason.

    With stored ``heads`` a chain that ends before its head, or is gone altogether, is broken as well.
    """
    checked = check_links(df, payload, timestamp, style, chunk, keys)
    counts = checked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).select(*keys, "_chunk", "_off")
    inside = Window.partitionBy(*keys, "_chunk").orderBy("chain_sequence")
    placed = checked.withColumn("_r", F.row_number().over(inside)).join(offsets, [*keys, "_chunk"])
    index = F.col("_off") + F.col("_r") - 1
    bad = ~F.col("link_ok") | ~F.col("payload_ok")
    out = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.when(bad, F.struct(index.alias("i"), F.col("chain_sequence").alias("s"), F.col("alert_id").alias("a"),
                                   F.col("link_ok").alias("l")))).alias("b"),
        F.max(F.struct("chain_sequence", "evidence_hash")).alias("h"))
    short = F.lit(False)
    if heads is not None:
        known = heads.select(*keys, F.col("head_sequence").alias("_hs"), F.col("head_hash").alias("_hh"))
        out = out.join(known, list(keys), "full_outer") if keys else out.crossJoin(F.broadcast(known.limit(1)))
        out = out.withColumn("count", F.coalesce("count", F.lit(0)))
        short = F.col("_hh").isNotNull() & ~F.coalesce(F.col("h.evidence_hash") == F.col("_hh"), F.lit(False))
    broken = F.col("b").isNotNull()
    seq = F.col("b.s").cast("string")
    reason = (F.when(broken & ~F.col("b.l"), F.concat(F.lit("Hash chain broken at sequence "), seq, F.lit(
                  ": previous_hash does not match preceding evidence_hash")))
              .when(broken, F.concat(F.lit("Tampered alert payload detected at sequence "), seq,
                                     F.lit(" (alert_id: "), F.col("b.a"), F.lit(")")))
              .when(short, F.concat(F.lit("Chain ends before its head at sequence "),
                                    (F.col("_hs") if heads is not None else F.lit(0)).cast("string")))
              .when(F.col("count") == 0, F.lit("empty_chain")).otherwise(F.lit("verified")))
    fine = ~broken & ~short
    return out.select(
        *keys, fine.alias("valid"), "count", F.col("b.i").alias("broken_index"), F.col("b.s").alias("broken_sequence"),
        F.col("b.a").alias("broken_alert_id"), reason.alias("reason"),
        F.when(fine, F.col("h.chain_sequence")).alias("head_sequence"), F.when(fine, F.col("h.evidence_hash")).alias("head_hash"))
