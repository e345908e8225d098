"""Evidence carried in the open metadata document of an event (a VARIANT column)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata keys.
OBSERVED_SOURCE_KEYS = ["observed_socket_src_ip", "observed_src_ip", "wire_src_ip", "expected_src_ip"]
SPOOF_MARKERS = ["virtual_identity", "ip_spoofing", "spoofed", "mac_ip_conflict"]
ALTERATION_MARKERS = [
    "payload_altered", "packet_altered", "checksum_mismatch",
    "ip_checksum_invalid", "tcp_checksum_invalid", "udp_checksum_invalid",
]
HASH_PAIRS = [
    ("payload_sha256", "expected_payload_sha256"),
    ("payload_hash", "expected_payload_hash"),
    ("packet_hash", "expected_packet_hash"),
]
TRUE_TEXT = ["true", "yes", "1"]


def _mentions(meta: Column, keys: list[str]) -> Column:
    """Whether the document's text contains any of the keys: a cheap test that most events fail."""
    return F.coalesce(F.to_json(meta).rlike('"(' + "|".join(keys) + ')"'), F.lit(False))


def _kind(meta: Column, key: str) -> Column:
    return F.schema_of_variant(F.variant_get(meta, f"$.{key}", "variant"))


def text(meta: Column, key: str) -> Column:
    """The value as text, or null when it is absent, empty, false or zero."""
    value = F.try_variant_get(meta, f"$.{key}", "string")
    blank = (value == "") | ((_kind(meta, key) != "STRING") & value.isin("false", "0"))
    return F.when(~blank, value)


def flag(meta: Column, *keys: str) -> Column:
    """JSON true, or text that spells true. The number 1 is not true."""

    def one(key: str) -> Column:
        kind = _kind(meta, key)
        value = F.lower(F.try_variant_get(meta, f"$.{key}", "string"))
        return F.coalesce(((kind == "BOOLEAN") & (value == "true"))
                          | ((kind == "STRING") & value.isin(TRUE_TEXT)), F.lit(False))

    return reduce(or_, [one(k) for k in keys])


def identity_mismatch(meta: Column, src_ip: Column) -> Column:
    return reduce(or_, [F.coalesce(text(meta, k) != src_ip, F.lit(False)) for k in OBSERVED_SOURCE_KEYS])


def spoofed(meta: Column, src_ip: Column) -> Column:
    exact = F.coalesce(identity_mismatch(meta, src_ip) | flag(meta, *SPOOF_MARKERS), F.lit(False))
    return F.when(_mentions(meta, [*OBSERVED_SOURCE_KEYS, *SPOOF_MARKERS]), exact).otherwise(F.lit(False))


def altered(meta: Column) -> Column:
    """Explicit markers, a failed checksum, or the first complete hash pair that differs."""
    checksum_failed = F.coalesce((_kind(meta, "checksum_valid") == "BOOLEAN")
                                 & ~F.try_variant_get(meta, "$.checksum_valid", "boolean"), F.lit(False))
    pair = F.lit(False)
    for actual, expected in reversed(HASH_PAIRS):
        a, e = text(meta, actual), text(meta, expected)
        pair = F.when(a.isNotNull() & e.isNotNull(), F.lower(a) != F.lower(e)).otherwise(pair)
    exact = F.coalesce(flag(meta, *ALTERATION_MARKERS) | checksum_failed | pair, F.lit(False))
    keys = [*ALTERATION_MARKERS, "checksum_valid", *[a for a, _ in HASH_PAIRS]]
    return F.when(_mentions(meta, keys), exact).otherwise(F.lit(False))
