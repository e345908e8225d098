"""Per-event protocol decoding as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapline.functions.math import let

# Flag letters with their bit, in output order.
TCP_FLAG_BITS = [("F", 0x01), ("S", 0x02), ("R", 0x04), ("P", 0x08), ("A", 0x10), ("U", 0x20)]

# TCP application protocols by port on either side; first match wins.
TCP_APP_PORTS = [
    ("MODBUS_TCP", [502]),
    ("DNP3", [20000]),
    ("IEC104", [2404]),
    ("S7COMM", [102]),
    ("HTTP", [80, 8080]),
    ("HTTPS", [443, 8443]),
    ("SSH", [22]),
    ("RDP", [3389]),
]

# UDP application protocols by destination port (DNS matches either side).
UDP_DST_PORTS = [("NTP", 123), ("SNMP", 161), ("SNMP-TRAP", 162), ("SYSLOG", 514)]

# Modbus function code groups and industrial ports.
MODBUS_WRITES = [5, 6, 15, 16, 22, 23]
MODBUS_ADDRESSED = [1, 2, 3, 4, 5, 6, 15, 16, 22, 23]
MODBUS_UNEXPECTED = [8, 43, 90, 91]
MODBUS_MAX_QUANTITY = 2000
METADATA_ONLY_PROTOCOLS = ["DNP3", "IEC104", "S7COMM"]


def flags_from_bits(bits: Column) -> Column:
    """Flag bitmask to letters in F,S,R,P,A,U order."""
    return F.concat(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(ch)).otherwise(F.lit(""))
                      for ch, b in TCP_FLAG_BITS])


def flags_from_text(text: Column) -> Column:
    """Letters found in free text, upper-cased, in F,S,R,P,A,U order."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.concat(*[F.when(up.contains(ch), F.lit(ch)).otherwise(F.lit("")) for ch, _ in TCP_FLAG_BITS])


def direction(src: Column, dst: Column, local_ips: list[str] | None) -> Column:
    """LOCAL/OUTBOUND/INBOUND/TRANSIT against a literal address list; UNKNOWN without one."""
    if not local_ips:
        return F.lit("UNKNOWN")
    return direction_from_membership(src.isin(local_ips), dst.isin(local_ips))


def direction_from_membership(src_local: Column, dst_local: Column) -> Column:
    return (F.when(src_local & dst_local, F.lit("LOCAL")).when(src_local, F.lit("OUTBOUND"))
            .when(dst_local, F.lit("INBOUND")).otherwise(F.lit("TRANSIT")))


def tcp_app(sport: Column, dport: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ports in reversed(TCP_APP_PORTS):
        out = F.when(dport.isin(ports) | sport.isin(ports), F.lit(name)).otherwise(out)
    return out


def udp_app(sport: Column, dport: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(UDP_DST_PORTS):
        out = F.when(dport == p, F.lit(name)).otherwise(out)
    return F.when((dport == 53) | (sport == 53), F.lit("DNS")).otherwise(out)


def app_protocol(proto: Column, sport: Column, dport: Column) -> Column:
    up = F.upper(proto)
    s, d = F.coalesce(sport, F.lit(-1)), F.coalesce(dport, F.lit(-1))
    return F.when(up == "TCP", tcp_app(s, d)).when(up == "UDP", udp_app(s, d))


def observable(proto: Column) -> Column:
    """Visibility tag for protocols that are seen only through metadata."""
    up = F.upper(proto)
    return F.struct(
        up.alias("protocol"),
        F.when(up.isin(METADATA_ONLY_PROTOCOLS), F.lit("metadata_only")).otherwise(F.lit("generic"))
        .alias("visibility_status"),
        F.lit(0.0).alias("protocol_anomaly_score"),
    )


def _word(hexed: Column, byte: int, width: int) -> Column:
    """Big-endian unsigned integer at a byte offset of canonical hex text."""
    return F.conv(F.substring(hexed, byte * 2 + 1, width * 2), 16, 10).cast("int")


def modbus(payload_hex: Column, quantity_check: str = "all") -> Column:
    """Decode a Modbus/TCP header from hex text into one struct.

    ``quantity_check="multi_only"`` skips the quantity rule for the single-write functions 5 and 6,
    whose fourth word is a value rather than a count.
    """
    # Spaces between byte pairs are tolerated; everything else must be hex.
    text = F.regexp_replace(payload_hex, r"\s", "")
    raw = F.when(F.length(text) % 2 == 0, F.try_to_binary(text, F.lit("hex")))
    empty = payload_hex.isNull() | (payload_hex == "")
    frame = F.struct(empty.alias("empty"), F.hex(raw).alias("h"), F.length(raw).alias("size"))

    def words(x: Column) -> Column:
        h = x["h"]
        ok = ~x["empty"] & F.coalesce(x["size"] >= 8, F.lit(False))
        fc = _word(h, 7, 1)
        return F.struct(
            x["empty"].alias("empty"), ok.alias("ok"), x["size"].alias("size"), F.when(ok, fc).alias("fc"),
            F.when(ok, _word(h, 0, 2)).alias("transaction"), F.when(ok, _word(h, 2, 2)).alias("protocol"),
            F.when(ok, _word(h, 4, 2)).alias("length"), F.when(ok, _word(h, 6, 1)).alias("unit"),
            F.when(ok & (x["size"] >= 12) & fc.isin(MODBUS_ADDRESSED), _word(h, 8, 2)).alias("address"),
            F.when(ok & (x["size"] >= 12) & fc.isin(MODBUS_ADDRESSED), _word(h, 10, 2)).alias("quantity"))

    def verdict(x: Column) -> Column:
        ok, fc, qty = x["ok"], x["fc"], x["quantity"]
        checked = ~fc.isin([5, 6]) if quantity_check == "multi_only" else F.lit(True)
        bad_qty = qty.isNotNull() & checked & ((qty == 0) | (qty > MODBUS_MAX_QUANTITY))
        bad_header = (x["protocol"] != 0) | (x["length"] != x["size"] - 6)
        malformed = (F.when(x["empty"], F.lit(0.2)).when(~ok, F.lit(1.0)).when(bad_header, F.lit(0.8))
                     .when(bad_qty, F.lit(0.7)).otherwise(F.lit(0.0)))
        unexpected = F.when(ok, F.when(fc.isin(MODBUS_UNEXPECTED), F.lit(1.0)).otherwise(F.lit(0.0)))
        write = fc.isin(MODBUS_WRITES)
        return F.struct(
            F.lit("Modbus/TCP").alias("protocol"), x["transaction"].alias("transaction_id"),
            x["protocol"].alias("protocol_id"), x["length"].alias("mbap_length"), x["unit"].alias("unit_id"),
            fc.bitwiseAND(F.lit(0x7F)).alias("function_code"),
            F.when(ok, F.when(write, F.lit("write")).otherwise(F.lit("read"))).alias("operation"),
            F.when(fc >= 0x80, F.lit(True)).alias("exception_response"),
            x["address"].alias("starting_address"), qty.alias("quantity"),
            malformed.alias("malformed_message_score"), unexpected.alias("unexpected_function_score"),
            F.when(ok, F.when(write, F.lit(0.7)).otherwise(F.lit(0.0))).alias("write_operation_risk_score"),
            F.when(x["empty"], F.lit(0.2)).when(~ok, F.lit(0.9)).otherwise(F.greatest(malformed, unexpected))
            .alias("protocol_anomaly_score"))

    return let(let(frame, words), verdict)
