"""Server name from a TLS ClientHello, without decryption."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HANDSHAKE, CLIENT_HELLO, SERVER_NAME = 0x16, 0x01, 0
FIXED_HEADER = 43  # record, handshake, version and random fields before the session id


def _take(data: bytes, at: int, width: int) -> int:
    if at + width > len(data):
        raise IndexError
    return int.from_bytes(data[at:at + width], "big")


def server_name(data: bytes | None) -> str | None:
    """Walk the three length-prefixed lists, then the extensions; any truncation means no name."""
    if data is None or len(data) < FIXED_HEADER + 1 or data[0] != HANDSHAKE or data[5] != CLIENT_HELLO:
        return None
    try:
        at = FIXED_HEADER
        for prefix in (1, 2, 1):  # session id, cipher suites, compression methods
            at += prefix + _take(data, at, prefix)
        end = min(at + 2 + _take(data, at, 2), len(data))
        at += 2
        while at + 4 <= end:
            kind, size = _take(data, at, 2), _take(data, at + 2, 2)
            at += 4
            if kind == SERVER_NAME and at + 5 <= end and data[at + 2] == 0:
                stop = at + 5 + _take(data, at + 3, 2)
                if stop <= end:
                    return data[at + 5:stop].decode("ascii", errors="ignore")
            at += size
    except IndexError:
        return None
    return None


def tls_sni(payload: Column) -> Column:
    """Server name of a binary payload column."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda b: server_name(bytes(b)) if b is not None else None)

    return run(payload)
