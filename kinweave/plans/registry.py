"""Registered queries and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    steps = "[-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]"
    feed = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_prepend(ascii(ch)::BIGINT, {steps})))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {feed}), lambda c, x: {step}))"
