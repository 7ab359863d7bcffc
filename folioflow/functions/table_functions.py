"""Table functions for SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# How each dialect writes one part of a range text.
SHAPES = {
    "strict": re.compile(r"([0-9]+)(?:\s*(-)\s*([0-9]+))?"),
    "swap": re.compile(r"([0-9]+)(?:\s*(-)\s*([0-9]+))?"),
    "open": re.compile(r"([0-9]+)(?:(-)([0-9]*))?"),
    "lenient": re.compile(r"(?=.*[0-9])([0-9]*)(?:\s*(-)\s*([0-9]*))?"),
}


def bounds(part: str, total: int, dialect: str) -> tuple[int, int] | None:
    """First and last page of one part; None if it is bad."""
    m = SHAPES[dialect].fullmatch(part)
    if not m:
        return None
    low = int(m[1]) if m[1] else 1
    high = (int(m[3]) if m[3] else total) if m[2] else low
    if dialect == "swap":
        low, high = min(low, high), max(low, high)
    if dialect == "lenient":
        low, high = max(low, 1), min(high, total)
    elif dialect == "open" and low <= total and low <= high:
        high = min(high, total)
    return (low, high) if 1 <= low <= high <= total else None


class ExpandRanges:
    """SELECT * FROM expand_ranges('1-3, 5', 10, 'strict'), or joined by LATERAL to a table of texts: the pages that a range text names, each
    once, in the order in which it names them. A bad part fails the text (one row with the error), but in the dialect lenient, where the
    others stay. A blank text means all pages; a null text, total or dialect gives no row. Dialects as in operators.manifest.parse_ranges."""

    def eval(self, spec: str, total: int, dialect: str):
        if spec is None or total is None or dialect is None:
            return
        text = spec.strip(" ")
        parts = [p.strip(" ") for p in (re.split(r"[,;\s]+", text) if dialect == "open" else text.split(","))]
        if dialect != "strict":
            parts = [p for p in parts if p]
        found = [bounds(p, total, dialect) for p in parts] if text else [(1, total)]
        if None in found and dialect != "lenient":
            yield None, "bad"
            return
        seen = set()
        for low, high in filter(None, found):
            for page in range(low, high + 1):
                if page not in seen:
                    seen.add(page)
                    yield page, None


def register(spark: SparkSession) -> None:
    spark.udtf.register("expand_ranges", udtf(ExpandRanges, returnType="page: bigint, error: string"))
