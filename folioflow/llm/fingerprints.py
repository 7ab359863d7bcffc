"""Document fingerprints: content-defined chunks, kept as a set of digests weighted by length."""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.llm.chunks import cuts
from folioflow.llm.common import shuffle_width

TARGET = 64


def fingerprint(text: str | None, target: int = TARGET) -> np.ndarray:
    """Sorted distinct chunk marks: 48 bits of digest, then 16 bits of length in bytes. Empty for null or ''."""
    raw = (text or "").encode("utf-8")
    marks, start = set(), 0
    for end in cuts(raw, target):
        marks.add((xxhash.xxh64_intdigest(raw[start:end]) >> 16 << 16) | (end - start))
        start = end
    return np.array(sorted(marks), dtype=np.uint64)


def to_text(marks: np.ndarray) -> str:
    return base64.b64encode(marks.astype("<u8").tobytes()).decode("ascii")


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(value), dtype="<u8")


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's bytes in chunks that b has too; 1 if both are empty, 0 if only one is."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    width = np.uint64(0xFFFF)
    return float((np.intersect1d(a, b, assume_unique=True) & width).sum()) / float((a & width).sum())


def _range_number(column: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the column; looked up in two short steps of about sqrt(len(bounds)) each."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
    inner = F.array(*[F.array(*[F.lit(v).cast("long") for v in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda v: v <= column))
    within = F.size(F.filter(F.element_at(inner, F.greatest(block, F.lit(1))), lambda v: v <= column))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * F.lit(width) + within)


def with_next_text(docs: DataFrame, per_row, schema: str, ranges: int | None = None) -> DataFrame:
    """Stream every row next to the text that follows it by ascending id (the last row meets the first), without
    an unpartitioned window: ids are dealt into ranges by quantiles, each range is sorted in its task, and a copy
    of each range's first row travels to the range before it. per_row(doc_id, text, next_text) gives an
    output row as a dict.

    Rows without an id come first; rows that share an id follow each other by text (null first)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = ranges or min(4096, max(64, 4 * shuffle_width(spark)))
    bounds = sorted({int(v) for v in rows.approxQuantile("doc_id", [i / width for i in range(1, width)], 0.25 / width)})
    number = F.coalesce(_range_number(F.col("doc_id"), bounds), F.lit(-1)).cast("int")
    firsts = sorted(rows.groupBy(number.alias("part")).agg(F.min("doc_id").alias("first")).collect(), key=lambda r: r["part"])
    heads = [(r["first"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    head = F.broadcast(spark.createDataFrame(heads, "first long, before int"))  # a row for each range: 4096 at most
    place = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guest")))
    dealt = (
        rows.withColumn("part", number)
        .join(head, rows["doc_id"].eqNullSafe(head["first"]), "left")
        .withColumn("at", F.explode(F.when(F.col("before").isNull(), place).otherwise(guest)))
        .select("at.part", "at.guest", "doc_id", "text")
        .repartition(len(firsts) or 1, "part")
        .sortWithinPartitions("part", "guest", "doc_id", "text")
    )

    def walk(batches):
        held = part = None
        for batch in batches:
            out = []
            for at, is_guest, doc_id, text in zip(*(column.to_pylist() for column in batch.columns)):
                if held is not None and part == at:
                    out.append(per_row(*held, text))
                held, part = (None if is_guest else (doc_id, text)), at
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    target = to_arrow_schema(T.StructType.fromDDL(schema))
    return dealt.mapInArrow(walk, schema)


def compare_with_edits(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """One row for each row of docs(doc_id, text): its fingerprint, that of the text whose last floor(n / 2) code
    points are replaced by the first as many of the next document's, and how much of the own fingerprint the
    edited text and the next document contain (0 to 1, by bytes).

    A null text counts as empty. Empty texts have the fingerprint '' and contain each other fully. Repeated rows
    each give a row; a table of one row follows itself; an empty table gives no rows; other columns are ignored."""

    def per_row(doc_id, text, following):
        text, following = text or "", following or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        own, changed, near = (fingerprint(t, target) for t in (text, edited, following))
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8")).hexdigest(),
            "fingerprint": to_text(own), "edited_fingerprint": to_text(changed),
            "near_edited": containment(own, changed), "near_next": containment(own, near),
        }

    return with_next_text(
        docs, per_row,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
