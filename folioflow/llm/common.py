"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GAP = r"[\x20\x09-\x0D]+"
RUN_CHARS = 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none and all runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written into the shared folder, which survives a lost executor. Unlike a plan that goes
    through checkpoint(), a table read back has the size of its files as its size estimate, also after many rounds."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if before is not None:  # the shuffle files of this write serve nothing else
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of checkpointed() that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_apart(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns but the used ones renamed, so that none clashes with what an operator adds, and their new names."""
    names = {c: f"own_column_{i}" for i, c in enumerate(df.columns) if c not in used}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]), names


def given_back(df: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    """The columns of a table that set_apart() renamed, by their names."""
    return df.select(*[F.col(names.get(c, c)).alias(c) for c in columns])


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sample_by_class(df: DataFrame, label: str, key: Column, per_class: int) -> DataFrame:
    """About per_class rows of each class, by a threshold on a hash of the key, so that no class is ranked or
    gathered: one count per class fixes the thresholds. Rows with a null label are left out. The sample has at most 2 x classes x per_class
    rows, also where many rows share a key."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(20240229)), 1) / F.lit(float(1 << 63))
    chosen = F.lit(False)
    for value in sorted(counts):
        chosen = chosen | ((F.col(label) == F.lit(value)) & (draw < F.lit(min(1.0, per_class / counts[value]))))
    return bounded(df.where(chosen), 2 * per_class * len(counts))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """At most this many rows: all where they are no more, which is counted, else those with the smallest hashes of all their columns."""
    return df if df.count() <= most else df.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).limit(most)


def runs(texts: pa.Array, limit: int = RUN_CHARS):
    """Slices (start, texts) of a column of texts of about `limit` bytes each; null is ''."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit)))
        yield start, texts.slice(start, end - start)
        start = end


def even_runs(texts: pa.Array, limit: int = RUN_CHARS):
    """runs() of about equal size, none much smaller than the others, for work that costs something for each run."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    total = int(sizes[-1]) if len(texts) else 0
    parts = max(1, round(total / limit))
    inner = np.searchsorted(sizes, total / parts * np.arange(1, parts)) + 1
    ends = np.unique([0, *inner, len(texts)]).tolist()
    for start, end in zip(ends, ends[1:]):
        yield start, texts.slice(start, end - start)
