"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_html_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, html) of every .html file below a folder, at any depth; other files are not read. Small files are read many to a task, as
    many as spark.sql.files.maxPartitionBytes and openCostInBytes let stand together."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("html"))


def write_tree(rows: DataFrame, base: str) -> None:
    """One file for each row of rows(path, content), below a folder that all executors share. A file that is written again stays the same."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else f"file://{base}")
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                at.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with at.open_output_stream(f"{root}/{path}") as out:
                    out.write(content.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def scan_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of every url of a sitemap; lastmod is null where the file has none."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def write_parts(pages: DataFrame, path: str, part: str = "part_name") -> None:
    """One folder for each part."""
    pages.write.mode("overwrite").partitionBy(part).parquet(path)


def write_log_csv(lines: DataFrame, header: list[str], path: str) -> None:
    """Lines of a log (column `line`) under a header, with CRLF; every file starts with the header and a byte order mark."""
    head = "﻿" + ",".join(f'"{h}"' for h in header)

    def run(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([head, *rows] if first else rows, pa.string())], names=["value"])
            first = False

    lines.select("line").mapInArrow(run, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def append_usage(rows: DataFrame, path: str) -> None:
    """Usage rows, missing texts as '' and missing numbers as 0, at the end of a table."""
    rows.na.fill("").na.fill(0).write.mode("append").parquet(path)
