"""WARC fixity audit: Merkle trees over offset ranges of archive files, compared between replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import checkpointed, release

RECORDS_PER_FILE = 256
RANGE_BITS = 16
FAN_BITS = 3
LOOSE_FILES = 4096
DATE = "2024-01-01T00:00:00Z"


def record_text(page_id: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A response record: header lines, an empty line, the body and the two empty lines that end a record. Its id is a digest of the page's
    id and address."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    name = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), url).cast("binary"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def record_index(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """file_id, page_id, start, size, digest of the record of every row of pages(page_id, url, html).

    A file holds the pages of a range of records_per_file ids in order of id, then url and digest, so that repeated ids
    have a place; rows without an id are dealt by their digest into LOOSE_FILES files with numbers below 0. Offsets are running sums
    within a file (offsets), in which equal rows, which may stand in any order, lie in as many tasks as others."""
    record = record_text(F.col("page_id").cast("long"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("digest"))
    loose = -1 - F.pmod(F.xxhash64("digest"), F.lit(LOOSE_FILES))
    rows = rows.withColumn("file_id", F.coalesce(F.floor(F.col("page_id") / records_per_file).cast("long"), loose)).select("file_id", "page_id", "url", "size", "digest")
    return offsets(rows, "page_id", "url", "digest").select("file_id", "page_id", "size", "digest", "start")


def offsets(rows: DataFrame, *order: str) -> DataFrame:
    """rows(file_id, size, ...) with the sum of the sizes before each in its file, as start.

    Rows are written, then dealt into ranges of file and order, and of their number where these are equal, so that a file of any size lies in
    as many tasks as its rows fill; each has its sum within its range, and what comes before a range in a file is a running sum over one
    row a range and file."""
    made = checkpointed(rows.withColumn("row_number", F.monotonically_increasing_id()))
    keys = ("file_id", *order, "row_number")
    dealt = made.repartitionByRange(*keys).withColumn("range", F.spark_partition_id())
    within = Window.partitionBy("range", "file_id").orderBy(*order, "row_number").rowsBetween(Window.unboundedPreceding, 0)
    placed = checkpointed(dealt.withColumn("upto", F.sum("size").over(within)))
    release(made)
    shares = placed.groupBy(F.col("range").alias("s_range"), F.col("file_id").alias("s_file")).agg(F.sum("size").alias("share"))
    before = Window.partitionBy("s_file").orderBy("s_range").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("before", F.coalesce(F.sum("share").over(before), F.lit(0)))
    met = placed.join(shares, (placed["range"] == shares["s_range"]) & (placed["file_id"] == shares["s_file"]))
    return met.select(*rows.columns, (F.col("before") + F.col("upto") - F.col("size")).alias("start"))


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(digests), lambda x: F.concat_ws(":", x["place"].cast("string"), x["digest"])), ","), 256)


def tree_levels(index: DataFrame) -> list[DataFrame]:
    """Nodes (side, file_id, node, digest) from the leaves up. A leaf covers the records that start in one range of 2^16 bytes
    of a file; a node of the next level covers 8 neighbours; the last level, as many up as the longest file needs, is the file's root. No
    group holds more than the records of one range or 8 nodes. Levels are written, for the audit reads each on its way down."""
    item = F.struct(F.col("start").alias("place"), F.concat_ws("/", F.col("size").cast("string"), "digest").alias("digest"))
    level = checkpointed(index.groupBy("side", "file_id", F.shiftright("start", RANGE_BITS).alias("node")).agg(_joined(F.collect_list(item)).alias("digest")))
    out = [level]
    for _ in range(-(-level.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0].bit_length() // FAN_BITS)):
        child = F.struct(F.col("node").alias("place"), "digest")
        level = checkpointed(level.groupBy("side", "file_id", F.shiftright("node", FAN_BITS).alias("node")).agg(_joined(F.collect_list(child)).alias("digest")))
        out.append(level)
    return out


def _below(rows: DataFrame, suspects: DataFrame, up: Column) -> DataFrame:
    s = suspects.select(F.col("file_id").alias("s_file"), F.col("node").alias("s_node"))
    return rows.join(s, rows["file_id"].eqNullSafe(s["s_file"]) & (up == s["s_node"]), "left_semi")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two indexes (file_id, start, size, digest, page_id) of the same archive differ: file_id,
    page_id, start, expected_size, found_size, expected, found and status (changed, missing or extra).

    Roots are compared by file; below a root that differs, or is on one side only, its children are compared, and so on
    down to ranges; records are compared in the ranges that differ. Equal archives give no rows."""
    columns = ["file_id", "page_id", "start", "size", "digest"]
    index = checkpointed(
        primary.select(F.lit(0).alias("side"), *columns).unionByName(replica.select(F.lit(1).alias("side"), *columns))
    )
    suspects = None
    for level in reversed(tree_levels(index)):
        if suspects is not None:
            level = _below(level, suspects, F.shiftright("node", FAN_BITS))
        sides = level.groupBy("file_id", "node").agg(F.min("digest").alias("x"), F.max("digest").alias("y"), F.count("*").alias("n"))
        suspects = checkpointed(sides.where("x <> y or n = 1").select("file_id", "node"))

    def of(side: int, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    met = _below(index, suspects, F.shiftright("start", RANGE_BITS)).groupBy("file_id", "start").agg(
        F.max("page_id").alias("page_id"), of(0, "size").alias("expected_size"), of(1, "size").alias("found_size"), of(0, "digest").alias("expected"), of(1, "digest").alias("found")
    )
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return met.where(~(F.col("expected").eqNullSafe(F.col("found")) & F.col("expected_size").eqNullSafe(F.col("found_size")))).withColumn("status", status)
