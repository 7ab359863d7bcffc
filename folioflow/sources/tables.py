"""Table loading, and tables derived from the driver's by fixed rules (with the SQL of each rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; timestamps without a zone become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


SMALL_SHARE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few and small to be read by all of them: below SMALL_SHARE bytes a core. Larger tables are read as
    they lie. Only where rows are worked on depends on this, never what comes out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_SHARE else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page of each document: an output per source, files by doc_id, pages of 500 characters."""
    pages = load(spark, sf_dir, "documents").select(
        F.col("source").alias("out_id"), F.col("doc_id").alias("file_id"),
        (F.lit(1) + F.floor(F.col("n_chars") / 500)).cast("long").alias("n_pages"),
    )
    m = pages.withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pages"))))
    odd = F.col("file_id") % 7 == 0
    return m.select(
        "out_id", "file_id", "page", "n_pages", (F.lit(90) * ((F.col("file_id") + F.col("page")) % 4)).alias("rot"),
        F.when(odd, 792.0).otherwise(612.0).alias("w"), F.when(odd, 612.0).otherwise(792.0).alias("h"),
        ((F.col("file_id") + F.col("page")) % 3 == 0).alias("selected"),
    )


MANIFEST = """manifest AS (
  SELECT source AS out_id, doc_id AS file_id, p.page, n_pages, 90 * ((doc_id + p.page) % 4) AS rot,
         CASE WHEN doc_id % 7 = 0 THEN 792.0::DOUBLE ELSE 612.0::DOUBLE END AS w, CASE WHEN doc_id % 7 = 0 THEN 612.0::DOUBLE ELSE 792.0::DOUBLE END AS h,
         (doc_id + p.page) % 3 = 0 AS selected
  FROM (SELECT *, 1 + n_chars // 500 AS n_pages FROM documents) d, LATERAL (SELECT unnest(range(1, n_pages + 1)) AS page) p)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned words: 8 a line, 40 lines a page; every third document in two columns of 20 lines; larger first lines;
    a repeated heading on the pages of every fifth."""
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", "[ \n]+"), lambda x: x != "")).alias("wi", "str"))
    placed = docs.select(
        "doc_id", F.floor(F.col("wi") / 320).cast("long").alias("page"), F.floor(F.col("wi") % 320 / 8).cast("long").alias("line"),
        (F.col("wi") % 8).cast("long").alias("k"), "wi", "str",
    )
    right = (F.col("doc_id") % 3 == 0) & (F.col("line") >= 20)
    heads = placed.where((F.col("wi") % 320 == 0) & (F.col("doc_id") % 5 == 0)).select(
        "doc_id", "page", F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("Report "), F.col("page").cast("string")).alias("str"),
        F.lit(72.0).alias("x"), F.lit(40.0).alias("y"), F.lit(60.0).alias("w"), F.lit(12.0).alias("size"),
    )
    body = placed.select(
        "doc_id", "page", (F.col("wi") % 320).cast("long").alias("seq"), "str",
        (F.lit(72.0) + F.col("k") * 34 + F.when(right, 290).otherwise(0)).alias("x"),
        (F.lit(72.0) + (F.col("line") - F.when(right, 20).otherwise(0)) * 16).alias("y"),
        (F.least(F.length("str"), F.lit(5)) * 6).cast("double").alias("w"),
        F.when((F.col("line") == 0), 18.0).otherwise(12.0).alias("size"),
    )
    return body.unionByName(heads)


ITEMS = r"""words AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '')) AS str,
         generate_subscripts(list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> ''), 1) - 1 AS wi FROM documents),
placed AS (SELECT doc_id, wi // 320 AS page, wi % 320 // 8 AS line, wi % 8 AS k, wi, str FROM words),
items AS (
  SELECT doc_id, page, wi % 320 AS seq, str,
         72.0::DOUBLE + k * 34 + CASE WHEN doc_id % 3 = 0 AND line >= 20 THEN 290 ELSE 0 END AS x,
         72.0::DOUBLE + (line - CASE WHEN doc_id % 3 = 0 AND line >= 20 THEN 20 ELSE 0 END) * 16 AS y,
         (least(length(str), 5) * 6)::DOUBLE AS w, CASE WHEN line = 0 THEN 18.0::DOUBLE ELSE 12.0::DOUBLE END AS size FROM placed
  UNION ALL
  SELECT doc_id, page, -1, 'Report ' || page, 72.0::DOUBLE, 40.0::DOUBLE, 60.0::DOUBLE, 12.0::DOUBLE FROM placed WHERE wi % 320 = 0 AND doc_id % 5 = 0)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grey pixels of each embedding; pages whose id divides by 17 are blank."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    grey = F.floor(F.lit(255.0) * (F.col("v").cast("double") + 0.6) / 1.2)
    return e.select(
        F.col("vec_id").alias("page_id"), (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).cast("long").alias("y"),
        F.when(F.col("vec_id") % 17 == 0, 255).otherwise(F.least(F.greatest(grey, F.lit(0)), F.lit(255))).cast("long").alias("lum"),
    )


PIXELS = """pixels AS (
  SELECT page_id, (i % 8)::BIGINT AS x, (i // 8)::BIGINT AS y,
         CASE WHEN page_id % 17 = 0 THEN 255 ELSE least(greatest(floor(255.0::DOUBLE * (v::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE), 0), 255) END::BIGINT AS lum
  FROM (SELECT vec_id AS page_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


# Fixed values of the derived label texts.
COURIER_NAMES = ("DHL", "FedEx", "UPS", "USPS", "Royal Mail", "Evri", "DPD", "GLS", "TCS", "Aramex", "Blue Dart", "none")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label texts: a courier, an SKU and a quantity from line items; every fifth is an invoice; four slots a page."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("qty"))
    part = load(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", "-").alias("name"))
    name = F.element_at(F.array(*[F.lit(c) for c in COURIER_NAMES]), (F.col("l_suppkey") % 12 + 1).cast("int"))
    ship = F.concat(F.lit("Ship To Box "), F.col("l_orderkey"), F.lit(" "), name, F.lit(" SKU: "), F.col("name"), F.lit(" Qty: "), F.col("qty"))
    bill = F.concat(F.lit("Tax Invoice No "), F.col("l_orderkey"), F.lit(" Total "), F.col("qty"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.floor(F.col("l_orderkey") / 4).cast("long").alias("page_id"), (F.col("l_orderkey") % 4 * 10 + F.col("l_linenumber")).cast("long").alias("idx"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0, bill).otherwise(ship).alias("text"),
    )


LABELS = f"""label_rows AS (
  SELECT (l_orderkey // 4)::BIGINT AS page_id, (l_orderkey % 4 * 10 + l_linenumber)::BIGINT AS idx,
         CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'Tax Invoice No ' || l_orderkey || ' Total ' || l_quantity::BIGINT
              ELSE 'Ship To Box ' || l_orderkey || ' ' || {list(COURIER_NAMES)!r}[l_suppkey % 12 + 1] || ' SKU: ' || replace(p_name, ' ', '-') || ' Qty: ' || l_quantity::BIGINT END AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.regexp_replace(F.lower("c_name"), "#", ".").alias("name"))
    domain = F.element_at(F.array(*[F.lit(d) for d in MAIL_DOMAINS]), (F.col("key") % 6 + 1).cast("int"))
    at = F.when(F.col("key") % 11 == 0, "").otherwise("@")
    return c.select("key", F.concat("name", at, domain).alias("email"))


MAIL_DOMAINS = ("example.com", "Example.org", "mail.test", "throwaway.test", "quickbox.test", "post.example.net")
EMAILS = f"""emails AS (
  SELECT c_custkey AS key, replace(lower(c_name), '#', '.') || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '@' END || {list(MAIL_DOMAINS)!r}[c_custkey % 6 + 1] AS email FROM customer)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool"), F.col("user_id").alias("voter"), (F.col("event_id") % 6 + 1).cast("long").alias("score"), "ts", "event_id"
    )


VOTES = "votes AS (SELECT event_type AS tool, user_id AS voter, (event_id % 6 + 1)::BIGINT AS score, ts, event_id FROM events)"


def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    date = F.concat(F.lit("D:20"), F.lpad((k % 25).cast("string"), 2, "0"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lpad((k % 28 + 1).cast("string"), 2, "0"),
                    F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("07+05'00'"))
    trapped = F.element_at(F.array(*[F.lit(x) for x in ("True", "False", "Unknown", "maybe", "")]), (k % 5 + 1).cast("int"))
    return load(spark, sf_dir, "part").select(
        k.alias("file_id"),
        F.create_map(
            F.lit("Title"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("p_name")), F.lit("Author"), F.col("p_brand"), F.lit("Trapped"), trapped,
            F.lit("CreationDate"), date, F.lit("Keywords"), F.regexp_replace("p_type", " ", ","), F.concat(F.lit("X-"), F.regexp_replace("p_type", " ", "_")), F.lit("custom"),
        ).alias("info"),
        F.create_map(F.lit("Title"), F.concat(F.lit("xmp "), F.col("p_name")), F.lit("Author"), F.lit("xmp author"), F.lit("Subject"), F.col("p_type")).alias("xmp"),
        (k % 9 + 1).cast("long").alias("n_pages"),
    )


FILE_META = """file_meta AS (
  SELECT p_partkey AS file_id, CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE p_name END AS title, p_brand AS author,
         ['True', 'False', 'Unknown', 'maybe', ''][p_partkey % 5 + 1] AS trapped, replace(p_type, ' ', ',') AS keywords, 'X-' || replace(p_type, ' ', '_') AS custom_key,
         'D:20' || lpad((p_partkey % 25)::VARCHAR, 2, '0') || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0')
           || lpad((p_partkey % 24)::VARCHAR, 2, '0') || lpad((p_partkey % 60)::VARCHAR, 2, '0') || '07+05''00''' AS created,
         'xmp ' || p_name AS x_title, 'xmp author' AS x_author, p_type AS x_subject, (p_partkey % 9 + 1)::BIGINT AS n_pages FROM part)"""


def file_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cfm = F.element_at(F.array(F.lit("AESV2"), F.lit("V2"), F.lit("")), (k % 3 + 1).cast("int"))
    return load(spark, sf_dir, "part").select(
        k.alias("file_id"), (k % 5 != 0).alias("encrypted"), (F.lit(-4) - k * 37 % 4096).cast("int").alias("perm_word"), (k % 4 + 2).cast("int").alias("rev"),
        (k % 5 + 1).cast("int").alias("v"), cfm.alias("cfm"), F.when(k % 6 == 0, 40).otherwise(128).cast("int").alias("length"),
        F.when(k % 13 == 0, "Adobe.PubSec").otherwise("Standard").alias("filter"),
        F.when(k % 7 == 0, "locked").otherwise("open").alias("open_state"), (k % 6).cast("long").alias("n_fonts"), (k % 3).cast("long").alias("n_missing"),
        (k % 10 == 0).alias("js"), (k % 4).cast("long").alias("attachments"), (k % 4).cast("long").alias("pdfa_part"),
    )


SECURITY = """file_security AS (
  SELECT p_partkey AS file_id, p_partkey % 5 <> 0 AS encrypted, (-4 - p_partkey * 37 % 4096)::INTEGER AS perm_word, (p_partkey % 4 + 2)::INTEGER AS rev,
         (p_partkey % 5 + 1)::INTEGER AS v, ['AESV2', 'V2', ''][p_partkey % 3 + 1] AS cfm, CASE WHEN p_partkey % 6 = 0 THEN 40 ELSE 128 END AS length,
         CASE WHEN p_partkey % 13 = 0 THEN 'Adobe.PubSec' ELSE 'Standard' END AS filter, CASE WHEN p_partkey % 7 = 0 THEN 'locked' ELSE 'open' END AS open_state,
         p_partkey % 6 AS n_fonts, p_partkey % 3 AS n_missing, p_partkey % 10 = 0 AS js, p_partkey % 4 AS attachments, p_partkey % 4 AS pdfa_part FROM part)"""
