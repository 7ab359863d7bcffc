"""Queries over file metadata and security."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import metadata as M
from folioflow.plans.registry import query
from folioflow.sources.scratch import written
from folioflow.sources.tables import FILE_META, SECURITY, file_meta, file_security, load

_CLEAN = "nullif(trim(title), '')"


@query(f"WITH {FILE_META} SELECT file_id, coalesce({_CLEAN}, x_title) AS \"Title\", coalesce(nullif(author, ''), x_author) AS \"Author\", x_subject AS \"Subject\" FROM file_meta")
def j11_fill_missing(spark, sf_dir):
    f = file_meta(spark, sf_dir)
    fields = ("Title", "Author", "Subject")
    info = f.select("file_id", *[F.element_at("info", k).alias(k) for k in fields])
    xmp = f.select("file_id", *[F.element_at("xmp", k).alias(k) for k in fields])
    return M.fill_missing(info, xmp, "file_id", fields)


@query(
    f"""WITH {FILE_META} SELECT file_id, coalesce({_CLEAN}, x_title) AS title, author, x_subject AS subject, keywords, NULL::VARCHAR AS creator, NULL::VARCHAR AS producer, created AS creationdate, NULL::VARCHAR AS moddate,
      CASE WHEN trapped IN ('True', 'False', 'Unknown') THEN trapped ELSE 'Unknown' END AS trapped, custom_key AS custom FROM file_meta"""
)
def m1_read_metadata(spark, sf_dir):
    return M.read_metadata(file_meta(spark, sf_dir))


@query(
    f"""WITH {FILE_META} SELECT file_id, make_timestamp(substr(created, 3, 4)::BIGINT, substr(created, 7, 2)::BIGINT, substr(created, 9, 2)::BIGINT, substr(created, 11, 2)::BIGINT, substr(created, 13, 2)::BIGINT, substr(created, 15, 2)::DOUBLE) - INTERVAL 5 HOUR AS created_at FROM file_meta"""
)
def m2_parse_pdf_date(spark, sf_dir):
    return file_meta(spark, sf_dir).select("file_id", M.parse_pdf_date(F.element_at("info", "CreationDate")).cast("timestamp_ntz").alias("created_at"))


def _edits(f):
    edit = F.create_map(F.lit("Title"), F.when(F.col("file_id") % 3 == 0, "").otherwise("New"), F.lit("bad key"), F.lit("x"), F.lit("title"), F.lit("shadow"), F.lit("ok.key"), F.lit("v"))
    return f.where("file_id % 2 = 0").select("file_id", edit.alias("edit"))


@query(
    f"""WITH {FILE_META} SELECT file_id, CASE WHEN file_id % 2 = 1 THEN title WHEN file_id % 3 = 0 THEN NULL ELSE 'New' END AS title, CASE WHEN file_id % 2 = 0 THEN 'v' END AS ok, NULL::VARCHAR AS bad,
      len(list_filter(string_split(keywords, ','), lambda x: trim(x) <> ''))::BIGINT AS n_keywords, (5 + (CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN file_id % 6 = 0 THEN 0 ELSE 1 END))::BIGINT AS n_keys FROM file_meta"""
)
def m3_apply_metadata(spark, sf_dir):
    f = file_meta(spark, sf_dir)
    m = M.apply_metadata(f, _edits(f))
    get = lambda k: F.element_at("info", k)
    return m.select("file_id", get("Title").alias("title"), get("ok.key").alias("ok"), get("bad key").alias("bad"), F.size("keywords").cast("long").alias("n_keywords"), F.size("info").cast("long").alias("n_keys"))


@query("SELECT p_partkey AS file_id, 0::BIGINT AS n FROM part")
def m4_strip_metadata(spark, sf_dir):
    return M.strip_metadata(file_meta(spark, sf_dir)).select("file_id", (F.size("info") + F.size("xmp")).cast("long").alias("n"))


@query(f"WITH {FILE_META} SELECT file_id, CASE WHEN file_id % 10 = 0 THEN 'pages' WHEN file_id % 2 = 0 AND (file_id % 3 = 0 OR title <> 'New') THEN 'title' ELSE 'ok' END AS verdict FROM file_meta")
def m5_verify_metadata(spark, sf_dir):
    f = file_meta(spark, sf_dir)
    after = M.apply_metadata(f, _edits(f)).join(f.select("file_id", "n_pages", "xmp"), "file_id").withColumn("n_pages", F.when(F.col("file_id") % 10 == 0, F.col("n_pages") + 1).otherwise(F.col("n_pages")))
    return M.verify_metadata(f, after, stripped=False)


def _bit(n: int) -> str:
    return f"((perm_word >> {n - 1}) & 1 = 1)"


_PERMS = {
    "print": f"CASE WHEN NOT {_bit(3)} THEN 'no' WHEN rev >= 3 AND NOT {_bit(12)} THEN 'low' ELSE 'yes' END",
    "copy": f"CASE WHEN {_bit(5)} THEN 'yes' ELSE 'no' END",
    "edit": f"CASE WHEN {_bit(4)} THEN 'yes' ELSE 'no' END",
    "assemble": f"CASE WHEN CASE WHEN rev >= 3 THEN {_bit(11)} ELSE {_bit(4)} END THEN 'yes' ELSE 'no' END",
    "annot": f"CASE WHEN {_bit(6)} THEN 'yes' ELSE 'no' END",
    "forms": f"CASE WHEN CASE WHEN rev >= 3 THEN {_bit(9)} OR {_bit(6)} ELSE {_bit(6)} END THEN 'yes' ELSE 'no' END",
    "sign": f"CASE WHEN CASE WHEN rev >= 3 THEN {_bit(9)} OR {_bit(6)} ELSE {_bit(6)} END THEN 'yes' ELSE 'no' END",
    "access": f"CASE WHEN CASE WHEN rev >= 3 THEN {_bit(10)} ELSE {_bit(5)} END THEN 'yes' ELSE 'no' END",
}
_LIMITED = "len(list_filter([" + ", ".join(_PERMS.values()) + "], lambda x: x <> 'yes'))"


@query(f"WITH {SECURITY} SELECT file_id, " + ", ".join(f'{sql} AS "p_{k}"' for k, sql in _PERMS.items()) + " FROM file_security")
def m6_decode_permissions(spark, sf_dir):
    f = file_security(spark, sf_dir).withColumn("p", M.decode_permissions(F.col("perm_word"), F.col("rev")))
    return f.select("file_id", *[F.element_at("p", k).alias(f"p_{k}") for k in _PERMS])


@query(
    f"""WITH {SECURITY} SELECT file_id, CASE WHEN filter <> 'Standard' THEN filter || ' (certificate or custom security)' WHEN v >= 5 OR rev >= 5 THEN 'AES 256-bit' WHEN cfm = 'AESV2' THEN 'AES 128-bit'
      WHEN v = 1 OR rev = 2 OR length = 40 THEN 'RC4 40-bit' ELSE 'RC4 ' || length || '-bit' END AS cipher FROM file_security"""
)
def m7_cipher_name(spark, sf_dir):
    return file_security(spark, sf_dir).select("file_id", M.cipher_name(F.col("v"), F.col("rev"), F.col("cfm"), F.col("length"), F.col("filter")).alias("cipher"))


@query(
    f"""WITH {SECURITY}, r AS (SELECT *, CASE WHEN encrypted THEN {_LIMITED} ELSE 0 END::BIGINT AS restricted FROM file_security)
      SELECT file_id, restricted, CASE WHEN NOT encrypted THEN 'clear' WHEN open_state = 'locked' THEN 'needs password' WHEN restricted > 0 THEN 'restricted' ELSE 'encrypted open' END AS verdict FROM r"""
)
def m8_security_verdict(spark, sf_dir):
    return M.security_verdict(file_security(spark, sf_dir))


@query(
    f"""WITH {SECURITY}, c AS (SELECT file_id, unnest(['encryption', 'fonts', 'scripts', 'attachments', 'part', 'has fonts', 'open']) AS "check",
        unnest([NOT encrypted, n_missing = 0, NOT js, attachments = 0 OR pdfa_part >= 3, pdfa_part > 0, n_fonts > 0, open_state = 'open']) AS passed FROM file_security)
      SELECT file_id, count(*) FILTER (WHERE passed) OVER (PARTITION BY file_id)::BIGINT AS n_passed, "check", passed FROM c"""
)
def m9_pdfa_checklist(spark, sf_dir):
    return M.pdfa_checklist(file_security(spark, sf_dir))


@query(
    """SELECT p_partkey AS file_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE '1.' || p_partkey % 8 END AS version, p_partkey % 3 = 0 AS linearised,
      greatest(1, p_partkey % 4 - CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS saves FROM part"""
)
def m10_scan_markers(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.concat(F.when(k % 7 == 0, "no header").otherwise(F.concat(F.lit("%PDF-1."), (k % 8).cast("string"))), F.when(k % 3 == 0, "\n/Linearized 1").otherwise(""))
    content = F.concat(head, F.lit("\n"), F.repeat(F.lit("startxref\n"), (k % 4).cast("int"))).cast("binary")
    return load(spark, sf_dir, "part").select(k.alias("file_id"), *[c.alias(n) for n, c in M.scan_markers(content).items()])


@query(
    """WITH l AS (SELECT p_partkey, p_partkey % 4 AS m, p_partkey % 5 = 0 AS direct, p_partkey % 3 AS s FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 5 = 0)
      SELECT 'leaf' || p_partkey AS field, CASE s WHEN 0 THEN 'empty' WHEN 1 THEN 'whole' ELSE 'later changes' END AS coverage FROM l"""
)
def m11_signature_coverage(spark, sf_dir):
    k = F.col("p_partkey")
    p = load(spark, sf_dir, "part")
    leaf = p.select(F.concat(F.lit("leaf"), k).alias("field"), F.concat(F.lit("mid"), k).alias("parent"), F.when(k % 5 == 0, "Sig").alias("type"), F.lit(100).cast("long").alias("offset"),
                    F.when(k % 3 == 1, 900).when(k % 3 == 2, 500).cast("long").alias("length"), F.lit(1000).cast("long").alias("file_size"))
    mid = p.select(F.concat(F.lit("mid"), k).alias("field"), F.concat(F.lit("top"), (k % 2)).alias("parent"))
    top = spark.range(2).select(F.concat(F.lit("top"), "id").alias("field"), F.lit(None).cast("string").alias("parent"), F.when(F.col("id") == 1, "Sig").otherwise("Tx").alias("type"))
    return M.signature_coverage(leaf.unionByName(mid, allowMissingColumns=True).unionByName(top, allowMissingColumns=True), written)


@query(
    """SELECT p_size AS file_id, count(DISTINCT p_brand)::BIGINT AS fonts, coalesce(string_agg(DISTINCT CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN p_brand END, ',' ORDER BY CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN p_brand END), '') AS missing FROM part GROUP BY 1"""
)
def m12_font_embedding(spark, sf_dir):
    k = F.col("p_partkey")
    f = load(spark, sf_dir, "part").select(
        F.col("p_size").alias("file_id"), F.concat(F.when(k % 3 == 0, "QWERTY+").otherwise(""), "p_brand").alias("name"), F.when(k % 5 == 0, "Type3").when(k % 3 == 0, "Type0").otherwise("TrueType").alias("type"),
        (k % 2 == 1).alias("font_file"), (k % 2 == 1).alias("descendant_file"),
    )
    return M.font_embedding(f)


@query("SELECT p_partkey AS file_id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type END AS title FROM part")
def m13_xmp_value(spark, sf_dir):
    k = F.col("p_partkey")
    xml = F.when(k % 3 == 0, F.concat(F.lit('<rdf dc:title="'), "p_name", F.lit('"/>'))).when(k % 3 == 1, F.concat(F.lit("<dc:title>\n "), "p_type", F.lit(" </dc:title>"))).otherwise("<rdf/>")
    text = F.regexp_replace(M.xmp_value(xml, "dc:title"), r"^\s+", "")
    return load(spark, sf_dir, "part").select(k.alias("file_id"), text.alias("title"))


@query(
    f"""WITH {SECURITY}, o AS (SELECT *, CASE WHEN NOT encrypted THEN 'clear' WHEN filter <> 'Standard' THEN 'certificate' WHEN open_state = 'locked' AND file_id % 4 = 0 THEN 'password needed'
        WHEN open_state = 'locked' AND file_id % 4 = 1 THEN 'password wrong' WHEN file_id % 10 = 0 THEN 'failed' ELSE 'done' END AS outcome FROM file_security)
      SELECT file_id, outcome, CASE WHEN outcome = 'done' THEN array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {sql} <> 'yes' THEN '{k}' END" for k, sql in _PERMS.items())}], lambda x: x IS NOT NULL)), ',') END AS freed FROM o"""
)
def m14_unlock_outcome(spark, sf_dir):
    f = file_security(spark, sf_dir)
    return M.unlock_outcome(f.withColumn("password", F.when(F.col("file_id") % 4 == 0, None).when(F.col("file_id") % 4 == 1, "wrong").otherwise("right")).withColumn("pages", F.col("file_id") % 10))
