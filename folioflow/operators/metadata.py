"""Document metadata and compliance: normalising, editing, dates, permissions, ciphers, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import clean_field

# The standard information fields, permissions and their bits.
STANDARD = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
TRAPPED = ("True", "False", "Unknown")
DATE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([Zz+-])(?:(\d{2})'?(\d{2})?'?)?)?"


def fill_missing(info: DataFrame, xmp: DataFrame, key: str, fields: tuple) -> DataFrame:
    """Field by field, what info lacks or has blank comes from xmp."""
    other = xmp.select(key, *[F.col(f).alias(f"x_{f}") for f in fields])
    return info.join(other, key, "left").select(key, *[F.coalesce(F.nullif(F.trim(f), F.lit("")), F.nullif(F.trim(f"x_{f}"), F.lit(""))).alias(f) for f in fields])


def read_metadata(files: DataFrame) -> DataFrame:
    """Standard fields cleaned, gaps filled from xmp, trapped limited to its three values, other keys as a sorted custom list."""
    value = lambda m, k: F.nullif(clean_field(F.element_at(m, k)), F.lit(""))
    fields = [F.coalesce(value("info", k), value("xmp", k)).alias(k.lower()) for k in STANDARD]
    trapped = F.element_at("info", "Trapped")
    custom = F.map_filter("info", lambda k, v: ~k.isin(*STANDARD, "Trapped"))
    return files.select("file_id", *fields, F.when(trapped.isin(*TRAPPED), trapped).otherwise("Unknown").alias("trapped"), F.array_join(F.array_sort(F.map_keys(custom)), ",").alias("custom"))


def parse_pdf_date(col: Column) -> Column:
    """UTC instant of a date text; parts from the month on may be missing, without a zone it is the session's."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(col, DATE, i), F.lit("")), F.lit(default)).cast("int")
    sign = F.regexp_extract(col, DATE, 7)
    minutes = (part(8, "0") * 60 + part(9, "0")) * F.when(sign == "-", -1).when(sign == "+", 1).otherwise(0)
    at = F.try_make_timestamp(part(1, "0"), part(2, "1"), part(3, "1"), part(4, "0"), part(5, "0"), part(6, "0").cast("double"))
    return F.when(col.rlike(DATE), at - F.make_dt_interval(mins=minutes))


def apply_metadata(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (file_id, edit map): a blank value deletes its key, others are set; keys outside [A-Za-z0-9_.-] or shadowing a standard one in
    another case are ignored; keywords become a list."""
    e = files.join(edits, "file_id", "left")
    good = F.map_filter(F.coalesce("edit", F.create_map().cast("map<string,string>")), lambda k, v: k.rlike(r"^[A-Za-z0-9_.-]+$") & (k.isin(*STANDARD) | ~F.lower(k).isin(*[s.lower() for s in STANDARD])))
    kept = F.map_filter("info", lambda k, v: ~F.map_contains_key(F.col("good"), k))
    merged = F.map_concat(kept, F.map_filter("good", lambda k, v: F.trim(v) != ""))
    out = e.withColumn("good", good).withColumn("info", merged)
    words = F.filter(F.transform(F.split(F.element_at("info", "Keywords"), "[,;]"), lambda x: F.trim(x)), lambda w: w != "")
    return out.select("file_id", "info", F.coalesce(words, F.array().cast("array<string>")).alias("keywords"))


def strip_metadata(files: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return files.withColumns({"info": empty, "xmp": empty})


def verify_metadata(before: DataFrame, after: DataFrame, stripped: bool) -> DataFrame:
    """The first rule that fails: pages, title, author, or remains (after stripping); ok else."""
    a = before.select("file_id", F.col("n_pages").alias("p0"), clean_field(F.element_at("info", "Title")).alias("t0"), clean_field(F.element_at("info", "Author")).alias("a0"))
    b = after.select("file_id", F.col("n_pages").alias("p1"), clean_field(F.element_at("info", "Title")).alias("t1"), clean_field(F.element_at("info", "Author")).alias("a1"), (F.size("info") + F.size("xmp")).alias("left"))
    rule = F.when(F.col("p1").isNull() | (F.col("p0") != F.col("p1")), "pages")
    if stripped:
        rule = rule.when(F.col("left") > 0, "remains")
    else:
        rule = rule.when(~F.col("t0").eqNullSafe(F.col("t1")), "title").when(~F.col("a0").eqNullSafe(F.col("a1")), "author")
    return a.join(b, "file_id", "left").select("file_id", rule.otherwise("ok").alias("verdict"))


def decode_permissions(word: Column, rev: Column) -> Column:
    """Map from permission to no, low or yes, by the bits of the permission word and the revision."""
    bit = lambda n: F.getbit(word, F.lit(n - 1)) == 1
    new = rev >= 3
    yes = lambda c: F.when(c, "yes").otherwise("no")
    forms = F.when(new, bit(9) | bit(6)).otherwise(bit(6))
    pages = F.when(new, bit(11)).otherwise(bit(4))
    reader = F.when(new, bit(10)).otherwise(bit(5))
    return F.create_map(
        F.lit("print"), F.when(~bit(3), "no").when(new & ~bit(12), "low").otherwise("yes"), F.lit("copy"), yes(bit(5)), F.lit("edit"), yes(bit(4)), F.lit("assemble"), yes(pages),
        F.lit("annot"), yes(bit(6)), F.lit("forms"), yes(forms), F.lit("sign"), yes(forms), F.lit("access"), yes(reader),
    )


def cipher_name(v: Column, r: Column, cfm: Column, length: Column, kind: Column) -> Column:
    return (
        F.when(kind != "Standard", F.concat(kind, F.lit(" (certificate or custom security)")))
        .when((v >= 5) | (r >= 5), "AES 256-bit").when(cfm == "AESV2", "AES 128-bit").when((v == 1) | (r == 2) | (length == 40), "RC4 40-bit")
        .otherwise(F.concat(F.lit("RC4 "), F.coalesce(length, F.lit(128)).cast("string"), F.lit("-bit")))
    )


def security_verdict(files: DataFrame) -> DataFrame:
    """Restricted permissions and what they mean: needs password, restricted, encrypted but open, or clear."""
    perms = decode_permissions(F.col("perm_word"), F.col("rev"))
    limited = F.when(F.col("encrypted"), F.size(F.filter(F.map_values(perms), lambda x: x != "yes"))).otherwise(0).cast("long")
    verdict = F.when(~F.col("encrypted"), "clear").when(F.col("open_state") == "locked", "needs password").when(limited > 0, "restricted").otherwise("encrypted open")
    return files.select("file_id", limited.alias("restricted"), verdict.alias("verdict"))


def pdfa_checklist(files: DataFrame) -> DataFrame:
    """Seven archive checks a file, and how many pass."""
    checks = {
        "encryption": ~F.col("encrypted"), "fonts": F.col("n_missing") == 0, "scripts": ~F.col("js"), "attachments": (F.col("attachments") == 0) | (F.col("pdfa_part") >= 3),
        "part": F.col("pdfa_part") > 0, "has fonts": F.col("n_fonts") > 0, "open": F.col("open_state") == "open",
    }
    all_ = F.array(*[F.struct(F.lit(k).alias("check"), c.alias("passed")) for k, c in checks.items()])
    rows = files.select("file_id", all_.alias("c"))
    return rows.select("file_id", F.size(F.filter("c", lambda x: x["passed"])).cast("long").alias("n_passed"), F.explode("c").alias("x")).select("file_id", "n_passed", "x.check", "x.passed")


def scan_markers(content: Column) -> dict[str, Column]:
    """Version in the first 1024 bytes, linearised flag and number of saves of a file's bytes."""
    text = F.decode(content, "ISO-8859-1")
    linear = F.substring(text, 1, 1024).contains("/Linearized")
    saves = F.greatest(F.lit(1), F.regexp_count(text, F.lit("startxref")) - linear.cast("int"))
    return {"version": F.nullif(F.regexp_extract(F.substring(text, 1, 1024), r"%PDF-(\d\.\d)", 1), F.lit("")), "linearised": linear, "saves": saves.cast("long")}


def signature_coverage(fields: DataFrame, checkpointed) -> DataFrame:
    """Signature fields (field, parent, type, offset, length, file_size): the type may come from a parent, however far up; the signed range covers the
    whole file, leaves later changes out, or is empty."""
    from folioflow.operators.relational import resolve_inherited

    kinds = resolve_inherited(fields.select(F.col("field").alias("node"), "parent", F.col("type").alias("value")), checkpointed).select(F.col("node").alias("field"), F.col("value").alias("kind"))
    state = F.when(F.col("length").isNull(), "empty").when(F.col("offset") + F.col("length") >= F.col("file_size"), "whole").otherwise("later changes")
    leaves = fields.join(fields.select(F.col("parent").alias("field")).distinct(), "field", "left_anti")
    return leaves.join(kinds, "field").where("kind = 'Sig'").select("field", state.alias("coverage"))


def font_embedding(fonts: DataFrame) -> DataFrame:
    """Fonts and those without a font file by file; Type3 is exempt, composite fonts have their descendant's file."""
    has = F.when(F.col("type") == "Type3", True).when(F.col("type") == "Type0", F.col("descendant_file")).otherwise(F.col("font_file"))
    name = F.regexp_replace("name", r"^[A-Z]{6}\+", "")
    return fonts.groupBy("file_id").agg(F.count_distinct(name).alias("fonts"), F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce(has, F.lit(False)), name))), ",").alias("missing"))


def xmp_value(xml: Column, key: str) -> Column:
    """Attribute form first, else the element's text."""
    attr, text = F.regexp_extract(xml, rf'{key}="([^"]*)"', 1), F.regexp_extract(xml, rf"(?s)<{key}[^>]*>(.*?)</{key}>", 1)
    return F.trim(F.coalesce(F.nullif(attr, F.lit("")), F.nullif(text, F.lit(""))))


def unlock_outcome(files: DataFrame) -> DataFrame:
    """What an attempt to unlock ends in (a copy without pages has failed), and which permissions it frees."""
    perms = decode_permissions(F.col("perm_word"), F.col("rev"))
    outcome = (
        F.when(~F.col("encrypted"), "clear").when(F.col("filter") != "Standard", "certificate").when((F.col("open_state") == "locked") & F.col("password").isNull(), "password needed")
        .when((F.col("open_state") == "locked") & (F.col("password") != "right"), "password wrong").when(F.coalesce("pages", F.lit(0)) == 0, "failed").otherwise("done")
    )
    freed = F.array_join(F.array_sort(F.map_keys(F.map_filter(perms, lambda k, v: v != "yes"))), ",")
    return files.select("file_id", outcome.alias("outcome"), F.when(outcome == "done", freed).alias("freed"))
