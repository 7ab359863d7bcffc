"""Queries over the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import corpus as C
from folioflow.plans.registry import query
from folioflow.sources.tables import EMAILS, documents, emails, load

# The same patterns, for SQL text: quotes doubled, no look-around.
_WORD = T.WORD.replace("'", "''")
_WORDS = f"list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x))"
_TOKENS = f"list_filter(string_split_regex(text, '{T.SPACE}+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_PLAIN_SENTENCE = r"[^.!?…]*[\p{L}\p{N}][^.!?…]*(?:[.!?…]+|$)"
_ABBR = rf"(\b(?:{T.ABBREVIATIONS}))\.(\s+[\p{{L}}\p{{N}}])"


def _docs(spark, sf_dir):
    return documents(spark, sf_dir)


@query(
    f"""SELECT doc_id, len({_TOKENS})::BIGINT AS words, length_grapheme(regexp_replace(text, '[\\r\\n]+', '', 'g'))::BIGINT AS chars,
      length_grapheme(regexp_replace(text, '{T.SPACE}+', '', 'g'))::BIGINT AS chars_ns,
      len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{T.NOT_SPACE}')))::BIGINT AS paragraphs,
      len(list_distinct({_WORDS}))::BIGINT AS unique_words FROM documents"""
)
def p1_text_stats(spark, sf_dir):
    return C.text_stats(_docs(spark, sf_dir)).select("doc_id", "words", "chars", "chars_ns", "paragraphs", "unique_words")


@query(
    rf"""SELECT doc_id, list_sum(list_transform(string_split(regexp_replace(regexp_replace(text, '{_ABBR}', '\1\2', 'g'), '{_ABBR}', '\1\2', 'g'), chr(10)),
      lambda l: len(regexp_extract_all(l, '{_PLAIN_SENTENCE}'))))::BIGINT AS sentences FROM documents"""
)
def p2_sentence_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.sentence_count(F.col("text")).alias("sentences"))


def _label_sql(sec: str) -> str:
    return f"""CASE WHEN {sec} < 60 THEN {sec} || ' sec' WHEN {sec} >= 3600 THEN ({sec} // 3600) || ' hr ' || ({sec} // 60 % 60) || ' min'
      WHEN {sec} % 60 = 0 THEN ({sec} // 60) || ' min' ELSE ({sec} // 60) || ' min ' || ({sec} % 60) || ' sec' END"""


@query(
    f"""WITH w AS (SELECT doc_id, lang, len({_TOKENS}) AS words FROM documents),
      s AS (SELECT *, floor(words::DOUBLE / 238 * 60 + 0.5)::BIGINT AS read_sec, floor(words::DOUBLE / 183 * 60 + 0.5)::BIGINT AS speak_sec FROM w)
      SELECT doc_id, lang, read_sec, speak_sec, {_label_sql('read_sec')} AS read_label, {_label_sql('speak_sec')} AS speak_label,
        (sum(read_sec) OVER (PARTITION BY lang))::BIGINT AS group_read_sec FROM s"""
)
def p3_reading_time(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "lang", F.size(T.tokens(F.col("text"))).cast("double").alias("words"))
    return C.reading_time(d, "words", "lang").select("doc_id", "lang", "read_sec", "speak_sec", "read_label", "speak_label", "group_read_sec")


@query(
    """WITH l AS (SELECT source, CASE WHEN source = 'src3' THEN 0 ELSE 1000 + 100 * length(source) END AS m FROM (SELECT DISTINCT source FROM documents) WHERE source <> 'src4')
      SELECT doc_id, source, n_chars, CASE WHEN m >= 1 THEN m END::BIGINT AS max_count, least(100.0::DOUBLE, n_chars::DOUBLE / CASE WHEN m >= 1 THEN m END * 100) AS pct,
        n_chars > CASE WHEN m >= 1 THEN m END AS over, CASE WHEN m >= 1 AND n_chars > m THEN n_chars - m END::BIGINT AS over_by,
        CASE WHEN m >= 1 AND n_chars <= m THEN m - n_chars END::BIGINT AS left_over FROM documents LEFT JOIN l USING (source)"""
)
def p4_limit_report(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    m = F.when(F.col("source") == "src3", 0).otherwise(F.lit(1000) + F.length("source") * 100).cast("long").alias("max_count")
    return C.limit_report(d, "n_chars", "source", d.select("source").distinct().where("source <> 'src4'").select("source", m))


@query(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'),
      '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{T.SPACE}+|{T.SPACE}+$', '', 'g') AS cleaned FROM documents"""
)
def p5_clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '{T.SPACE}+', ' ', 'g')) AS cleaned FROM documents"""
)
def p6_clean_field(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_field(F.col("text")).alias("cleaned"))


def _entities_sql(expr: str) -> str:
    for name, value in T.NAMED_ENTITIES:
        expr = f"replace({expr}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    for mark, code in (("&#[0-9]{1,8};", "substr(m, 3, len(m) - 3)::INTEGER"), ("&#[xX][0-9a-fA-F]{1,8};", "('0x' || substr(m, 4, len(m) - 4))::INTEGER")):
        expr = f"list_reduce([{expr}] || list_distinct(regexp_extract_all({expr}, '{mark}')), lambda a, m: replace(a, m, chr({code})))"
    return f"replace({expr}, '&amp;', '&')"


@query(
    "SELECT page_id, trim(regexp_replace("
    + _entities_sql("regexp_replace(regexp_replace(regexp_replace(replace(html, '</p>', ' &#8364;&#x1F600; caf&#233; &rsquo;</p>'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")
    + f", '{T.SPACE}+', ' ', 'g')) AS text FROM pages"
)
def p7_html_to_text(spark, sf_dir):
    html = F.replace("html", F.lit("</p>"), F.lit(" &#8364;&#x1F600; caf&#233; &rsquo;</p>"))
    return load(spark, sf_dir, "pages").select("page_id", T.html_to_text(html).alias("text"))


@query(
    r"""SELECT p_partkey, substr(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || ' / ' || p_type || '.PDF', '(?i)\.pdf$', ''),
      '[\\/:*?"<>|]+', '-', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'document'), 1, 80) AS slug FROM part"""
)
def p10_slug_name(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.slug_name(F.concat("p_name", F.lit(" / "), "p_type", F.lit(".PDF"))).alias("slug"))


@query(
    r"""WITH e AS (SELECT upper(string_split(regexp_replace(url, '[?#].*$', ''), '.')[-1]) AS ext, length(html) AS n FROM pages)
      SELECT CASE WHEN length(ext) > 5 OR ext = '' THEN 'FILE' ELSE ext END AS type, count(*)::BIGINT AS files, sum(n)::BIGINT AS bytes FROM e GROUP BY 1"""
)
def p11_files_by_type(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return C.files_by_type(p, F.regexp_replace("url", r"[?#].*$", ""), F.length("html").cast("long"))


@query(
    r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0B-\x1F]')) AS bad, len(regexp_extract_all(text, '[^ \n\t]')) AS tot FROM documents)
      SELECT doc_id, tot > 30 AND bad::DOUBLE / tot > 0.3 AS garbled FROM c"""
)
def p12_garbled(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.garbled(F.col("text")).alias("garbled"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.RTL}')) > len(regexp_extract_all(text, '[A-Za-z]')) AS rtl FROM documents")
def p13_is_rtl(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.is_rtl(F.col("text")).alias("rtl"))


# Every third word of a document is given a Hebrew letter in front.
_RTL_WORDS = "list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i + doc_id) % 3 = 0 OR doc_id % 4 = 0 THEN chr(1488) || w ELSE w END)"


@query(f"WITH w AS (SELECT doc_id, {_RTL_WORDS} AS ws FROM documents) SELECT doc_id, len(list_filter(ws, lambda x: regexp_matches(x, '{T.RTL}')))::INTEGER AS rtl_items, len(list_filter(ws, lambda x: regexp_matches(x, '{T.RTL}'))) * 2 > len(ws) AS rtl_line FROM w")
def p13_rtl_items(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w, i: F.when(((i + 1 + F.col("doc_id")) % 3 == 0) | (F.col("doc_id") % 4 == 0), F.concat(F.lit(chr(1488)), w)).otherwise(w))
    d = _docs(spark, sf_dir).select("doc_id", words.alias("ws"))
    return d.select("doc_id", F.size(F.filter("ws", T.item_is_rtl)).alias("rtl_items"), T.line_is_rtl(F.col("ws")).alias("rtl_line"))


@query("SELECT doc_id, text AS folded FROM documents")
def p14_fold_presentation_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fold_presentation_forms(F.col("text")).alias("folded"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, ', ', '-' || chr(10)), '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '([^\n])\n([^\n])', '\1 \2', 'g') AS joined FROM documents"""
)
def p15_dehyphenate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.dehyphenate(F.replace(F.col("text"), F.lit(", "), F.lit("-\n"))).alias("joined"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS "at" FROM documents)
      SELECT doc_id, l."at"::BIGINT AS "at", regexp_replace(regexp_replace(trim(regexp_replace(replace(line, ', ', ' · '), '\s+', ' ', 'g')), '^[*·▪●◦]\s*|^[-–]\s+', '• '), ' [·▪●◦] ', ' • ', 'g') AS line FROM l"""
)
def p16_fix_ocr_line(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("doc_id", F.col("at").cast("long").alias("at"), T.fix_ocr_line(F.replace(F.col("line"), F.lit(", "), F.lit(" · "))).alias("line"))


@query(
    f"""WITH {EMAILS} SELECT key, email, regexp_matches(email, '{T.LOOSE_EMAIL}') AS loose, regexp_matches(email, '{T.STRICT_EMAIL.replace(chr(39), chr(39) * 2)}') AS strict FROM emails"""
)
def p19_valid_email(spark, sf_dir):
    return emails(spark, sf_dir).select("key", "email", T.valid_email(F.col("email")).alias("loose"), T.valid_email(F.col("email"), strict=True).alias("strict"))


@query("SELECT event_id, substr(sha256('salt|' || user_id || '|' || event_type), 1, 24) AS voter FROM events")
def p21_voter_key(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", T.voter_key("salt", F.col("user_id").cast("string"), F.col("event_type")).alias("voter"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), ':\d+$', ''), '^www\.', '') AS host,
      array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x NOT IN ('', '.')), '/') AS path FROM pages"""
)
def p22_normalize_url(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    return p.select("page_id", T.normalize_host(F.parse_url("url", F.lit("HOST"))).alias("host"), T.normalize_path(path).alias("path"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN trim(role) = '' OR trim(text) = '' OR text IS NULL THEN 'missing' WHEN conv_id % 5 = 0 THEN 'email'
      WHEN length(trim(text)) < 10 THEN 'short' WHEN length(trim(text)) > 5000 THEN 'long' ELSE 'ok' END AS verdict FROM conversations"""
)
def p34_validate_message(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    c = c.withColumn("email", F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 5 == 0, " at x.org").otherwise("@x.org")))
    return C.validate_message(c.withColumn("subject", F.lit("s")), "role", "email", "subject", "text").select("conv_id", "turn", "verdict")


_TOP_WORDS = f"""WITH w AS (SELECT lang, unnest({_WORDS}) AS word FROM documents), c AS (SELECT lang, word, count(*)::BIGINT AS n FROM w GROUP BY ALL),
      t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM t WHERE word NOT IN ({_STOP}) AND NOT regexp_matches(word, '{T.NUMBER_ONLY}'))
      SELECT lang, rank, word, n, floor((n * 1000)::DOUBLE / total + 0.5) / 10 AS share FROM r WHERE rank <= 10"""


@query(_TOP_WORDS)
def a1_top_words(spark, sf_dir):
    return C.top_words(_docs(spark, sf_dir), by=("lang",))


@query(_TOP_WORDS)
def a1_top_words_sketched(spark, sf_dir):
    """The same by sketches and an exact count of the words that they name."""
    from folioflow.sources.scratch import written

    return C.top_words_sketched(_docs(spark, sf_dir), written, by=("lang",))


@query(
    f"""SELECT CASE WHEN doc_id % 4 = 0 THEN 'ocr' ELSE 'text' END AS method, count(*)::BIGINT AS docs, sum(len({_TOKENS}))::BIGINT AS words, sum(n_chars)::BIGINT AS chars,
      count(*) FILTER (WHERE len({_TOKENS}) = 0)::BIGINT AS empty FROM documents GROUP BY 1"""
)
def a7_corpus_totals(spark, sf_dir):
    d = _docs(spark, sf_dir).select(
        F.when(F.col("doc_id") % 4 == 0, "ocr").otherwise("text").alias("method"), F.size(T.tokens(F.col("text"))).cast("long").alias("words"), F.col("n_chars").alias("chars")
    )
    return C.corpus_totals(d)


@query("SELECT source, sum(length(text))::BIGINT * 2 AS bytes, least(100.0::DOUBLE, (sum(length(text)) * 2)::DOUBLE / 5242880 * 100) AS pct FROM documents GROUP BY 1")
def a10_storage_usage(spark, sf_dir):
    return C.storage_usage(_docs(spark, sf_dir), "text", "source")


@query(
    """WITH f AS (SELECT doc_id, source, n_chars, ['pdf', 'txt', 'PDF', 'docx', 'exe'][doc_id % 5 + 1] AS ext FROM documents),
      g AS (SELECT *, CASE WHEN lower(ext) NOT IN ('pdf', 'docx') THEN 'type' WHEN n_chars <= 0 THEN 'empty' WHEN n_chars > 5000 THEN 'size' END AS fault FROM f),
      h AS (SELECT *, count(*) FILTER (WHERE fault IS NULL) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS place FROM g)
      SELECT doc_id, source, CASE WHEN fault IS NOT NULL THEN fault WHEN place > 20 THEN 'count' ELSE 'ok' END AS reason FROM h"""
)
def s1_admit_files(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "txt", "PDF", "docx", "exe")]), (F.col("doc_id") % 5 + 1).cast("int"))
    d = _docs(spark, sf_dir).select("doc_id", "source", "n_chars", F.concat(F.lit("f."), ext).alias("name"))
    return C.admit_files(d, "name", "n_chars", "doc_id", ("pdf", "docx"), 5000, 20, "source").select("doc_id", "source", "reason")


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS line FROM documents)
      SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || line, chr(10) || chr(10) ORDER BY page) AS text FROM l WHERE trim(line) <> '' GROUP BY doc_id"""
)
def s6_assemble_text(spark, sf_dir):
    pages = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return C.assemble_text(pages.withColumn("page", F.col("at") + 1), "doc_id", "page", "line", banner=True)


@query(
    r"""WITH c AS (SELECT *, len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{FFFD}\x00-\x08\x0B-\x1F]')) AS bad, len(regexp_extract_all(text, '[^ \n\t]')) AS tot, (doc_id % 10) / 20.0::DOUBLE AS cover FROM documents)
      SELECT doc_id, CASE WHEN tot > 30 AND bad::DOUBLE / tot > 0.3 THEN 'ocr' WHEN length(trim(text)) >= 20 THEN 'text' WHEN cover >= 0.1 THEN 'ocr' WHEN length(trim(text)) > 0 THEN 'text' ELSE 'none' END AS route FROM c"""
)
def l14_triage_pages(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("cover", (F.col("doc_id") % 10) / F.lit(20.0))
    return C.triage(d, "text", "cover").select("doc_id", "route")


def _triage_sql(wanted: str) -> str:
    return rf"""WITH c AS (SELECT *, len(regexp_extract_all(text, '[\x{{E000}}-\x{{F8FF}}\x{{FFFD}}\x00-\x08\x0B-\x1F]')) AS bad, len(regexp_extract_all(text, '[^ \n\t]')) AS tot, (doc_id % 10) / 20.0::DOUBLE AS cover, length(regexp_replace(text, '\s', '', 'g')) AS n FROM documents),
      w AS (SELECT *, {wanted} AS wanted FROM c), p AS (SELECT *, sum(wanted::INTEGER) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS place FROM w)
      SELECT doc_id, CASE WHEN wanted AND place > 50 THEN 'skipped' WHEN wanted AND doc_id % 13 = 5 THEN 'ocr failed' WHEN wanted THEN 'ocr' WHEN n > 0 THEN 'text' ELSE 'none' END AS route FROM p"""


def _triage(spark, sf_dir, mode: str):
    k = F.col("doc_id")
    d = _docs(spark, sf_dir).withColumns({"cover": (k % 10) / F.lit(20.0), "failed": k % 13 == 5, "bad_font": k % 6 == 1})
    return C.triage_with(d, mode, "source", "doc_id").select("doc_id", "route")


@query(_triage_sql("(n < 20 AND cover >= 0.1) OR (tot > 30 AND bad::DOUBLE / tot > 0.3) OR doc_id % 6 = 1"))
def l14_triage_auto(spark, sf_dir):
    return _triage(spark, sf_dir, "auto")


@query(_triage_sql("true"))
def l14_triage_all(spark, sf_dir):
    return _triage(spark, sf_dir, "all")


@query(
    """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 31 <> 0)
      SELECT doc_id, length(d.text)::BIGINT AS n_before, length(a.text)::BIGINT AS n_after, sha256(d.text) IS NOT DISTINCT FROM sha256(a.text) AS intact
      FROM documents d FULL JOIN a USING (doc_id)"""
)
def j14_verify_integrity(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "text")
    after = d.where("doc_id % 31 <> 0").withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return C.verify_integrity(d, after, "doc_id", "text")


PHRASES = [(" the ", " this "), (" of ", " from "), ("This is", "That was"), (" de ", " du ")]


@query(
    "SELECT doc_id, new_text, new_text <> text AS changed FROM (SELECT doc_id, text, "
    + "".join("replace(" for _ in PHRASES) + "text" + "".join(f", '{a}', '{b}')" for a, b in PHRASES) + " AS new_text FROM documents)"
)
def w7_replace_phrases(spark, sf_dir):
    return C.replace_phrases(_docs(spark, sf_dir), "text", PHRASES).select("doc_id", "new_text", "changed")
