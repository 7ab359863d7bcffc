"""Queries over page manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import manifest as M
from folioflow.plans.registry import query
from folioflow.sources.tables import MANIFEST, manifest

_POS = f"""{MANIFEST}, m AS (SELECT out_id, file_id AS src, page, row_number() OVER (PARTITION BY out_id ORDER BY file_id, page) AS pos, rot, w, h, selected FROM manifest)"""


def _placed(spark, sf_dir):
    m = M.renumber(manifest(spark, sf_dir), "out_id", "file_id", "page")
    return m.select("out_id", F.col("file_id").alias("src"), "page", "pos", "rot", "w", "h", "selected")


def _roman_sql(n: str) -> str:
    def digit(names, unit):
        return f"{names!r}[{n} // {unit} % 10 + 1]"

    return f"{digit(T._THOUSANDS, 1000)} || {digit(T._HUNDREDS, 100)} || {digit(T._TENS, 10)} || {digit(T._ONES, 1)}"


@query(
    f"""WITH {MANIFEST}, s AS (SELECT *, row_number() OVER (PARTITION BY out_id ORDER BY file_id, page) AS pos FROM manifest WHERE selected),
      g AS (SELECT *, min(pos) OVER (PARTITION BY out_id, file_id) AS fp, min(file_id) OVER (PARTITION BY out_id) <> max(file_id) OVER (PARTITION BY out_id) AS several FROM s)
      SELECT out_id, file_id, page, pos, pos = fp AND several AS bookmark, lag(file_id) OVER (PARTITION BY out_id ORDER BY file_id, page) AS prev_file,
        lead(file_id) OVER (PARTITION BY out_id ORDER BY file_id, page) AS next_file FROM g"""
)
def o2_merge_manifests(spark, sf_dir):
    return M.merge_manifests(manifest(spark, sf_dir))


@query(
    f"""WITH {MANIFEST}, b AS (SELECT *, greatest(1, least(2, n_pages)) AS lo, greatest(greatest(1, least(2, n_pages)), least(9, n_pages)) AS hi FROM manifest)
      SELECT file_id, page, CASE WHEN page NOT BETWEEN lo AND hi THEN NULL WHEN page - lo < 3 THEN {_roman_sql('(page - lo + 1)')} ELSE (page - lo - 3 + 5)::VARCHAR END AS label,
        CASE WHEN page BETWEEN lo AND hi THEN n_pages END AS total FROM b"""
)
def o1_number_pages(spark, sf_dir):
    return M.number_pages(manifest(spark, sf_dir), first=2, last=9, front=3, start=5)


def _letters_sql(n: str) -> str:
    return f"CASE WHEN {n} > 702 THEN chr((97 + ({n} - 703) // 676)::INTEGER) ELSE '' END || CASE WHEN {n} > 26 THEN chr((97 + (({n} - 27) // 26) % 26)::INTEGER) ELSE '' END || chr((97 + ({n} - 1) % 26)::INTEGER)"


@query(
    f"""WITH {MANIFEST}, b AS (SELECT file_id, page, file_id + page AS n, n_pages AS t, lpad((file_id + page)::VARCHAR, greatest(3, length((file_id + page)::VARCHAR))::INTEGER, '0') AS p FROM manifest WHERE file_id + page > 0)
      SELECT file_id, page, p AS f0, 'Page ' || p AS f1, p || ' of ' || t AS f2, 'Page ' || p || ' of ' || t AS f3, p || ' / ' || t AS f4, '- ' || p || ' -' AS f5,
        CASE WHEN n BETWEEN 1 AND 3999 THEN {_roman_sql('n')} ELSE n::VARCHAR END AS f6, CASE WHEN n BETWEEN 1 AND 3999 THEN upper({_roman_sql('n')}) ELSE n::VARCHAR END AS f7,
        {_letters_sql('n')} AS f8, 'p.' || p || '/' || t AS f9 FROM b"""
)
def p17_page_label(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("n", F.col("file_id") + F.col("page")).where("n > 0")
    labels = [T.page_label(F.col("n"), F.col("n_pages"), kind, pad=3, template="p.{n}/{total}").alias(f"f{i}") for i, kind in enumerate(T.FORMATS)]
    return m.select("file_id", "page", *labels)


@query(
    f"""WITH {MANIFEST}, n AS (SELECT file_id, page, 'name' || (page % 3) || CASE WHEN page % 5 = 0 THEN '-2' ELSE '' END AS name FROM manifest),
      a AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id * 1000000 + page) AS k FROM n), b AS (SELECT *, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS given FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY given ORDER BY k, file_id * 1000000 + page) AS j FROM b)
      SELECT file_id, page, name, CASE WHEN j = 1 THEN given ELSE given || '-' || j END AS unique_name FROM c"""
)
def o3_dedupe_names(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("name", F.concat(F.lit("name"), (F.col("page") % 3).cast("string"), F.when(F.col("page") % 5 == 0, "-2").otherwise("")))
    m = m.withColumn("ord", F.col("file_id") * 1000000 + F.col("page")).select("file_id", "page", "name", "ord")
    return M.dedupe_names(m, "name", "ord").select("file_id", "page", "name", "unique_name")


@query(
    f"""WITH {MANIFEST} SELECT file_id, page, CASE WHEN n_pages >= 3 THEN (page - 1) // 3 + 1 END AS part, CASE WHEN n_pages < 3 THEN 'size' END AS error FROM manifest"""
)
def o4_split_every(spark, sf_dir):
    return M.split_every(manifest(spark, sf_dir), 3)


@query(
    f"""WITH {MANIFEST} SELECT file_id, page, coalesce(sum(CASE WHEN page % 4 = 2 THEN 1 END) OVER (PARTITION BY file_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS part FROM manifest"""
)
def o5_split_at(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return M.split_at(m, m.where("page % 4 = 2").select("file_id", "page"))


@query(
    f"""WITH {MANIFEST}, d AS (SELECT DISTINCT file_id, n_pages FROM manifest), r AS (SELECT file_id, n_pages, unnest([1, 2, 3]) AS part FROM d WHERE n_pages >= 4),
      s AS (SELECT *, CASE part WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END AS a, CASE part WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE n_pages END AS b FROM r)
      SELECT s.file_id, s.part::BIGINT AS part, m.page FROM s JOIN manifest m ON m.file_id = s.file_id AND m.page BETWEEN a AND b"""
)
def o6_split_ranges(spark, sf_dir):
    m = manifest(spark, sf_dir)
    specs = m.select("file_id", F.col("n_pages").alias("total")).distinct().where("total >= 4")
    return M.split_ranges(m, specs.withColumn("spec", F.concat(F.lit("2-3, 1-2, 4-"), F.col("total").cast("string")))).select("file_id", "part", "page")


@query(f"WITH {MANIFEST} SELECT file_id, page, page AS part FROM manifest")
def o7_split_all(spark, sf_dir):
    return manifest(spark, sf_dir).select("file_id", "page", F.col("page").alias("part"))


@query(
    f"""WITH {MANIFEST}, g AS (SELECT file_id, (page - 1) // 3 + 1 AS part, min(page) AS first, max(page) AS last FROM manifest WHERE n_pages >= 3 GROUP BY 1, 2)
      SELECT *, lpad(part::VARCHAR, 2, '0') || CASE WHEN first = last THEN '_page_' || lpad(first::VARCHAR, 3, '0') ELSE '_pages_' || lpad(first::VARCHAR, 3, '0') || '-' || lpad(last::VARCHAR, 3, '0') END || '.pdf' AS name FROM g"""
)
def o8_part_name(spark, sf_dir):
    return M.part_names(M.split_every(manifest(spark, sf_dir), 3).where("error is null"))


@query(
    f"""WITH {MANIFEST}, i AS (SELECT file_id, page, page - row_number() OVER (PARTITION BY file_id ORDER BY page) AS g FROM manifest WHERE page % 4 <> 0),
      r AS (SELECT file_id, min(page) AS a, max(page) AS b FROM i GROUP BY file_id, g)
      SELECT file_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1"""
)
def o9_collapse_ranges(spark, sf_dir):
    return M.collapse_ranges(manifest(spark, sf_dir).where("page % 4 <> 0"))


@query(f"WITH {MANIFEST} SELECT out_id, file_id, page, row_number() OVER (PARTITION BY out_id ORDER BY file_id, page) > 30 AS skipped FROM manifest WHERE selected")
def o15_page_cap(spark, sf_dir):
    return M.page_cap(manifest(spark, sf_dir), 30)


# Range texts with the pages of ten that each dialect gives; the SQL derives them from the document count alone.
SPECS = ("1-3, 5, 8-10", "5-", "-3", "3-1", "0", "99", "a", "1,,2", "2;4 6", " ", "7")
PAGES = {
    "strict": {0: [1, 2, 3, 5, 8, 9, 10], 9: list(range(1, 11)), 10: [7]},
    "open": {0: [1, 2, 3, 5, 8, 9, 10], 1: [5, 6, 7, 8, 9, 10], 7: [1, 2], 8: [2, 4, 6], 9: list(range(1, 11)), 10: [7]},
    "lenient": {0: [1, 2, 3, 5, 8, 9, 10], 1: [5, 6, 7, 8, 9, 10], 2: [1, 2, 3], 7: [1, 2], 9: list(range(1, 11)), 10: [7]},
    "swap": {0: [1, 2, 3, 5, 8, 9, 10], 3: [1, 2, 3], 7: [1, 2], 9: list(range(1, 11)), 10: [7]},
}


def _expand_sql(dialect: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {p!r}" for i, p in PAGES[dialect].items())
    return f"""WITH d AS (SELECT doc_id, CASE (doc_id % 11)::INTEGER {cases} ELSE [NULL] END AS p FROM documents), e AS (SELECT doc_id, unnest(p)::BIGINT AS page FROM d)
      SELECT doc_id, page, CASE WHEN page IS NULL THEN 'bad' END AS error FROM e {"WHERE page IS NOT NULL" if dialect == "lenient" else ""}"""


def _expand(dialect: str):
    def run(spark, sf_dir):
        from folioflow.sources.tables import load

        spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("doc_id") % 11 + 1).cast("int"))
        d = load(spark, sf_dir, "documents").select("doc_id", spec.alias("spec"), F.lit(10).cast("long").alias("total"))
        return M.expand_ranges(d, "doc_id", dialect=dialect)

    run.__name__ = f"g1_expand_ranges_{dialect}"
    return query(_expand_sql(dialect))(run)


for _dialect in M.DIALECTS:
    _expand(_dialect)


@query(" UNION ALL ".join(f"SELECT '{d}' AS dialect, * FROM ({_expand_sql(d)})" for d in M.DIALECTS))
def g1_expand_ranges_lateral(spark, sf_dir):
    """The table function joined to each text, in all dialects."""
    from folioflow.functions import table_functions
    from folioflow.sources.tables import load

    table_functions.register(spark)
    spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("doc_id") % len(SPECS) + 1).cast("int"))
    texts = load(spark, sf_dir, "documents").select("doc_id", spec.alias("spec"), F.explode(F.array(*[F.lit(d) for d in M.DIALECTS])).alias("dialect"))
    return spark.sql("SELECT dialect, doc_id, page, error FROM {texts}, LATERAL expand_ranges(spec, 10, dialect)", texts=texts)


@query(f"WITH {MANIFEST} SELECT file_id, page, 'odd' AS mode FROM manifest WHERE page % 2 = 1 UNION ALL SELECT file_id, page, 'even' FROM manifest WHERE page % 2 = 0 UNION ALL SELECT file_id, page, 'first' FROM manifest WHERE page = 1")
def g2_pick_pages(spark, sf_dir):
    m = manifest(spark, sf_dir)
    picked = [M.pick_pages(m, mode).select("file_id", "page", F.lit(mode).alias("mode")) for mode in ("odd", "even", "first")]
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


@query(
    f"""WITH {_POS}, n AS (SELECT out_id, src, page, row_number() OVER (PARTITION BY out_id ORDER BY src, page) AS pos FROM m WHERE src % 50 = 0),
      t AS (SELECT out_id, count(*) AS n_old, max(pos) AS top, (SELECT count(*) FROM n WHERE n.out_id = m.out_id) AS n_new FROM m GROUP BY 1)
      SELECT m.out_id, src, page, CASE WHEN pos >= 4 AND n_old + n_new <= 1500 THEN pos + n_new ELSE pos END AS pos, n_old + n_new > 1500 AS over FROM m JOIN t USING (out_id)
      UNION ALL SELECT n.out_id, src, page, pos + least(3, top), false FROM n JOIN t USING (out_id) WHERE n_old + n_new <= 1500"""
)
def e1_insert_pages(spark, sf_dir):
    m = _placed(spark, sf_dir)
    new = M.renumber(m.where("src % 50 = 0"), "out_id", "src", "page").select("out_id", "src", "page", "pos")
    return M.insert_pages(m.select("out_id", "src", "page", "pos"), new, 4)


@query(
    f"""WITH {_POS}, g AS (SELECT *, selected OR out_id = 'src3' AS gone FROM m), k AS (SELECT *, bool_and(gone) OVER (PARTITION BY out_id) AS refused FROM g)
      SELECT out_id, src, page, row_number() OVER (PARTITION BY out_id ORDER BY pos) AS pos, refused FROM k WHERE refused OR NOT gone"""
)
def e2_delete_pages(spark, sf_dir):
    m = _placed(spark, sf_dir)
    return M.delete_pages(m.select("out_id", "src", "page", "pos"), m.where("selected or out_id = 'src3'").select("out_id", "pos"))


@query(f"WITH {_POS}, u AS (SELECT *, 0 AS copy FROM m UNION ALL SELECT *, 1 FROM m WHERE selected) SELECT out_id, src, page, copy, row_number() OVER (PARTITION BY out_id ORDER BY pos, copy) AS pos FROM u")
def e3_duplicate_pages(spark, sf_dir):
    m = _placed(spark, sf_dir)
    return M.duplicate_pages(m.select("out_id", "src", "page", "pos"), m.where("selected").select("out_id", "pos"))


@query(
    f"""WITH {_POS}, t AS (SELECT *, max(pos) OVER (PARTITION BY out_id) AS top FROM m),
      u AS (SELECT out_id, src, page, pos, w, h, 0 AS blank FROM m UNION ALL SELECT out_id, -1, 0, pos, CASE WHEN rot % 180 = 90 THEN h ELSE w END, CASE WHEN rot % 180 = 90 THEN w ELSE h END, 1 FROM t WHERE pos = least(5, top))
      SELECT out_id, src, page, w, h, row_number() OVER (PARTITION BY out_id ORDER BY pos, blank) AS pos FROM u"""
)
def e4_insert_blank(spark, sf_dir):
    return M.insert_blank(_placed(spark, sf_dir), 5).select("out_id", "src", "page", "w", "h", "pos")


@query(f"WITH {_POS} SELECT out_id, src, page, row_number() OVER (PARTITION BY out_id ORDER BY NOT selected, pos) AS pos FROM m")
def e5_move_pages(spark, sf_dir):
    return M.move_pages(_placed(spark, sf_dir), "front").select("out_id", "src", "page", "pos")


@query(f"WITH {_POS} SELECT out_id, src, page, row_number() OVER (PARTITION BY out_id ORDER BY pos DESC) AS pos FROM m")
def e6_reverse_pages(spark, sf_dir):
    return M.reverse_pages(_placed(spark, sf_dir)).select("out_id", "src", "page", "pos")


@query(
    f"""WITH {_POS}, f AS (SELECT out_id, src, row_number() OVER (PARTITION BY out_id ORDER BY min(pos)) AS rank FROM m GROUP BY 1, 2),
      i AS (SELECT m.*, rank, row_number() OVER (PARTITION BY out_id, src ORDER BY CASE WHEN rank = 2 THEN -pos ELSE pos END) AS ix FROM m JOIN f USING (out_id, src))
      SELECT out_id, src, page, row_number() OVER (PARTITION BY out_id ORDER BY rank > 2, CASE WHEN rank <= 2 THEN ix END, CASE WHEN rank <= 2 THEN rank END, pos) AS pos FROM i"""
)
def e7_interleave(spark, sf_dir):
    return M.interleave(_placed(spark, sf_dir), reverse_second=True).select("out_id", "src", "page", "pos")


@query(f"WITH {_POS} SELECT out_id, src, page, row_number() OVER (PARTITION BY out_id ORDER BY src, page) AS pos FROM m")
def e8_original_order(spark, sf_dir):
    return M.original_order(M.reverse_pages(_placed(spark, sf_dir))).select("out_id", "src", "page", "pos")


@query(f"WITH {_POS} SELECT out_id, src, page, pos, CASE WHEN selected OR NOT bool_or(selected) OVER (PARTITION BY out_id) THEN (rot + 270) % 360 ELSE rot END AS rot FROM m")
def e9_rotate_pages(spark, sf_dir):
    return M.rotate_pages(_placed(spark, sf_dir), -90).select("out_id", "src", "page", "pos", "rot")
