"""Queries over votes, labels, catalogues, dictionaries and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import relational as R
from folioflow.plans.registry import query
from folioflow.sources.tables import EMAILS, LABELS, PIXELS, VOTES, emails, label_rows, load, pixels, votes


@query(
    f"""WITH {VOTES}, l AS (SELECT tool, voter, arg_max(score, (ts, event_id)) AS score FROM votes WHERE score BETWEEN 1 AND 5 GROUP BY 1, 2),
      c AS (SELECT unnest(['click', 'purchase', 'signup', 'never used']) AS tool), s AS (SELECT tool, sum(score) AS s, count(*) AS n FROM l GROUP BY 1)
      SELECT tool, coalesce(floor((s * 10)::DOUBLE / n + 0.5) / 10, 0.0) AS average, coalesce(n, 0)::BIGINT AS votes FROM c LEFT JOIN s USING (tool)"""
)
def a2_rating_summary(spark, sf_dir):
    tools = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in ("click", "purchase", "signup", "never used")])).alias("tool"))
    return R.rating_summary(votes(spark, sf_dir), tools)


def _courier_sql(text: str = "text") -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, '(?i)(^|[^A-Za-z])" + n.replace(" ", r"\s*") + f"([^A-Za-z]|$)') THEN '{R.ALIASES.get(n, n)}'" for n in R.COURIERS
    )
    return f"CASE {cases} END"


FIELDS = rf"""{LABELS}, fields AS (SELECT *, {_courier_sql()} AS courier, nullif(regexp_replace(regexp_extract(text, '{R.SKU}', 1), '[.|]+$', ''), '') AS sku,
  coalesce(nullif(regexp_extract(text, '{R.QTY}', 1), '')::BIGINT, 1) AS qty FROM label_rows)"""


def _fields(spark, sf_dir):
    return R.label_fields(label_rows(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT page_id, idx, courier, sku, qty FROM fields")
def p32_extract_label_fields(spark, sf_dir):
    return _fields(spark, sf_dir).select("page_id", "idx", "courier", "sku", "qty")


@query(f"WITH {LABELS} SELECT page_id, idx, regexp_matches(text, '{R.INVOICE}') AND NOT regexp_matches(text, '{R.SHIPPING}') AS invoice FROM label_rows")
def p33_is_invoice(spark, sf_dir):
    return label_rows(spark, sf_dir).select("page_id", "idx", R.is_invoice(F.col("text")).alias("invoice"))


@query(f"WITH {LABELS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS n FROM label_rows) SELECT page_id, idx, n // 4 AS sheet, n % 4 // 2 AS row, n % 2 AS col FROM n")
def p31_label_cells(spark, sf_dir):
    return R.label_cells(label_rows(spark, sf_dir), 2, 2)


@query(f"WITH {FIELDS} SELECT coalesce(sku, '—') AS sku, sum(qty)::BIGINT AS qty FROM fields GROUP BY 1")
def a3_pick_list(spark, sf_dir):
    return R.pick_list(_fields(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT coalesce(courier, '—') AS courier, count(*)::BIGINT AS labels FROM fields GROUP BY 1")
def a3_courier_counts(spark, sf_dir):
    return R.courier_counts(_fields(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY lower(coalesce(courier, '~')), lower(coalesce(sku, '~')), idx) AS place FROM fields")
def o11_sort_labels(spark, sf_dir):
    return R.sort_labels(_fields(spark, sf_dir), "courier").select("page_id", "idx", "place")


@query(
    f"""WITH {LABELS}, k AS (SELECT *, CASE WHEN regexp_matches(text, '{R.INVOICE}') AND NOT regexp_matches(text, '{R.SHIPPING}') THEN 'invoice' ELSE 'label' END AS kind FROM label_rows)
      SELECT page_id, idx, kind, row_number() OVER (PARTITION BY page_id ORDER BY kind = 'invoice', idx) AS place FROM k"""
)
def e10_select_kind(spark, sf_dir):
    return R.select_kind(label_rows(spark, sf_dir), "both").select("page_id", "idx", "kind", "place")


@query("WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, min(l_extendedprice) AS quantile FROM r WHERE rn = floor(0.85::DOUBLE * (n - 1)) + 1 GROUP BY 1")
def a6_floor_quantile(spark, sf_dir):
    return R.floor_quantile(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 0.85)


@query("WITH r AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, l_extendedprice AS median FROM r WHERE rn = n // 2 + 1")
def a6_upper_median(spark, sf_dir):
    return R.upper_median(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


_SHARES = """h AS (SELECT l_orderkey, l_linenumber, [0.5, 0.25, 0.125, 0.6666, 0.3333][(l_partkey % 5 + 1)::INTEGER]::DOUBLE AS share, l_linenumber % 4 = 0 AS spouse FROM lineitem),
  t AS (SELECT *, sum(share) OVER w AS total, sum(CASE WHEN spouse THEN 0.0::DOUBLE ELSE share END) OVER w AS others FROM h WINDOW w AS (PARTITION BY l_orderkey))"""


@query(
    f"""WITH {_SHARES} SELECT l_orderkey, l_linenumber, CASE WHEN total > 1 + 1e-9 THEN share / total WHEN total < 1 - 1e-9 AND others > 0 AND NOT spouse THEN share + (1 - total) * share / others ELSE share END AS given,
      total > 1 + 1e-9 AS aul, total < 1 - 1e-9 AND others > 0 AS radd FROM t"""
)
def a14_apportion_shares(spark, sf_dir):
    share = F.element_at(F.array(*[F.lit(x) for x in (0.5, 0.25, 0.125, 0.6666, 0.3333)]), (F.col("l_partkey") % 5 + 1).cast("int"))
    h = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", share.alias("share"), (F.col("l_linenumber") % 4 == 0).alias("spouse"))
    return R.apportion_shares(h, "l_orderkey", "share", "spouse").select("l_orderkey", "l_linenumber", "given", "aul", "radd")


@query(
    """WITH f AS (SELECT *, min(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id) AS first FROM events)
      SELECT user_id, count(*)::BIGINT AS requests, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS third_party, count(*) FILTER (WHERE event_type = 'error' AND NOT regexp_matches(props, '[13]\\}'))::BIGINT AS errors,
        count(*) FILTER (WHERE ts < first AND event_type = 'signup')::BIGINT AS too_early FROM f GROUP BY 1"""
)
def a13_request_audit(spark, sf_dir):
    return R.request_audit(load(spark, sf_dir, "events"), "user_id", "event_type", "props", r"[13]\}")


@query(
    r"""WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'É' ELSE 'e' END || p_type || ' img' || CASE WHEN p_partkey % 7 = 0 THEN '00' ELSE '' END || p_partkey % 200 AS name FROM part),
      k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(strip_accents(lower(name)), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(len(ltrim(p, '0'))::VARCHAR, 9, '0') || ltrim(p, '0') ELSE p END), '') AS k FROM n)
      SELECT p_partkey, name, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_partkey) AS place FROM k"""
)
def o10_natural_sort(spark, sf_dir):
    from pyspark.sql import Window

    head = F.when(F.col("p_partkey") % 3 == 0, F.lit("É")).otherwise("e")
    zeros = F.when(F.col("p_partkey") % 7 == 0, F.lit("00")).otherwise("")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(head, "p_type", F.lit(" img"), zeros, (F.col("p_partkey") % 200).cast("string")).alias("name"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(R.natural_key(F.col("name")), "p_partkey"))
    return p.select("p_partkey", "name", place.cast("long").alias("place"))


_NAMED = "n AS (SELECT *, event_type || '-' || event_id % 23 AS name FROM events)"


def _named(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("name", F.concat("event_type", F.lit("-"), (F.col("event_id") % 23).cast("string")))


@query(
    f"""WITH {_NAMED}, l AS (SELECT user_id, name, max((ts, event_id)) AS l FROM n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY l DESC) AS rn FROM l),
      p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS place FROM r WHERE rn <= 30 AND strpos(lower(name), 'click') > 0)
      SELECT user_id, name, place, l[2] AS event_id FROM p WHERE place <= 12"""
)
def o13_recent_docs(spark, sf_dir):
    return R.recent_docs(_named(spark, sf_dir), "user_id", 30, 12, "Click")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def o14_cap_log(spark, sf_dir):
    return R.cap_log(load(spark, sf_dir, "events"), "user_id", 5).select("event_id", "user_id")


@query(
    f"""WITH {_NAMED}, o AS (SELECT user_id, name, count(*) AS c, max((ts, event_id)) AS l FROM n GROUP BY 1, 2)
      SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY l DESC) AS place FROM o WHERE c % 2 = 1 AND name IN (SELECT DISTINCT name FROM n WHERE name NOT LIKE 'error%')"""
)
def o16_favourites(spark, sf_dir):
    n = _named(spark, sf_dir)
    return R.favourites(n, "user_id", "name", n.where("name not like 'error%'").select("name").distinct())


@query("SELECT p_partkey, p_name FROM part WHERE strpos(lower(p_name), 'steel') > 0 OR strpos(lower(p_brand), 'steel') > 0 OR lower(p_brand) = 'steel' OR strpos(lower(p_type), 'steel') > 0 ORDER BY p_partkey LIMIT 12")
def o17_search_catalogue(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("keywords"))
    return R.search_catalogue(p, "Steel", 12).select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def j1_keep_known(spark, sf_dir):
    known = spark.range(1).select(F.explode(F.array(F.lit("click"), F.lit("view"))).alias("event_type"))
    return R.keep_known(load(spark, sf_dir, "events"), known, "event_type").select("event_id")


_BLOCK = "strpos(email, '@') > 0 AND lower(string_split(email, '@')[-1]) IN ('throwaway.test', 'quickbox.test')"


@query(f"WITH {EMAILS} SELECT key, strpos(email, '@') > 0 AS server FROM emails WHERE NOT ({_BLOCK})")
def j2_drop_blocked(spark, sf_dir):
    blocked = spark.range(1).select(F.explode(F.array(F.lit("throwaway.test"), F.lit("quickbox.test"))).alias("domain"))
    kept = R.drop_blocked(emails(spark, sf_dir), "email", blocked, keep_without_at=True)
    strict = R.drop_blocked(emails(spark, sf_dir), "email", blocked, keep_without_at=False).select("key", F.lit(True).alias("server"))
    return kept.select("key").join(strict, "key", "left").select("key", F.coalesce("server", F.lit(False)).alias("server"))


# A dictionary with gaps and an empty text.
WORDS = [("en", "src0", "First", 1), ("en", "src1", "Second", 2), ("en", "src2", "", 3), ("fr", "src0", "Premier", 4), ("fr", "src1", "", 5), ("de", "src2", "Dritte", 6), ("en", "src4", "First", 7)]
_WORDS_SQL = f"i18n(lang, key, value, ord) AS (VALUES {', '.join(map(str, WORDS))})"


def _words(spark):
    return spark.createDataFrame(WORDS, "lang string, key string, value string, ord int")


@query(
    f"""WITH {_WORDS_SQL} SELECT doc_id, d.lang, source, coalesce(nullif(a.value, ''), nullif(b.value, ''), source) AS translated FROM documents d
      LEFT JOIN i18n a ON a.lang = d.lang AND a.key = source LEFT JOIN i18n b ON b.lang = 'en' AND b.key = source"""
)
def j3_translate(spark, sf_dir):
    return R.translate(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _words(spark), "lang", "source")


@query(f"WITH {_WORDS_SQL}, t AS (SELECT doc_id, ['First', ' Second ', 'Other'][doc_id % 3 + 1] AS txt FROM documents) SELECT doc_id, txt, (SELECT arg_max(key, ord) FROM i18n WHERE lang = 'en' AND trim(value) = trim(txt)) AS found_key FROM t")
def j4_reverse_lookup(spark, sf_dir):
    txt = F.element_at(F.array(F.lit("First"), F.lit(" Second "), F.lit("Other")), (F.col("doc_id") % 3 + 1).cast("int"))
    return R.reverse_lookup(load(spark, sf_dir, "documents").select("doc_id", txt.alias("txt")), _words(spark).where("lang = 'en'"), "txt").select("doc_id", "txt", "found_key")


@query("SELECT event_id, event_id IN (SELECT event_id FROM events WHERE event_id % 3 = 0) AS is_read FROM events WHERE event_type = 'signup'")
def j12_read_flags(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return R.read_flags(e.where("event_type = 'signup'").select("event_id"), e.where("event_id % 3 = 0").select("event_id"), "event_id")


_TREE = """tree(node, parent, value) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_name END FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, CASE WHEN r_regionkey <> 2 THEN r_name END FROM region)"""


def _tree(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("value"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("value"))
    r = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("value"))
    return c.unionByName(n).unionByName(r)


@query(
    f"""WITH RECURSIVE {_TREE}, up AS (SELECT node, parent AS up_node, value, 0 AS depth FROM tree UNION ALL SELECT up.node, t.parent, t.value, depth + 1 FROM up JOIN tree t ON t.node = up.up_node WHERE up.value IS NULL AND depth < 12)
      SELECT node, max(value) AS value, CASE WHEN max(value) IS NOT NULL THEN max(depth) END::INTEGER AS depth FROM up GROUP BY node"""
)
def j17_resolve_inherited(spark, sf_dir):
    from folioflow.sources.scratch import written

    return R.resolve_inherited(_tree(spark, sf_dir), written)


@query(
    f"""WITH RECURSIVE {_TREE}, o AS (SELECT node, parent, length(node) * 7 % 5 + ascii(right(node, 1)) % 7 AS page FROM tree), alive AS (SELECT * FROM o WHERE page NOT IN (1, 2, 3, 4, 5, 6)),
      k(node, parent) AS (SELECT node, parent FROM alive UNION SELECT o.node, o.parent FROM k JOIN o ON o.node = k.parent) SELECT DISTINCT node FROM k"""
)
def j18_prune_outline(spark, sf_dir):
    from folioflow.sources.scratch import written

    page = F.length("node") * 7 % 5 + F.ascii(F.right("node", F.lit(1))) % 7
    deleted = spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in range(1, 7)])).alias("page"))
    return R.prune_outline(_tree(spark, sf_dir).select("node", "parent", page.alias("page")), deleted, written).select("node")


_STEPS = "s AS (SELECT * FROM (VALUES (1, 180), (2, 144), (3, 110), (4, 90), (5, 72), (6, 60)) v(ord, dpi), (VALUES (9), (7), (5)) w(q))"


@query(
    f"""WITH {_STEPS}, c AS (SELECT p_partkey, ord, q, (p_size * dpi * dpi * q // 10)::BIGINT AS size FROM part, s),
      b AS (SELECT p_partkey, min((ord, -q, size)) FILTER (WHERE size <= 200000) AS f, min((size, ord, -q)) AS s FROM c GROUP BY 1)
      SELECT p_partkey, coalesce(f[1], s[2]) AS ord, -coalesce(f[2], s[3]) AS q, coalesce(f[3], s[1]) AS size, f IS NOT NULL AS met FROM b"""
)
def k1_best_under_budget(spark, sf_dir):
    steps = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d).alias("dpi")) for i, d in enumerate((180, 144, 110, 90, 72, 60), 1)])
    c = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(steps).alias("s")).select("p_partkey", "p_size", "s.*", F.explode(F.array(F.lit(9), F.lit(7), F.lit(5))).alias("q"))
    size = F.floor(F.col("p_size").cast("long") * F.col("dpi") * F.col("dpi") * F.col("q") / 10)
    return R.best_under_budget(c.withColumn("size", size), "p_partkey", 200000)


@query(
    """WITH c AS (SELECT p_brand, p_size * 100 AS o, p_size * 100 * (80 + p_partkey % 25) // 100 AS n, p_partkey % 2 = 0 AS img, p_partkey % 7 = 0 AS mask, p_partkey % 3 = 0 AS tr FROM part),
      k AS (SELECT *, NOT (mask OR (img AND tr AND o < 2000)) AND n < o * CASE WHEN img THEN 0.95::DOUBLE ELSE 0.90::DOUBLE END AS keep FROM c)
      SELECT p_brand, coalesce(sum(o - n) FILTER (WHERE keep), 0)::BIGINT AS saved, count(*) FILTER (WHERE keep)::BIGINT AS changed FROM k GROUP BY 1"""
)
def k2_worth_replacing(spark, sf_dir):
    k = F.col("p_partkey")
    old = (F.col("p_size") * 100).cast("long")
    p = load(spark, sf_dir, "part").select("p_brand", old.alias("old_size"), F.floor(old * (80 + k % 25) / 100).alias("new_size"), (k % 2 == 0).alias("is_image"), (k % 7 == 0).alias("is_mask"), (k % 3 == 0).alias("transparent"))
    return R.worth_replacing(p, "p_brand")


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS b, DATE '2026-03-01' AS n FROM orders),
      d AS (SELECT *, year(n) - year(b) AS y, month(n) - month(b) AS m, day(n) - day(b) AS dd FROM o),
      e AS (SELECT *, CASE WHEN dd < 0 THEN dd + 28 ELSE dd END AS days, CASE WHEN dd < 0 THEN m - 1 ELSE m END AS mm, (b + to_years((year(n) - year(b))::INTEGER))::DATE AS this FROM d)
      SELECT o_orderkey, (CASE WHEN mm < 0 THEN y - 1 ELSE y END)::INTEGER AS years, ((mm + 12) % 12)::INTEGER AS months, days::INTEGER AS days, (n - b)::INTEGER AS total_days,
        (CASE WHEN this >= n THEN this ELSE (b + to_years((year(n) - year(b) + 1)::INTEGER))::DATE END - n)::INTEGER AS to_next FROM e"""
)
def p23_age_report(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("b"))
    return R.age_report(o, F.col("b"), F.lit("2026-03-01").cast("date")).drop("b")


def _bmi_sql(imperial: bool) -> str:
    kg, m = (f"w * {R.POUND}::DOUBLE", f"h * {R.INCH}::DOUBLE") if imperial else ("w", "h / 100")
    bad = "coalesce(w, 0) <= 0 OR NOT coalesce(h BETWEEN 20 AND 120, false)" if imperial else "NOT coalesce(w BETWEEN 1 AND 500 AND h BETWEEN 50 AND 300, false)"
    rows = "(80 + c_custkey % 300)::DOUBLE AS w, (10 + c_custkey % 115)::DOUBLE AS h" if imperial else "(c_custkey % 510)::DOUBLE AS w, (140 + c_custkey % 165)::DOUBLE AS h"
    classes = " ".join(f"WHEN bmi < {t} THEN '{n}'" for t, n in R.BMI_CLASSES)
    shown = f"delta * {R.POUNDS}::DOUBLE" if imperial else "delta"
    return f"""b AS (SELECT c_custkey, {rows} FROM customer), k AS (SELECT *, {kg} AS kg, ({m}) * ({m}) AS m2, {bad} AS bad FROM b),
  i AS (SELECT *, CASE WHEN NOT bad THEN kg / m2 END AS bmi, floor(18.5::DOUBLE * m2 * 10 + 0.5) / 10 AS low, floor(24.9::DOUBLE * m2 * 10 + 0.5) / 10 AS high FROM k),
  d AS (SELECT *, CASE WHEN kg < low THEN low - kg WHEN kg > high THEN kg - high ELSE 0.0 END AS delta FROM i),
  bmi AS (SELECT c_custkey, bmi, CASE WHEN bad THEN NULL {classes} ELSE '{R.BMI_LAST}' END AS class, CASE WHEN NOT bad THEN low END AS ideal_low, CASE WHEN NOT bad THEN high END AS ideal_high,
    CASE WHEN bad THEN NULL WHEN delta < 0.5 THEN 0.0 ELSE floor({shown} * 10 + 0.5) / 10 END AS delta, CASE WHEN bad THEN NULL WHEN delta < 0.5 THEN 'keep' WHEN kg < low THEN 'gain' ELSE 'lose' END AS verb, CASE WHEN bad THEN 'range' END AS error FROM d)"""


def _bmi(spark, sf_dir, imperial: bool):
    k = F.col("c_custkey")
    w, h = (80 + k % 300, 10 + k % 115) if imperial else (k % 510, 140 + k % 165)
    c = load(spark, sf_dir, "customer").select("c_custkey", w.cast("double").alias("w"), h.cast("double").alias("h"))
    return R.bmi_report(c, "w", "h", imperial).drop("w", "h")


@query(f"WITH {_bmi_sql(False)} SELECT * FROM bmi")
def p24_bmi_report(spark, sf_dir):
    return _bmi(spark, sf_dir, False)


@query(f"WITH {_bmi_sql(True)} SELECT * FROM bmi")
def p24_bmi_report_imperial(spark, sf_dir):
    return _bmi(spark, sf_dir, True)


@query(
    f"""WITH {_bmi_sql(False)}, c AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate([*(n for _, n in R.BMI_CLASSES), R.BMI_LAST]))}) v(ord, class))
      SELECT ord::BIGINT AS ord, class, count(b.class)::BIGINT AS n FROM c LEFT JOIN bmi b USING (class) GROUP BY 1, 2"""
)
def p24_bmi_distribution(spark, sf_dir):
    return R.bmi_distribution(_bmi(spark, sf_dir, False))


_PRICE_MODES = {
    "discount": ("l_discount * 100 + CASE WHEN l_orderkey % 50 = 0 THEN 95 ELSE 0 END", "amount IS NULL OR amount NOT BETWEEN 0 AND 100", "discount", "price * amount / 100", "NULL", "amount", "price - price * amount / 100"),
    "percent": ("l_extendedprice * (1 - l_discount) + CASE WHEN l_orderkey % 50 = 0 THEN 1e6 ELSE 0 END - CASE WHEN l_orderkey % 50 = 1 THEN 1e6 ELSE 0 END", "amount IS NULL OR amount <= 0", "final", "price - amount", "NULL", "(price - amount) / price * 100", "amount"),
    "tax": ("l_tax * 100 - CASE WHEN l_orderkey % 50 = 0 THEN 10 ELSE 0 END", "amount IS NULL OR amount < 0", "tax", "NULL", "price * amount / 100", "amount", "price + price * amount / 100"),
}


def _price_sql(mode: str) -> str:
    amount, bad, name, saved, tax, pct, total = _PRICE_MODES[mode]
    above = " WHEN amount > price THEN 'above'" if mode == "percent" else ""
    return f"""p AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_orderkey % 70 = 0 THEN 0.0 ELSE l_extendedprice END::DOUBLE AS price, ({amount})::DOUBLE AS amount FROM lineitem),
  e AS (SELECT *, CASE WHEN price IS NULL OR price <= 0 THEN 'price' WHEN {bad} THEN '{name}'{above} END AS error FROM p),
  priced AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN error IS NULL THEN {saved} END::DOUBLE AS saved, CASE WHEN error IS NULL THEN {tax} END::DOUBLE AS tax, CASE WHEN error IS NULL THEN {pct} END::DOUBLE AS pct, CASE WHEN error IS NULL THEN {total} END::DOUBLE AS total, error FROM e)"""


def _priced(spark, sf_dir, mode: str):
    price = F.when(F.col("l_orderkey") % 70 == 0, 0.0).otherwise(F.col("l_extendedprice")).cast("double")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", price.alias("price"), F.expr(_PRICE_MODES[mode][0]).cast("double").alias("amount"))
    return R.price_rows(li, mode).drop("price", "amount")


@query(f"WITH {_price_sql('discount')} SELECT * FROM priced")
def p25_price_rows_discount(spark, sf_dir):
    return _priced(spark, sf_dir, "discount")


@query(f"WITH {_price_sql('percent')} SELECT * FROM priced")
def p25_price_rows_percent(spark, sf_dir):
    return _priced(spark, sf_dir, "percent")


@query(f"WITH {_price_sql('tax')} SELECT * FROM priced")
def p25_price_rows_tax(spark, sf_dir):
    return _priced(spark, sf_dir, "tax")


@query(f"WITH {_price_sql('discount')} SELECT l_returnflag, sum(saved) AS saved, sum(tax) AS tax, sum(total) AS total, count(error)::BIGINT AS errors FROM priced GROUP BY 1")
def p25_price_report(spark, sf_dir):
    return R.price_report(_priced(spark, sf_dir, "discount"), "l_returnflag")


@query(
    """WITH j AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{broken' ELSE props END AS js FROM events)
      SELECT event_id, CASE WHEN json_valid(js) THEN coalesce((js->>'k')::BIGINT, -1) ELSE -1 END AS k, 'none' AS other FROM j"""
)
def s4_load_json_state(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props")).alias("js"))
    return R.load_json_state(e, "js", {"k": ("bigint", -1), "other": ("string", "none")}).select("event_id", "k", "other")


@query("""SELECT event_id, '"' || event_type || '","' || replace(props, '"', '""') || '",' || user_id AS line FROM events""")
def s5_write_log_csv(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", R.csv_lines(e, ("event_type", "props"), ("user_id",)).alias("line"))


@query("SELECT event_id, event_type AS tool, '' AS action, CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS pages FROM events")
def s9_append_usage(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), F.lit(None).cast("string").alias("action"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("pages"))
    return e.select("event_id", "tool", F.coalesce("action", F.lit("")).alias("action"), F.coalesce("pages", F.lit(0)).alias("pages"))


@query(
    f"""WITH {PIXELS}, b AS (SELECT page_id, x, y, CASE WHEN (page_id + x) % 9 = 0 THEN lum + 1 ELSE lum END AS lum FROM pixels WHERE (page_id + y) % 13 <> 0)
      SELECT page_id, count(*) FILTER (WHERE p.lum IS DISTINCT FROM b.lum)::BIGINT AS different FROM pixels p FULL JOIN b USING (page_id, x, y) GROUP BY 1"""
)
def a12_diff_count(spark, sf_dir):
    p = pixels(spark, sf_dir)
    b = p.where("(page_id + y) % 13 <> 0").withColumn("lum", F.when((F.col("page_id") + F.col("x")) % 9 == 0, F.col("lum") + 1).otherwise(F.col("lum")))
    return R.diff_count(p, b, ["page_id", "x", "y"], "lum", "page_id")


@query(
    """WITH r AS (SELECT event_id, user_id AS id, event_id % 3 AS version, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'done' END AS status FROM events),
      v AS (SELECT DISTINCT user_id AS id, 2 AS current FROM events WHERE user_id % 2 = 0)
      SELECT event_id, CASE WHEN current IS NULL OR current <> version THEN 'stale' WHEN status = 'failed' THEN 'review' ELSE 'applied' END AS verdict FROM r LEFT JOIN v USING (id)"""
)
def t8_accept_current(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    res = e.select("event_id", F.col("user_id").alias("id"), (F.col("event_id") % 3).alias("version"), F.when(F.col("event_id") % 10 == 0, "failed").otherwise("done").alias("status"))
    ver = e.where("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.lit(2).alias("version")).distinct()
    return R.valid_versions(res, ver).select("event_id", "verdict")


@query(
    """WITH q AS (SELECT vec_id, embedding[1:24] AS e FROM embeddings), c AS (SELECT vec_id, unnest(range(4)) AS k, e FROM q)
      SELECT vec_id % 10 AS grp, avg(sqrt(pow(e[2*k+1]::DOUBLE - e[2*k+9]::DOUBLE, 2) + pow(e[2*k+2]::DOUBLE - e[2*k+10]::DOUBLE, 2))) AS old_error, avg(sqrt(pow(e[2*k+1]::DOUBLE - e[2*k+17]::DOUBLE, 2) + pow(e[2*k+2]::DOUBLE - e[2*k+18]::DOUBLE, 2))) AS new_error FROM c GROUP BY 1"""
)
def a11_corner_error(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    at = lambda i: F.element_at("embedding", F.col("k") * 2 + i).cast("double")
    return e.groupBy((F.col("vec_id") % 10).alias("grp")).agg(
        F.avg(F.hypot(at(1) - at(9), at(2) - at(10))).alias("old_error"), F.avg(F.hypot(at(1) - at(17), at(2) - at(18))).alias("new_error")
    )


@query(
    rf"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ABCDEF+' ELSE '' END || ['Times-Roman', 'Arial-BoldMT', 'CMR10', 'NimbusSans-BoldOblique', 'Mystery-Italic', 'Garamond', 'DejaVuSansMono'][p_partkey % 7 + 1] AS name, ['serif', 'monospace', 'sans-serif'][p_partkey % 3 + 1] AS gen FROM part),
      l AS (SELECT *, lower(regexp_replace(name, '^[A-Z]{{6}}\+', '')) AS t FROM n)
      SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(t, '{a}') THEN '{b}'" for a, b in T.FONT_RULES)} WHEN gen = 'monospace' THEN 'Courier New' WHEN gen = 'serif' THEN 'Times New Roman' ELSE 'Arial' END AS family, regexp_matches(t, 'bold|black|heavy|semibold|demi') AS bold, regexp_matches(t, 'italic|oblique') AS italic FROM l"""
)
def p26_font_family(spark, sf_dir):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("Times-Roman", "Arial-BoldMT", "CMR10", "NimbusSans-BoldOblique", "Mystery-Italic", "Garamond", "DejaVuSansMono")])
    name = F.concat(F.when(k % 3 == 0, "ABCDEF+").otherwise(""), F.element_at(names, (k % 7 + 1).cast("int")))
    gen = F.element_at(F.array(F.lit("serif"), F.lit("monospace"), F.lit("sans-serif")), (k % 3 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", T.font_family(name, gen).alias("family"), T.is_bold(name).alias("bold"), T.is_italic(name).alias("italic"))
