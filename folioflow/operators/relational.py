"""Aggregations, joins and selections over keyed rows: votes, labels, catalogues, dictionaries, budgets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def rating_summary(votes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Average (1 decimal) and count of each known tool's latest valid votes; 0 without votes."""
    good = votes.where(F.col("score").between(1, 5))
    last = good.groupBy("tool", "voter").agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"))
    sums = last.groupBy("tool").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    avg = F.floor(F.col("s") * 10 / F.col("n") + 0.5) / 10
    return catalogue.join(sums, "tool", "left").select("tool", F.coalesce(avg, F.lit(0.0)).alias("average"), F.coalesce("n", F.lit(0)).alias("votes"))


# Courier names in order of priority; names that differ in form only stand for the first of them.
COURIERS = (
    "Ekart", "Delhivery", "Xpressbees", "Shadowfax", "Ecom Express", "Valmo", "DTDC", "Blue Dart", "BlueDart", "Amazon Shipping",
    "Amazon Transportation", "ATS", "India Post", "Speed Post", "Shiprocket", "Smartr", "Gati", "Professional Couriers", "TCS",
    "Leopards", "M&P", "PostEx", "Trax", "Rider", "Call Courier", "BlueEx", "Pakistan Post", "UPS", "FedEx", "DHL", "USPS", "Royal Mail",
    "Evri", "DPD", "PostNL", "GLS", "Canada Post", "Australia Post", "Aramex", "J&T", "Ninja Van",
)
ALIASES = {"BlueDart": "Blue Dart", "Amazon Transportation": "Amazon Shipping", "ATS": "Amazon Shipping"}
SKU = r"(?i)\bSKU(?:\s*ID)?\s*[:\-|]?\s*([A-Za-z0-9][A-Za-z0-9_\-/.]{1,40})"
QTY = r"(?i)\bQ(?:ty|uantity)\s*[:\-]?\s*(\d{1,4})\b"
INVOICE = r"(?i)tax invoice|invoice no|bill of supply"
SHIPPING = r"(?i)ship to|deliver to|awb"


def courier(text: Column) -> Column:
    """The first courier of the list that the text names."""
    plain = [name.lower().replace(" ", "") for name in COURIERS]
    either = r"(?i)(?<![A-Za-z])(?:" + "|".join(name.replace(" ", r"\s*") for name in COURIERS) + ")(?![A-Za-z])"
    place = F.create_map(*[F.lit(x) for name in dict.fromkeys(plain) for x in (name, plain.index(name))])
    named = F.regexp_extract_all(text, F.lit(either), F.lit(0))
    first = F.array_min(F.transform(named, lambda n: F.element_at(place, F.lower(F.regexp_replace(n, r"\s+", "")))))
    return F.when(F.size(named) > 0, F.get(F.array(*[F.lit(ALIASES.get(name, name)) for name in COURIERS]), first))


def label_fields(labels: DataFrame, text: str = "text") -> DataFrame:
    """Courier, SKU and quantity (1 if there is none) of each label text."""
    t = F.col(text)
    sku = F.nullif(F.regexp_replace(F.regexp_extract(t, SKU, 1), r"[.|]+$", ""), F.lit(""))
    qty = F.coalesce(F.nullif(F.regexp_extract(t, QTY, 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return labels.select("*", courier(t).alias("courier"), sku.alias("sku"), qty.alias("qty"))


def is_invoice(text: Column) -> Column:
    return text.rlike(INVOICE) & ~text.rlike(SHIPPING)


def pick_list(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.coalesce("sku", F.lit("—")).alias("sku")).agg(F.sum("qty").alias("qty"))


def courier_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.coalesce("courier", F.lit("—")).alias("courier")).agg(F.count("*").alias("labels"))


def label_cells(labels: DataFrame, cols: int, rows: int) -> DataFrame:
    """Sheet, row and column of each label of a page in order."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("idx")) - 1
    per = cols * rows
    return labels.select("page_id", "idx", F.floor(n / per).cast("long").alias("sheet"), F.floor(n % per / cols).cast("long").alias("row"), (n % cols).cast("long").alias("col"))


def sort_labels(labels: DataFrame, by: str) -> DataFrame:
    """Place of each label on its page by courier and SKU, or SKU and courier; what is missing comes last."""
    c, s = (F.lower(F.coalesce(x, F.lit("~"))) for x in ("courier", "sku"))
    keys = (c, s) if by == "courier" else (s, c)
    return labels.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*keys, "idx")).cast("long"))


def select_kind(labels: DataFrame, mode: str) -> DataFrame:
    """Labels, invoices or both; an invoice stands behind its page's last label."""
    kind = F.when(is_invoice(F.col("text")), "invoice").otherwise("label")
    rows = labels.withColumn("kind", kind)
    if mode != "both":
        rows = rows.where(F.col("kind") == mode.rstrip("s"))
    order = Window.partitionBy("page_id").orderBy((F.col("kind") == "invoice").cast("int"), "idx")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def floor_quantile(df: DataFrame, by: str, col: str, q: float) -> DataFrame:
    """The element at floor(q (n - 1)) of each group's sorted values. Equal values are counted first, so that the window sees
    each value of a group once."""
    counts = df.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count("*").alias("n"))
    group = Window.partitionBy(by)
    upto = F.sum("n").over(group.orderBy(col))
    ranked = counts.select(by, col, upto.alias("upto"), F.sum("n").over(group).alias("total"))
    return ranked.where(F.col("upto") > F.floor((F.col("total") - 1) * q)).groupBy(by).agg(F.min(col).alias("quantile"))


def upper_median(df: DataFrame, by: str, col: str) -> DataFrame:
    counts = df.where(F.col(col).isNotNull()).groupBy(by, col).agg(F.count("*").alias("n"))
    group = Window.partitionBy(by)
    ranked = counts.select(by, col, F.sum("n").over(group.orderBy(col)).alias("upto"), F.sum("n").over(group).alias("total"))
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(by).agg(F.min(col).alias("median"))


def weighted_mode(df: DataFrame, by: str, value: Column, weight: Column) -> DataFrame:
    """The value with the largest sum of weights; the smallest of several."""
    sums = df.groupBy(by, value.alias("mode")).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(by).agg(F.min(F.struct((-F.col("w")).alias("w"), "mode")).alias("b"))
    return best.select(by, F.col("b.mode").alias("mode"), (-F.col("b.w")).alias("weight"))


def apportion_shares(df: DataFrame, by: str, share: str, spouse: str) -> DataFrame:
    """Shares that sum to more than 1 are divided by their sum (aul); what is left below 1 goes back in proportion to the shares
    of those who are not spouses (radd), if there are any."""
    g = Window.partitionBy(by)
    total = F.sum(share).over(g)
    others = F.sum(F.when(~F.col(spouse), F.col(share)).otherwise(0.0)).over(g)
    radd = (total < 1 - 1e-9) & (others > 0)
    given = F.when(total > 1 + 1e-9, F.col(share) / total).when(radd & ~F.col(spouse), F.col(share) + (1 - total) * F.col(share) / others).otherwise(F.col(share))
    return df.select(*df.columns, given.alias("given"), (total > 1 + 1e-9).alias("aul"), radd.alias("radd"))


def request_audit(df: DataFrame, page: str, kind: str, text: str, ignore: str) -> DataFrame:
    """Requests, errors that are not to be ignored, and events before the first action of each page."""
    first = F.min(F.when(F.col(kind) == "click", F.col("ts"))).over(Window.partitionBy(page))
    rows = df.withColumn("early", F.col("ts") < first)
    return rows.groupBy(page).agg(
        F.count("*").alias("requests"), F.count_if(F.col(kind) == "view").alias("third_party"),
        F.count_if((F.col(kind) == "error") & ~F.col(text).rlike(ignore)).alias("errors"), F.count_if(F.col("early") & (F.col(kind) == "signup")).alias("too_early"),
    )


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters with accents, by their decomposition, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if c == c.lower() and len(d) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _plain_letters()


def natural_key(col: Column) -> Column:
    """Sort key in which runs of digits compare as numbers and case and accents do not count: a number is preceded by its number of
    digits without leading zeros."""
    folded = F.translate(F.regexp_replace(F.lower(col), r"\p{M}+", ""), ACCENTED, PLAIN)
    parts = F.regexp_extract_all(folded, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def one(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def recent_docs(events: DataFrame, client: str, cap: int, show: int, needle: str) -> DataFrame:
    """The latest row of each item of a client, newest first, `cap` kept, filtered by name, `show` shown."""
    latest = events.groupBy(client, "name").agg(F.max(F.struct("ts", "event_id")).alias("l"))
    w = Window.partitionBy(client).orderBy(F.desc("l.ts"), F.desc("l.event_id"))
    kept = latest.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).where(F.instr(F.lower("name"), needle.lower()) > 0)
    place = F.row_number().over(Window.partitionBy(client).orderBy("rn"))
    return kept.withColumn("place", place.cast("long")).where(F.col("place") <= show).select(client, "name", "place", F.col("l.event_id").alias("event_id"))


def cap_log(events: DataFrame, client: str, n: int) -> DataFrame:
    w = Window.partitionBy(client).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def favourites(events: DataFrame, client: str, item: str, known: DataFrame) -> DataFrame:
    """Items toggled an odd number of times, newest first; unknown ids drop out."""
    on = events.groupBy(client, item).agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("l")).where("n % 2 = 1").join(known, item, "left_semi")
    place = F.row_number().over(Window.partitionBy(client).orderBy(F.desc("l.ts"), F.desc("l.event_id")))
    return on.select(client, item, place.cast("long").alias("place"))


def search_catalogue(items: DataFrame, needle: str, k: int) -> DataFrame:
    """The first k items in catalogue order that name the needle anywhere."""
    n = needle.lower()
    hit = F.instr(F.lower("name"), n) > 0
    hit = hit | (F.instr(F.lower("description"), n) > 0) | (F.lower("category") == n) | F.exists("keywords", lambda x: F.instr(F.lower(x), n) > 0)
    return items.where(hit).orderBy("ord").limit(k)


def keep_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known, key, "left_semi")


def drop_blocked(df: DataFrame, email: str, blocked: DataFrame, keep_without_at: bool) -> DataFrame:
    """Addresses whose domain is not blocked; what has no @ is blocked or kept."""
    domain = F.lower(F.substring_index(F.col(email), "@", -1))
    has_at = F.col(email).contains("@")
    kept = df.withColumn("domain", F.when(has_at, domain)).join(blocked, "domain", "left_anti")
    return kept if keep_without_at else kept.where(has_at)


def translate(df: DataFrame, dictionary: DataFrame, lang: str, key: str) -> DataFrame:
    """The text in the row's language, else the English one, else the key; empty texts fall through."""
    own = dictionary.select(F.col("lang").alias(lang), F.col("key").alias(key), F.col("value").alias("v1"))
    english = dictionary.where("lang = 'en'").select(F.col("key").alias(key), F.col("value").alias("v2"))
    return df.join(own, [lang, key], "left").join(english, key, "left").select(*df.columns, F.coalesce(F.nullif("v1", F.lit("")), F.nullif("v2", F.lit("")), F.col(key)).alias("translated"))


def reverse_lookup(df: DataFrame, dictionary: DataFrame, text: str) -> DataFrame:
    """Key of an English text; the last of several entries (by ord) wins."""
    last = dictionary.groupBy(F.trim("value").alias("t")).agg(F.max_by("key", "ord").alias("found_key"))
    return df.withColumn("t", F.trim(text)).join(last, "t", "left").drop("t")


def read_flags(notes: DataFrame, read: DataFrame, key: str) -> DataFrame:
    return notes.join(read.select(key).distinct().withColumn("r", F.lit(True)), key, "left").select(*notes.columns, F.col("r").isNotNull().alias("is_read"))


def resolve_inherited(nodes: DataFrame, checkpointed) -> DataFrame:
    """Each node's own value, or the nearest one up its chain of parents (node, parent, value), and how far up it stands.

    Every round an open node takes over what the node it points to knows, its value or where that one points, so that rounds grow with
    the logarithm of the longest chain; each is checkpointed. Nodes that are left when chains of all nodes would have ended
    stand in a circle and have no value."""
    own = F.col("value").isNotNull()
    state = checkpointed(nodes.select("node", F.when(~own, F.col("parent")).alias("at"), F.when(own, 0).otherwise(1).cast("long").alias("depth"), "value"))
    for _ in range(state.count().bit_length() + 1):
        if not state.where("at is not null").take(1):
            break
        up = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("value").alias("found"))
        is_open = F.col("at").isNotNull()
        state = checkpointed(
            state.join(up, "at", "left").select(
                "node", F.when(is_open, F.col("next")).alias("at"),
                F.when(is_open, F.col("depth") + F.coalesce("more", F.lit(0))).otherwise(F.col("depth")).alias("depth"), F.coalesce("value", "found").alias("value"),
            )
        )
    return state.select("node", "value", F.when(F.col("value").isNotNull(), F.col("depth")).cast("int").alias("depth"))


def prune_outline(outline: DataFrame, deleted: DataFrame, checkpointed) -> DataFrame:
    """Outline nodes (node, parent, page) that stay: alive ones, and those with an alive node below them at any depth. Each
    round goes one parent up and is checkpointed, until none is new."""
    kept = checkpointed(outline.join(deleted, "page", "left_anti").select("node", "parent"))
    front = kept
    while True:
        up = outline.join(front.select(F.col("parent").alias("node")), "node", "left_semi").select("node", "parent")
        front = checkpointed(up.join(kept.select("node"), "node", "left_anti").distinct())
        if not front.take(1):
            break
        kept = checkpointed(kept.union(front))
    return outline.join(kept.select("node").distinct(), "node", "left_semi")


def best_under_budget(df: DataFrame, by: str, target: int) -> DataFrame:
    """The first step (by ord) that meets the target, at its highest quality; else the smallest; `met` tells which."""
    fit = F.when(F.col("size") <= target, F.struct(F.col("ord").alias("o"), (-F.col("q")).alias("q"), F.col("size").alias("size")))
    small = F.struct(F.col("size").alias("size"), F.col("ord").alias("o"), (-F.col("q")).alias("q"))
    best = df.groupBy(by).agg(F.min(fit).alias("f"), F.min(small).alias("s"))
    return best.select(
        by, F.coalesce("f.o", "s.o").alias("ord"), (-F.coalesce("f.q", "s.q")).alias("q"), F.coalesce("f.size", "s.size").alias("size"), F.col("f").isNotNull().alias("met")
    )


def worth_replacing(df: DataFrame, by: str) -> DataFrame:
    """Saved bytes and changed streams, where a new encoding is kept below 95 % (images) or 90 % (others) of the old size."""
    limit = F.when(F.col("is_image"), 0.95).otherwise(0.90)
    skip = F.col("is_mask") | (F.col("is_image") & F.col("transparent") & (F.col("old_size") < 2000))
    keep = ~skip & (F.col("new_size") < F.col("old_size") * limit)
    return df.groupBy(by).agg(F.coalesce(F.sum(F.when(keep, F.col("old_size") - F.col("new_size"))), F.lit(0)).alias("saved"), F.count_if(keep).alias("changed"))


def age_report(df: DataFrame, born: Column, as_of: Column) -> DataFrame:
    """Years, months and days with the length of the month before as_of, all days, and days to the next anniversary."""
    y, m, d = (f(as_of) - f(born) for f in (F.year, F.month, F.day))
    before = F.day(F.last_day(F.add_months(as_of, -1)))
    days = F.when(d < 0, d + before).otherwise(d)
    months = F.when(d < 0, m - 1).otherwise(m)
    years = F.when(months < 0, y - 1).otherwise(y)
    this = F.add_months(born, 12 * (F.year(as_of) - F.year(born)))
    nxt = F.when(this >= as_of, this).otherwise(F.add_months(born, 12 * (F.year(as_of) - F.year(born) + 1)))
    return df.select(
        *df.columns, years.alias("years"), F.pmod(months, F.lit(12)).alias("months"), days.alias("days"), F.datediff(as_of, born).alias("total_days"), F.datediff(nxt, as_of).alias("to_next")
    )


# Upper bounds of the body mass classes.
# Upper bounds of the classes of the body mass index, in order.
BMI_CLASSES = ((16.0, "severely underweight"), (18.5, "underweight"), (25.0, "normal"), (30.0, "overweight"), (35.0, "obese class I"), (40.0, "obese class II"))
BMI_LAST = "obese class III"
POUND, INCH, POUNDS = 0.453592, 0.0254, 2.205


def bmi_report(df: DataFrame, weight: str, height: str, imperial: bool = False) -> DataFrame:
    """Body mass index, class, ideal range (18.5 to 24.9, one decimal) and distance to it with a verb, from kilograms and centimetres or
    from pounds and inches; rows out of range carry an error. Distances below half a kilogram are none."""
    w, h = F.col(weight), F.col(height)
    kg, metres = (w * POUND, h * INCH) if imperial else (w, h / 100)
    bad = (F.coalesce(w, F.lit(0)) <= 0) | ~F.coalesce(h.between(20, 120), F.lit(False)) if imperial else ~F.coalesce(w.between(1, 500) & h.between(50, 300), F.lit(False))
    m2 = metres * metres
    bmi = F.when(~bad, kg / m2)
    kind = None
    for top, name in BMI_CLASSES:
        kind = F.when(bmi < top, name) if kind is None else kind.when(bmi < top, name)
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    low, high = tenth(18.5 * m2), tenth(24.9 * m2)
    delta = F.when(kg < low, low - kg).when(kg > high, kg - high).otherwise(0.0)
    shown = F.when(delta < 0.5, 0.0).otherwise(tenth(delta * POUNDS) if imperial else tenth(delta))
    verb = F.when(delta < 0.5, "keep").when(kg < low, "gain").otherwise("lose")
    return df.select(
        *df.columns, bmi.alias("bmi"), F.when(~bad, kind.otherwise(BMI_LAST)).alias("class"), F.when(~bad, low).alias("ideal_low"), F.when(~bad, high).alias("ideal_high"),
        F.when(~bad, shown).alias("delta"), F.when(~bad, verb).alias("verb"), F.when(bad, "range").alias("error"),
    )


def bmi_distribution(report: DataFrame) -> DataFrame:
    """Rows of each class, all classes kept."""
    names = F.array(*[F.lit(n) for _, n in BMI_CLASSES], F.lit(BMI_LAST))
    every = report.sparkSession.range(1).select(F.posexplode(names).alias("ord", "class"))
    counts = report.where("error is null").groupBy("class").agg(F.count("*").alias("n"))
    return every.join(counts, "class", "left").select(F.col("ord").cast("long").alias("ord"), "class", F.coalesce("n", F.lit(0)).alias("n"))


def price_rows(df: DataFrame, mode: str) -> DataFrame:
    """saved, tax, pct, total and error of each row. Modes: `discount` (price, amount = percent off), `percent` (price, amount = final
    price) and `tax` (price, amount = rate in percent); a row with an error has nothing else."""
    price, amount = F.col("price"), F.col("amount")
    bad_price = price.isNull() | (price <= 0)
    none = F.lit(None).cast("double")
    if mode == "discount":
        error = F.when(bad_price, "price").when(amount.isNull() | ~amount.between(0, 100), "discount")
        saved, tax, pct = price * amount / 100, none, amount
        total = price - saved
    elif mode == "percent":
        error = F.when(bad_price, "price").when(amount.isNull() | (amount <= 0), "final").when(amount > price, "above")
        saved, tax, total = price - amount, none, amount
        pct = saved / price * 100
    else:
        error = F.when(bad_price, "price").when(amount.isNull() | (amount < 0), "tax")
        saved, tax, pct = none, price * amount / 100, amount
        total = price + tax
    good = error.isNull()
    return df.select(*df.columns, *[F.when(good, c).alias(n) for n, c in (("saved", saved), ("tax", tax), ("pct", pct), ("total", total))], error.alias("error"))


def price_report(rows: DataFrame, by: str) -> DataFrame:
    """Totals of saving, tax and price by group, and the rows with an error."""
    return rows.groupBy(by).agg(F.sum("saved").alias("saved"), F.sum("tax").alias("tax"), F.sum("total").alias("total"), F.count("error").alias("errors"))


def load_json_state(df: DataFrame, col: str, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """JSON fields with types and defaults; broken JSON gives all defaults."""
    schema = ", ".join(f"`{k}` {kind}" for k, (kind, _) in fields.items())
    parsed = F.from_json(F.col(col), schema)
    return df.select("*", *[F.coalesce(parsed[k], F.lit(default).cast(kind)).alias(k) for k, (kind, default) in fields.items()])


def csv_lines(df: DataFrame, text: tuple, numbers: tuple) -> Column:
    """A CSV line: texts quoted with doubled quotes, numbers bare."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in text]
    return F.concat_ws(",", *quoted, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in numbers])


def diff_count(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """Cells that differ between two rasters, or are in one only."""
    both = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys, "full")
    return both.groupBy(by).agg(F.count_if(~F.col("va").eqNullSafe(F.col("vb"))).alias("different"))


def valid_versions(results: DataFrame, versions: DataFrame) -> DataFrame:
    """Late results with a verdict: applied if the item has that version still, else stale; failed ones need review."""
    v = versions.select("id", F.col("version").alias("current"))
    verdict = F.when(F.col("current").isNull() | (F.col("current") != F.col("version")), "stale").when(F.col("status") == "failed", "review").otherwise("applied")
    return results.join(v, "id", "left").select(*results.columns, verdict.alias("verdict"))
