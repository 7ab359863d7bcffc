"""Ordered page manifests: ranges, splits, merges and edits. Position is data; an output of any number of pages is numbered in ranges,
never in one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources.scratch import written

DIALECTS = ("strict", "open", "lenient", "swap")


def _same(left: DataFrame, right: DataFrame, names: list[str], prefix: str) -> Column:
    return F.lit(True) if not names else _all(left[n].eqNullSafe(right[prefix + n]) for n in names)


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def numbered(df: DataFrame, by: list[str], *order, name: str = "pos") -> DataFrame:
    """df with the number of each row among those with the same `by`, in this order, from 1 on; ties take any order.

    Rows are dealt into ranges of (by, order), so that a group of any size lies in as many tasks as its rows fill, and written with
    their place in their range. What comes before a range's share of a group is a running sum over one row a range and group."""
    place, part = "numbering_place", F.shiftright("numbering_place", 33)  # what monotonically_increasing_id() puts the partition into
    keys = [F.col(c) for c in by]
    placed = written(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(place, F.monotonically_increasing_id()))
    shares = placed.groupBy(*[F.col(c).alias(f"numbering_{c}") for c in by], part.alias("numbering_part")).agg(F.min(place).alias("numbering_first"), F.count("*").alias("numbering_rows"))
    earlier = Window.partitionBy(*[f"numbering_{c}" for c in by]).orderBy("numbering_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("numbering_rows").over(earlier), F.lit(0)) - F.col("numbering_first") + 1
    shares = shares.select(*[f"numbering_{c}" for c in by], "numbering_part", shift.alias("numbering_shift"))
    met = placed.join(shares, _same(placed, shares, by, "numbering_") & (part == F.col("numbering_part")))
    columns = [c for c in df.columns if c != name]
    return met.select(*[placed[c] for c in columns], (F.col(place) + F.col("numbering_shift")).cast("long").alias(name))


def renumber(m: DataFrame, doc: str, *order) -> DataFrame:
    return numbered(m, [doc], *[F.col(c) if isinstance(c, str) else c for c in order])


def per_output(m: DataFrame, **values: Column) -> DataFrame:
    """m with sums over each output, which are counted first in every task and joined as one row an output."""
    sums = m.groupBy(F.col("out_id").alias("sums_of")).agg(*[v.alias(k) for k, v in values.items()])
    return m.join(sums, m["out_id"].eqNullSafe(F.col("sums_of"))).drop("sums_of")


def merge_manifests(m: DataFrame) -> DataFrame:
    """Selected pages of each file, files and pages in order, as one output; the first page of each file is a
    bookmark when the output has several files; prev and next name the file of the page before and behind.

    Only files are compared with each other: a file's neighbours are those that end and begin beside it."""
    out = numbered(m.where("selected").select("out_id", "file_id", "page"), ["out_id"], F.col("file_id"), F.col("page"))
    files = out.groupBy("out_id", "file_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    several = per_output(files, least=F.min("file_id"), most=F.max("file_id")).withColumn("several", F.col("least") != F.col("most"))

    def beside(name: str, edge: str, step: int) -> DataFrame:
        return files.select(F.col("out_id").alias("o"), (F.col(edge) + step).alias("at"), F.col("file_id").alias(name))

    told = several
    for name, edge, step, own in (("before", "last", 1, "first"), ("behind", "first", -1, "last")):
        side = beside(name, edge, step)
        told = told.join(side, told["out_id"].eqNullSafe(side["o"]) & (told[own] == side["at"]), "left").drop("o", "at")
    told = told.select(F.col("out_id").alias("o"), F.col("file_id").alias("f"), "first", "last", "several", "before", "behind")
    met = out.join(told, out["out_id"].eqNullSafe(told["o"]) & out["file_id"].eqNullSafe(told["f"]))
    return met.select(
        "out_id", "file_id", "page", "pos", ((F.col("pos") == F.col("first")) & F.coalesce("several", F.lit(False))).alias("bookmark"),
        F.when(F.col("pos") == F.col("first"), F.col("before")).otherwise(F.col("file_id")).alias("prev_file"),
        F.when(F.col("pos") == F.col("last"), F.col("behind")).otherwise(F.col("file_id")).alias("next_file"),
    )


def number_pages(m: DataFrame, first: int, last: int, front: int, start: int, total_mode: str = "all") -> DataFrame:
    """Labels of the pages first to last of each file: `front` Roman ones, then start, start + 1 ...; null outside."""
    lo = F.greatest(F.lit(1), F.least(F.lit(first).cast("long"), F.col("n_pages")))
    hi = F.greatest(lo, F.least(F.lit(last).cast("long"), F.col("n_pages")))
    at = F.col("page") - lo
    inside = (F.col("page") >= lo) & (F.col("page") <= hi)
    number = at - front + start
    label = F.when(inside & (at < front), T.roman(at + 1)).when(inside, number.cast("string"))
    total = F.col("n_pages") if total_mode == "all" else hi - lo - front + start
    return m.select("file_id", "page", label.alias("label"), F.when(inside, total).alias("total"))


def dedupe_names(df: DataFrame, name: str, order: str, style: str = "-") -> DataFrame:
    """The second use of a name gets `-2` and so on; a name made so that another row has already gets one more number."""
    w = Window.partitionBy(name).orderBy(order)
    first = df.withColumn("k", F.row_number().over(w)).withColumn(
        "given", F.when(F.col("k") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(style), F.col("k").cast("string")))
    )
    again = Window.partitionBy("given").orderBy(F.col("k"), order)
    return first.withColumn("j", F.row_number().over(again)).withColumn(
        "unique_name", F.when(F.col("j") == 1, F.col("given")).otherwise(F.concat("given", F.lit(style), F.col("j").cast("string")))
    ).drop("k", "j", "given")


def split_every(m: DataFrame, n: int) -> DataFrame:
    """Parts of n pages; where n is outside 1 to n_pages the rows carry an error instead."""
    bad = (F.lit(n) < 1) | (F.lit(n) > F.col("n_pages"))
    return m.select("file_id", "page", F.when(~bad, F.floor((F.col("page") - 1) / n) + 1).cast("long").alias("part"), F.when(bad, "size").alias("error"))


def split_at(m: DataFrame, cuts: DataFrame) -> DataFrame:
    """A new part after each listed page (file_id, page)."""
    marked = m.join(cuts.select("file_id", "page", F.lit(1).alias("cut")), ["file_id", "page"], "left")
    before = Window.partitionBy("file_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return marked.select("file_id", "page", (F.coalesce(F.sum("cut").over(before), F.lit(0)) + 1).cast("long").alias("part"))


def part_names(parts: DataFrame) -> DataFrame:
    """NN_page_PPP.pdf or NN_pages_PPP-QQQ.pdf for every part; numbers are padded, never cut."""

    def pad(n: Column, size: int) -> Column:
        s = n.cast("string")
        return F.when(F.length(s) < size, F.lpad(s, size, "0")).otherwise(s)

    g = parts.groupBy("file_id", "part").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    one = F.concat(pad(F.col("part"), 2), F.lit("_page_"), pad(F.col("first"), 3), F.lit(".pdf"))
    many = F.concat(pad(F.col("part"), 2), F.lit("_pages_"), pad(F.col("first"), 3), F.lit("-"), pad(F.col("last"), 3), F.lit(".pdf"))
    return g.select("file_id", "part", "first", "last", F.when(F.col("first") == F.col("last"), one).otherwise(many).alias("name"))


def collapse_ranges(m: DataFrame, doc: str = "file_id", page: str = "page") -> DataFrame:
    """Page sets as text such as `1-3, 5`, by gaps and islands."""
    rows = m.select(doc, page).distinct().withColumn("island", F.col(page) - F.row_number().over(Window.partitionBy(doc).orderBy(page)))
    runs = rows.groupBy(doc, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def parse_ranges(df: DataFrame, spec: str = "spec", total: str = "total", dialect: str = "strict") -> DataFrame:
    """The parts of a range text in order: (a, b, bad), with the whole text's `blank` flag, as an array column `parts`.

    strict: commas only, empty, backward and out-of-range parts are bad. open: commas, semicolons and blanks part; `5-`
    runs to the end; a start beyond the total or a backward range is bad; ends are clipped. lenient: `-3` and `5-` are open
    ranges, ends are clipped, bad parts are ignored. swap: reversed bounds are swapped, out-of-range ones are bad."""
    text, n = F.trim(F.col(spec)), F.col(total).cast("long")
    pieces = F.transform(F.split(text, r"[,;\s]+" if dialect == "open" else ","), lambda x: F.trim(x))
    if dialect != "strict":
        pieces = F.filter(pieces, lambda p: p != "")

    def number(digits: Column) -> Column:
        bare = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(digits == "", None).when(F.length(bare) > 9, 999999999).otherwise(bare.try_cast("long")).cast("long")

    def one(p: Column) -> Column:
        left, right = F.regexp_extract(p, r"^(\d*)\s*-?", 1), F.regexp_extract(p, r"^\d*\s*-\s*(\d*)$", 1)
        ranged = p.contains("-")
        a = number(left)
        b = F.when(ranged, number(right)).otherwise(a)
        if dialect == "strict" or dialect == "swap":
            shape = p.rlike(r"^\d+(\s*-\s*\d+)?$")
            lo, hi = (a, b) if dialect == "strict" else (F.least(a, b), F.greatest(a, b))
            bad = ~shape | (lo < 1) | (hi > n) | (lo > hi)
        elif dialect == "open":
            shape = p.rlike(r"^\d+(-\d*)?$")
            b = F.when(ranged, F.coalesce(b, n)).otherwise(a)
            bad = ~shape | (a < 1) | (a > n) | (b < a)
            lo, hi = a, F.least(b, n)
        else:
            shape = p.rlike(r"^(\d+(\s*-\s*\d*)?|-\s*\d+)$")
            lo = F.greatest(F.coalesce(a, F.lit(1).cast("long")), F.lit(1).cast("long"))
            hi = F.least(F.when(ranged, F.coalesce(b, n)).otherwise(a), n)
            bad = ~shape | (lo > hi)
        bad = F.coalesce(bad, F.lit(True))
        return F.struct(F.when(~bad, lo).alias("a"), F.when(~bad, hi).alias("b"), bad.alias("bad"))

    return df.withColumn("blank", text == "").withColumn("parts", F.when(text == "", F.array().cast("array<struct<a:bigint,b:bigint,bad:boolean>>")).otherwise(F.transform(pieces, one)))


def expand_ranges(df: DataFrame, key: str, spec: str = "spec", total: str = "total", dialect: str = "strict", blank: str = "all", keep_valid: bool = False) -> DataFrame:
    """Pages named by a range text: (key, page, error). A bad part fails the text (one row with the error, no page), except
    in the lenient dialect and with keep_valid, where valid parts stay. Blank texts mean all pages, none or an error."""
    p = parse_ranges(df, spec, total, dialect)
    faulty = F.exists("parts", lambda x: x["bad"])
    whole = F.array(F.struct(F.lit(1).cast("long").alias("a"), F.col(total).cast("long").alias("b"), F.lit(False).alias("bad")))
    error = F.when(F.col("blank") & (F.lit(blank) == "error"), "blank").when(faulty & F.lit(dialect != "lenient"), "bad")
    fails = F.col("error").isNotNull() & ~F.lit(keep_valid)
    good = F.when(fails, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.flatten(F.transform(F.filter("use", lambda x: ~x["bad"]), lambda x: F.sequence(x["a"], x["b"]))))
    )
    use = F.when(F.col("blank") & (F.lit(blank) == "all"), whole).otherwise(F.col("parts"))
    out = p.withColumn("error", error).withColumn("use", use).withColumn("pages", good)
    shown = F.when((F.size("pages") == 0), F.array(F.lit(None).cast("long"))).otherwise(F.col("pages"))
    return out.select(key, F.explode(shown).alias("page"), "error").where("page is not null or error is not null")


def split_ranges(m: DataFrame, specs: DataFrame, key: str = "file_id", dialect: str = "strict") -> DataFrame:
    """One part per range of the text, as written; overlaps and repeats stay."""
    parsed = parse_ranges(specs, dialect=dialect).select(key, F.posexplode("parts").alias("at", "r")).where("not r.bad")
    spans = parsed.select(key, (F.col("at") + 1).cast("long").alias("part"), F.explode(F.sequence("r.a", "r.b")).alias("page"))
    return spans.join(m.select(key, "page"), [key, "page"])


def pick_pages(m: DataFrame, mode: str) -> DataFrame:
    return m.where({"all": "true", "odd": "page % 2 = 1", "even": "page % 2 = 0", "first": "page = 1"}[mode])


def page_cap(m: DataFrame, n: int) -> DataFrame:
    """The first n selected pages of an output stay; later ones are flagged as skipped."""
    rows = numbered(m.where("selected").select("out_id", "file_id", "page"), ["out_id"], F.col("file_id"), F.col("page"))
    return rows.select("out_id", "file_id", "page", (F.col("pos") > n).alias("skipped"))


def insert_pages(m: DataFrame, new: DataFrame, at: int, most: int = 1500) -> DataFrame:
    """new (out_id, src, page, pos) goes before position `at` of m (out_id, src, page, pos); documents that would exceed
    `most` pages keep what they have and are flagged."""
    size = new.groupBy("out_id").agg(F.count("*").alias("n_new"))
    total = m.groupBy("out_id").agg(F.count("*").alias("n_old")).join(size, "out_id", "left").select("out_id", "n_new", (F.col("n_old") + F.coalesce("n_new", F.lit(0)) > most).alias("over"))
    old = m.join(total, "out_id").withColumn("pos", F.when((F.col("pos") >= at) & ~F.col("over"), F.col("pos") + F.coalesce("n_new", F.lit(0))).otherwise(F.col("pos")))
    n_old = m.groupBy("out_id").agg(F.max("pos").alias("top"))
    added = new.join(total, "out_id").join(n_old, "out_id").where("not over").withColumn("pos", F.col("pos") + F.least(F.lit(at - 1), F.col("top")))
    cols = ["out_id", "src", "page", "pos", "over"]
    return old.select(cols).unionByName(added.select(cols))


def delete_pages(m: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages without those of gone (out_id, pos), renumbered; a document that would lose all pages is left and flagged."""
    marked = m.join(gone.select("out_id", "pos", F.lit(True).alias("drop")), ["out_id", "pos"], "left")
    counted = per_output(marked, n_gone=F.count("drop"), n_all=F.count("*"))
    kept = counted.withColumn("refused", F.col("n_gone") == F.col("n_all")).where("refused or drop is null")
    return renumber(kept.drop("drop", "n_gone", "n_all"), "out_id", "pos")


def duplicate_pages(m: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each chosen page is followed by a copy of itself."""
    copies = m.join(chosen, ["out_id", "pos"], "left_semi").withColumn("copy", F.lit(1))
    return renumber(m.withColumn("copy", F.lit(0)).unionByName(copies), "out_id", "pos", "copy")


def insert_blank(m: DataFrame, after: int) -> DataFrame:
    """A blank page (src -1) behind position `after` of each document, or behind its last: as large as that page, sides
    swapped if it is turned by 90 or 270 degrees."""
    at = per_output(m, top=F.max("pos")).where(F.col("pos") == F.least(F.lit(after), F.col("top"))).drop("top")
    turned = F.pmod("rot", F.lit(180)) == 90
    blank = at.withColumns({"w": F.when(turned, F.col("h")).otherwise(F.col("w")), "h": F.when(turned, F.col("w")).otherwise(F.col("h")), "src": F.lit(-1).cast("long"), "page": F.lit(0).cast("long"), "rot": F.lit(0).cast("long"), "blank": F.lit(1)})
    return renumber(m.withColumn("blank", F.lit(0)).unionByName(blank), "out_id", "pos", "blank")


def move_pages(m: DataFrame, to: str = "front") -> DataFrame:
    """Selected pages to the front or the end; both groups keep their order."""
    first = F.when(F.col("selected"), 0 if to == "front" else 1).otherwise(1 if to == "front" else 0)
    return renumber(m, "out_id", first, "pos")


def reverse_pages(m: DataFrame) -> DataFrame:
    return renumber(m, "out_id", F.desc("pos"))


def interleave(m: DataFrame, reverse_second: bool = False) -> DataFrame:
    """The first two sources of each document alternate; the longer one's rest follows, then the other sources.

    The two sources come from two minima over each output; only their pages are numbered within the source."""
    firsts = m.groupBy("out_id", "src").agg(F.struct(F.min("pos").alias("p"), F.col("src").alias("s")).alias("at"))
    one = per_output(firsts, lead=F.min("at"))
    two = one.groupBy(F.col("out_id").alias("o")).agg(F.min("lead").alias("lead"), F.min(F.when(F.col("at") != F.col("lead"), F.col("at"))).alias("next"))
    two = two.select("o", F.col("lead.s").alias("lead"), F.col("next.s").alias("next"))
    met = m.join(two, m["out_id"].eqNullSafe(two["o"])).drop("o")
    met = met.withColumn("rank", F.when(F.col("src") == F.col("lead"), 1).when(F.col("src") == F.col("next"), 2)).drop("lead", "next")
    early = numbered(met.where("rank is not null"), ["out_id", "rank"], F.col("pos"), name="index")
    if reverse_second:
        size = early.where("rank = 2").groupBy(F.col("out_id").alias("o")).agg(F.count("*").alias("n"))
        early = early.join(size, early["out_id"].eqNullSafe(size["o"]), "left").withColumn("index", F.when(F.col("rank") == 2, F.col("n") + 1 - F.col("index")).otherwise(F.col("index"))).drop("o", "n")
    late = met.where("rank is null").withColumn("index", F.lit(None).cast("long"))
    rows = early.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.lit(1)))
    return renumber(rows, "out_id", "late", "index", "rank", "pos").drop("late", "index", "rank")


def original_order(m: DataFrame) -> DataFrame:
    """By source and page; blank pages (src below 0) last."""
    return renumber(m, "out_id", (F.col("src") < 0).cast("int"), "src", "page", "pos")


def rotate_pages(m: DataFrame, degrees: int) -> DataFrame:
    """Turn the selected pages of each document, or all if none is selected."""
    met = per_output(m, any_selected=F.max("selected"))
    return met.withColumn("rot", F.when(F.col("selected") | ~F.col("any_selected"), F.pmod(F.col("rot") + degrees, F.lit(360))).otherwise(F.col("rot"))).drop("any_selected")
