"""Mixing sources to target weights by hash thresholds: histograms instead of sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, checkpointed, given_back, set_apart

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BITS = 60
STEP = 10
SALTS = 32
CLOSE = 0.002


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits that depend on the row's id and text alone. Repeated rows share them; tie_of() tells these apart."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.col(text)).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def tie_of(row: str) -> Column:
    """60 bits of a row's number."""
    return F.shiftrightunsigned(F.xxhash64(F.col(row)), 64 - BITS)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also target. Sources in code-point order, null last, take the weights in turn; a
    source whose share would exceed most x its size is held there and the rest is shared anew by weight, until none
    is above: with sources in order of size / weight those held are a prefix, so running sums find the split.
    The windows run over one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    ranked = (
        sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("w_all", F.sum("weight").over(every))
        .withColumn("cap_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("w_before", F.sum("weight").over(by_ratio) - F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
        .withColumn("open", F.col("level") < F.col("ratio"))
    )
    level = F.min(F.when(F.col("open"), F.struct("ratio", "source", "level"))).over(every)["level"]
    return ranked.withColumn("cut", level).select(
        "source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("cut")).otherwise(F.col("cap")).alias("target")
    )


def _meet(items: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join per-source rows to the items. The per-source side, one row a source, is repeated for SALTS salts, so that
    a source with a third of the rows is spread over as many keys."""
    salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    renamed = salted.withColumnRenamed("source", "its_source").withColumnRenamed("salt", "its_salt")
    return items.join(
        renamed, items["source"].eqNullSafe(renamed["its_source"]) & (F.pmod(items["draw"], F.lit(SALTS)) == renamed["its_salt"]), "inner"
    ).drop("its_source", "its_salt")


def fill_threshold(items: DataFrame, need: DataFrame) -> DataFrame:
    """Per source, the largest draw threshold below which the items' words fit the need.

    items: source, draw (60 bits), size. need: source, need. Returns source, below (take draw < below), got (words
    taken) and tie, the draw that several items at the boundary share, if that is why no more were taken. Each level sums words by source and the next 10 bits of the draw inside the boundary bucket of the level
    before, finds by a running sum over at most 1024 buckets a source where the need is crossed, and goes down into
    that bucket alone; it ends when no boundary bucket holds two items."""
    state = need.select("source", F.lit(0).cast("long").alias("low"), F.col("need").alias("left"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("got"))
    for shift in range(BITS - STEP, -1, -STEP):
        width = 1 << shift
        inside = _meet(items, state.where("open").select("source", "low")).where(
            F.shiftright("draw", shift + STEP) == F.shiftright("low", shift + STEP)
        )
        histogram = inside.groupBy("source", F.shiftright("draw", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        running = Window.partitionBy("source").orderBy("bucket")
        crossed = (
            histogram.join(
                state.where("open").select(F.col("source").alias("s"), "left", F.col("low").alias("l")), histogram["source"].eqNullSafe(F.col("s"))
            )
            .withColumn("sum", F.sum("words").over(running))
            .groupBy("source")
            .agg(
                F.coalesce(F.sum(F.when(F.col("sum") <= F.col("left"), F.col("words"))), F.lit(0)).alias("more"),
                F.min(F.when(F.col("sum") > F.col("left"), F.struct("bucket", "n"))).alias("edge"),
            )
        )
        old = state.alias("o")
        new = crossed.select(F.col("source").alias("s"), "more", "edge", F.lit(True).alias("met"))
        joined = old.join(new, F.col("o.source").eqNullSafe(F.col("s")) & F.col("met"), "left")
        end = (F.shiftright("low", shift + STEP) + 1) * F.lit(1 << (shift + STEP)).cast("long")
        state = checkpointed(
            joined.select(
                F.col("o.source").alias("source"),
                F.when(~F.col("open"), F.col("low"))
                .when(F.col("edge").isNull(), end)
                .otherwise(F.col("edge.bucket") * F.lit(width).cast("long"))
                .alias("low"),
                F.when(F.col("open"), F.col("left") - F.coalesce("more", F.lit(0))).otherwise(F.col("left")).alias("left"),
                (F.col("open") & F.col("edge").isNotNull() & (F.coalesce("edge.n", F.lit(0)) > 1)).alias("open"),
                (F.col("got") + F.when(F.col("open"), F.coalesce("more", F.lit(0))).otherwise(F.lit(0))).alias("got"),
            )
        )
        if not state.where("open").take(1):
            break
    return state.select("source", F.col("low").alias("below"), "got", F.when(F.col("open"), F.col("low")).alias("tie"), "left")


def part_of_ties(fitting: DataFrame, found: DataFrame) -> DataFrame:
    """found of fill_threshold() with tie_below: of the items (source, draw, tie_draw, size) at a tied boundary, which are equal rows, those whose
    tie_draw lies below it are taken too, as many as fit; got counts them."""
    if not found.where("tie is not null").take(1):
        return found.withColumn("tie_below", F.lit(None).cast("long"))
    edge = found.where("tie is not null").select(F.col("source").alias("edge_of"), F.col("tie").alias("edge"), F.lit(True).alias("at_edge"))
    tied = fitting.join(edge, fitting["source"].eqNullSafe(edge["edge_of"]) & (fitting["draw"] == edge["edge"])).select("source", F.col("tie_draw").alias("draw"), "size")
    more = fill_threshold(tied, found.where("tie is not null").select("source", F.col("left").alias("need")))
    more = more.select(F.col("source").alias("more_of"), F.col("below").alias("tie_below"), F.col("got").alias("more"), F.lit(True).alias("has_more"))
    met = found.join(more, found["source"].eqNullSafe(more["more_of"]) & F.col("has_more"), "left")
    return checkpointed(met.select("source", "below", (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"), "tie", "left", "tie_below"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Choose how often each row of docs(doc_id, text, source) enters a mix: 0 to `most` times.

    Sizes are counted in words (a null text has none). Sources share share x all words by weight (source_targets).
    A source takes every row floor(target / size) times; the rest of its target is met by rows whose draw, a hash of
    id and text, lies below a threshold (fill_threshold). What whole rows leave open there, at most one row's size, is met
    by further thresholds among the later rows that still fit it, as long as it exceeds CLOSE x target and a row fits; each
    takes a row at least.

    Returns doc_id, source, draw, size, source_size, target, copies, taken; every input row gives one, repeated rows
    share a draw and are told apart by a number that is written with them, so that as many of them are taken as fit, a null source is a source of its
    own, sources without words take nothing, an empty table gives no rows. The same table always gives the same mix; which of equal rows
    are taken is left open."""
    items = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            draw_of().alias("draw"), n_words().alias("size"), F.monotonically_increasing_id().alias("row"),
        )
    ).withColumn("tie_draw", tie_of("row"))
    targets = source_targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = checkpointed(
        targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = state.select("source", "target", "need", F.array().cast("array<struct<low:bigint,below:bigint,most:double,tie:bigint,tie_below:bigint>>").alias("picks"), F.lit(0).cast("long").alias("low"), F.lit(True).alias("fits"))
    while True:
        open_ = plan.where(F.col("fits") & (F.col("need") >= 1) & (F.col("need") >= CLOSE * F.col("target")))
        if not open_.take(1):
            break
        fitting = _meet(items, open_.select("source", "need", "low")).where((F.col("draw") >= F.col("low")) & (F.col("size") > 0) & (F.col("size") <= F.col("need")))
        found = part_of_ties(fitting.select("source", "draw", "tie_draw", "size"), fill_threshold(fitting.select("source", "draw", "size"), open_.select("source", "need")))
        found = found.select(F.col("source").alias("s"), "below", "got", "tie", "tie_below", F.lit(True).alias("met"))
        plan = checkpointed(
            plan.join(found, plan["source"].eqNullSafe(F.col("s")) & F.col("met"), "left").select(
                "source", "target",
                (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"),
                F.when(F.col("met"), F.concat("picks", F.array(F.struct("low", "below", F.col("need").alias("most"), "tie", "tie_below")))).otherwise(F.col("picks")).alias("picks"),
                F.coalesce(F.greatest("low", "below", F.col("tie") + 1), F.col("low")).alias("low"),
                F.coalesce(F.col("met") & (F.col("got") > 0), F.lit(False)).alias("fits"),
            )
        )
    rules = state.join(plan.select(F.col("source").alias("s"), "picks"), state["source"].eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", "whole", "picks"
    )
    chosen = F.exists(
        "picks", lambda p: (((F.col("draw") >= p["low"]) & (F.col("draw") < p["below"])) | F.coalesce((F.col("draw") == p["tie"]) & (F.col("tie_draw") < p["tie_below"]), F.lit(False)))
        & (F.col("size") > 0) & (F.col("size") <= p["most"])
    )
    return _meet(items, rules).select(
        "doc_id", "source", "draw", "size", "source_size", "target",
        (F.col("whole") + F.when(chosen, F.lit(1)).otherwise(F.lit(0))).alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs. Rows are matched by id, draw and source. Where only some of equal
    rows are taken, these rows are written with numbers, by which as many are chosen."""
    columns = docs.columns
    docs, names = set_apart(docs, "doc_id", "text", "source")
    counts = mix(docs, **options).groupBy(F.col("doc_id").alias("mix_id"), F.col("draw").alias("mix_draw"), F.col("source").alias("mix_source")).agg(
        F.min("copies").alias("mix_least"), F.max("copies").alias("mix_most"), F.sum("copies").alias("mix_sum"), F.count("*").alias("mix_rows")
    )
    picks = checkpointed(counts.where("mix_most > 0"))
    keyed = docs.withColumn("mix_key", draw_of())

    def matched(p: DataFrame) -> DataFrame:
        same = keyed["doc_id"].cast("long").eqNullSafe(p["mix_id"]) & (keyed["mix_key"] == p["mix_draw"]) & keyed["source"].cast("string").eqNullSafe(p["mix_source"])
        return keyed.join(p, same)

    taken = matched(picks.where("mix_least = mix_most")).withColumn("mix_copies", F.col("mix_most"))
    some = picks.where("mix_least < mix_most")
    if some.take(1):
        group = F.concat_ws(":", F.coalesce(F.col("mix_id").cast("string"), F.lit("none")), F.col("mix_draw").cast("string"), F.coalesce("mix_source", F.lit("")), F.col("mix_source").isNull().cast("string"))
        rows = checkpointed(matched(some).withColumn("mix_row", F.monotonically_increasing_id())).withColumn("mix_group", group).withColumn("mix_tie", tie_of("mix_row"))
        need = some.select(group.alias("source"), (F.col("mix_sum") - F.col("mix_least") * F.col("mix_rows")).cast("double").alias("need"))
        below = fill_threshold(rows.select(F.col("mix_group").alias("source"), F.col("mix_tie").alias("draw"), F.lit(1).cast("long").alias("size")), need).select(F.col("source").alias("below_of"), "below")
        chosen = rows.join(below, F.col("mix_group") == F.col("below_of")).withColumn("mix_copies", F.when(F.col("mix_tie") < F.col("below"), F.col("mix_most")).otherwise(F.col("mix_least")))
        taken = taken.unionByName(chosen.select(*taken.columns))
    out = taken.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return given_back(out, columns, names)
