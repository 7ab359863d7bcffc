"""Page-image checks over rows (page_id, x, y, lum): histograms and projection profiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ink_threshold(pixels: DataFrame) -> DataFrame:
    """Paper is the brightest level with 35 % of the pixels at or above it; ink is darker than min(170, 0.72 x paper). Counts run over the
    256-level histogram."""
    h = pixels.groupBy("page_id", "lum").agg(F.count("*").alias("n"))
    page = Window.partitionBy("page_id")
    c = h.withColumn("above", F.sum("n").over(page.orderBy(F.desc("lum")))).withColumn("total", F.sum("n").over(page))
    paper = F.max(F.when(F.col("above") >= F.col("total") * 0.35, F.col("lum"))).over(page)
    c = c.withColumn("paper", paper).withColumn("threshold", F.least(F.lit(170.0), 0.72 * F.col("paper")))
    ink = F.coalesce(F.sum(F.when(F.col("lum") < F.col("threshold"), F.col("n"))), F.lit(0))
    return c.groupBy("page_id", "paper", "threshold").agg(ink.alias("ink"))


def blank_pages(pixels: DataFrame, text: DataFrame, most_text: int = 2, share: float = 0.003) -> DataFrame:
    dark = pixels.groupBy("page_id").agg(F.avg((F.col("lum") < 200).cast("double")).alias("dark"))
    return dark.join(text, "page_id", "left").select("page_id", ((F.col("dark") < share) & (F.coalesce("text_length", F.lit(0)) <= most_text)).alias("blank"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Brightness as a whole number, cut off."""
    return F.floor((red * 299 + green * 587 + blue * 114) / 1000).cast("long")


def paper_color(pixels: DataFrame, width: int, height: int, band: float = 0.03, channels: tuple = ("lum",)) -> DataFrame:
    """Upper median of each channel over the border, the outer `band` of either side and a pixel at least, of every second pixel both ways (0
    counts as 255). A border darker than 200 is white paper; the tolerance is larger for light paper that is tinted."""
    from folioflow.operators.relational import upper_median

    bx, by = max(1, int(width * band)), max(1, int(height * band))
    edge = (F.col("x") < bx) | (F.col("x") >= width - bx) | (F.col("y") < by) | (F.col("y") >= height - by)
    border = pixels.where(edge & (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    out = None
    for c in channels:
        m = upper_median(border, "page_id", c).select("page_id", F.when(F.col("median") == 0, 255).otherwise(F.col("median")).alias(f"paper_{c}"))
        out = m if out is None else out.join(m, "page_id")
    paper = [F.col(f"paper_{c}") for c in channels]
    light = (paper[0] if len(channels) == 1 else paper[0] * 299 + paper[1] * 587 + paper[2] * 114) >= (200 if len(channels) == 1 else 200_000)
    tinted = functools.reduce(lambda x, y: x | y, [p < 250 for p in paper])
    return out.select("page_id", *[F.when(light, F.col(f"paper_{c}")).otherwise(255).alias(f"paper_{c}") for c in channels], F.when(light & tinted, 34).otherwise(18).alias("tolerance"))


def _strip(strong: Column, n: int) -> Column:
    """How many of the first places are a dark edge strip: a run of strong places (a sorted array) from 0 on, shorter than 6 % of n, and clear
    places behind it, 3 and 1 % of n at least. 0 if there is none."""
    limit, clear = int(n * 0.06 + 0.5), max(3, int(n * 0.01 + 0.5))
    run = F.size(F.filter(strong, lambda v, i: v == i))
    gap = F.coalesce(F.get(strong, run) - run, F.lit(0))  # nothing strong behind it: no strip
    alone = F.get(strong, run).isNull() & (F.lit(n) - run > int(n * 0.4 + 0.5))
    return F.when((run > 0) & (run < limit) & ((gap >= clear) | alone), run).otherwise(0)


def content_box(pixels: DataFrame, width: int, height: int, channels: tuple = ("lum",), scale: float = 1.0) -> DataFrame:
    """The box of what differs from the paper (paper_color) in any channel by more than its tolerance: x0, y0, x1, y1 and the margins top, bottom, left
    and right in points, scale pixels each; `blank` pages have none.

    A row counts from max(1, 0.15 % of the width) such pixels on, a column likewise. A dark strip along an edge (_strip) is left out, and what is left is
    counted anew. Profiles are sums over rows and columns; a page's strong places are an array of at most its height or width."""
    least_row, least_col = max(1, int(width * 0.0015)), max(1, int(height * 0.0015))
    paper = paper_color(pixels, width, height, channels=channels)
    differs = functools.reduce(lambda a, b: a | b, [F.abs(F.col(c) - F.col(f"paper_{c}")) > F.col("tolerance") for c in channels])
    ink = pixels.join(paper, "page_id").where(differs).select("page_id", "x", "y")

    def strong(rows: DataFrame, axis: str, least: int) -> DataFrame:
        return rows.groupBy("page_id", axis).agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy("page_id")

    def places(axis: str, least: int, n: int) -> DataFrame:
        there = F.array_sort(F.collect_list(F.col(axis).cast("long")))
        back = F.transform(F.reverse(F.col("there")), lambda v: F.lit(n - 1) - v)
        return strong(ink, axis, least).agg(there.alias("there")).select("page_id", _strip(F.col("there"), n).alias(f"{axis}_from"), (F.lit(n - 1) - _strip(back, n)).alias(f"{axis}_to"))

    edges = places("y", least_row, height).join(places("x", least_col, width), "page_id")
    inner = ink.join(edges, "page_id").where(F.col("x").between(F.col("x_from"), F.col("x_to")) & F.col("y").between(F.col("y_from"), F.col("y_to")))
    rows = strong(inner, "y", least_row).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = rows.join(strong(inner, "x", least_col).agg(F.min("x").alias("x0"), F.max("x").alias("x1")), "page_id")
    return paper.select("page_id").join(box, "page_id", "left").select(
        "page_id", "x0", "y0", "x1", "y1", (F.col("y0") / scale).alias("top"), ((height - 1 - F.col("y1")) / scale).alias("bottom"),
        (F.col("x0") / scale).alias("left"), ((width - 1 - F.col("x1")) / scale).alias("right"), F.col("x0").isNull().alias("blank"),
    )


def column_gaps(pixels: DataFrame, dark: int, columns: int, share: float = 0.03, least: int = 12, of_width: float = 0.025, part: int = 40) -> DataFrame:
    """Runs of max(least, of_width x columns) columns or more with at most max(1, share x inked rows) dark pixels, and where to cut them:
    in the middle, where both sides and what the cut before leaves are `part` columns wide."""
    rows = pixels.groupBy("page_id", "y").agg(F.count_if(F.col("lum") < dark).alias("n")).groupBy("page_id").agg(F.count_if(F.col("n") > 0).alias("inked"))
    cols = pixels.groupBy("page_id", "x").agg(F.count_if(F.col("lum") < dark).alias("n")).join(rows, "page_id").where(F.col("n") <= F.greatest(F.lit(1.0), share * F.col("inked")))
    runs = cols.withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("page_id").orderBy("x"))).groupBy("page_id", "g")
    out = runs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n")).where(F.col("n") >= max(least, of_width * columns))
    out = out.withColumn("cut", F.floor((F.col("x0") + F.col("x1")) / 2)).where((F.col("cut") >= part) & (columns - F.col("cut") >= part))
    before = F.lag("cut").over(Window.partitionBy("page_id").orderBy("cut"))
    return out.withColumn("before", before).where(F.col("before").isNull() | (F.col("cut") - F.col("before") >= part)).select("page_id", "x0", "x1", "cut")


def is_bilevel(pixels: DataFrame, step: int) -> DataFrame:
    """Whether every sampled pixel is near black or near white in each channel (red, green, blue), and grey within 8."""
    channels = [F.col(c) for c in ("red", "green", "blue")]
    low, high = F.least(*channels), F.greatest(*channels)
    return pixels.where((F.col("x") + F.col("y")) % step == 0).groupBy("page_id").agg(F.bool_and(((high <= 8) | (low >= 247)) & (high - low <= 8)).alias("bilevel"))
