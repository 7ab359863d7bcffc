"""Reading order, lines, tables and paragraphs from positioned text items. The unit of work is a page of a document."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import RTL, SPACE
from folioflow.sources.scratch import written

PAGE = ("doc_id", "page")
SPARK_TYPE = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}


def by_page(rows: DataFrame, order: tuple, columns: tuple, fold: Callable, made: dict) -> DataFrame:
    """doc_id, page and the columns `made` (name to Arrow type) that fold(*lists of a page's columns, in order) gives as lists of one length. A task
    reads its pages in order, batch by batch, and holds one page at a time."""
    names = [*PAGE, *made]

    def run(batches):
        key, held = None, [[] for _ in columns]
        for batch in itertools.chain(batches, [None]):
            out: list[list] = [[] for _ in names]
            docs, pages, *values = [[], []] if batch is None else [c.to_pylist() for c in batch.columns]
            keys = list(zip(docs, pages))
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for start, end in zip([0, *ends], [*ends, len(keys)]):
                if (not keys or keys[start] != key) and key is not None:
                    for column, new in zip(out[2:], fold(*held)):
                        column += new
                    n = len(out[2]) - len(out[0])
                    out[0] += [key[0]] * n
                    out[1] += [key[1]] * n
                    held = [[] for _ in columns]
                if keys:
                    key = keys[start]
                    for have, new in zip(held, values):
                        have += new[start:end]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), *made.values()))], names=names)

    placed = rows.select(*PAGE, *dict.fromkeys([*columns, *order])).repartition(*PAGE).sortWithinPartitions(*PAGE, *order).select(*PAGE, *columns)
    return placed.mapInArrow(run, ", ".join(f"{n} {SPARK_TYPE[t]}" for n, t in zip(names, (pa.int64(), pa.int64(), *made.values()))))


def cluster_lines(items: DataFrame, share: float = 0.45) -> DataFrame:
    """Lines of a page: items in order of height start a new line where the step exceeds share x the smaller size. Equal to the
    look-back over four lines where sizes on a line are alike."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "seq")
    step = F.col("y") - F.lag("y").over(w)
    new = (step > share * F.least(F.col("size"), F.lag("size").over(w))) | step.isNull()
    return items.withColumn("line", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cluster_lines_exact(items: DataFrame, share: float = 0.45) -> DataFrame:
    """The same with the look-back: an item joins the nearest of the last four lines within the tolerance, whose size is its largest
    item's. Sequential within a page, so a task folds its pages one by one."""

    def run(heights: list, sizes: list, seqs: list) -> tuple:
        ys: list[float] = []
        most: list[float] = []
        out = []
        for y, size in zip(heights, sizes):
            for i in range(len(ys) - 1, max(-1, len(ys) - 5), -1):
                if abs(ys[i] - y) <= share * min(most[i], size):
                    if size > most[i]:
                        most[i] = size
                    out.append(i + 1)
                    break
            else:
                ys.append(y)
                most.append(size)
                out.append(len(ys))
        return seqs, out

    told = items.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("y", "size")})
    return by_page(told, ("y", "x", "seq"), ("y", "size", "seq"), run, {"seq": pa.int64(), "line": pa.int64()})


def line_text(lines: DataFrame, gap: float = 0.18) -> DataFrame:
    """Text of each line in reading direction, with a space where the gap exceeds gap x size and neither side has one. Lines whose
    items are mostly right-to-left are read from the right."""
    per_line = Window.partitionBy(*PAGE, "line")
    rtl = F.avg(F.col("str").rlike(RTL).cast("int")).over(per_line) > 0.5
    rows = lines.withColumn("rtl", rtl).withColumn("start", F.when(F.col("rtl"), -(F.col("x") + F.col("w"))).otherwise(F.col("x")))
    rows = rows.withColumn("end", F.when(F.col("rtl"), -F.col("x")).otherwise(F.col("x") + F.col("w")))
    w = per_line.orderBy("start", "seq")
    apart = (F.col("start") - F.lag("end").over(w) > gap * F.col("size")) & ~F.lag("str").over(w).endswith(" ") & ~F.col("str").startswith(" ")
    rows = rows.withColumn("piece", F.concat(F.when(apart, " ").otherwise(""), F.col("str")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "piece"))), lambda s: s["piece"]), "")
    return rows.groupBy(*PAGE, "line").agg(text.alias("text"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y"), F.max("size").alias("size"))


def merge_superscripts(lines: DataFrame) -> DataFrame:
    """A small line just above a larger one (sizes at most 0.75 of it, within 0.6 of its size) takes that line's number."""
    w = Window.partitionBy(*PAGE).orderBy("y", "line")
    nxt, size, y = F.lead("line").over(w), F.lead("size").over(w), F.lead("y").over(w)
    raised = (F.col("size") <= 0.75 * size) & (y - F.col("y") <= 0.6 * size)
    return lines.withColumn("into", F.when(raised, nxt).otherwise(F.col("line")))


def fragments(lines: DataFrame, tight: bool = False) -> DataFrame:
    """Pieces of a line that gaps wider than max(6, size) part, if tight than max(3, 0.6 x size), with the median height of the
    largest items as base."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    right = F.max(F.col("x") + F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    least = F.greatest(F.lit(3.0), F.col("size") * 0.6) if tight else F.greatest(F.lit(6.0), F.col("size"))
    new = F.coalesce(F.col("x") - right > least, F.lit(True))
    rows = lines.withColumn("frag", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("large", F.when(F.col("size") == F.max("size").over(Window.partitionBy(*PAGE, "line", "frag")), F.col("y")))
    base = F.expr("percentile_disc(0.5) within group (order by large)")
    return rows.groupBy(*PAGE, "line", "frag").agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.min("y").alias("y"), F.max("size").alias("size"), F.count("*").alias("n"), base.alias("base"))


def gutters(frags: DataFrame, bins: int = 200, width: float = 612.0, side: float = 0.2) -> DataFrame:
    """Column gaps of pages with 8 lines or more: runs of 2 bins or more within 20 to 80 % of the width that few lines cover, with a
    share of `side` of the page's items or more, by their fragments' centres, left and right of their middle."""
    to_bin = lambda c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(c / width * bins)))
    low = range(bins // 5, bins * 4 // 5 + 1)

    def run(starts: list, ends: list, centres: list, counts: list, lines: list) -> tuple:
        found: tuple = ([], [], [])
        n_lines = len(set(lines))
        if n_lines < 8:
            return found
        step = [0] * (bins + 1)  # of the number of fragments that cover a bin
        for a, b in zip(starts, ends):
            if a <= b:
                step[a] += 1
                step[b + 1] -= 1
        few, items, bin0 = max(2.0, n_lines * 0.25), sum(counts), None
        for b, cover in enumerate(itertools.accumulate(step)):
            if b in low and cover <= few:
                bin0 = b if bin0 is None else bin0
                continue
            if bin0 is not None and b - 1 > bin0:
                middle = (bin0 + b) / 2.0 * width / bins
                left = sum(n for c, n in zip(centres, counts) if c < middle)
                if left >= side * items and items - left >= side * items:
                    for column, value in zip(found, (bin0, b - 1, middle)):
                        column.append(value)
            bin0 = None
        return found

    # a fragment without a place covers nothing and lies left of nothing
    known = F.col("x0").isNotNull() & F.col("x1").isNotNull()
    rows = frags.withColumns({
        "start": F.when(known, to_bin(F.col("x0"))).otherwise(1), "end": F.when(known, to_bin(F.col("x1"))).otherwise(0),
        "centre": F.coalesce((F.col("x0") + F.col("x1")) / 2, F.lit(float("nan"))),
    })
    return by_page(rows, ("line",), ("start", "end", "centre", "n", "line"), run, {"bin0": pa.int64(), "bin1": pa.int64(), "middle": pa.float64()})


def reading_order(frags: DataFrame, gaps: DataFrame) -> DataFrame:
    """Place of each fragment: those that cross a column gap stay where they are; between them the columns are read one by one. Pages
    without a gap have one column. A page has fewer gaps than bins."""
    per_page = gaps.groupBy(*PAGE).agg(F.collect_list("middle").alias("gaps"))
    rows = frags.join(per_page, list(PAGE), "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<double>")))
    wide = F.exists("gaps", lambda g: (F.col("x0") < g) & (F.col("x1") > g))
    column = F.size(F.filter("gaps", lambda g: g < (F.col("x0") + F.col("x1")) / 2))
    w = Window.partitionBy(*PAGE).orderBy("y", "x0", "line", "frag")
    rows = rows.withColumn("wide", wide).withColumn("col", F.when(F.col("wide"), -1).otherwise(column))
    rows = rows.withColumn("band", F.sum(F.col("wide").cast("long")).over(w))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "col", "y", "x0", "line", "frag")).cast("long"))


def table_runs(frags: DataFrame, least_cells: int, pitch: float, least_rows: int) -> DataFrame:
    """Runs of at least least_rows neighbouring rows with least_cells fragments or more and a pitch below pitch x size."""
    rows = frags.groupBy(*PAGE, "line").agg(F.count("*").alias("cells"), F.min("y").alias("y"), F.max("size").alias("size"))
    w = Window.partitionBy(*PAGE).orderBy("y", "line")
    good = F.col("cells") >= least_cells
    joined = good & F.lag(good).over(w) & (F.col("y") - F.lag("y").over(w) < pitch * F.col("size"))
    marked = rows.withColumn("run", F.sum((~F.coalesce(joined, F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(good)
    return marked.groupBy(*PAGE, "run").agg(F.count("*").alias("rows"), F.min("cells").alias("min_cells"), F.min("y").alias("y0"), F.max("y").alias("y1")).where(F.col("rows") >= least_rows)


def detect_tables(frags: DataFrame, pitch: float = 3.2, gap: float = 6.0, most: int = 12, share: float = 0.6) -> DataFrame:
    """Tables: runs of neighbouring rows of two fragments or more with a pitch below pitch x size, of three rows, or of two whose
    rows all have three. Its columns are parted where nothing covers `gap` points or more of its width, in 1 to `most` places, and
    `share` of its rows or more have two cells. One row a table: rows, columns, edges and the median pitch."""
    rows = frags.groupBy(*PAGE, "line").agg(F.count("*").alias("cells"), F.min("y").alias("top"), F.max("size").alias("row_size"))
    w = Window.partitionBy(*PAGE).orderBy("top", "line")
    good = F.col("cells") >= 2
    step = F.col("top") - F.lag("top").over(w)
    joined = good & F.lag(good).over(w) & (step < pitch * F.col("row_size"))
    marked = rows.withColumn("joined", F.coalesce(joined, F.lit(False))).withColumn("step", F.when(F.col("joined"), step))
    marked = marked.withColumn("run", F.sum((~F.col("joined")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(good)
    runs = marked.groupBy(*PAGE, "run").agg(
        F.count("*").alias("rows"), F.min("cells").alias("min_cells"), F.min("top").alias("y0"), F.max("top").alias("y1"), F.expr("percentile_disc(0.5) within group (order by step)").alias("pitch")
    ).where("rows >= 3 or (rows >= 2 and min_cells >= 3)")
    inner = frags.join(marked.select(*PAGE, "line", "run"), [*PAGE, "line"]).join(runs.select(*PAGE, "run"), [*PAGE, "run"])
    across = Window.partitionBy(*PAGE, "run").orderBy("x0", "x1", "line", "frag")
    right = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    cells = inner.withColumn("right", right).withColumn("gap_at", F.when(F.col("x0") - F.col("right") >= gap, (F.col("x0") + F.col("right")) / 2))
    # every place that parts columns lies left of the fragments that follow it, so a running count is a fragment's column
    cells = cells.withColumn("col", F.count("gap_at").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    per_row = cells.groupBy(*PAGE, "run", "line").agg(F.countDistinct("col").alias("cols"))
    full = per_row.groupBy(*PAGE, "run").agg(F.count_if(F.col("cols") >= 2).alias("full"))
    edges = cells.groupBy(*PAGE, "run").agg(F.max("col").alias("parted"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    out = runs.join(edges, [*PAGE, "run"]).join(full, [*PAGE, "run"])
    out = out.where((F.col("parted") >= 1) & (F.col("parted") <= most) & (F.col("full") >= share * F.col("rows")))
    return out.select(*PAGE, "run", "rows", "min_cells", (F.col("parted") + 1).alias("columns"), "x0", "x1", "y0", "y1", "pitch")


def block_text(lines: DataFrame, tight: float = 1.45, loose: float = 2.2, dehyphenate: bool = False) -> DataFrame:
    """Text of each page's lines: a paragraph break where the gap exceeds tight x the median gap or loose x size; if asked for, a word
    that a hyphen parts at a line end is joined with its rest in lower case."""
    w = Window.partitionBy(*PAGE).orderBy("y", "line")
    gap = F.col("y") - F.lag("y").over(w)
    rows = lines.withColumn("gap", gap)
    rows = rows.withColumn("median", F.expr("percentile_disc(0.5) within group (order by gap)").over(Window.partitionBy(*PAGE)))
    rows = rows.withColumn("sep", F.when(F.col("gap").isNull(), "").when((F.col("gap") > tight * F.col("median")) | (F.col("gap") > loose * F.col("size")), "\n\n").otherwise(" "))
    if dehyphenate:
        cut = lambda text, after: text.rlike(r"\p{L}-$") & after.rlike(r"^\p{Ll}")
        rows = rows.withColumn("goes_on", F.coalesce(cut(F.col("text"), F.lead("text").over(w)) & (F.lead("sep").over(w) == " "), F.lit(False)))
        rows = rows.withColumn("sep", F.when(F.lag("goes_on").over(w), "").otherwise(F.col("sep")))
        rows = rows.withColumn("text", F.when(F.col("goes_on"), F.regexp_replace("text", "-$", "")).otherwise(F.col("text")))
    rows = rows.withColumn("piece", F.concat("sep", "text"))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line", "piece"))), lambda s: s["piece"]), "").alias("text"))


def _edges_told(lines: DataFrame, height: float, most: int) -> DataFrame:
    """Lines with `kind` and `key` where they are the first line of a page in its top tenth or the last in its bottom tenth, and with `first`, which
    one line a page is. One pass, as all lines of a page are together, in which only lines at the edges carry a text."""
    top, bottom = F.col("y") <= 0.1 * height, F.col("y") >= 0.9 * height
    rows = lines.withColumn("key", F.when((F.length("text") <= most) & (top | bottom), F.regexp_replace(F.lower("text"), "[0-9]+", "#")))
    w, place = Window.partitionBy(*PAGE), F.struct("y", "line")
    rows = rows.withColumns({"first": F.min(place).over(w)["line"] == F.col("line"), "last": F.max(place).over(w)["line"] == F.col("line")})
    rows = rows.withColumn("kind", F.when(F.col("key").isNotNull(), F.when(F.col("first") & top, "header").when(F.col("last") & bottom, "footer")))
    return rows.withColumn("key", F.when(F.col("kind").isNotNull(), F.col("key"))).drop("last")


def _running(told: DataFrame, share: float, width: float) -> DataFrame:
    pages = told.groupBy("doc_id").agg(F.count(F.when(F.col("first"), F.col("page"))).alias("pages")).where("pages >= 2")
    centre = F.avg((F.col("x0") + F.col("x1")) / 2) / width
    counts = told.where("kind is not null").groupBy("doc_id", "kind", "key").agg(F.count("*").alias("n"), centre.alias("centre"))
    found = counts.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share)))
    align = F.when(F.col("centre") < 0.38, "left").when(F.col("centre") > 0.62, "right").otherwise("centre")
    return found.select("doc_id", "kind", "key", "n", "pages", align.alias("align"))


def running_headers(lines: DataFrame, share: float = 0.6, most: int = 120, height: float = 792.0, width: float = 612.0) -> DataFrame:
    """Headers and footers: first and last lines in the top and bottom tenth of the pages, with digits as #, that repeat on
    max(2, share x pages) pages of a document of several pages, aligned by their mean centre at 38 and 62 % of the width."""
    return _running(_edges_told(lines, height, most), share, width)


def without_running(lines: DataFrame, share: float = 0.6, most: int = 120, height: float = 792.0, width: float = 612.0, keep: tuple | None = None) -> DataFrame:
    """The lines without running headers and footers, with the columns `keep` (all, if None). Lines are made once and written with these, since
    they are asked for several times."""
    keep = list(lines.columns if keep is None else keep)
    told, edge = _edges_told(lines, height, most), F.col("kind").isNotNull()
    need = ["doc_id", "page", "first", "kind", "key", F.when(edge, F.col("x0")).alias("x0"), F.when(edge, F.col("x1")).alias("x1")]
    told = written(told.select(F.struct(*keep).alias("row"), *need))
    gone = _running(told, share, width).select("doc_id", "kind", "key")
    edges = told.where("kind is not null").join(gone, ["doc_id", "kind", "key"], "left_anti")
    return told.where("kind is null").select("row.*").unionByName(edges.select("row.*"))


def stitch_columns(blocks: DataFrame) -> DataFrame:
    """Blocks in order; one that does not end a sentence runs on in the next if that starts in lower case or with `(`, has the same size
    and stands higher on the page. `part` numbers the paragraphs that result."""
    w = Window.partitionBy(*PAGE).orderBy("place")
    open_ = ~F.lag("text").over(w).rlike(r"[.!?:]\s*$") & F.col("text").rlike(r"^[\p{Ll}(]") & (F.lag("size").over(w) == F.col("size")) & (F.col("y") < F.lag("y").over(w))
    new = ~F.coalesce(open_, F.lit(False))
    return blocks.withColumn("part", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def text_in_box(items: DataFrame, boxes: DataFrame, pad: float) -> DataFrame:
    """Items whose point lies in a box, give or take pad, joined in order for each box. The page is the equality that keeps the range
    test small."""
    b = boxes.select(*PAGE, "box", "x0", "y0", "x1", "y1")
    inside = items.join(b, list(PAGE)).where(F.col("x").between(F.col("x0") - pad, F.col("x1") + pad) & F.col("y").between(F.col("y0") - pad, F.col("y1") + pad))
    return inside.groupBy(*PAGE, "box").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda s: s["str"]), " ").alias("text"))


def attach_links(items: DataFrame, links: DataFrame, pad: float = 2.0) -> DataFrame:
    """The first link (by ord) whose rectangle holds an item's centre."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") - 0.3 * F.col("size")
    hit = items.join(links, list(PAGE)).where(cx.between(F.col("lx0") - pad, F.col("lx1") + pad) & cy.between(F.col("ly0") - pad, F.col("ly1") + pad))
    return hit.groupBy(*PAGE, "seq").agg(F.min_by("href", "ord").alias("href"))


def assign_columns(frags: DataFrame, separators: list[float]) -> DataFrame:
    """Column of each fragment: how many separators lie left of its centre."""
    centre = (F.col("x0") + F.col("x1")) / 2
    return frags.withColumn("col", F.size(F.filter(F.array(*[F.lit(float(s)) for s in separators]), lambda s: s < centre)).cast("long"))


def attach_markers(markers: DataFrame, lines: DataFrame, width: float = 612.0) -> DataFrame:
    """Each list marker with the nearest text line right of it (centres within 0.6 of its height, gap below a quarter of the
    width); markers choose in order and a line serves once. Greedy, so a task folds its pages one by one, and a marker looks only at the lines of its height."""
    both = markers.select(*PAGE, F.lit(0).alias("kind"), "idx", "x0", "x1", "y", "h").unionByName(lines.select(*PAGE, F.lit(1).alias("kind"), "idx", "x0", "x1", "y", "h"))

    def run(kinds: list, ids: list, lefts: list, rights: list, ys: list, heights: list) -> tuple:
        split = kinds.index(1) if 1 in kinds else len(kinds)
        rows = sorted((y, x0, i) for y, x0, i in zip(ys[split:], lefts[split:], ids[split:]) if y == y and x0 == x0)
        levels, used, found = [r[0] for r in rows], set(), ([], [])
        for i, x1, y, h in zip(ids[:split], rights, ys, heights):
            best = None
            # a little more than the reach, as sums round; the test itself is on the difference
            for j in range(bisect_left(levels, y - 0.61 * h), bisect_right(levels, y + 0.61 * h)):
                r, x0, line = rows[j]
                if x0 >= x1 and x0 - x1 < width / 4 and abs(r - y) <= 0.6 * h and line not in used and (best is None or (x0, line) < best):
                    best = (x0, line)
            if best is not None:
                used.add(best[1])
                found[0].append(i)
                found[1].append(best[1])
        return found

    known = both.dropna(subset=["y", "x0"]).where("kind = 1 or (x1 is not null and h is not null)")
    return by_page(known, ("kind", "idx"), ("kind", "idx", "x0", "x1", "y", "h"), run, {"marker": pa.int64(), "line": pa.int64()})


MOST_TRIES = 12
LEVELS = (0.0, 0.05, 0.15, 0.35)


def _column_gap(rows: list, least: int, gap: float = 6.0) -> float | None:
    """Where a region's rows (id, x0, x1, y) part into two columns, if they do. Gaps are looked for at rising shares of rows that may
    cover them, wider ones first, MOST_TRIES at most; both sides need `least` rows, of which 15 % or four are long, and must stand beside
    each other over 40 % of the lower one's height; at most 35 % of the rows cross."""
    edges = sorted({r[1] for r in rows} | {r[2] for r in rows})
    # between two edges that follow each other lie the rows that have begun and not ended
    begun, over = (sorted(r[i] for r in rows if r[1] <= r[2]) for i in (1, 2))
    spans = [(a, b, bisect_left(begun, b) - bisect_right(over, a)) for a, b in zip(edges, edges[1:])]
    tries = 0
    for level in LEVELS:
        runs: list[list[float]] = []
        for a, b, covered in spans:
            if covered > level * len(rows):
                continue
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        for a, b in sorted((r for r in runs if r[1] - r[0] >= gap), key=lambda r: (r[0] - r[1], r[0])):
            tries += 1
            if tries > MOST_TRIES:
                return None
            x = (a + b) / 2
            left, right = [r for r in rows if r[2] <= x], [r for r in rows if r[1] >= x]
            if min(len(left), len(right)) < least or len(rows) - len(left) - len(right) > 0.35 * len(rows):
                continue
            low, high = max(min(r[3] for r in side) for side in (left, right)), min(max(r[3] for r in side) for side in (left, right))
            if high - low < 0.4 * min(max(r[3] for r in side) - min(r[3] for r in side) for side in (left, right)):
                continue
            half = [0.5 * (max(q[2] for q in side) - min(q[1] for q in side)) for side in (left, right)]
            wide = [sum(r[2] - r[1] >= least_width for r in side) for least_width, side in zip(half, (left, right))]
            if all(n >= min(4, 0.15 * len(side)) for n, side in zip(wide, (left, right))):
                return x
    return None


def _regions(rows: list, depth: int, least: int) -> list[list]:
    """The regions of rows in reading order. Rows that cross a column gap part the columns into bands and are regions of their own."""
    x = _column_gap(rows, least) if depth > 0 and len(rows) >= 2 * least else None
    if x is None:
        return [rows] if rows else []
    out: list[list] = []
    band: list = []
    for r in [*sorted(rows, key=lambda r: (r[3], r[1])), None]:
        if r is not None and (r[2] <= x or r[1] >= x):
            band.append(r)
            continue
        for side in ([q for q in band if q[2] <= x], [q for q in band if q[1] >= x]):
            out += _regions(side, depth - 1, least)
        band = []
        if r is not None:
            out.append([r])
    return out


def xy_cut(frags: DataFrame, depth: int = 3, least: int = 5) -> DataFrame:
    """Region of each fragment by a recursive search for column gaps, `depth` times at most, in reading order. A task folds its pages one by one."""

    def run(lefts: list, rights: list, ys: list, lines: list, frags: list) -> tuple:
        place = [0] * len(ys)
        for i, region in enumerate(_regions(list(zip(range(len(ys)), lefts, rights, ys)), depth, least)):
            for r in region:
                place[r[0]] = i
        return lines, frags, place

    return by_page(frags, ("y", "x0", "line", "frag"), ("x0", "x1", "y", "line", "frag"), run, {"line": pa.int64(), "frag": pa.int64(), "region": pa.int64()})


LIST_ITEM = rf"^{SPACE}*(?:[•‣▪●○*–—-]{SPACE}|\(?[0-9]{{1,3}}[.)]{SPACE}|[a-z][.)]{SPACE})"
ENDS_SENTENCE = rf"[.!?]{SPACE}*$"


def _nth(value: Column, at: Column, w) -> Column:
    """The value on the row that is number `at` (from 0) of the partition in order of value; null on all others."""
    return F.when(F.row_number().over(w.orderBy(F.asc_nulls_last(value))) == at + 1, value)


def build_paragraphs(lines: DataFrame, body: float = 12.0) -> DataFrame:
    """Paragraphs of each page. A line starts one if it is a heading (1.18 x body, below 200 characters), has another size (12 %), stands
    farther away than 1.5 times the usual pitch, is a list item or indented by more than a size, or follows a short line that ends a
    sentence. Else it goes on with a space, or with a line break behind a line that ends far from the right edge. Level (1 from 1.6,
    2 from 1.3 x body, else 3 for headings), alignment and indent are told. Each line looks at the one before it only, so windows over
    the page do."""
    w = Window.partitionBy(*PAGE)
    down = w.orderBy("y", "line")
    last = F.count("*").over(w) - 1
    rows = lines.withColumn("bp_head", (F.col("size") >= 1.18 * body) & (F.length("text") < 200)).withColumn("bp_step", F.col("y") - F.lag("y").over(down))
    rows = rows.withColumns({
        "bp_right": _nth(F.col("x1"), F.floor(last * 0.85), w), "bp_left": _nth(F.col("x0"), F.floor(last * 0.15), w), "bp_pitch": _nth(F.col("bp_step"), F.floor(last / 2), w),
    })
    rows = rows.withColumns({
        "bp_right": F.max("bp_right").over(w), "bp_left": F.max("bp_left").over(w), "bp_pitch": F.coalesce(F.max("bp_pitch").over(w), F.lit(body)),
        "bp_before": F.lag(F.struct("bp_head", "size", "x0", "x1", "text")).over(down),
    })
    before, size, right, left = F.col("bp_before"), F.col("size"), F.col("bp_right"), F.col("bp_left")
    starts = (
        before.isNull() | F.col("bp_head") | before["bp_head"] | (F.abs(size - before["size"]) > 0.12 * before["size"]) | (F.col("bp_step") > 1.5 * F.col("bp_pitch"))
        | F.col("text").rlike(LIST_ITEM) | (F.col("x0") - before["x0"] > size) | ((before["x1"] < right - 3 * size) & before["text"].rlike(ENDS_SENTENCE))
    )
    lead, trail = F.col("x0") - left, right - F.col("x1")
    rows = rows.withColumns({
        "bp_new": starts,
        "bp_level": F.when(~F.col("bp_head"), 0).when(size >= 1.6 * body, 1).when(size >= 1.3 * body, 2).otherwise(3).cast("long"),
        "bp_align": F.when((F.least(lead, trail) > 2 * size) & (F.abs(lead - trail) < size), "centre").when((lead > 2 * size) & (F.abs(trail) < size), "right").otherwise("left"),
        "bp_indent": F.greatest(F.lit(0.0), lead),
    })
    joint = F.when(F.col("bp_new"), "").when(before["x1"] < right - 0.25 * (right - left), "\n").otherwise(" ")
    rows = rows.withColumn("para", F.sum(F.col("bp_new").cast("long")).over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("bp_piece", F.concat(joint, F.col("text")))
    first = F.min(F.struct("y", "line", "bp_level", "bp_align", "bp_indent", "x0", "size"))
    pieces = F.array_sort(F.collect_list(F.struct("y", "line", "bp_piece")))
    paras = rows.groupBy(*PAGE, "para").agg(F.array_join(F.transform(pieces, lambda s: s["bp_piece"]), "").alias("text"), first.alias("f"), F.max("y").alias("y1"))
    return paras.select(
        *PAGE, "para", "text", F.col("f.bp_level").alias("level"), F.col("f.bp_align").alias("align"), F.col("f.bp_indent").alias("indent"),
        F.col("f.x0").alias("x0"), F.col("f.y").alias("y0"), "y1", F.col("f.size").alias("size"),
    )


def designed_pages(frags: DataFrame, boxes: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Pages that look designed: below 900 items and short fragments (below 35 / 6 words on average) beside three boxes or more or boxes
    over more than 8 % of the page, or half of the lines or more parted into short columns side by side; a document is exact when
    half of its pages are. boxes has x0, y0, x1, y1."""
    short = F.col("n") < 35 / 6
    lines = frags.groupBy(*PAGE, "line").agg(F.count("*").alias("frags"), F.min(short).alias("short"), F.sum("n").alias("n"))
    pages = lines.groupBy(*PAGE).agg(F.sum("n").alias("items"), (F.sum("n") / F.sum("frags")).alias("mean"), F.avg(((F.col("frags") >= 2) & F.col("short")).cast("int")).alias("beside"))
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / (width * height)
    marked = pages.join(boxes.groupBy(*PAGE).agg(F.count("*").alias("boxes"), area.alias("area")), list(PAGE), "left")
    boxed = (F.col("mean") < 35 / 6) & ((F.coalesce("boxes", F.lit(0)) >= 3) | (F.coalesce("area", F.lit(0.0)) > 0.08))
    rows = marked.select(*PAGE, ((F.col("items") < 900) & (boxed | (F.col("beside") >= 0.5))).alias("designed"))
    return rows.withColumn("exact", F.avg(F.col("designed").cast("int")).over(Window.partitionBy("doc_id")) >= 0.5)


SIGNS = frozenset("|·¦*•")


def structure_ocr(words: DataFrame) -> DataFrame:
    """Boxes of recognised words in reading order (place). Words that overlap the first of a row by more than 60 % in height are a row; it is
    cut at gaps above 1.25 heights, and a row of three boxes or more anew at 1.5 times its median gap. Lone separator signs become •. Runs
    of rows that are two boxes on either side of the page's middle are read left first. level tells headings by their height, 1.9, 1.3
    or 1.16 times the body's. A row's height is its first word's and a box depends on all gaps of its row, so a task folds its pages one by one. A
    word without a text, a place or a size belongs to no row."""

    def run(ys: list, xs: list, ws: list, sizes: list, texts: list) -> tuple:
        rows: list[list] = []
        top = low = 0.0
        for y, x, w, size, text in zip(ys, xs, ws, sizes, texts):
            if rows and min(low, y) - max(top, y - size) > 0.6 * min(low - top, size):
                rows[-1].append((x, y, w, text, size))
            else:
                top, low = y - size, y
                rows.append([(x, y, w, text, size)])
        body, middle = sorted(sizes)[len(sizes) // 2], (min(xs) + max(x + w for x, w in zip(xs, ws))) / 2
        told, beside = [], []  # of each row: its boxes, and whether they are two on either side of the middle
        for words in rows:
            words.sort()
            gaps = [b[0] - (a[0] + a[2]) for a, b in zip(words, words[1:])]
            limit = 1.25 * words[0][4]
            if sum(g > limit for g in gaps) >= 2:
                limit = max(limit, 1.5 * sorted(gaps)[len(gaps) // 2])
            cuts = [0, *(i for i, g in enumerate(gaps, 1) if g > limit), len(words)]
            told.append([words[a:b] for a, b in zip(cuts, cuts[1:])])
            beside.append(len(cuts) == 3 and words[cuts[1] - 1][0] + words[cuts[1] - 1][2] <= middle <= words[cuts[1]][0])
        order, out = [], ([], [], [], [], [])
        # rows of two columns that follow each other are an island; its left boxes are read before its right ones
        for two, island in itertools.groupby(range(len(rows)), beside.__getitem__):
            island = list(island)
            order += [(r, box) for box in (0, 1) for r in island] if two else [(r, box) for r in island for box in range(len(told[r]))]
        for place, (r, box) in enumerate(order):
            words = told[r][box]
            share = max(w[4] for w in words) / body if body else 0.0
            text = " ".join("•" if w[3] in SIGNS else w[3] for w in words)
            for column, value in zip(out, (place, r, box, text, 1 if share >= 1.9 else 2 if share >= 1.3 else 3 if share >= 1.16 else 0)):
                column.append(value)
        return out

    order = ("y", "x", "w", "size", "str")
    made = {"place": pa.int64(), "row": pa.int64(), "box": pa.int64(), "text": pa.string(), "level": pa.int64()}
    return by_page(words.dropna(subset=order), order, order, run, made)


def rejoin_paragraphs(paras: DataFrame, near: float = 0.8) -> DataFrame:
    """Paragraphs cut apart are joined: the one before ends without . ! ? :, this one starts in lower case and is no list item, both are body
    text, begin within half a size of each other and the gap between them is below `near` sizes more than a line; `part` numbers them."""
    w = Window.partitionBy(*PAGE).orderBy("para")
    close = (F.col("y0") - F.lag("y1").over(w) < (1 + near) * F.col("size")) & (F.abs(F.col("x0") - F.lag("x0").over(w)) <= 0.5 * F.col("size"))
    item = F.col("text").rlike(LIST_ITEM)
    runs_on = ~F.lag("text").over(w).rlike(r"[.!?:]\s*$") & F.col("text").rlike(r"^\p{Ll}") & ~item & (F.col("level") == 0) & (F.lag("level").over(w) == 0) & close
    rows = paras.withColumn("part", F.sum((~F.coalesce(runs_on, F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*PAGE, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda s: s["text"]), " ").alias("text"))


def with_list_numbers(paras: DataFrame, markers: DataFrame, joined: DataFrame) -> DataFrame:
    """Paragraph lines (doc_id, page, line, text) with the list marker that attach_markers() gave them (marker, line) in front."""
    named = joined.join(markers.select(*PAGE, F.col("idx").alias("marker"), F.col("text").alias("sign")), [*PAGE, "marker"]).select(*PAGE, "line", "sign")
    return paras.join(named, [*PAGE, "line"], "left").withColumn("text", F.concat(F.when(F.col("sign").isNotNull(), F.concat("sign", F.lit(" "))).otherwise(""), F.col("text"))).drop("sign")


def ocr_confidence(words: DataFrame, by: Column, name: str) -> DataFrame:
    """Mean confidence of the words that are not blank, rounded half up; null where there is none."""
    real = (F.trim("str") != "") & F.col("confidence").isNotNull() & ~F.isnan(F.col("confidence").cast("double"))
    return words.groupBy(by.alias(name)).agg(F.floor(F.avg(F.when(real, F.col("confidence"))) + 0.5).cast("long").alias("confidence"))


def flatten_ocr(pages: DataFrame) -> DataFrame:
    """Words of a blocks - paragraphs - lines - words tree, blank ones dropped."""
    b = pages.select("doc_id", "page", F.explode("blocks").alias("b"))
    p = b.select("doc_id", "page", F.explode("b.paragraphs").alias("p"))
    li = p.select("doc_id", "page", F.posexplode("p.lines").alias("line", "l"))
    return li.select("doc_id", "page", F.col("line").cast("long").alias("line"), F.explode("l.words").alias("w")).select("doc_id", "page", "line", "w.text", "w.confidence").where(F.trim("text") != "")
