"""Text statistics, reports and checks over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def text_stats(df: DataFrame, col: str = "text") -> DataFrame:
    """Words, characters, characters without white space, paragraphs and different words of each text."""
    c = F.col(col)
    # white space is searched for once: as single spaces, it parts the words and can be taken out
    told = df.withColumn("stats_flat", F.trim(F.regexp_replace(c, T.SPACE + "+", " "))).withColumn("stats_dense", F.replace("stats_flat", F.lit(" "), F.lit("")))
    return told.select(
        *df.columns,
        (F.length("stats_flat") - F.length("stats_dense") + (F.col("stats_flat") != "").cast("int")).cast("long").alias("words"),
        T.graphemes(F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))).alias("chars"),
        T.graphemes(F.col("stats_dense")).alias("chars_ns"),
        F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(T.NOT_SPACE))).cast("long").alias("paragraphs"),
        F.size(F.array_distinct(T.words(c))).cast("long").alias("unique_words"),
    )


def top_words(df: DataFrame, col: str = "text", by: tuple = (), k: int = 10, skip_common: bool = True) -> DataFrame:
    """The k most frequent lower-cased words of each group, with their share of all its words in percent (1 decimal).
    Stop words and bare numbers can be skipped; they still count in the total. Ties go by code point. Without groups only the k
    words of a sort that keeps no more are ranked."""
    counts = df.select(*by, F.explode(T.words(F.col(col))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counts = counts.withColumn("total", F.sum("n").over(group)) if by else counts.join(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # one row
    if skip_common:
        counts = counts.where(~F.col("word").isin(*T.STOP_WORDS) & ~F.col("word").rlike(T.NUMBER_ONLY))
    if not by:
        counts = counts.orderBy(F.desc("n"), "word").limit(k)
    ranked = counts.withColumn("rank", F.row_number().over(group.orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)
    share = F.floor(F.col("n") * 1000 / F.col("total") + 0.5) / 10
    return ranked.select(*by, F.col("rank").cast("long").alias("rank"), "word", "n", share.alias("share"))


def top_words_sketched(df: DataFrame, checkpointed, col: str = "text", by: tuple = ("lang",), k: int = 10, skip_common: bool = True, tracked: int = 10_000) -> DataFrame:
    """The rows of top_words() without counts of all words: a sketch of frequent words a group, made in every task and merged, names 4 k
    candidates, which alone are counted exactly.

    A word that is no candidate occurs at most as often as the least estimate of the candidates, or, where the sketch named fewer, as
    twice the sketch's error, 7 / tracked of the group's words. A group whose k-th candidate occurs no more often than that is counted
    as a whole, so that the result is the exact one in any case. Groups are few: a candidate is a row of at most 4 k a group."""
    c = F.col("word")
    common = c.isin(*T.STOP_WORDS) | c.rlike(T.NUMBER_ONLY) if skip_common else F.lit(False)
    words = df.select(*by, F.explode(T.words(F.col(col))).alias("word"))
    kept = words.where(~common)
    asked = 4 * k
    sketch = kept.groupBy(*by).agg(F.expr(f"approx_top_k(word, {asked}, {tracked})").alias("top"))
    held = words.groupBy(*by).agg(F.count("*").alias("total"))
    named = checkpointed(sketch.select(*by, "top").join(held, list(by)).withColumn(
        "most", F.when(F.size("top") == asked, F.array_min(F.transform("top", lambda x: x["count"])).cast("double")).otherwise(F.col("total") * 7.0 / tracked)
    ))
    candidates = named.select(*by, F.explode(F.transform("top", lambda x: x["item"])).alias("word"))
    counts = kept.join(F.broadcast(candidates), [*by, "word"]).groupBy(*by, "word").agg(F.count("*").alias("n")).join(named.select(*by, "total", "most"), list(by))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)
    # sure: k candidates occur more often than any other word can
    sure = ranked.groupBy(*by).agg(((F.count("*") == k) & (F.min("n") > F.first("most"))).alias("sure")).where("sure").select(*by)
    share = F.floor(F.col("n") * 1000 / F.col("total") + 0.5) / 10
    told = ranked.join(sure, list(by), "left_semi").select(*by, F.col("rank").cast("long").alias("rank"), "word", "n", share.alias("share"))
    return told.unionByName(top_words(df.join(sure, list(by), "left_anti"), col, by, k, skip_common))


def reading_time(df: DataFrame, words: str, by: str) -> DataFrame:
    """Reading and speaking seconds and labels of every row, and the group's total seconds."""
    read, speak = T.seconds_for(F.col(words), T.READ_WPM), T.seconds_for(F.col(words), T.SPEAK_WPM)
    totals = df.groupBy(by).agg(F.sum(read).alias("group_read_sec"))
    rows = df.select("*", read.alias("read_sec"), speak.alias("speak_sec"), T.time_label(read).alias("read_label"), T.time_label(speak).alias("speak_label"))
    return rows.join(totals, by)


def limit_report(df: DataFrame, count: str, key: str, limits: DataFrame) -> DataFrame:
    """Each row against its group's limit: percent (100 at most), over, and by how much it is over or below."""
    joined = df.join(limits, key, "left")
    lim = F.when(F.col("max_count") >= 1, F.col("max_count"))
    over = F.col(count) > lim
    return joined.select(
        *df.columns, lim.alias("max_count"), F.least(F.lit(100.0), F.col(count) / lim * 100).alias("pct"), over.alias("over"),
        F.when(over, F.col(count) - lim).alias("over_by"), F.when(~over, lim - F.col(count)).alias("left_over"),
    )


def files_by_type(df: DataFrame, name: Column, size: Column) -> DataFrame:
    return df.groupBy(T.file_type(name).alias("type")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def admit_files(df: DataFrame, name: str, size: str, order: str, exts: tuple, max_bytes: int, max_files: int, part: str) -> DataFrame:
    """Intake: a reason for each file: `type`, `empty`, `size`, `count` (beyond the first max_files good ones) or `ok`."""
    ext = F.lower(F.element_at(F.split(F.col(name), r"\."), -1))
    first = F.when(~ext.isin(*exts), "type").when(F.col(size) <= 0, "empty").when(F.col(size) > max_bytes, "size")
    checked = df.withColumn("fault", first)
    place = F.count(F.when(F.col("fault").isNull(), 1)).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return checked.select(*df.columns, F.coalesce("fault", F.when(place > max_files, "count"), F.lit("ok")).alias("reason"))


def assemble_text(pages: DataFrame, key: str, page: str, col: str, banner: bool) -> DataFrame:
    """One text a document: its non-blank pages in order with empty lines between, each under a banner if asked."""
    shown = pages.where(F.trim(F.col(col)) != "")
    body = F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(col)) if banner else F.col(col)
    return shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), body.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def corpus_totals(df: DataFrame) -> DataFrame:
    """Documents, words, characters and empty documents by method (text or needs recognition)."""
    return df.groupBy("method").agg(
        F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.count_if(F.col("words") == 0).alias("empty")
    )


def storage_usage(df: DataFrame, col: str, by: str, cap: int = 5 * 1024 * 1024) -> DataFrame:
    """Two bytes a character by group, and percent of the cap, 100 at most."""
    used = df.groupBy(by).agg((F.sum(F.length(col)) * 2).alias("bytes"))
    return used.select(by, "bytes", F.least(F.lit(100.0), F.col("bytes") / cap * 100).alias("pct"))


def duplicate_values(df: DataFrame, key: str, cols: tuple) -> DataFrame:
    """The rows that share a non-blank value in one of the columns with another row, one for each, with the number that do; a value may
    have any number of members."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in cols])
    rows = df.select(key, F.explode(pairs).alias("x")).select(key, "x.field", "x.value").where(F.col("value").isNotNull() & (F.col("value") != ""))
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(counts, ["field", "value"])


def triage(df: DataFrame, text: str, cover: str, text_min: int = 20) -> DataFrame:
    """Route of a page: text, ocr (little text and a large image, or garbled text) or none."""
    n = F.length(F.trim(F.col(text)))
    route = (
        F.when(T.garbled(F.col(text)), "ocr").when(n >= text_min, "text").when((n < text_min) & (F.col(cover) >= 0.1), "ocr").when(n > 0, "text").otherwise("none")
    )
    return df.select(*df.columns, route.alias("route"))


def triage_with(df: DataFrame, mode: str, by: str, order: str, text: str = "text", cover: str = "cover", failed: str = "failed", text_min: int = 20, most: int = 50) -> DataFrame:
    """The route of each page under a mode: `auto` as triage() has it, with a bad font told by the column bad_font counting as garbled,
    `all` recognises every page and `off` none. At most `most` pages of a group, in order, are recognised, the others are skipped;
    a page whose recognition failed says so."""
    n = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s", ""))
    auto = ((n < text_min) & (F.col(cover) >= 0.1)) | T.garbled(F.col(text)) | F.col("bad_font")
    wanted = {"auto": auto, "all": F.lit(True), "off": F.lit(False)}[mode]
    rows = df.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    place = F.sum(F.col("wanted").cast("long")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    route = F.when(F.col("wanted") & (place > most), "skipped").when(F.col("wanted") & F.col(failed), "ocr failed").when(F.col("wanted"), "ocr").when(n > 0, "text").otherwise("none")
    return rows.withColumn("route", route).drop("wanted")


def verify_integrity(before: DataFrame, after: DataFrame, key: str, col: str) -> DataFrame:
    """Digest and length of each source before and after; rows missing on a side or changed are not intact."""

    def marks(df: DataFrame, side: str) -> DataFrame:
        return df.select(key, F.sha2(col, 256).alias(f"sha_{side}"), F.length(col).cast("long").alias(f"n_{side}"))

    both = marks(before, "before").join(marks(after, "after"), key, "full")
    intact = F.col("sha_before").eqNullSafe(F.col("sha_after")) & F.col("n_before").eqNullSafe(F.col("n_after"))
    return both.select(key, "n_before", "n_after", intact.alias("intact"))


def replace_phrases(df: DataFrame, col: str, phrases: list[tuple[str, str]]) -> DataFrame:
    """Literal replacements in order; `changed` tells where anything was replaced."""
    c = F.col(col)
    for old, new in phrases:
        c = F.replace(c, F.lit(old), F.lit(new))
    return df.withColumn("new_text", c).withColumn("changed", F.col("new_text") != F.col(col))


def validate_message(df: DataFrame, name: str, email: str, subject: str, message: str) -> DataFrame:
    """The first rule that a message breaks, or ok."""
    n = F.length(F.trim(F.col(message)))
    missing = F.lit(False)
    for c in (name, email, subject, message):
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    verdict = F.when(missing, "missing").when(~T.valid_email(F.col(email)), "email").when(n < 10, "short").when(n > 5000, "long").otherwise("ok")
    return df.select(*df.columns, verdict.alias("verdict"))
