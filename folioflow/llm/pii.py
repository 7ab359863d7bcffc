"""Personal data: patterns, and terms that corpus co-occurrence shows to reveal what the patterns found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import checkpointed, given_back, release, set_apart

# A run of address or digit characters is tried once, from its start or from where the last match ended; a plain
# pattern finds the same and tries a long run from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = (*PATTERNS, "term")
NEAR = 8
SHARE_OF_IC = 0.8
UNSEEN = 1.0
ELSEWHERE = 0.5
BROADCAST_BYTES = 64 << 20
SPLIT = 100
SPAN = "array<struct<s:int,e:int,v:string>>"
CHUNK = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def placed(text: str, pattern: str) -> str:
    """SQL for all matches with their places in code points, by the lengths of what lies between them. Arrays grow by CHUNK places at a time, so that
    a text of many matches takes little more than their number."""
    p = _quoted(pattern)
    pieces = f"""zip_with(regexp_extract_all({text}, {p}, 0), slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))),
               (v, gap) -> named_struct('v', v, 'gap', length(gap)))"""
    return f"""flatten(aggregate({_in_chunks(pieces)}, named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
      (o, c) -> aggregate(c, named_struct('at', o.at, 'out', cast(array() as {SPAN})),
        (a, x) -> named_struct('at', a.at + x.gap + length(x.v),
                  'out', array_append(a.out, named_struct('s', a.at + x.gap, 'e', a.at + x.gap + length(x.v), 'v', x.v))),
        a -> named_struct('at', a.at, 'out', array_append(o.out, a.out))),
      o -> o.out))"""


def _in_chunks(array: str) -> str:
    """SQL for an array cut into arrays of CHUNK entries; the array is made once."""
    return f"transform(array({array}), w -> transform(sequence(0, greatest(size(w) - 1, 0) div {CHUNK}), k -> slice(w, k * {CHUNK} + 1, {CHUNK})))[0]"


def _luhn(value: str) -> str:
    return f"""aggregate(sequence(1, length({value})), 0, (sum, i) -> sum +
      if(i % 2 = 1, cast(substring(reverse({value}), i, 1) as int),
         2 * cast(substring(reverse({value}), i, 1) as int) - if(substring(reverse({value}), i, 1) > '4', 9, 0))) % 10 = 0"""


def _valid(kind: str) -> str:
    digits = r"regexp_replace(x.v, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": r"forall(split(x.v, '\\.'), p -> length(ltrim('0', p)) <= 3 and cast(right(concat('0', p), 9) as int) <= 255)",
        "card": f"length({digits}) between 16 and 19 and {_luhn(digits)}",
        "phone": f"length({digits}) between 8 and 15",
    }[kind]


def base_spans(text: str = "text") -> Column:
    """array<struct<kind, s, e, v>> of the patterns' valid matches, in order of kind and start; null text has none."""
    parts = []
    for kind, pattern in PATTERNS.items():
        hint = HINTS[kind]
        may = f"contains({text}, '{hint}')" if hint else "true"
        hits = f"if({may} and {text} rlike {_quoted(pattern)}, filter({placed(text, pattern)}, x -> {_valid(kind)}), cast(array() as {SPAN}))"
        parts.append(f"transform({hits}, x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e, 'v', x.v))")
    return F.expr(f"if({text} is null, cast(array() as array<struct<kind:string,s:int,e:int,v:string>>), concat({', '.join(parts)}))")


def _laid_out(held: DataFrame) -> DataFrame:
    """dk, place, s, e, entity, term of the spans and words of held(dk, text, spans). Words are runs of letters and digits in
    lower case that no span overlaps; place is a word's number in its text, and for a span that of the last word before it."""
    word = _quoted(r"[\p{L}\p{N}]+")
    pieces = held.select("dk", F.posexplode(F.expr(f"zip_with(regexp_extract_all(text, {word}, 0), split(text, {word}, -1), (v, gap) -> named_struct('v', v, 'gap', length(gap)))")).alias("i", "x"))
    by_dk = Window.partitionBy("dk")
    so_far = by_dk.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = (
        pieces.where("x.v is not null").withColumn("e", F.sum(F.col("x.gap") + F.length("x.v")).over(so_far).cast("int"))
        .select("dk", (F.col("e") - F.length("x.v")).alias("s"), "e", F.lit(None).cast("string").alias("entity"), F.lower("x.v").alias("term"))
    )
    entity = F.expr("concat(y.kind, ':', if(y.kind in ('card', 'phone'), regexp_replace(y.v, '[^0-9]', ''), lower(y.v)))")
    spans = held.select("dk", F.explode("spans").alias("y")).select("dk", "y.s", "y.e", entity.alias("entity"), F.lit(None).cast("string").alias("term"))
    is_span = F.col("entity").isNotNull()
    down = by_dk.orderBy("s", F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    up = by_dk.orderBy(F.desc("s"), F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = words.union(spans).withColumn("open", F.max(F.when(is_span, F.col("e"))).over(down)).withColumn("next", F.min(F.when(is_span, F.col("s"))).over(up))
    rows = rows.where(is_span | ((F.coalesce("open", F.lit(0)) <= F.col("s")) & (F.coalesce("next", F.col("e")) >= F.col("e"))))
    return rows.withColumn("place", F.count("term").over(down)).select("dk", "place", "s", "e", "entity", "term")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64("text"))


def _words_among(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text_hash, term: the different words of each row that are among terms. These are broadcast while they fit into
    BROADCAST_BYTES, 64 bytes a term besides its own counted; the rows are the same either way."""
    words = rows.select("doc_id", "text_hash", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term"))
    few = (terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    return words.join(F.broadcast(terms) if few else terms, "term", "left_semi")


def _documents(rows: DataFrame) -> DataFrame:
    """One row, with its key dk and the number of rows, for rows that share an id and a text."""
    held = rows.withColumn("dk", F.xxhash64("doc_id", "text_hash"))
    return held.groupBy("dk").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("text").alias("text"), F.first("spans").alias("spans"), F.count("*").alias("rows"))


def _met(pairs: DataFrame, held: DataFrame, key: str, df: str) -> DataFrame:
    """pairs(key, df, total, ...) joined to held(key, dk, ...), in which df of the total rows have the key. A key of more than 1 / SPLIT of all
    rows is dealt by dk into as many parts as it has such shares. There are at most SPLIT times as many such keys as a document has
    on average, so that they are broadcast."""
    asked = pairs.withColumn("parts", (F.floor(F.col(df) * SPLIT / F.col("total")) + 1).cast("int"))
    hot = asked.where("parts > 1").select(F.col(key).alias("hot_key"), F.col("parts").alias("hot_parts")).distinct()
    dealt = held.join(F.broadcast(hot), held[key] == hot["hot_key"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("dk", F.lit(1)), F.coalesce("hot_parts", F.lit(1))).cast("int")).drop("hot_key", "hot_parts")
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(dealt, [key, "part"]).drop("part", "parts")


def found_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, terms): base has doc_id, text_hash and spans of every row; terms has doc_id, text_hash and the places of
    revealing terms, one row for each id and text that has any.

    A term is a word that stands within NEAR words of a protected value c somewhere. With document frequencies over the
    whole corpus, PMI(c; t) = log2(P(c | t) N / df(c)) tells how strongly t reveals c; it is at most the information
    IC(c) = log2(N / df(c)). Small counts are corrected: P(c | t) is estimated as if t stood in UNSEEN more documents
    in which c is as frequent as anywhere. Values seen once are judged like others. Where PMI reaches SHARE_OF_IC of IC,
    t is disclosed by c and is a span of the kind `term` wherever it stands in a document that has both. Where P(c | t) also
    reaches ELSEWHERE, so that t tells c by itself more often than not, it is one in all other documents too.

    df(c, t) is counted from the rarer side of each pair, and only for pairs that could reach the bound; documents
    without values give df(t) alone, of words that stand near a value somewhere."""
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    spanned = rows.withColumn("spans", base_spans())
    base = checkpointed(spanned.select("doc_id", "text_hash", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")))
    one = checkpointed(_documents(base.where("text is not null")))
    laid = checkpointed(_laid_out(one.select("dk", "text", "spans")))
    has = checkpointed(laid.where("term is not null").select("dk", "term").distinct())
    holders = checkpointed(laid.where("entity is not null").select("dk", "entity").distinct().join(one.select("dk", "rows"), "dk"))
    beside = laid.where("entity is not null").select("dk", "entity", F.explode(F.sequence(F.col("place") - NEAR + 1, F.col("place") + NEAR)).alias("place"))
    near = checkpointed(beside.join(laid.where("term is not null").select("dk", "place", "term"), ["dk", "place"]).select("entity", "term").distinct())
    vocabulary = _words_among(rows, checkpointed(near.select("term").distinct())).groupBy("term").agg(F.count("*").alias("df_term"))
    total = rows.select(F.count("*").alias("total"))

    def given_term(df_both: Column) -> Column:
        return (df_both + UNSEEN * F.col("df_entity") / F.col("total")) / (F.col("df_term") + UNSEEN)

    def reaches(df_both: Column) -> Column:
        ic = F.log2(F.col("total") / F.col("df_entity"))
        return (F.col("total") > F.col("df_entity")) & (F.log2(given_term(df_both)) + ic >= SHARE_OF_IC * ic)

    may = checkpointed(
        near.join(holders.groupBy("entity").agg(F.sum("rows").alias("df_entity")), "entity").join(vocabulary, "term")
        .join(F.broadcast(total))  # one row
        .where(reaches(F.least("df_entity", "df_term")))
    )
    met = _met(may.where("df_entity <= df_term"), holders, "entity", "df_entity").join(has, ["dk", "term"])
    other = _met(may.where("df_entity > df_term"), has, "term", "df_term").join(holders, ["dk", "entity"])
    met = checkpointed(met.unionByName(other).select("dk", "entity", "term", "rows"))
    reveals = met.groupBy("entity", "term").agg(F.sum("rows").alias("df_both")).join(may, ["entity", "term"]).where(reaches(F.col("df_both")))
    reveals = checkpointed(reveals.select("entity", "term", ((given_term(F.col("df_both")) >= ELSEWHERE) & (F.col("df_term") > F.col("df_both"))).alias("elsewhere")))
    wide = checkpointed(reveals.where("elsewhere").select("term").distinct())
    told = met.join(reveals.select("entity", "term"), ["entity", "term"]).select("dk", "term").union(has.join(wide, "term").select("dk", "term")).distinct()
    marked = laid.where("term is not null").select("dk", "s", "e", "term").join(told, ["dk", "term"]).join(one.select("dk", "doc_id", "text_hash"), "dk")
    marked = marked.select("doc_id", "text_hash", "s", "e", "term")
    if wide.take(1):  # documents without a value
        bare = base.where(F.size("spans") == 0).select(F.col("doc_id").alias("bare_id"), F.col("text_hash").alias("bare_hash")).distinct()
        tell = _words_among(rows, wide).select(F.col("doc_id").alias("tell_id"), F.col("text_hash").alias("tell_hash")).distinct()
        tell = checkpointed(tell.join(bare, tell["tell_id"].eqNullSafe(bare["bare_id"]) & (tell["tell_hash"] == bare["bare_hash"]), "left_semi"))
        hit = rows["doc_id"].eqNullSafe(tell["tell_id"]) & (rows["text_hash"] == tell["tell_hash"])
        none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int,v:string>>)")
        others = checkpointed(_documents(rows.join(tell, hit, "left_semi").withColumn("spans", none)))
        more = _laid_out(others.select("dk", "text", "spans")).where("term is not null").join(wide, "term", "left_semi").join(others.select("dk", "doc_id", "text_hash"), "dk")
        marked = marked.union(more.select("doc_id", "text_hash", "s", "e", "term"))
    spots = F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "s", "e", F.col("term").alias("v"))))
    terms = checkpointed(marked.groupBy("doc_id", "text_hash").agg(spots.alias("terms")))
    release(laid, has, holders, near, may, met, reveals, wide, one)
    return base.select("doc_id", "text_hash", "spans"), terms


def _with_terms(left: DataFrame, terms: DataFrame) -> DataFrame:
    t = terms.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "terms")
    return left.join(t, left["doc_id"].eqNullSafe(t["t_id"]) & (left["text_hash"] == t["t_hash"]), "left").drop("t_id", "t_hash")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (array<struct<kind, s, e, v>>, places in code points, end exclusive) for every row of
    docs(doc_id, text): base holds the patterns' matches, spans also the revealing terms (found_spans).

    Patterns: e-mail; IPv4 with parts up to 255; 16 to 19 digits that pass Luhn; + and 8 to 15 digits. Matches are
    leftmost and do not overlap within a kind; one that fails its test is dropped. A null text counts as empty. Repeated
    rows each give a row with equal spans; an empty table gives none; other columns are ignored."""
    base, terms = found_spans(docs)
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int,v:string>>)")
    return _with_terms(base, terms).select("doc_id", F.col("spans").alias("base"), F.concat("spans", F.coalesce("terms", none)).alias("spans"))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitize(docs: DataFrame) -> DataFrame:
    """The rows of docs with personal data replaced by [EMAIL], [IP], [CARD] or [PHONE] and revealing terms by [TERM]
    ([NUMBER] for digits). Overlapping spans become one, named by the first; n_chars, if there, is set anew."""
    columns = docs.columns
    docs, names = set_apart(docs, "doc_id", "text", "n_chars")
    _, terms = found_spans(docs)
    keyed = _keyed(docs.withColumn("pii_base", base_spans()))
    t = terms.select(F.col("doc_id").alias("pii_id"), F.col("text_hash").alias("pii_hash"), F.col("terms").alias("pii_terms"))
    met = keyed.join(t, keyed["doc_id"].cast("long").eqNullSafe(F.col("pii_id")) & (keyed["text_hash"] == F.col("pii_hash")), "left")
    spans = """array_sort(transform(concat(pii_base, coalesce(pii_terms, cast(array() as array<struct<kind:string,s:int,e:int,v:string>>))),
        x -> named_struct('s', x.s, 'e', x.e, 'kind', if(x.kind = 'term' and x.v rlike '^[0-9]+$', 'number', x.kind))))"""
    # each chunk of spans cuts its own block of the text, so that no place is looked for from the text's start more than once a chunk
    merged = f"""aggregate({_in_chunks(spans)}, named_struct('at', 0, 'open', '', 'out', cast(array() as array<string>)),
      (a, c) -> aggregate(c, named_struct('at', a.at, 'open', a.open, 'base', a.at, 'block', substring(text, a.at + 1, coalesce(array_max(transform(c, y -> y.e)), 0) - a.at), 'out', cast(array() as array<string>)),
        (b, x) -> if(x.s < b.at, named_struct('at', greatest(b.at, x.e), 'open', b.open, 'base', b.base, 'block', b.block, 'out', b.out),
          named_struct('at', x.e, 'open', concat('[', upper(x.kind), ']'), 'base', b.base, 'block', b.block,
            'out', array_append(b.out, concat(b.open, substring(b.block, b.at - b.base + 1, x.s - b.at))))),
        b -> named_struct('at', b.at, 'open', b.open, 'out', array_append(a.out, array_join(b.out, '')))),
      a -> concat(array_join(a.out, ''), a.open, substring(text, a.at + 1, length(text))))"""
    clean = F.when((F.size("pii_base") == 0) & F.col("pii_terms").isNull(), F.col("text")).otherwise(F.expr(merged))
    out = met.withColumn("text", clean)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return given_back(out, columns, names)
