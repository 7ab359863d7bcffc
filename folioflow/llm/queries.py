"""The registered queries of the training-data operators, and their SQL where SQL can say what they compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, fingerprints, language, main_text, mixing, neighbours, ngram_join, periodic, pii, spelling, token_counts, toxicity, warc
from folioflow.llm.common import WORD, crc_of_id, table
from folioflow.llm.oracles import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
COUNTED_BY = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica in which a rule on the id picks pages whose first byte is flipped and others
    that are lost; the audit must find exactly those."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.col("page_id") * 7919 + 13
    flipped = F.when((mark % 53 == 7) & F.col("html").startswith("<"), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = warc.record_index(pages.withColumn("html", flipped)).where(mark % 97 != 5)
    return warc.audit(warc.record_index(pages), replica).select(
        "file_id", "page_id", "start", "expected_size", "found_size", "expected", "found", "status"
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def letter_lost(doc_id: Column, word: Column) -> Column:
    """The word without one letter where 97 divides the crc32 of `<doc_id>:<word>`; without an id the word stays."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(97)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.group_variants(spelling.vocabulary_of(table(spark, sf_dir, "documents"), letter_lost))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def with_repeated_tail(docs: DataFrame) -> DataFrame:
    """doc_id and text; where 10 divides h = crc32 of the id, with g = floor(h / 10) and n words, the words from a = g mod n on are word
    a + (i - a) mod p of the text, p = 1 + floor((n - a) / (3 + g mod 8)). Rows without an id stay as they are."""
    g = F.floor(crc_of_id() / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i))), " ")

    words = F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1))
    told = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), F.lit(0))
    return docs.select("doc_id", F.when((F.pmod(crc_of_id(), F.lit(10)) == 0) & F.col("text").isNotNull(), told).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_repeated_tail(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"), (-F.col("first.less")).alias("length"), F.col("first.period").alias("period"),
        F.floor(1000 * -F.col("first.less") / F.col("first.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(COUNTED_BY))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_mixing, op3_pii, op4_main_text, op5_neighbours, op6_language, op7_ngram_join, op8_toxicity, op9_fixity, op10_bpe,
        op11_spelling, op12_periodic, op13_token_counts, pipeline,
    )
}
