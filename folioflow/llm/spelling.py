"""Spelling variants: words one edit apart, met through one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import checkpointed, release
from folioflow.llm.shingles import mix64

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 5
LEAST_LETTERS = 5
LEAST_COUNT = 3
TIMES = 2
# Words up to this length travel with their keys; of longer ones only their hashes do.
SHORT = 40
KEYS_AT_ONCE = 1_000_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def reduced(codes: np.ndarray) -> np.ndarray:
    """One of SYMBOLS symbols, from 1 on, for each code point, by a hash."""
    return mix64(codes.astype(np.uint64)) % _U(SYMBOLS) + _U(1)


def neighbour_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length, given as rows of code points: the hash of each reduced word; the hashes of its neighbourhood, a row each, itself
    first; and which of these are to be used.

    A reduced word r1..rL has the hash sum(ri B^i), modulo 2^64, so that an edit's hash comes from those of the parts before and behind it.
    Of two reduced words one edit apart the one generates the other: the longer by a deletion, of two with the same length the one
    with the smaller symbol by a replacement. Insertions and downward replacements are thus met from the other side."""
    symbols = reduced(codes)
    m, n = symbols.shape
    power = np.cumprod(np.concatenate(([_U(1)], np.full(n, _BASE, np.uint64))))
    head = np.zeros((m, n + 1), np.uint64)
    np.cumsum(symbols * power[:n], axis=1, out=head[:, 1:])
    own = head[:, n]
    # what stands behind place i, moved one place down
    tail = np.zeros((m, n + 1), np.uint64)
    for i in range(n - 1, -1, -1):
        tail[:, i] = symbols[:, i] + tail[:, i + 1] * _BASE
    deleted = head[:, :n] + power[:n] * tail[:, 1:]
    same_as_next = symbols[:, :-1] == symbols[:, 1:]  # either one gone leaves the same word
    near, keep = [own[:, None], deleted], [np.ones((m, 1), bool), np.concatenate((~same_as_next, np.ones((m, 1), bool)), axis=1)]
    for s in range(2, SYMBOLS + 1):
        near.append(own[:, None] + (_U(s) - symbols) * power[:n])
        keep.append(symbols < _U(s))
    return own, np.concatenate(near, axis=1), np.concatenate(keep, axis=1)


def _keys(words: DataFrame, carried: list[str], whole: bool) -> DataFrame:
    """key and the carried columns of words(word, ...): for `whole` one row for each key of a word's neighbourhood, with `same` for its
    own key, else one row with its own key."""
    base = words.select("word", *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lengths = np.array([len(t) for t in texts])
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                step = max(1, KEYS_AT_ONCE // (n * SYMBOLS + 1))
                for a in range(0, len(rows), step):
                    some = rows[a : a + step]
                    codes = np.array([texts[i] for i in some], dtype=f"U{n}").view(np.uint32).reshape(len(some), n)
                    own, near, open_ = neighbour_keys(codes)
                    if whole:
                        owner, at = np.nonzero(open_)
                        keys, some = near[owner, at], some[owner]
                        told = [pa.array(at == 0)]
                    else:
                        keys, told = own, []
                    held = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mix64(keys).view(np.int64)), *[c.take(held) for c in batch.columns[1:]], *told], names=["key", *carried, *["same"] * whole]
                    )

    return base.mapInArrow(run, "key long" + "".join(f", {c} {kinds[c]}" for c in carried) + ", same boolean" * whole)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways round, of all words of vocabulary(word, n) that differ by exactly one code point inserted,
    deleted or replaced. The vocabulary's words are distinct.

    Words whose reduced forms are equal or one edit apart meet by the hash of a reduced form; the words themselves are compared within
    the join. Words beyond SHORT code points meet by ids first, as their neighbourhoods are as many times their length. Of two
    words one meets the other once; words with one reduced form would meet both ways, so that only the smaller does."""
    apart = (F.levenshtein("word", "near", 1) == 1) & (~F.col("same") | (F.col("word") < F.col("near")))
    short = vocabulary.where(F.length("word") <= SHORT).select("word", "n")
    other = short.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = _keys(short, ["word", "n"], True).join(_keys(other, ["near", "near_n"], False), "key").where(apart)
    long_ = vocabulary.where(F.length("word") >= SHORT).select("word", "n").withColumn("id", F.xxhash64("word"))
    other = long_.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("id").alias("other"))
    met = _keys(long_, ["id"], True).join(_keys(other.withColumn("word", F.col("near")), ["other"], False), "key").where("id <> other")
    more = met.select("id", "other", "same").distinct().join(long_, "id").join(other, "other").where(apart & (F.greatest(F.length("word"), F.length("near")) > SHORT))
    one_way = found.select("word", "n", "near", "near_n").unionByName(more.select("word", "n", "near", "near_n"))
    there, back = F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return one_way.select(F.explode(F.array(there, back)).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last of each word's forms, itself if it has none. A word's way doubles with each
    round, which is written, until no way goes on; forms do not run in circles."""
    at = held = checkpointed(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        ahead = at.where("root <> word").select(F.col("word").alias("by"), F.col("root").alias("beyond"))
        moved = checkpointed(at.join(ahead, F.col("root") == F.col("by"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        release(held)
        at = held = moved
        if not moved.where("moved").take(1):
            return moved.select("word", "root")


def group_variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of vocabulary(word, n), whose words are distinct and not null.

    n_near counts the words one edit away. form is the one of them with the largest n (ties: the smallest in code-point order), if
    that is at least times x n, with form_n its n; else both are null. root follows forms to the last one, which is the word itself
    if it has no form: forms grow by `times`, 2 or more, so that none comes back. An empty vocabulary gives no rows."""
    if times < 2:
        raise ValueError("forms must grow to come to an end")
    words = checkpointed(vocabulary.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_pairs(words).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), best)
    chosen = -F.col("best.less") >= times * F.col("n")
    told = checkpointed(
        words.join(near, F.col("word") == F.col("of"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")
        )
    )
    ends = roots(told.where("form is not null")).select(F.col("word").alias("of"), F.col("root").alias("end"))
    release(words)
    return told.join(ends, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("end", "word").alias("root"))


def lowered(word: Column) -> Column:
    """A to Z in lower case and all else as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary_of(docs: DataFrame, edit=None, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of docs(doc_id, text), in lower case from A to Z, that have least_letters code points or more and occur least_count times
    or more. Words are runs of Latin letters; edit(doc_id, word) may change each before it is counted. A null or empty text has no words;
    repeated rows count each; other columns are ignored."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({RUN})"), 1)).alias("run"))
    words = words.select("doc_id", lowered(F.col("run")).alias("run"))
    told = words.select((edit(F.col("doc_id"), F.col("run")) if edit else F.col("run")).alias("word"))
    # the length comes through the sum, for a condition on words would be moved down and make each word twice
    summed = told.groupBy("word").agg(F.count("*").alias("n"), F.max(F.length("word")).alias("letters"))
    return summed.where((F.col("letters") >= least_letters) & (F.col("n") >= least_count)).select("word", "n")
