"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded, checkpointed, crc_of_id, release, sample_by_class
from folioflow.llm.ngram_join import _runs

PER_CLASS = 3000
SHORTEST, LONGEST = 3, 8
LEAST_PLACES = 5
LEAST_ODDS = 2.0
LEAST_SURE = 25.0
LEAST_CLEAN = 3
DECIDE = 0.7

# Letters of other scripts that look like Latin ones, and the letters themselves.
LOOKALIKE = ("аеорсухіјѕԁһӏԛԝкмтвнгαερουνικτβηχɑɡıⅼ", "aeopcyxijsdhlqwkmtbhraepouviktbnxagil")
# Digits and signs written for letters.
SUBSTITUTE = ("01345789@$!|", "oieastbgasil")
# Seed words, used beside what the labels teach, and phrases in which such a word means no harm.
SEED = ("idiot", "stupid", "moron", "scum", "trash", "clown", "pathetic", "loser", "worthless", "disgusting")
HARMLESS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "stupid mistake")

_SIGN = re.compile(r"(?<![^\W_])[@$](?=[^\W\d_])|(?<=[^\W_])[@$!|](?=[^\W_])")
_DIGIT = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
_OTHER = re.compile(r"[\W_]+")
_PARTED = re.compile(r"(?<![^\W_])[^\W_](?:([ .*_-])[^\W_](?![^\W_]))(?:\1[^\W_](?![^\W_]))+")
_AGAIN = re.compile(r"([^\W\d_])\1+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SIGNS = str.maketrans(*SUBSTITUTE)
_LOOKS = str.maketrans(*LOOKALIKE)


def fold(text: str | None) -> str:
    """Lower case, compatibility forms and lookalikes as plain letters, digits and signs inside words as the letters
    they stand for, three or more single letters parted by one sign or space as one word, repeated letters once, everything
    else as single spaces, with a space at both ends."""
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _HIDDEN.sub("", t)).lower().translate(_LOOKS)
    else:
        t = t.lower()
    t = _SIGN.sub(lambda m: m.group().translate(_SIGNS), t)
    t = _PARTED.sub(lambda m: m.group().replace(m.group(1), ""), t)
    if any(c in t for c in "0123456789"):
        t = _DIGIT.sub(lambda m: m.group().translate(_SIGNS), t)
    return " " + _OTHER.sub(" ", _AGAIN.sub(r"\1", t)).strip() + " "


def joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches that spans cover together, in order."""
    begins, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


class Lexicon:
    """Weights of whole words (' word ') and of stems (' stem') for an Aho-Corasick automaton."""

    def __init__(self, weights: dict[str, float], harmless: tuple = ()):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for pattern, weight in weights.items():
            self.machine.add_word(pattern, (len(pattern), float(weight)))
        for phrase in (*HARMLESS, *harmless):
            self.machine.add_word(fold(phrase), (len(fold(phrase)), 0.0))
        self.machine.make_automaton()

    def measure(self, text: str | None) -> list[float]:
        """Words, sum of weights, largest weight and matches of a text. A word counts once, with its largest
        weight; words inside a harmless phrase do not count."""
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.machine.iter(folded):
            start = end - size + 1
            if weight == 0.0:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            begins, ends = joined(spared)
            best = {at: w for at, w in best.items() if (k := bisect_right(begins, at)) == 0 or at >= ends[k - 1]}
        kept = list(best.values())
        return [float(folded.count(" ") - 1), float(sum(kept)), float(max(kept, default=0.0)), float(len(kept))]


def _inputs(measures: np.ndarray) -> np.ndarray:
    words, total, most, hits = measures.T
    size = np.maximum(words, 1)
    return np.stack(
        [np.ones(len(size)), np.log1p(100 * total / size), np.log1p(100 * hits / size), np.log1p(total), most, (hits > 0).astype(float), (hits > 1).astype(float)], axis=1
    )


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
        grad = x.T @ (weight * (y - p)) - pull * w
        curve = (x.T * (weight * p * (1 - p))) @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(curve, grad)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def _word_places(sample: DataFrame) -> DataFrame:
    """word, toxic and other: between how many different pairs of neighbours each folded word stands in toxic and in other
    documents. Copies of a document add nothing, as their words have the same neighbours."""

    def run(batches):
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ["", *fold(text).split(), ""]
                seen.update((w, toxic, xxhash.xxh64_intdigest(f"{a} {b}") >> 1) for a, w, b in zip(words, words[1:], words[2:]))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                names=["word", "toxic", "place"],
            )

    places = sample.select("text", "toxic").mapInArrow(run, "word string, toxic int, place long").distinct()
    return places.groupBy("word").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("other"))


def _rate(a: int, b: int, all_a: int, all_b: int) -> tuple[float, float]:
    """Log ratio of the rates of a in all_a and b in all_b places, and how sure a difference is: twice the log-likelihood ratio."""
    share = max(all_a, 1) / max(all_a + all_b, 1)
    sure = 2 * sum(n * np.log(n / ((a + b) * s)) for n, s in ((a, share), (b, 1 - share)) if n)
    return float(np.log((a + 0.5) / (all_a + 1)) - np.log((b + 0.5) / (all_b + 1))), float(sure)


def choose(counts: dict[str, tuple[int, int]], all_a: int, all_b: int) -> tuple[dict[str, float], tuple[str, ...]]:
    """Weights (log odds) of the words and stems that mark toxic documents, and the words that are exceptions to the stems.

    counts has the places of each word in toxic and other documents. A word with LEAST_CLEAN places or more in others that
    does not mark is set aside. Of the rest, summed over their beginnings, a stem is taken where at least two
    branches go on from it, it marks as a whole and no branch with LEAST_CLEAN places in others fails to; where one branch has
    nearly all of its toxic places, that branch is looked at instead. Below stems that are not taken, words that mark are."""

    def marks(a: int, b: int) -> bool:
        odds, sure = _rate(a, b, all_a, all_b)
        return a >= LEAST_PLACES and odds >= LEAST_ODDS and sure >= LEAST_SURE

    def fails(a: int, b: int) -> bool:
        return b >= LEAST_CLEAN and (a == 0 or _rate(a, b, all_a, all_b)[0] < LEAST_ODDS)

    apart = {w for w, (a, b) in counts.items() if fails(a, b)}
    known = {w: v for w, v in counts.items() if w not in apart}
    sums: dict[str, list[int]] = {}
    branches: dict[str, set] = {}
    longer: dict[str, list[str]] = {}
    for w, (a, b) in known.items():
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            own = sums.setdefault(w[:n], [0, 0])
            own[0] += a
            own[1] += b
            if n < min(LONGEST, len(w)):
                branches.setdefault(w[:n], set()).add(w[: n + 1])
        if len(w) > LONGEST:
            longer.setdefault(w[:LONGEST], []).append(w)
    weights: dict[str, float] = {}
    open_ = sorted(p for p in sums if len(p) == SHORTEST)
    while open_:
        stem = open_.pop()
        a, b = sums[stem]
        if a == 0:
            continue
        below = sorted(branches.get(stem, ()))
        main = [q for q in below if sums[q][0] >= 0.98 * a]
        if main:
            open_.append(main[0])
            continue
        if len(below) > 1 and marks(a, b) and not any(fails(*sums[q]) for q in below):
            weights[" " + stem] = _rate(a, b, all_a, all_b)[0]
            continue
        for w in (stem, *longer.get(stem, ())):
            if w in known and marks(*known[w]):
                weights[f" {w} "] = _rate(*known[w], all_a, all_b)[0]
        open_.extend(below)
    stems = tuple(p[1:] for p in weights if not p.endswith(" "))
    return weights, tuple(sorted(w for w in apart if w.startswith(stems))) if stems else ()


def _lexicon_of(sample: DataFrame) -> tuple[dict[str, float], tuple[str, ...]]:
    """choose() over the sample. Only words that begin with the same SHORTEST letters as something that marks come to the driver."""
    words = checkpointed(_word_places(sample))
    all_a, all_b = (int(v or 0) for v in words.agg(F.sum("toxic"), F.sum("other")).first())
    beginnings = words.where(F.length("word") >= SHORTEST).select(
        F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring("word", F.lit(1), n))).alias("stem"), "toxic", "other"
    )
    odds = F.log((F.col("toxic") + 0.5) / (all_a + 1)) - F.log((F.col("other") + 0.5) / (all_b + 1))
    share = max(all_a, 1) / max(all_a + all_b, 1)
    parts = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("toxic") + F.col("other")) * s))).otherwise(0.0) for c, s in (("toxic", share), ("other", 1 - share)) if s]
    marking = (F.col("toxic") >= LEAST_PLACES) & (odds >= LEAST_ODDS) & (2 * sum(parts, F.lit(0.0)) >= LEAST_SURE - 1e-6)
    starts = beginnings.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).union(words.select("word", "toxic", "other"))
    starts = starts.where(marking).select(F.substring("stem", 1, SHORTEST).alias("start")).distinct()
    rows = words.join(starts, F.substring("word", 1, SHORTEST) == F.col("start"), "left_semi").collect()
    release(words)
    return choose({r["word"]: (r["toxic"], r["other"]) for r in rows}, all_a, all_b)


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[dict[str, float], tuple[str, ...], list[float]]:
    """Lexicon weights, exceptions and the regression that turns a text's measures into a score, from about per_class labelled
    documents of each class whose crc32 of the id mod 3 is not 1."""
    marked = labels.where(F.col("toxic").isin(0, 1) & (F.pmod(crc_of_id(), F.lit(3)) != 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = sample_by_class(marked, "toxic", F.col("doc_id"), per_class)  # about 2 x per_class rows
    sample = docs.where(F.pmod(crc_of_id(), F.lit(3)) != 1).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = bounded(sample, 4 * per_class)  # ids may repeat
    weights, harmless = _lexicon_of(sample)
    for word in SEED:
        weights.setdefault(fold(word), LEAST_ODDS)
    measured = sorted((r["toxic"], *r["measures"]) for r in _measured(sample, weights, harmless, ("toxic",)).select("toxic", "measures").collect())
    x = _inputs(np.array([m[1:] for m in measured], dtype=float).reshape(len(measured), 4))
    y = np.array([m[0] for m in measured], dtype=float)
    if len(set(y)) < 2:
        return weights, harmless, [-4.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    share = np.array([size[c] / (y == c).sum() for c in (0, 1)])
    weight = share[y.astype(int)]
    return weights, harmless, logistic(x, y, weight * len(y) / weight.sum()).tolist()


def _measured(docs: DataFrame, weights: dict[str, float], harmless: tuple[str, ...], keep: tuple = ()) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((weights, harmless))  # words and stems that a bounded sample taught
    base = docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])

    def run(batches):
        lexicon = Lexicon(*shipped.value)
        for batch in batches:
            texts, done = batch.column(1).to_pylist(), 0
            for _, part in _runs(range(len(texts)), texts):
                same = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*same.columns, pa.array([lexicon.measure(t) for t in part], pa.list_(pa.float64()))], names=[*batch.schema.names, "measures"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, measures array<double>").drop(*([] if "text" in keep else ["text"]))


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: tuple | None = None, keep: tuple = ()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text), with the columns of `keep`.

    The whole text is folded (fold), matched against weighted words and stems except for exception words and phrases, and its
    sum and count of matches are normalised by its number of words; a logistic regression on these measures gives the score. Null and empty texts
    have no match and get the score of such a text. Without labels to learn from, the seed words decide. A null
    doc_id is not held out and not learned from; repeated rows each give a row; an empty table gives none."""
    weights, harmless, line = model or learn_toxicity(docs, labels)
    words, total, most, hits = (F.element_at("measures", i) for i in (1, 2, 3, 4))
    size = F.greatest(words, F.lit(1.0))
    inputs = [F.lit(1.0), F.log1p(100 * total / size), F.log1p(100 * hits / size), F.log1p(total), most, (hits > 0).cast("double"), (hits > 1).cast("double")]
    z = sum((F.lit(w) * x for w, x in zip(line, inputs)), F.lit(0.0))
    score = 1 / (1 + F.exp(-z))
    return _measured(docs, weights, harmless, keep).select(
        "doc_id", *[c for c in keep if c != "doc_id"], F.coalesce(F.pmod(crc_of_id(), F.lit(3)) == 1, F.lit(False)).alias("held_out"), score.alias("score"),
        F.when(score >= DECIDE, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("predicted"),
    )
