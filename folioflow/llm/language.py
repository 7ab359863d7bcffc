"""Language of every word, and so of every text, by a linear-chain conditional random field."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import GAP, crc_of_id, even_runs, given_back, sample_by_class, set_apart
from folioflow.llm.ngram_join import _runs
from folioflow.llm.shingles import mix64

DOCS_PER_LANGUAGE = 400
WORDS_PER_DOC = 200
TABLE = 1 << 16
LEXICON = 4000
NONE = "und"
BLOCK_CELLS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case. Numerals and other signs that are no letters part words."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    if low.isascii():
        return words
    return [p for w in words for p in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Field:
    """The model: a weight row for each hashed n-gram or affix, one for each lexicon word, and transitions."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        self.grams = np.zeros((TABLE, len(labels)), np.float32)
        self.known = np.zeros((len(lexicon) + 1, len(labels)), np.float32)
        self.step = np.zeros((len(labels), len(labels)), np.float32)

    def features(self, words: list[str]):
        """Yields (rows of words, hashed features as a matrix) by bands of word length, of about BLOCK_CELLS letters at once; -1 fills."""
        lengths = np.array([len(w) for w in words])
        size = 8
        low = 0
        while low < (lengths.max() if len(lengths) else 0):
            band = np.flatnonzero((lengths > low) & (lengths <= size))
            width = size + 2
            most = max(1, BLOCK_CELLS // width)
            for a in range(0, len(band), most):
                rows = band[a : a + most]
                marked = ["^" + words[i] + "$" for i in rows]
                code = np.array(marked, dtype=f"U{width}").view(np.uint32).reshape(len(rows), width).astype(np.uint64)
                ends = lengths[rows] + 2
                parts, fill = [], np.int64(-1)
                for n in (1, 2, 3, 4):
                    h = code[:, : width - n + 1].copy()
                    for k in range(1, n):
                        h = h * _U(0x100000001B3) + code[:, k : width - n + 1 + k]
                    h = (mix64(h + _U(n << 40)) % _U(TABLE)).astype(np.int64)
                    at = np.arange(width - n + 1)
                    h[at[None, :] + n > ends[:, None]] = fill
                    parts.append(h)
                for n in (2, 3, 4, 5):
                    head = np.zeros(len(rows), np.uint64)
                    tail = np.zeros(len(rows), np.uint64)
                    for k in range(n):
                        head = head * _U(0x100000001B3) + code[:, min(1 + k, width - 1)]
                        tail = tail * _U(0x100000001B3) + code[np.arange(len(rows)), np.maximum(ends - 2 - k, 0)]
                    short = lengths[rows] < n
                    for h, kind in ((head, 11), (tail, 12)):
                        h = (mix64(h + _U((kind * 8 + n) << 40)) % _U(TABLE)).astype(np.int64)
                        h[short] = fill
                        parts.append(h[:, None])
                yield rows, np.concatenate(parts, axis=1)
            low, size = size, size * 2

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        padded = np.concatenate((self.grams, np.zeros((1, len(self.labels)), np.float32)))
        for rows, feats in self.features(words):
            out[rows] = padded[feats].sum(1) / np.sqrt((feats >= 0).sum(1))[:, None]
        known = np.array([self.lexicon.get(w, len(self.lexicon)) for w in words], np.int64)
        return out + self.known[known] if len(words) else out


def forward_backward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: np.ndarray, with_pairs: bool = True):
    """Marginals of every word, and expected transitions (zeros where not asked for), of sequences laid end to end; all
    sequences advance together. The sequences must be in order of falling length."""
    emit = scores - scores.max(1, keepdims=True)
    np.exp(emit, out=emit)
    move = np.exp(step)
    alpha = np.empty_like(emit)
    n = len(lengths)
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if n else 0) + 1), side="right")
    for t, k in enumerate(active.tolist()):
        at = starts[:k] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    beta = np.ones((n, scores.shape[1]), scores.dtype)
    marginal = alpha  # a word's alpha is read for the last time where its marginal is set
    pairs = np.zeros_like(move)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        m = alpha[at] * beta[:k]
        marginal[at] = m / m.sum(1, keepdims=True)
        if t:
            back = emit[at] * beta[:k]
            if with_pairs:
                joint = alpha[at - 1][:, :, None] * move[None] * back[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = back @ move.T
            beta[:k] = b / b.sum(1, keepdims=True)
    return marginal, pairs


def fit(samples: list[tuple[str, list[str]]], seed: int = 7, rounds: int = 6, rate: float = 0.3) -> Field:
    """Fit on (language, words) samples. Sequences are made of one to three stretches of samples, often of different
    languages, so that the transitions learn both to stay and to switch; Adagrad on the log-likelihood."""
    labels = sorted({lang for lang, _ in samples})
    number = {v: i for i, v in enumerate(labels)}
    counts: dict[str, int] = {}
    for _, words in samples:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    common = sorted(counts, key=lambda w: (-counts[w], w))[:LEXICON]
    field = Field(labels, {w: i for i, w in enumerate(common)})
    if len(labels) < 2:
        return field
    rng = np.random.default_rng(seed)
    vocabulary = sorted(counts)
    place = {w: i for i, w in enumerate(vocabulary)}
    table = [None] * len(vocabulary)
    for rows, feats in field.features(vocabulary):
        for r, f in zip(rows.tolist(), feats):
            table[r] = f[f >= 0]
    coded = [(number[lang], np.array([place[w] for w in words], np.int64)) for lang, words in samples if words]
    in_lexicon = np.array([field.lexicon.get(w, len(common)) for w in vocabulary], np.int64)
    g2, k2, s2 = (np.full_like(x, 1e-6) for x in (field.grams, field.known, field.step))
    for _ in range(rounds):
        order = rng.permutation(len(coded)).tolist()
        stretches = []
        while order:
            own = []
            for _ in range(min(len(order), int(rng.integers(1, 4)))):
                label, words = coded[order.pop()]
                own.append((label, words))
            stretches.append(own)
        for a in range(0, len(stretches), 48):
            batch = [(np.concatenate([w for _, w in s]), np.concatenate([np.full(len(w), y) for y, w in s])) for s in stretches[a : a + 48]]
            batch.sort(key=lambda x: -len(x[0]))
            lengths = np.array([len(w) for w, _ in batch])
            starts = np.cumsum(lengths) - lengths
            flat, gold = np.concatenate([w for w, _ in batch]), np.concatenate([y for _, y in batch])
            uniq, code = np.unique(flat, return_inverse=True)
            feats = [table[u] for u in uniq.tolist()]
            sizes = np.array([len(f) for f in feats])
            owner, joined = np.repeat(np.arange(len(uniq)), sizes), np.concatenate(feats)
            share = (1 / np.sqrt(sizes))[owner]
            emit = np.stack([np.bincount(owner, field.grams[joined, j] * share, len(uniq)) for j in range(len(labels))], 1) + field.known[in_lexicon[uniq]]
            marginal, pairs = forward_backward(emit[code].astype(np.float64), starts, lengths, field.step.astype(np.float64))
            error = -marginal
            error[np.arange(len(gold)), gold] += 1
            per_word = np.stack([np.bincount(code, error[:, j], len(uniq)) for j in range(len(labels))], 1)
            inner = np.ones(len(flat), bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            real = np.bincount(gold[at - 1] * len(labels) + gold[at], minlength=len(labels) ** 2).reshape(len(labels), -1)
            for weights, squares, grad in (
                (field.grams, g2, np.stack([np.bincount(joined, per_word[owner, j] * share, TABLE) for j in range(len(labels))], 1)),
                (field.known, k2, np.stack([np.bincount(in_lexicon[uniq], per_word[:, j], len(common) + 1) for j in range(len(labels))], 1)),
                (field.step, s2, real - pairs),
            ):
                grad = grad / len(batch) - 1e-4 * weights
                squares += (grad * grad).astype(np.float32)
                weights += (rate * grad / np.sqrt(squares)).astype(np.float32)
            field.known[-1] = 0
    return field


def label_texts(field: Field, texts: list) -> list[tuple[str, float, list]]:
    """(language, score, share of each label) of each text, from the marginals of its words."""
    out = [(NONE, 0.0, [])] * len(texts)
    code: dict[str, int] = {}
    coded = [np.array([code.setdefault(w, len(code)) for w in words_of(t)], np.int32) for t in texts]
    order = sorted((i for i, c in enumerate(coded) if len(c)), key=lambda i: -len(coded[i]))
    if not order or not field.labels:
        return out
    lengths = np.array([len(coded[i]) for i in order])
    starts = np.cumsum(lengths) - lengths
    emit = field.emissions(list(code))[np.concatenate([coded[i] for i in order])]
    marginal, _ = forward_backward(emit, starts, lengths, field.step, with_pairs=False)
    means = np.add.reduceat(marginal, starts, axis=0, dtype=np.float64) / lengths[:, None]
    for i, m in zip(order, means):
        best = int(m.argmax())
        out[i] = (field.labels[best], float(min(1.0, m[best])), m.tolist())
    return out


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and words (array<struct<word, lang, score>>) of every row of docs(doc_id, text): each word of the whole text, in lower case,
    with its most probable language by forward-backward and that probability, so that code-switched texts are labelled word by
    word. Null texts and texts without a letter have no words."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(field))

    def run(batches):
        model = Field([], {})
        vars(model).update(shipped.value)
        for batch in batches:
            texts, done = batch.column(1).to_pylist(), 0
            for _, part in _runs(range(len(texts)), texts, 1_000_000):
                out = []
                for words in map(words_of, part):
                    if not words or not model.labels:
                        out.append([])
                        continue
                    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    emit = model.emissions(list(code))[[code[w] for w in words]]
                    marginal, _ = forward_backward(emit, np.array([0]), np.array([len(words)]), model.step, with_pairs=False)
                    out.append([{"word": w, "lang": model.labels[i], "score": float(m[i])} for w, i, m in zip(words, marginal.argmax(1).tolist(), marginal)])
                kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(out, kind)], names=["doc_id", "words"])
                done += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def learn_languages(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, words: int = WORDS_PER_DOC) -> Field:
    """Fit on a bounded sample of the rows that may be learned from (crc32 of the id mod 4 is not 2, lang not null):
    about per_language documents of each language, of each at most `words` words in a row from a place set by a hash."""
    known = docs.where((F.pmod(crc_of_id(), F.lit(4)) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    parts = F.split("text", GAP)
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.size("parts") - words, F.lit(0)) + 1).cast("int") + 1
    cut = known.select("doc_id", "lang", parts.alias("parts")).select("doc_id", "lang", F.array_join(F.slice("parts", start, words), " ").alias("text"))
    rows = sample_by_class(cut, "lang", F.col("doc_id"), per_language)
    got = sorted((r["lang"], r["doc_id"], r["text"]) for r in rows.collect())
    return fit([(lang, words_of(text)) for lang, _, text in got])


def identify(docs: DataFrame, field: Field | None = None, keep: tuple = ()) -> DataFrame:
    """lang_pred, score and held_out of every row of docs(doc_id, text, lang), with doc_id and the columns of `keep`.

    Words are runs of letters. A field with affix, n-gram and lexicon features and learned transitions gives every
    word of the whole text a distribution over languages by forward-backward; the language with the largest mean is
    predicted and that mean is the score. A text without a letter, or null, is `und` with score 0, as is every text if
    no language can be learned. Only the text enters a prediction. A null doc_id is not held out and not learned from."""
    field = field or learn_languages(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(vars(field))  # of fixed size; plain arrays and a dict
    names = [c for c in keep if c not in ("doc_id", "text")]
    base = docs.select("doc_id", "text", *names)

    def run(batches):
        model = Field([], {})
        vars(model).update(shipped.value)
        for batch in batches:
            for start, texts in even_runs(batch.column(1)):
                got = label_texts(model, texts.to_pylist())
                same = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*same.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    names=[*batch.schema.names, "lang_pred", "score"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    held = F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))
    out = base.mapInArrow(run, f"{fields}, lang_pred string, score double").withColumn("held_out", held)
    return out.select("doc_id", *[c for c in keep if c != "doc_id"], "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows of docs whose language is identified: not `und`, with a score of `least` or more. Columns stay."""
    renamed, names = set_apart(docs, "doc_id", "text")
    field = learn_languages(docs)
    found = identify(renamed, field, keep=("text", *names.values())).where((F.col("lang_pred") != NONE) & (F.col("score") >= least))
    return given_back(found, docs.columns, names)
