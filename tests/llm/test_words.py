"""Spelling variants, periodic runs and token counts against brute force, on small fixtures with nulls, empty, long and repeated rows
and columns whose names clash; their queries against SQL and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import periodic, queries, spelling, token_counts
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (3, "To be or not to be. " * 40, "en"), (1, "", "en"), (2, None, None), (None, "no id here no id here no id here no id here", "de"), (5, "word " * 30000, "en"),
        (6, "same text twice", "fr"), (6, "same text twice", "fr"), (7, "a b a b a b a b c c c c c c", "fr"), (8, "é😀 日本語 \U0001f600\n\n\x0b\xa0  x\x1c y", "es"), (9, " \t\n", "en"), (10, "x" * 70000, "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1).cast("long") for c in ("n", "word", "key", "runs", "n_words", "n_tokens", "start", "c0")})


@pytest.mark.parametrize("name", ["op11_spelling", "op12_periodic"])
def test_same_rows_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], connect(SF)) == ""


def plain_runs(w, least=6, power=4):
    out = set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                size = j + q - i
                if size >= max(least, power * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                    out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize("least, power", [(6, 4), (2, 2), (9, 3)])
def test_runs_match_brute_force(spark, least, power):
    rng, docs = random.Random(least), []
    for _ in range(300):
        kinds, w, size = rng.choice([1, 2, 2, 3, 8]), [], rng.randint(0, 60)
        while len(w) < size:
            if rng.random() < 0.4 and w:
                p = rng.randint(1, min(6, len(w)))
                w += [w[-p:][i % p] for i in range(rng.randint(1, 30))]
            else:
                w.append(f"w{rng.randrange(kinds)}")
        docs.append(w)
    df = spark.createDataFrame([(i, "  ".join(w) + "\n") for i, w in enumerate(docs)], "doc_id long, text string").coalesce(2)
    for r in periodic.find_runs(df, least, power).collect():
        want = plain_runs(docs[r.doc_id], least, power)
        gone = {i for s, size, q in want for i in range(s + q, s + size)}
        assert [tuple(x) for x in r.runs] == want
        assert r.n_words == len(docs[r.doc_id]) and r.collapsed == " ".join(x for i, x in enumerate(docs[r.doc_id]) if i not in gone)


def test_runs_of_odd_rows(spark, odd):
    rows = periodic.find_runs(odd, keep=("lang", "key")).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].runs == [] and by[2].collapsed == "" and by[9].n_words == 0
    assert [tuple(x) for x in by[5].runs] == [(0, 30000, 1)] and by[5].collapsed == "word"
    assert [tuple(x) for x in by[7].runs] == [(0, 8, 2), (8, 6, 1)] and by[7].collapsed == "a b c"
    assert [tuple(x) for x in by[None].runs] == [(0, 12, 3)]
    assert periodic.find_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(odd, least_power=1)


def test_long_repetition_is_quick():
    import numpy as np

    assert periodic.runs_of(np.arange(60000) % 500, np.full(60000, 60000)) == [(0, 60000, 500)]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w in count:
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, count[w], len(near[w]), form[w], count.get(form[w]), root))
    return out


def test_variants_match_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(3, 6))) for _ in range(250)}
    for size in (39, 40, 41, 42, 300, 3000):  # around the length up to which words travel themselves
        base = "".join(rng.choice("abcdefgh") for _ in range(size))
        words |= {base, base[1:], base[:-1] + "z", base[:7] + "q" + base[7:], base + "aa"}
    count = {w: rng.choice([1, 2, 4, 4, 9, 20]) for w in words}
    got = spelling.group_variants(spark.createDataFrame(list(count.items()), "word string, n long")).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == plain_groups(count) and len(got) == len(count)


def test_words_of_odd_rows(spark, odd):
    count = Counter()
    for r in odd.select("doc_id", "text").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if c < "a" else c for c in w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            if r.doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    got = {r.word: r.n for r in spelling.vocabulary_of(odd.drop("word").withColumn("word", F.lit(1)), queries.letter_lost, 2, 1).collect()}
    assert got == {w: n for w, n in count.items() if len(w) >= 2}
    assert spelling.group_variants(spelling.vocabulary_of(odd.limit(0))).count() == 0


TRICKY = [
    "it's 's don't  we'll\n\n\nthey've \t x", "a<|endoftext|>b <|endoftext|>  c  <|endoftext|>", "  lead", "trail  \n", "\n", " ", "a\xa0 b\xa0  c \xa0", "!\x1c x\x1c  y \x1d\x85 z\u2003 w", "日本語 テキスト　全角", "½ ² ① x½ y",
    "é" * 500, "x" * 3000, "a b\tc\r\nd\x0be\x0c f", "\u200b \u200b", "🏽👍 👍🏽", "...---... !!! ", "1 234,567.89  10", "\ud7ff \ue000 \ufffd", " \n \n x", "\t\tif x:\n\t\t\treturn  y\n",
]


def test_token_counts_match_the_library(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    parts = ["a", "B9", "'s", " ", "  ", "\n", "\t", "\xa0", "\x1c", "é", "日", ".", "<|endoftext|>", "<|endof", "text|>", "ing", "\u3000", "\r\n", "😀"]
    texts = TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    path = queries.tokenizer_path(queries.COUNTED_BY)
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    model = open(path, encoding="utf-8").read()
    assert token_counts.Lengths(model).safe
    for name, value in (("PART_CHARS", 7), ("BATCH_CHARS", 50), ("RUN_BYTES", 100), ("KEPT_CHARS", 1000)):
        assert token_counts.Lengths(model).count([t or "" for t in texts]) == want
        monkeypatch.setattr(token_counts, name, value)
        if name == "PART_CHARS":
            assert any(len(list(token_counts.parts_of(t or "", 7))) > 1 for t in texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.count_tokens(df, path).collect():
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len((texts[r.doc_id] or "").encode()), want[r.doc_id] > 512)
    rows = token_counts.count_tokens(odd, path_of_words := queries.tokenizer_path(), keep=("lang", "n")).collect()
    other = Tokenizer.from_file(path_of_words)
    told = {(r.doc_id, r.text or "") for r in odd.collect()}
    assert sorted(r.n_tokens for r in rows) == sorted(len(other.encode(t, add_special_tokens=False)) for i, t in [*told, (6, "same text twice")])
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


def test_edited_tails(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.with_repeated_tail(docs).collect()}
    for r in docs.collect():
        words, h = (r.text or "").split(), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            assert got[r.doc_id] == " ".join(words[a + (i - a) % p] if i >= a else words[i] for i in range(n))
        else:
            assert got[r.doc_id] == r.text or not n
    first = queries.op12_periodic(spark, SF).where("n_runs = 0").first()
    assert first.start is None and first.runs_sha256 == hashlib.sha256(b"").hexdigest()
