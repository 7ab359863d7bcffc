"""Training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures with nulls, empty, long and
repeated rows and columns whose names clash."""

import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import bpe, chunks, components, fingerprints, language, main_text, mincut, mixing, neighbours, ngram_join, pii, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that break careless code; the extra columns have names that operators use inside."""
    rows = [
        (3, "Mr. A wrote to a.b@c.de and b@c.de today. " * 3, "en", "s1"), (1, "", "en", None), (2, None, None, "s1"), (None, "no id here", "de", "s2"),
        (5, "word " * 30000, "en", "s1"), (6, "same text twice with more words in it", "fr", "s3"), (6, "same text twice with more words in it", "fr", "s3"),
        (7, "same text twice with more words in it", "fr", "s2"), (8, "é😀 日本語 \U0001f600\n\n\x0b", "es", "s0"), (9, " \t\n", "en", "s2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1).cast("long") for c in ("n", "size", "score", "draw", "spans", "label", "marks", "part", "salt")})


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_rolling_hash_is_windowed():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h = chunks.rolling(data)
    for i in (0, 5, 31, 32, 100, 499):
        want = sum(int(chunks.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % 2**32
        assert int(h[i]) == want


def test_chunks_resist_shifts():
    raw = random.Random(1).randbytes(20000)
    assert b"".join(raw[a:b] for a, b in zip([0, *chunks.cuts(raw)], chunks.cuts(raw))) == raw
    a, b = fingerprints.fingerprint("x" + raw.hex()), fingerprints.fingerprint(raw.hex())
    assert fingerprints.containment(a, b) > 0.95


def test_fingerprints(spark, odd):
    rows = fingerprints.compare_with_edits(odd).collect()
    assert len(rows) == odd.count()
    order = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 2
        want.setdefault(i, set()).add(hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    for r in rows:
        assert r.edited_sha256 in want[r.doc_id]
        assert r.fingerprint == fingerprints.to_text(fingerprints.fingerprint(None if r.n_chars == 0 else next(x.text for x in odd.collect() if x.doc_id == r.doc_id)))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.compare_with_edits(odd.limit(0)).count() == 0
    assert fingerprints.compare_with_edits(odd.where("doc_id = 3")).first().near_next == 1.0


def plain_chunks(raw, target=64):
    """Byte by byte: the hash of the last 32 bytes, boundaries by the two masks, from a fourth to four times the target."""
    bits, out, start = target.bit_length() - 1, [], 0
    for i in range(len(raw)):
        h = sum(int(chunks.GEAR[raw[i - k]]) << k for k in range(min(32, i + 1))) % 2**32
        size = i + 1 - start
        strict, easy = h < 2 ** (32 - bits - 2), h < 2 ** (32 - bits + 2)
        if (target // 4 <= size < target and strict) or (size >= target and easy) or size == 4 * target:
            out.append(raw[start : i + 1])
            start = i + 1
    return out + ([raw[start:]] if start < len(raw) else [])


def test_fingerprints_match_a_plain_chunker():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["é", "日本"]
    for _ in range(20):
        one = " ".join(rng.choice(words) for _ in range(rng.randint(0, 500)))
        two = one[: len(one) // 2] + " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))
        a, b = plain_chunks(one.encode()), plain_chunks(two.encode())
        assert [len(c) for c in a] == np.diff([0, *chunks.cuts(one.encode())]).tolist()
        want = sum(len(c) for c in set(a) & set(b)) / sum(len(c) for c in set(a)) if a and b else float(not a and not b)
        assert abs(fingerprints.containment(fingerprints.fingerprint(one), fingerprints.fingerprint(two)) - want) < 1e-12


def test_mixing(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == r.copies * r["size"] and r.copies <= 2 for r in rows)
    again = mixing.mix(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.apply_mix(odd).columns == odd.columns


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        by[r.source][2] += r.taken
        by[r.source][3] = max(by[r.source][3], r["size"])
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-6 * total
    free = {s for s, v in by.items() if v[1] < 2 * v[0] - 1e-9}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    assert len({round(by[s][1] / weight[s], 6) for s in free}) == 1
    for size, target, taken, largest in by.values():
        assert taken <= target + 1e-9 and target - taken <= largest


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 10 +1 (555) 123-4567.", "é+44 20 7946 0958é😀foo.bar@x-y.co.uk.", "4111-1111-1111-1111 +1 10.0.0.1 2345678 user@1.2.3.4",
    "0000.0001.2.255 00000000000000000000256.1.1.1", "a" * 20000 + "@" + "b" * 10, "1 2 3 " * 3000, "+1+2+33333333+", "@@ a@.b a@b. a@b..c",
]


def test_pii_patterns(spark, odd):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s.kind, s.s, s.e) for s in r.base] == plain_spans(TRICKY[r.doc_id])
    clean = texts(pii.sanitize(df))
    assert not any(plain_spans(t) for t in clean.values())
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(odd.limit(0)).count() == 0
    assert pii.sanitize(odd).columns == odd.columns


def test_pii_terms(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(400)]
    words = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [f"{words(20)} Zorblatt mail zz@corp.org {words(20)}" for _ in range(6)] + [f"{words(20)} mail a{i}@x.org {words(20)}" for i in range(60)] + [words(40) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: {rows[r.doc_id][s.s : s.e] for s in r.spans if s.kind == "term"} for r in pii.find_pii(df).collect()}
    assert all("Zorblatt" in found[i] for i in range(6)) and not any(found[i] for i in range(6, 126))
    assert "Zorblatt" not in texts(pii.sanitize(df))[0] and "[TERM]" in texts(pii.sanitize(df))[0]


def test_pii_terms_in_documents_without_the_value(spark):
    rows = [f"plain words of row {i % 7} and no more" for i in range(100)] + ["plain words Quillfeather ab@corp.org and no more"] * 3 + ["only Quillfeather and no more"]
    df = spark.createDataFrame([*enumerate(rows), (None, rows[-1])], "doc_id long, text string")
    found = [(r.doc_id, [(s.s, s.e) for s in r.spans if s.kind == "term"]) for r in pii.find_pii(df).collect()]
    assert sorted(str(f) for f in found if f[1]) == sorted(str(f) for f in [*((i, [(12, 24)]) for i in (100, 101, 102)), (103, [(5, 17)]), (None, [(5, 17)])])


def test_pii_of_long_addresses(spark):
    text = "a@" + ".".join(["b"] * 100_000) + " " + "1." * 50_000 + " +" + "1 " * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(s.kind, s.s, s.e) for s in pii.find_pii(df).first().base] == plain_spans(text)


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    names = ["pii_id", "pii_base", "pii_hash", "text_hash", "mix_id", "mix_key", "mix_copy", "mix_draw", "copies", "terms", "key", "repeat_key", "again_id", "gone_id", "component_id", "lang_pred", "held_out"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names)


def test_pii_terms_of_a_value_seen_once(spark):
    rows = [f"plain words of row {i % 7} and no more" for i in range(100)] + ["plain words Quillfeather ab@corp.org and no more"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [rows[r.doc_id][s.s : s.e] for s in r.spans if s.kind == "term"] for r in pii.find_pii(df).collect()}
    assert found.pop(100) == ["Quillfeather"] and not any(found.values())
    assert texts(pii.sanitize(df))[100] == "plain words [TERM] [EMAIL] and no more"


def test_pii_terms_far_from_the_value(spark):
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    wide = "Zorblatt" + " " * 200 + "zz@corp.org"
    rows = [f"Zorblatt {words(30)} {wide} {words(300)} Zorblatt {words(30)}, Zorblatt."] * 2 + [f"{words(20)} zz@corp.org {words(30)} Zorblatt"]
    rows += [words(40) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        want = [m.span() for m in re.finditer("Zorblatt", rows[r.doc_id])]
        assert [(s.s, s.e) for s in r.spans if s.kind == "term"] == want
    assert not any("Zorblatt" in t for t in texts(pii.sanitize(df)).values())


def test_pii_words_that_spans_overlap(spark):
    rows = ["é+44 20 7946 0958é x a.b@c.de,b@c.dex 10.0.0.1 b 2345678 c"] + [f"x b c d é de {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    one = df.where("doc_id = 0").select(F.col("doc_id").alias("dk"), "text", pii.base_spans().alias("spans"))
    laid = [(r.place, rows[0][r.s : r.e]) for r in pii._laid_out(one).where("term is not null").orderBy("s").collect()]
    spans = plain_spans(rows[0])
    free = [m for m in re.finditer(r"[^\W_]+", rows[0]) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
    assert laid == [(i + 1, m.group()) for i, m in enumerate(free)]


def test_min_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 4)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda keep: sum(g for g, k in zip(gain, keep) if g > 0 and not k) - sum(g for g, k in zip(gain, keep) if g < 0 and k) + sum(w for i, j, w in edges if keep[i] != keep[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(mincut.min_cut(gain, edges)) == best


def test_main_text_of_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in main_text.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id]).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = """<html><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice"><p>We use cookies, and you may accept all of them if you like to.</p></div>
<div class="post-content"><header><h2>Title &amp; more</h2></header><p>First paragraph with <b>bold</b>text.</p><ul><li>one<li>two</ul><div class="ad">Buy now!</div></div>
<aside><p>Related words that are long enough to look like a paragraph.</p></aside><section id="comments"><div class="comment"><p>I liked this very much, thank you for all of it.</p></div></section>
<form><label>Name</label></form><footer>&copy; me</footer></body></html>"""


def test_main_text_cases(spark):
    assert main_text.main_text(PAGE) == "Title & more\n\nFirst paragraph with boldtext.\n\none\n\ntwo"
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, "<p>Open <b>tag"), (None, "u", "<!-- x --><script>var a='</p>'</script>")], "page_id long, url string, html string")
    assert sorted(r.text for r in main_text.extract_main_text(df).collect()) == ["", "", "", "Open tag"]
    assert main_text.main_text('<a href="x' * 5000)


TEXT = "A {} paragraph that has a number of words in it, enough to be text."


def test_the_cut_differs_from_the_threshold():
    """Blocks that alone would be labelled otherwise than among their neighbours."""
    long = [f"<{{0}}>{TEXT.format(w)}</{{0}}>" for w in ("first", "second")]
    pages = {
        "div": ("<table><tr><td>Home</td><td>News</td></tr></table>" + long[0].format("div") + "<div>Short</div>" + long[1].format("div"), [TEXT.format("first"), "Short", TEXT.format("second")]),
        "p": ("<div>" + long[0].format("p") + long[1].format("p") + "</div><div><div>Copyright</div><div>Impressum</div><div>All rights reserved</div><div>Contact</div></div>", [TEXT.format("first"), TEXT.format("second")]),
    }
    for page, want in pages.values():
        blocks = main_text.blocks_of(page)
        gain, keep = main_text.labels(blocks)
        assert [t for (t, _, _), k in zip(blocks, keep) if k] == want
        assert [g > 0 for g in gain] != keep


def test_words_of_a_class_do_not_drop_an_article():
    body = "<h1>Head of it</h1><p>One long paragraph that tells about the thing, as paragraphs do.</p>{}<p>And more.</p>"
    kept = lambda inner, outer="article": main_text.main_text(f"<nav><a href=a>Home</a></nav><{outer}>{body.format(inner)}</{outer}><footer>c</footer>").split("\n\n")
    assert kept('<p class="notice-of-death">He died in May.</p>')[2] == "He died in May."
    assert main_text.main_text('<main><div id="disclaimer-law"><p>The law of disclaimers, told at some length.</p></div></main>') == "The law of disclaimers, told at some length."
    for gone in ('<aside><p>Words beside that are long enough to look like a paragraph.</p></aside>', '<div class="comments"><p>A reader wrote this, at some length.</p></div>', '<div class="ad">Buy now!</div>', '<form><p>Your name and what you wish to tell us.</p></form>'):
        assert kept(gone) == ["Head of it", "One long paragraph that tells about the thing, as paragraphs do.", "And more."]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3000 + i, [float(v) for v in x[20]]) for i in range(40)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0]), (9080, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"key": F.lit("k"), "part": F.lit(0)})
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v in rows[:3040]]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = total = 0
    for q, found in got.items():
        found.sort()
        s = m @ m[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:20]
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and all(abs(f[2] - s[list(ids).index(f[1])]) < 1e-9 for f in found)
        hit, total = hit + len({f[1] for f in found} & set(ids[order].tolist())), total + 20
    assert hit / total >= 0.9 and set(got) == {i for i in ids.tolist() if i % 20 == 0}
    assert [f[1] for f in got[20]] == list(range(3000, 3020))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_ties_of_different_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [1.0] + [0.0] * 15)] + [(100 - i, [1.0, *(float(v) for v in rng.integers(-3, 4, 15))]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") == 0).collect())
    assert got == [(i, i, 1.0) for i in range(1, 21)]
    third = spark.createDataFrame([(0, [1.0, 1 / 3]), (1, [1.0, 1 / 3]), (2, [0.1, 0.2])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in neighbours.nearest(third, F.col("vec_id") == 0).collect()}
    assert got == {1: 1.0 + 1 / 3 * (1 / 3), 2: 0.1 + 0.2 * (1 / 3)}


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = language.learn_languages(docs)
    rows = language.identify(docs, field, keep=("lang",)).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    got = {r.doc_id: r for r in language.identify(odd, field).collect()}
    assert got[2].lang_pred == got[1].lang_pred == got[9].lang_pred == "und" and got[2].score == 0
    assert language.identify(odd.limit(0)).count() == 0 and language.keep_identified(odd).columns == odd.columns
    de, en = (next(r.text for r in docs.where(f"lang = '{v}' and n_chars > 500").orderBy("doc_id").limit(1).collect()) for v in ("de", "en"))
    share = language.label_texts(field, [de[:400] + " " + en[:400]])[0][2]
    assert 0.25 < share[field.labels.index("de")] < 0.75 and 0.25 < share[field.labels.index("en")] < 0.75
    switched = spark.createDataFrame([(1, de[:400] + " " + en[:400]), (2, None), (3, "1 2")], "doc_id long, text string")
    words = {r.doc_id: r.words for r in language.label_words(switched, field).collect()}
    assert words[2] == words[3] == [] and [w.word for w in words[1]] == language.words_of(de[:400] + " " + en[:400])
    half = len(language.words_of(de[:400]))
    assert sum(w.lang == "de" for w in words[1][:half]) > 0.9 * half and sum(w.lang == "en" for w in words[1][half:]) > 0.9 * (len(words[1]) - half)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    scores, step = rng.standard_normal((5, 3)), rng.standard_normal((3, 3))
    paths = {}
    for a in np.ndindex(3, 3, 3):
        paths[a] = np.exp(sum(scores[t, a[t]] for t in range(3)) + step[a[0], a[1]] + step[a[1], a[2]])
    z = sum(paths.values())
    marginal, _ = language.forward_backward(scores, np.array([0, 3]), np.array([3, 2]), step)
    for t in range(3):
        for k in range(3):
            assert abs(marginal[t, k] - sum(p for a, p in paths.items() if a[t] == k) / z) < 1e-9


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def families():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    out = ["", None, "a b", "a  B", "a", "x y z", "X y\nz"]
    for f, n in enumerate((12, 30, 60, 150)):
        pool = [[rng.choice(words) for _ in range(n)]]
        for _ in range(25):
            t = list(rng.choice(pool) if f % 2 else pool[0])
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                p, kind = rng.randrange(len(t)), rng.random()
                if kind < 0.6:
                    t[p] = rng.choice(words)
                elif kind < 0.8:
                    del t[p]
                else:
                    t.insert(p, rng.choice(words))
            pool.append(t)
            out.append(" ".join(t))
    return out + out[-4:]


@pytest.mark.parametrize("k,percent,small", [(3, 90, False), (5, 80, False), (3, 90, True), (5, 80, True)])
def test_jaccard_groups(spark, monkeypatch, k, percent, small):
    if small:  # many blocks and tiles, every shingle of two documents of a block is common there
        for name, value in (("BLOCK_CHARS", 3000), ("COMMON", 2), ("COLUMNS", 2), ("ROWS", 3), ("BATCH", 2), ("TILE", 4), ("BROADCAST_IDS", 0)):
            monkeypatch.setattr(ngram_join, name, value)
    docs = families()
    sets = {i * 3: shingles(t, k) for i, t in enumerate(docs)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(docs)], "doc_id long, text string")
    for r in ngram_join.jaccard_groups(df, k, percent).collect():
        assert r.component_id == find(r.doc_id) and r.n_shingles == len(sets[r.doc_id])


def test_jaccard_odd_rows(spark, odd):
    rows = ngram_join.jaccard_groups(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert ngram_join.jaccard_groups(odd.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one_each(odd).collect()) == sorted(["3", "1", "2", "None", "5", "6", "6", "8", "9"])


def test_pipeline_keeps_one_of_repeated_rows(spark, odd):
    import corpus_pipeline

    copies = odd.where("doc_id in (6, 7)").withColumn("doc_id", F.lit(None).cast("long"))
    lone = odd.where("doc_id is null")
    docs = odd.union(copies).union(lone.withColumn("source", F.lit("s9"))).union(odd.where("doc_id = 6").withColumn("text", F.lit("another text of six words here")))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:7]) for r in kept.collect()) == sorted(
        [("3", "Mr. A w"), ("1", ""), ("2", ""), ("None", "no id h"), ("5", "word wo"), ("6", "same te"), ("6", "another"), ("8", "é😀 日本語 "), ("9", " \t\n")]
    )


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in components.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model=model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    cases = {1: "you 1d10t", 2: "уоu іdiоt", 3: "an ordinary text about nothing", 4: "the trash can is full", 5: "", 6: None, 7: "idiot " + "word " * 20000}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(list(cases.items()), "doc_id long, text string"), model=model).collect()}
    assert got[1] > 0.7 and got[2] > 0.7 and max(got[3], got[4], got[5], got[6]) < 0.3 and got[7] < got[1]
    assert toxicity.score_toxicity(odd, model=model).count() == odd.count() and toxicity.score_toxicity(odd.limit(0), model=model).count() == 0


def test_fold():
    assert toxicity.fold("You 1D10T, $tupid m0r0n! іdiоt ＩＤＩＯＴ x$$$ 4785").split() == ["you", "idiot", "stupid", "moron", "idiot", "idiot", "x", "4785"]
    assert toxicity.fold("i.d.i.o.t s t u p i d iiidioot, a b ab c d").split() == ["idiot", "stupid", "idiot", "a", "b", "ab", "c", "d"]


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>" + "x" * (i * 37 % 5000)) for i in range(600)] + [(None, "u", None), (3, "u3", "again")], "page_id long, url string, html string")
    index = warc.record_index(pages)
    assert warc.audit(index, index).count() == 0
    bad = index.where("page_id is null or page_id <> 77").withColumn("digest", F.when(F.col("page_id").isin(5, 500), F.lit("0")).otherwise(F.col("digest")))
    got = {(r.page_id, r.status) for r in warc.audit(index, bad).collect()}
    assert got == {(5, "changed"), (500, "changed"), (77, "missing")}
    assert {(r.page_id, r.status) for r in warc.audit(bad, index).collect()} == {(5, "changed"), (500, "changed"), (77, "extra")}
    assert warc.audit(index.limit(0), index.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    cases = ["", None, "a  b\n\nc", " <|endoftext|> it's<|startoftext|>x 　 y z\x0bq\x1cw", "é ́ a", "Σας ΣΑΣ ẞ \U0001f600 " * 50, "x" * 5000, "日本語" * 300 + " q", "a<|endof text|>"]
    cases += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in bpe.encode_decode(df, path).collect():
        ids = library.encode(cases[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(odd, path).count() == odd.count() and bpe.encode_decode(odd.limit(0), path).count() == 0
    other = queries.tokenizer_path("byte_bpe_50k.json")  # does not part texts at white space
    library = Tokenizer.from_file(other)
    for r in bpe.encode_decode(df.where("doc_id < 60"), other).collect():
        ids = library.encode(cases[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_bpe_repairs_joins():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        coder = bpe.Coder(f.read())
    assert not coder.by_words
    rng = random.Random(3)
    long = [" ".join(rng.choice(["alpha", "beta", "gamma's", "x.", "9"]) for _ in range(4000)) for _ in range(3)]
    flat, sizes, _ = coder.by_chunks(pa.array([*long, ""]))  # as if it did: every join differs, so the texts are encoded anew
    library = Tokenizer.from_file(path)
    assert flat.tolist() == [i for t in long for i in library.encode(t, add_special_tokens=False).ids] and sizes[3] == 0


def test_chunks_of_texts_do_not_depend_on_others():
    rng = random.Random(8)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(6000)).encode() for _ in range(2))
    ends = lambda *t: bpe.chunk_ends(np.frombuffer(b"".join(t), np.uint8), np.cumsum([len(x) for x in t]))
    alone, behind = ends(b).tolist(), [e - len(a) for e in ends(a, b).tolist() if e > len(a)]
    assert alone == behind and len(alone) > 5
    assert all(b[e - 1 : e] == b" " for e in alone[:-1])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
    assert kept[0] >= kept[1] and kept[3] == kept[4] > 0 and set(docs.columns) >= {"doc_id", "ids", "n_tokens"}


def test_lexicon_matches_brute_force():
    rng = random.Random(9)
    weights = {" foe": 2.0, " foeman ": 3.5, " bad ": 1.5, " xbad": 0.5}
    lexicon = toxicity.Lexicon(weights, ("foes", "bad luck"))
    spared = ["foes", "bad luck", *toxicity.HARMLESS]
    for _ in range(300):
        text = " ".join(rng.choice(["foe", "foes", "foeman", "foel", "bad", "luck", "xbad", "xbadly", "a", "Trash can"]) for _ in range(rng.randint(0, 9)))
        folded = toxicity.fold(text)
        at = [i for i, c in enumerate(folded[:-1]) if c == " " and len(folded) > 2]
        hits = {i: max((w for p, w in weights.items() if folded.startswith(p, i)), default=0) for i in at}
        inside = {i for i in at for p in spared for k in [toxicity.fold(p)] for j in at if folded.startswith(k, j) and j <= i < j + len(k) - 1}
        want = [w for i, w in hits.items() if w and i not in inside]
        words, total, most, n = lexicon.measure(text)
        assert (total, most, n) == (sum(want), max(want, default=0), len(want)), (text, want)


def test_lexicon_choice():
    counts = {f"vequ{c}": (40, 0) for c in "abcd"} | {"vequz": (1, 9), "loser": (50, 0), "los": (3, 900)} | {f"los{c}x": (0, 4) for c in "abdfg"}
    weights, harmless = toxicity.choose(counts, 10_000, 20_000)
    assert set(weights) == {" vequ", " loser "} and harmless == ("vequz",)
