"""Letters that change under normalisation, elements and attributes of any kind, numerals, repeated ids in samples, and dense phrases."""

import random
import re
import time
import tracemalloc
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import bpe, language, main_text, queries, toxicity
from folioflow.llm.common import even_runs, runs, sample_by_class

SF = "/root/testdata/sf0.001"


def test_every_letter_before_every_tail():
    from tokenizers import Tokenizer
    import pyarrow as pa

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        coder = bpe.Coder(f.read())
    library = Tokenizer.from_file(queries.tokenizer_path())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    changing = [c for c in letters if c.isascii() or not unicodedata.normalize("NFC", c.lower())[-1].isalnum()]
    assert "İ" in changing and len(changing) > 60
    texts = [f"ab{c}{t} x{c}{t}" for c in changing for t in [*bpe.TAIL, "...", "!?", ".,"]] + [f"{c}, a{c}." for c in letters[:: 1 if len(letters) < 5000 else 7]]
    texts.append("TÜRKİYE CUMHURİYETİ, TARİHİ. ve GAZETESİ! bugün")
    flat, sizes, decoded = coder.code(pa.array(texts, pa.string()))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    at = 0
    for n, w in zip(sizes.tolist(), want):
        assert flat[at : at + n].tolist() == w
        at += n


ARTICLE = "<p>" + "The river rose over its banks in the night and the town woke to water. " * 6 + "</p>"


@pytest.mark.parametrize("page", [
    "<article><h1>Flood</h1><button>Listen</button>" + ARTICLE + "</article>", "<article><h1>Flood</h1>" + ARTICLE.replace("</p>", " <button class=x>Share</button> And then it fell again, slowly.</p>") + "</article>",
    "<article data-x=\"" + "a > b " * 3000 + "\"><h1>Flood</h1>" + ARTICLE + "</article>", "<article " + " ".join(f'k{i}="v"' for i in range(900)) + "><h1>Flood</h1>" + ARTICLE + "</article>",
])
def test_text_behind_buttons_and_long_attributes(page):
    got = main_text.main_text("<html><body><nav><a href=/>Home</a></nav>" + page + "<footer>Imprint</footer></body></html>")
    assert got.startswith("Flood\n\nThe river") and got.count("banks") == 6 and "Listen" not in got and "Share" not in got
    assert not any(x in got for x in ("a > b", 'k8="v"', "Imprint", "Home")) and ("And then" in got) == ("And then" in page)


def test_quotes_without_end_are_linear():
    start = time.time()
    for page in ("<p title=\"x>a" * 20000, "<p title=\"x' y='>a" * 20000, "<p>" + "<a href='" * 30000 + ">", "<p title=\"" * 9 + "x> the text"):
        main_text.main_text(page)
    assert time.time() - start < 20


def test_numerals_are_no_letters():
    assert language.words_of("½ ² ① Ⅷ 12 _") == [] and language.words_of("x½y né 日本") == ["x", "y", "né", "日本"]
    field = language.fit([("en", ["the", "cat"]), ("de", ["der", "hund"])])
    assert [r[0] for r in language.label_texts(field, ["½ ² ①", "the cat"])] == ["und", "en"]


def test_sample_is_bounded_where_an_id_repeats(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 10000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    for seed in range(3):
        assert sample_by_class(df.withColumn("doc_id", F.col("doc_id") + seed), "lang", F.col("doc_id"), 100).count() <= 400


def test_dense_phrases_are_linear():
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " clown": 3.0})
    start = time.time()
    assert lexicon.measure("circus clown, idiot. " * 100_000) == [300_000.0, 200_000.0, 2.0, 100_000.0]
    assert time.time() - start < 20
    assert toxicity.joined([(5, 9), (1, 3), (8, 12), (3, 4)]) == ([1, 5], [4, 12])


def test_mix_takes_part_of_equal_rows(spark):
    """Sources of equal rows, with and without an id, meet their targets within one row; the mix and its application agree."""
    from folioflow.llm import mixing

    rows = [(None, "one two three four five six", "a")] * 1000 + [(7, "w " * 9, "b")] * 500 + [(7, "w " * 9, None)] * 300 + [(i, "x y z " * (i % 5 + 1), "c") for i in range(900)] + [(5, None, "b"), (5, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit(1)).repartition(5)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    by = {}
    for r in mixed:
        t = by.setdefault(r.source, [r.target, 0, 0])
        t[1] += r.taken
        t[2] = max(t[2], r["size"])
        assert r.copies <= 2
    for source, (target, taken, largest) in by.items():
        assert taken <= target + 1e-9 and (source == "d" or target - taken < max(largest, 0.002 * target + 1)), (source, target, taken)
    again = sorted((str(r.source), r.draw, r.copies) for r in mixing.mix(docs.repartition(3)).collect())
    assert again == sorted((str(r.source), r.draw, r.copies) for r in mixed)
    applied = mixing.apply_mix(docs)
    words = {r.source: r.n for r in applied.groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()}
    assert applied.columns == docs.columns and words == {s: v[1] for s, v in by.items() if v[1]}


def test_personal_data_in_long_texts_is_quick(spark):
    """100,000 addresses in one text: places and replacements as by plain expressions, in little more than linear time."""
    from folioflow.llm import pii

    text = " ".join(f"é{i} u{i}@x.de" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "a@b.cd"), (3, "no"), (4, None)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r.base for r in df.select("doc_id", pii.base_spans().alias("base")).collect()}
    assert time.time() - start < 40
    want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(x.s, x.e) for x in got[1]] == want and [(x.s, x.e) for x in got[2]] == [(0, 6)] and got[3] == got[4] == []


def test_sanitize_many_spans(spark):
    from folioflow.llm import pii

    n = pii.CHUNK * 3 + 5
    text = " ".join(f"w{i} u{i}@x.de 10.0.0.{i % 250}" for i in range(n)) + " end"
    start = time.time()
    rows = {r.doc_id: r.text for r in pii.sanitize(spark.createDataFrame([(1, text), (2, "plain words"), (3, "")], "doc_id long, text string")).collect()}
    assert not re.search(r"@|10\.0", rows[1]) and rows[1].count("[EMAIL]") == n and rows[1].count("[IP]") == n and rows[1].endswith(" end") and rows[2] == "plain words"
    assert time.time() - start < 60


def test_terms_by_brute_force(spark):
    """Pointwise mutual information of every word near a value, over a small corpus, by plain counts."""
    import math
    import random

    from folioflow.llm import pii

    rng = random.Random(8)
    people = [("ann@x.de", "falconer"), ("bob@y.org", "luthier"), ("10.1.2.3", "gateway"), ("eve@z.net", "the")]
    common = ["the", "of", "and", "river", "stone", "house", "letter", "winter", "road"]
    docs = []
    for i in range(120):
        words = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        for value, term in rng.sample(people, rng.choice([0, 0, 1, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = [term if rng.random() < 0.8 else "river", "writes", value]
        docs.append(" ".join(words))
    split = re.compile(r"[^\W_]+")
    found = {i: [(k, m.start(), m.end(), m.group().lower()) for k, p in (("email", r"[a-z]+@[a-z]\.[a-z]+"), ("ip", r"10\.1\.2\.3")) for m in re.finditer(p, t)] for i, t in enumerate(docs)}
    has, holds, near, df = {}, {}, set(), {}
    for i, t in enumerate(docs):
        words = [(m.group().lower(), m.start(), m.end()) for m in split.finditer(t)]
        free = [w for w in words if not any(s < w[2] and w[1] < e for _, s, e, _ in found[i])]
        for w in {w for w, _, _ in words}:
            df[w] = df.get(w, 0) + 1
        has[i] = {w for w, _, _ in free}
        for k, s, e, v in found[i]:
            holds.setdefault(f"{k}:{v}", set()).add(i)
            before = [w for w, _, b in free if b <= s][-pii.NEAR :]
            behind = [w for w, a, _ in free if a >= e][: pii.NEAR]
            near |= {(f"{k}:{v}", w) for w in before + behind}
    total, told, wide = len(docs), set(), set()
    for c, t in near:
        both = [i for i in holds[c] if t in has[i]]
        given = (len(both) + pii.UNSEEN * len(holds[c]) / total) / (df[t] + pii.UNSEEN)
        ic = math.log2(total / len(holds[c]))
        if total > len(holds[c]) and math.log2(given) + ic >= pii.SHARE_OF_IC * ic:
            told |= {(i, t) for i in both}
            if given >= pii.ELSEWHERE and df[t] > len(both):
                wide.add(t)
    want = {(i, m.start(), m.end()) for i, t in enumerate(docs) for m in split.finditer(t) if ((i, m.group().lower()) in told or m.group().lower() in wide) and not any(s < m.end() and m.start() < e for _, s, e, _ in found[i])}
    got = {(r.doc_id, x.s, x.e) for r in pii.find_pii(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect() for x in r.spans if x.kind == "term"}
    assert got == want and want


def test_offsets_of_a_hot_file(spark):
    """Half of all rows share an id, many of them all columns, and others have none: offsets are running sums of each file's rows in order."""
    from folioflow.llm import warc

    rows = [(7, f"u{i % 5}", "x" * (i % 3)) for i in range(300)] + [(i, f"u{i}", "y" * i) for i in range(250)] + [(None, "same", "z")] * 40 + [(None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = warc.record_index(pages, records_per_file=100).collect()
    assert len(got) == len(rows) and {r.file_id for r in got if r.page_id is not None} == {0, 1, 2}
    files = {}
    for r in got:
        files.setdefault(r.file_id, []).append(r)
    for held in files.values():
        held.sort(key=lambda r: r.start)
        assert [r.start for r in held] == [sum(x.size for x in held[:k]) for k in range(len(held))]
        ids = [r.page_id for r in held]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    index = warc.record_index(pages, records_per_file=1000)
    assert warc.audit(index, warc.record_index(pages.repartition(3), records_per_file=1000)).count() == 0
    lost = warc.audit(index, index.where("page_id is null or page_id <> 249"))
    assert [(r.page_id, r.status) for r in lost.collect()] == [(249, "missing")]


def test_memory_of_a_tokenizing_worker_is_bounded():
    """Words that never come again: what a worker holds at once beside the library stays under 45 MB (79 before pieces were kept without their decoded forms and runs were halved)."""
    import pyarrow as pa

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        coder = bpe.Coder(f.read())
    rng = random.Random(11)
    texts = pa.array([" ".join("".join(rng.choices("aeioubcdfgklmnprst", k=rng.randrange(5, 11))) for _ in range(400)) for _ in range(1200)])
    tracemalloc.start()
    try:
        for _, part in runs(texts, bpe.BLOCK_CHARS):
            coder.code(part)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 45e6


def test_memory_of_a_labelling_worker_is_bounded():
    """A run of 3 MB: what labelling its texts takes at once stays under 40 MB (96 before words became numbers text by text and
    their features blocks), with the marginals that the whole algorithm has."""
    rng = random.Random(5)
    words = ["".join(rng.choices("aeioubcdfgklmnprst", k=rng.randrange(3, 16))) for _ in range(60_000)]
    field = language.fit([(lang, words[i : i + 9]) for i in range(0, 360, 9) for lang in ("de", "en", "es", "fr")[i // 9 % 4 :][:1]])
    texts = [" ".join(rng.choices(words, k=rng.choice((5, 200, 2000)))) for _ in range(420)]
    tracemalloc.start()
    try:
        got = language.label_texts(field, texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6
    for i in (0, 211, 419):
        scores = field.emissions(language.words_of(texts[i])).astype(np.float64)
        marginal, pairs = language.forward_backward(scores, np.array([0]), np.array([len(scores)]), field.step.astype(np.float64))
        assert np.allclose(got[i][2], marginal.mean(0), atol=1e-4) and np.isclose(pairs.sum(), len(scores) - 1)


def test_even_runs_have_no_small_rest():
    import pyarrow as pa

    texts = pa.array(["x" * (i % 7 * 10) for i in range(500)] + [None])
    for limit in (100, 1000, 4000, 10**6):
        parts = list(even_runs(texts, limit))
        sizes = [sum(map(len, t.to_pylist())) for _, t in parts]
        assert [s for s, _ in parts] == np.cumsum([0, *(len(t) for _, t in parts)])[:-1].tolist() and sum(len(t) for _, t in parts) == 501
        assert max(sizes) <= 2 * limit and (len(sizes) == 1 or limit < 1000 or min(sizes) > max(sizes) / 2)
    assert list(even_runs(pa.array([], pa.string()))) == []


def test_pipeline_hands_workers_small_batches(spark):
    """A worker of the first stage gets its rows by batches of 3 MB, not all 12 MB at once; a size that the session names stays."""
    import pyarrow as pa

    docs = spark.createDataFrame([(i, "some words of a text " * 600, "en", "web", 12600) for i in range(1000)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["doc_id"])

    before = spark.conf.getAll.get(corpus_pipeline.BATCH_BYTES)
    try:
        spark.conf.unset(corpus_pipeline.BATCH_BYTES)
        corpus_pipeline.identify_language(spark, docs, SF)
        rows = [r.doc_id for r in docs.mapInArrow(sizes, "doc_id long").collect()]
        assert sum(rows) == 1000 and max(rows) < 300
        spark.conf.set(corpus_pipeline.BATCH_BYTES, "5m")
        corpus_pipeline.identify_language(spark, docs, SF)
        assert spark.conf.get(corpus_pipeline.BATCH_BYTES) == "5m"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_BYTES) if before is None else spark.conf.set(corpus_pipeline.BATCH_BYTES, before)


def test_tokenizing_stage_sends_back_ids_only(spark):
    """The last stage of the pipeline decodes nothing, and its workers do not send the texts back."""
    from tokenizers import Tokenizer

    texts = ["It's a word, a Word.", "", None, "x" * 3000, "a<|endoftext|> b", " été 日本 "] + [f"n{i} words here" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.tokenize(spark, docs, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    plan = out._jdf.queryExecution().analyzed()
    while "MapInArrow" not in plan.nodeName():
        plan = plan.children().head()
    sent = [plan.output().apply(i).name() for i in range(plan.output().size())]
    assert sent == out.columns
    library = Tokenizer.from_file(queries.tokenizer_path())
    for r in out.collect():
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    kept = bpe.encode_decode(docs, queries.tokenizer_path(), keep=("text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "n_tokens", "ids", "decoded"]
    assert {r.doc_id: r.text for r in kept.collect()} == dict(enumerate(texts))
