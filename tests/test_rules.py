"""Hand-made cases: thresholds, goldens, properties."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import layout, manifest, metadata, relational, web
from folioflow.streaming import stateful as S


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("text,n", [("Dr. Smith came. He left!", 2), ("One\nTwo", 2), ("e.g. this is one.", 1), ("U.S. office. Big.", 2), ("...", 0), ("", 0)])
def test_sentences(spark, text, n):
    assert one(spark, T.sentence_count, text) == n


@pytest.mark.parametrize("sec,label", [(59, "59 sec"), (60, "1 min"), (61, "1 min 1 sec"), (3600, "1 hr 0 min"), (3719, "1 hr 1 min")])
def test_time_label(spark, sec, label):
    assert one(spark, T.time_label, sec, "long") == label


@pytest.mark.parametrize("n,text", [(4, "iv"), (1994, "mcmxciv"), (3999, "mmmcmxcix"), (4000, "4000"), (0, "0")])
def test_roman(spark, n, text):
    assert one(spark, T.roman, n, "long") == text


@pytest.mark.parametrize("n,text", [(1, "a"), (26, "z"), (27, "aa"), (702, "zz"), (703, "aaa")])
def test_letters(spark, n, text):
    assert one(spark, T.letters, n, "long") == text


def test_text_functions(spark):
    assert one(spark, T.normalize_path, "/a/./b/../c//d") == "a/c/d"
    assert one(spark, T.dehyphenate, "exam-\nple of\ntext\n\nnew") == "example of text\n\nnew"
    assert one(spark, T.fold_presentation_forms, "ﻼ x ﬁ") == "لا x ﬁ"
    assert one(spark, T.clean_text, "é \t\n\n\n\nb\x07 ") == "é\n\nb"
    assert one(spark, lambda c: T.fix_ocr_line(c, chip=True), "| a (b  [ ] c") == "a b c"
    assert one(spark, T.html_to_text, "<p>a&#38;b &#x41;&lt;i&gt;</p><script>x</script>") == "a&b A<i>"
    assert one(spark, T.is_rtl, "שלום ab") is True


def test_apportion_goldens(spark):
    rows = [("a", 0.5, True), ("a", 2 / 3, False), ("b", 0.5, False), ("c", 0.125, True), ("c", 0.5, False)]
    got = relational.apportion_shares(spark.createDataFrame(rows, "g string, share double, spouse boolean"), "g", "share", "spouse").collect()
    shares = {(r.g, r.spouse): (round(r.given, 9), r.aul, r.radd) for r in got}
    assert shares[("a", True)] == (round(3 / 7, 9), True, False) and shares[("a", False)] == (round(4 / 7, 9), True, False)
    assert shares[("b", False)] == (1.0, False, True)
    assert shares[("c", True)] == (0.125, False, True) and shares[("c", False)] == (0.875, False, True)


def test_collapse_undoes_expand(spark):
    specs = spark.createDataFrame([(1, "1-3, 5, 8-10", 10), (2, "7", 10)], "id int, spec string, total long")
    pages = manifest.expand_ranges(specs, "id")
    assert {r.id: r.ranges for r in manifest.collapse_ranges(pages, "id", "page").collect()} == {1: "1-3, 5, 8-10", 2: "7"}


def test_interleave_keeps_all_pages(spark):
    m = spark.createDataFrame([("o", s, p, i) for i, (s, p) in enumerate([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2)], 1)], "out_id string, src long, page long, pos long")
    got = [(r.src, r.page) for r in manifest.interleave(m).orderBy("pos").collect()]
    assert got == [(1, 1), (2, 1), (1, 2), (1, 3), (3, 1), (3, 2)]


def test_delete_refuses_all(spark):
    m = spark.createDataFrame([("o", 1, 1), ("o", 1, 2), ("q", 1, 1), ("q", 1, 2)], "out_id string, src long, pos long")
    gone = spark.createDataFrame([("o", 1), ("o", 2), ("q", 1)], "out_id string, pos long")
    got = sorted((r.out_id, r.pos, r.refused) for r in manifest.delete_pages(m, gone).collect())
    assert got == [("o", 1, True), ("o", 2, True), ("q", 1, False)]


def test_otp_rules():
    run = lambda events, flow=False: fold(S.otp_step, (None, 0, None, False), events, flow)

    def fold(step, state, events, flow):
        out = []
        for at, action in events:
            state, verdict = step(state, at, action, flow)
            out.append(verdict)
        return out

    assert run([(0, "right")]) == ["none"]
    assert run([(0, "send"), (600, "right"), (601, "right")]) == ["sent", "verified", "none"]
    assert run([(0, "send"), (601, "right"), (602, "right")]) == ["sent", "expired", "none"]
    wrong = [(i, "wrong") for i in range(1, 6)]
    assert run([(0, "send"), *wrong, (10, "right"), (20, "send"), (1805, "right")]) == ["sent", "wrong", "wrong", "wrong", "wrong", "locked now", "locked", "locked", "expired"]
    assert run([(0, "send"), (1, "right"), (2, "right")], True) == ["sent", "token", "token"]


def test_rate_and_throttle_bounds():
    state, ok = S.rate_step((None, 0), 0, 1, 10)
    assert ok and S.rate_step(state, 10, 1, 10)[1] is False and S.rate_step(state, 10.5, 1, 10)[1] is True
    state, ok = S.throttle_step((None,), 0, 30)
    assert ok and S.throttle_step(state, 29.9, 30)[1] is False and S.throttle_step(state, 30, 30)[1] is True


def test_permissions(spark):
    got = spark.createDataFrame([(-4, 3), (-3904, 3), (0, 2)], "p int, r int").select(metadata.decode_permissions(F.col("p"), F.col("r")).alias("m")).collect()
    assert set(got[0].m.values()) == {"yes"} and got[1].m["print"] == "no" and set(got[2].m.values()) == {"no"}


def test_lines_look_back(spark):
    rows = [(1, 1, i, "x", 0.0, y, 5.0, s) for i, (y, s) in enumerate([(10.0, 12.0), (13.0, 12.0), (30.0, 12.0)])]
    items = spark.createDataFrame(rows, "doc_id long, page long, seq long, str string, x double, y double, w double, size double")
    assert [r.line for r in layout.cluster_lines_exact(items).orderBy("seq").collect()] == [1, 1, 2]


def test_rewrites_are_idempotent(spark):
    pages = spark.createDataFrame([(1, '<link href="/a.css"><script src="https://c.d/x.js"></script>')], "page_id long, html string")
    once = web.stamp_assets(pages, "7")
    assert web.stamp_assets(once, "7").first().html == once.first().html
    defer = web.defer_scripts(pages, ["c.d"])
    assert defer.first().changed and not web.defer_scripts(defer, ["c.d"]).first().changed


def test_rules_carry_state_over_batches(spark):
    rows = [(k, i * 100 + j, float(i * 7), "send" if i % 9 == 0 else "wrong") for i in range(300) for j, k in enumerate(("a", "b", None))]
    events = spark.createDataFrame(rows, "key string, event_id long, at double, action string").repartition(3, "event_id")
    want, rate, otp = {}, {}, {}
    for k, e, at, action in sorted(rows, key=lambda r: r[1]):
        rate[k], ok = S.rate_limit(rate.get(k, S.EMPTY["rate"]), at)
        otp[k], said = S.otp_signup(otp.get(k, S.EMPTY["otp"]), at, action)
        want[e] = (ok, str(ok).lower(), said)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        native, grouped, verify = S.rate_limit_native(events, 3, 3600), S.batch_rule(events, "rate", S.rate_limit), S.batch_rule(events, "otp", S.otp_signup, with_action=True)
        got = [{r.event_id: r[c] for r in df.collect()} for df, c in ((native, "accepted"), (grouped, "verdict"), (verify, "verdict"))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {e: tuple(g[e] for g in got) for e in want} == want
    for df in (native, grouped, verify):  # no key's events are gathered in a row or a group
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_deep_graphs_are_walked_to_the_end(spark):
    from folioflow.sources.scratch import written

    edges = spark.createDataFrame([(i, i + 1) for i in range(54)] + [(54, 3)], "src long, dst long").coalesce(1)
    node = spark.createDataFrame([(0,)], "node long")
    assert {r.node for r in web.reachable(edges, node, node.limit(0), written).collect()} == set(range(55))
    outline = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(18)] + [(100, 5, 100)], "node long, parent long, page long").coalesce(1)
    deleted = outline.where("page <> 17").select("page")
    assert {r.node for r in relational.prune_outline(outline, deleted, written).collect()} == set(range(18))


def test_links_resolve_as_in_a_browser(spark):
    from folioflow.operators import web

    base = "http://A.b:80/c/d.html?x=1#y"
    cases = {
        "../e.html": "http://a.b/e.html", "./e": "http://a.b/c/e", "?q=1": "http://a.b/c/d.html?q=1", "#z": "http://a.b/c/d.html?x=1#z", "/": "http://a.b/", "..": "http://a.b/", "g/..": "http://a.b/c/",
        "//H.i/j/../k?l#m": "http://h.i/k?l#m", "https://X.y": "https://x.y/", "mailto:a@b": None, "": None, "../../../q": "http://a.b/q",
    }
    df = spark.createDataFrame([(base, h) for h in cases], "base string, href string")
    got = {r.href: r.target for r in df.select("href", web.resolve_link(F.col("base"), F.col("href")).alias("target")).collect()}
    assert got == cases


def test_character_references(spark):
    text = "caf&eacute; &#233;&#xE9;&#128512;&#x1f600; &rsquo;&lsquo;&ldquo;&rdquo; &#0; &#55296; &#99999999; &#1234567890123; &#xZ; &amp;lt; &#38;lt; &#"
    got = spark.createDataFrame([(text,)], "t string").select(T.decode_entities(F.col("t")).alias("t")).first().t
    assert got == "caf&eacute; éé😀😀 ’‘“” &#0; &#55296; &#99999999; &#1234567890123; &#xZ; &lt; &lt; &#"


def test_natural_order(spark):
    from folioflow.operators import relational

    names = ["img10", "img2", "IMG1", "img02b", "Éa", "eb", "img" + "9" * 30, "img" + "1" + "0" * 30]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(relational.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["Éa", "eb", "IMG1", "img2", "img02b", "img10", "img" + "9" * 30, "img1" + "0" * 30]


def test_words_of_many_joins(spark):
    text = "-".join("a" * 100_000)
    row = spark.createDataFrame([(text, "x@" + ".".join("b" * 100_000))], "t string, e string").select(F.size(T.words(F.col("t"))).alias("n"), T.valid_email(F.col("e")).alias("ok")).first()
    assert row.n == 1 and row.ok


def test_inheritance_over_long_chains_and_circles(spark):
    from folioflow.operators import relational
    from folioflow.sources.scratch import written

    rows = [(f"n{i}", f"n{i + 1}", None) for i in range(100)] + [("n100", None, "top"), ("a", "b", None), ("b", "a", None), ("c", None, None)]
    got = {r.node: (r.value, r.depth) for r in relational.resolve_inherited(spark.createDataFrame(rows, "node string, parent string, value string"), written).collect()}
    assert all(got[f"n{i}"] == ("top", 100 - i) for i in range(101)) and got["a"] == got["b"] == got["c"] == (None, None)


def test_columns_are_cut_and_read_in_order(spark):
    from folioflow.operators import layout

    rows = [(1, 0, i, 1, 72.0, 280.0, 100.0 + 16 * i) for i in range(10)] + [(1, 0, i, 2, 320.0, 540.0, 100.0 + 16 * i) for i in range(10)]
    rows += [(1, 0, 20, 1, 72.0, 540.0, 300.0)] + [(1, 0, 30 + i, 1, 72.0, 280.0, 320.0 + 16 * i) for i in range(6)] + [(1, 0, 30 + i, 2, 320.0, 540.0, 320.0 + 16 * i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, page long, line long, frag long, x0 double, x1 double, y double")
    got = {(r.line, r.frag): r.region for r in layout.xy_cut(df).collect()}
    assert [got[(0, 1)], got[(9, 1)], got[(0, 2)], got[(9, 2)], got[(20, 1)], got[(30, 1)], got[(35, 2)]] == [0, 0, 1, 1, 2, 3, 4]


def test_recognised_words_are_read_column_by_column(spark):
    from folioflow.operators import layout

    rows = [(1, 0, "Head", 72.0, 50.0, 60.0, 24.0)]
    rows += [(1, 0, f"{side}{i}", 72.0 + 300 * k, 100.0 + 20 * i, 40.0, 12.0) for i in range(3) for k, side in enumerate("LR")]
    rows += [(1, 0, w, 72.0 + 45 * k, 200.0, 40.0, 12.0) for k, w in enumerate(("one", "|", "two"))]
    df = spark.createDataFrame(rows, "doc_id long, page long, str string, x double, y double, w double, size double")
    got = sorted((r.place, r.text, r.level) for r in layout.structure_ocr(df).collect())
    assert [t for _, t, _ in got] == ["Head", "L0", "L1", "L2", "R0", "R1", "R2", "one • two"] and got[0][2] == 1 and got[1][2] == 0


def test_paragraphs_and_their_pieces(spark):
    from folioflow.operators import layout

    lines = [("Title", 72.0, 200.0, 60.0, 20.0), ("First line of it that is long enough", 72.0, 540.0, 90.0, 12.0), ("and goes on", 72.0, 540.0, 106.0, 12.0), ("1. item", 72.0, 150.0, 122.0, 12.0), ("after a gap", 72.0, 540.0, 170.0, 12.0)]
    df = spark.createDataFrame([(1, 0, i, *row) for i, row in enumerate(lines)], "doc_id long, page long, line long, text string, x0 double, x1 double, y double, size double")
    paras = layout.build_paragraphs(df)
    assert [(r.text, r.level) for r in paras.orderBy("para").collect()] == [("Title", 1), ("First line of it that is long enough and goes on", 0), ("1. item", 0), ("after a gap", 0)]
    assert layout.rejoin_paragraphs(paras).count() == 4


def test_votes_of_a_batch_that_comes_again(spark, tmp_path):
    from folioflow.streaming.stateful import VoteStore

    store = VoteStore(str(tmp_path))
    schema = "tool string, voter long, score long, ts long, event_id long"
    first, second = ([("t", 1, 5, 1, 1), ("t", 2, 3, 1, 2)], [("t", 1, 2, 2, 3)])
    for epoch, rows in ((0, first), (1, second), (1, second)):
        store.upsert(spark.createDataFrame(rows, schema), epoch)
    assert sorted((r.voter, r.score) for r in store.votes(spark).collect()) == [(1, 2), (2, 3)]


def test_signature_type_comes_from_far_up(spark):
    from folioflow.operators.metadata import signature_coverage
    from folioflow.sources.scratch import written

    rows = [("f0", None, "Sig", None, None, 1000)] + [(f"f{i}", f"f{i - 1}", None, None, None, 1000) for i in range(1, 5)]
    rows += [("f5", "f4", None, 100, 900, 1000), ("g5", "f4", None, 100, 500, 1000), ("h5", "f4", None, None, None, 1000), ("x", "none", None, 1, 1, 1000), ("y", "z", None, 1, 1, 10), ("z", "y", None, 1, 1, 10)]
    got = signature_coverage(spark.createDataFrame(rows, "field string, parent string, type string, offset long, length long, file_size long"), written).collect()
    assert {(r.field, r.coverage) for r in got} == {("f5", "whole"), ("g5", "later changes"), ("h5", "empty")}


def test_numbering_of_one_large_output(spark):
    """One output holds half of all pages: it lies in many tasks, none has a window over it, and numbers are those of a window."""
    from pyspark.sql import Window

    from folioflow.operators import manifest as M

    m = spark.range(40000).select(F.when(F.col("id") < 20000, "one").when(F.col("id") < 20100, F.lit(None)).otherwise(F.concat(F.lit("o"), F.col("id") % 300)).alias("out_id"), (F.col("id") % 7).alias("src"), ((F.col("id") * 7919) % 40009).alias("page"))
    got = M.numbered(m, ["out_id"], F.col("src"), F.desc("page"))
    want = m.withColumn("pos", F.row_number().over(Window.partitionBy("out_id").orderBy("src", F.desc("page"))).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line or "Window(" in line]
    assert windows and all("numbering_part" in w for w in windows)
    width = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = M.numbered(m.withColumn("task", F.lit(0)), ["out_id"], F.col("src"), F.col("page"))
        parts = table.inputFiles()
        sizes = [spark.read.parquet(f).where("out_id = 'one'").count() for f in parts]
        assert sum(sizes) == 20000 and max(sizes) < 16000 and sum(n > 0 for n in sizes) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", width)
    assert M.numbered(m.limit(0), ["out_id"], F.col("src")).count() == 0


def test_redirects_of_any_length_and_circles(spark):
    from folioflow.sources.scratch import written

    rules = [(k, None, f"/c{k}", "exact", f"/c{k + 1}", 308) for k in range(100)] + [(200, None, "/x", "exact", "/y", 308), (201, None, "/y", "exact", "/x", 308), (202, None, "/in", "exact", "/x", 308)]
    rules += [(300, "a.b", "/h/", "prefix", "/c98", 308), (301, None, "/h/", "prefix", "/old", 308), (302, "a.b", "/c100", "exact", "/old", 308), (303, None, "/old", "exact", "/old", 410), (304, None, "/self", "prefix", "/self/more", 308)]
    urls = [(1, "q.r", "/c0"), (2, "q.r", "/x"), (3, "q.r", "/in"), (4, "a.b", "/h/1"), (5, "q.r", "/h/1"), (6, None, "/h/1"), (7, "q.r", "/none"), (8, "q.r", "/self"), (9, "a.b", "/c0"), (9, "q.r", "/c99")]
    table = spark.createDataFrame(rules, "ord int, host string, pattern string, kind string, destination string, status int")
    got = web.resolve_redirects(spark.createDataFrame(urls, "key int, host string, path string"), table, written).collect()
    assert {tuple(r) for r in got} == {
        (1, "/c100", 100, 308), (2, "/x", None, 508), (3, "/in", None, 508), (4, "/old", 5, 410), (5, "/old", 2, 410), (6, "/old", 2, 410), (7, "/none", 0, 200), (8, "/self", None, 508), (9, "/old", 102, 410), (9, "/c100", 1, 308),
    }
    none = web.resolve_redirects(spark.createDataFrame(urls, "key int, host string, path string"), table.limit(0), written).collect()
    assert {(r.steps, r.status) for r in none} == {(0, 200)} and len(none) == len(urls)


def plain_box(page, n):
    """Row by row over one page of n x n pixels with one channel."""
    band = max(1, int(n * 0.03))
    border = sorted(v for (x, y), v in page.items() if (x < band or x >= n - band or y < band or y >= n - band) and x % 2 == 0 and y % 2 == 0)
    paper = border[len(border) // 2] or 255
    paper, tol = (paper, 34 if paper < 250 else 18) if paper >= 200 else (255, 18)
    ink = {(x, y) for (x, y), v in page.items() if abs(v - paper) > tol}

    def skip(line):
        lim, k = int(n * 0.06 + 0.5), 0
        while k < lim and line[k]:
            k += 1
        if k == 0 or k >= lim:
            return 0
        gap, j = 0, k
        while gap < int(n * 0.4 + 0.5) and not line[j]:
            j, gap = j + 1, gap + 1
            if j >= n:
                return 0
        return k if gap >= max(3, int(n * 0.01 + 0.5)) else 0

    rows, cols = [any((x, y) in ink for x in range(n)) for y in range(n)], [any((x, y) in ink for y in range(n)) for x in range(n)]
    t, b, left, r = skip(rows), n - 1 - skip(rows[::-1]), skip(cols), n - 1 - skip(cols[::-1])
    kept = [(x, y) for x, y in ink if left <= x <= r and t <= y <= b]
    return (min(x for x, _ in kept), min(y for _, y in kept), max(x for x, _ in kept), max(y for _, y in kept)) if kept else (None,) * 4


def test_content_box_with_edge_strips(spark):
    import random

    from folioflow.operators import pixels as P

    rng, n, pages = random.Random(4), 60, {}
    for k in range(40):
        base = rng.choice([255, 255, 230, 40])
        page = {(x, y): base for x in range(n) for y in range(n)}
        for _ in range(rng.choice([0, 1, 3])):
            x0, y0 = rng.randrange(8, 50), rng.randrange(8, 50)
            page.update({(x, y): 90 for x in range(x0, min(n, x0 + 6)) for y in range(y0, min(n, y0 + 3))})
        for side in rng.sample(range(4), rng.choice([0, 1, 2])):
            wide = rng.choice([1, 2, 3, 5])
            page.update({(x, y): 10 for x in range(n) for y in range(n) if (x, n - 1 - x, y, n - 1 - y)[side] < wide})
        pages[k] = page
    df = spark.createDataFrame([(k, x, y, v) for k, page in pages.items() for (x, y), v in page.items()], "page_id long, x long, y long, lum long")
    got = P.content_box(df, n, n, scale=2.0).collect()
    for r in got:
        want = plain_box(pages[r.page_id], n)
        assert (r.x0, r.y0, r.x1, r.y1) == want and r.blank == (want[0] is None)
        assert want[0] is None or (r.top, r.right) == (want[1] / 2, (n - 1 - want[2]) / 2)
    assert len(got) == 40 and any(r.blank for r in got)


def test_graphemes_of_all_kinds(spark):
    texts = ["plain", "a\r\nb", "é", "é", "日本語", "👩‍👩‍👧", "🇩🇪🇫🇷", "नमस्ते", "한글", "ᄒ​ᅡ", "´ñ ü", "x‍y", "", None, "Привет, мир", "か゚", "©️"]
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.graphemes(F.col("t")).alias("n"), F.regexp_count("t", F.lit(r"\X")).alias("w")).where("t is not null and n <> w or false").collect()}
    assert got == {}
    assert spark.createDataFrame([("a\r\nb",)], "t string").select(T.graphemes(F.col("t"))).first()[0] == 3


def test_loops_over_trees_and_links_give_what_recursive_sql_gives(spark):
    """Random forests with chains of up to 7 nodes and circles: the loops against WITH RECURSIVE of Spark itself."""
    from random import Random

    from folioflow.sources.scratch import written

    r = Random(5)
    parents = {i: (i - 1 if i % 7 else None) if i < 60 else r.choice([None, *range(i - 60, i - 40)]) for i in range(200)} | {200: 201, 201: 202, 202: 200}
    rows = [(f"n{i}", None if p is None else f"n{p}", f"v{i}" if r.random() < 0.1 else None, r.randrange(8)) for i, p in parents.items()]
    spark.createDataFrame(rows, "node string, parent string, value string, page int").createOrReplaceTempView("forest")
    forest = spark.table("forest")
    up = spark.sql("""WITH RECURSIVE u(node, at, value, depth) AS (SELECT node, parent, value, 0 FROM forest UNION ALL
        SELECT u.node, f.parent, f.value, u.depth + 1 FROM u JOIN forest f ON f.node = u.at WHERE u.value IS NULL AND u.depth < 11)
        SELECT node, max(value) AS value, CASE WHEN max(value) IS NOT NULL THEN max(depth) END AS depth FROM u GROUP BY node""")
    got = relational.resolve_inherited(forest.select("node", "parent", "value"), written)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, up.collect()), key=str)

    gone = spark.createDataFrame([(i,) for i in range(6)], "page int")
    kept = spark.sql("""WITH RECURSIVE k(node, parent, depth) AS (SELECT node, parent, 0 FROM forest WHERE page >= 6 UNION ALL
        SELECT f.node, f.parent, k.depth + 1 FROM k JOIN forest f ON f.node = k.parent WHERE k.depth < 11) SELECT DISTINCT node FROM k""")
    assert {x.node for x in relational.prune_outline(forest.select("node", "parent", "page"), gone, written).collect()} == {x.node for x in kept.collect()}

    down = forest.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    roots, dead = forest.where("node in ('n0', 'n8', 'n201')").select("node"), forest.where("page = 3 and node <> 'n201'").select("node")
    down.createOrReplaceTempView("down"), dead.createOrReplaceTempView("dead")
    reached = spark.sql("""WITH RECURSIVE r(node, depth) AS (SELECT node, 0 FROM forest WHERE node IN ('n0', 'n8', 'n201') AND node NOT IN (SELECT node FROM dead) UNION ALL
        SELECT dst, depth + 1 FROM r JOIN down ON src = r.node WHERE dst NOT IN (SELECT node FROM dead) AND depth < 11) SELECT DISTINCT node FROM r""")
    assert {x.node for x in web.reachable(down, roots, dead, written).collect()} == {x.node for x in reached.collect()}


def test_sketched_words_are_the_exact_ones(spark):
    """Also for groups that the sketch cannot tell: with ties at the last rank, more words than it keeps, fewer than asked for, or no name."""
    from folioflow.operators import corpus
    from folioflow.sources.scratch import written

    flat = " ".join(f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp")
    rows = [("flat", flat), ("steep", " ".join(f"{w} " * (200 - 9 * i) for i, w in enumerate(flat.split()[:20]))), ("few", "alpha beta beta"), (None, "gamma gamma delta"), ("none", None), ("", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(map(tuple, corpus.top_words(df, by=("lang",)).collect()), key=str)
    for tracked in (64, 10_000):
        assert sorted(map(tuple, corpus.top_words_sketched(df, written, tracked=tracked).collect()), key=str) == want


def test_words_of_the_whole_corpus(spark):
    from folioflow.operators import corpus

    df = spark.createDataFrame([("b b a a c the the the",), ("d d d 5 5 5 5",), (None,)], "text string")
    got = [tuple(r) for r in corpus.top_words(df, k=3).orderBy("rank").collect()]
    assert got == [tuple(r)[1:] for r in corpus.top_words(df.selectExpr("1 AS g", "text"), by=("g",), k=3).orderBy("rank").collect()]
    assert len(got) == 3
    assert corpus.top_words(df.limit(0)).count() == 0


def test_orphans_of_a_site(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.org/", '<a href="/x"></a><a href="x?q=1#f"></a><a href="mailto:a@b"></a>'), (2, "https://a.org/x", '<a href="https://a.org"></a><a href="https://b.org/x"></a>'), (3, "https://a.org/lost", None), (4, "https://b.org", ""), (5, None, '<a href="/x"></a>')],
        "page_id long, url string, html string",
    )
    got = {(r.site, r.path): (r.inbound, r.site_least, r.orphan) for r in web.link_audit(web.extract_links(pages), web.known_pages(pages)).collect()}
    assert got == {("https://a.org", "/"): (1, 0, False), ("https://a.org", "/x"): (2, 0, False), ("https://a.org", "/lost"): (0, 0, True), ("https://b.org", "/"): (0, 0, True)}


def test_missing_files_of_repeated_urls(spark, tmp_path):
    from folioflow.plans import web as plans
    from folioflow.plans.registry import ORACLES
    from tests.compare import connect, differences

    rows = [(3, "https://a.org/x"), (4, "https://a.org/x"), (10, "https://a.org/y"), (17, "https://a.org/y"), (24, None), (25, None), (None, "https://a.org/z")]
    spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert differences(plans.j13_missing_files(spark, str(tmp_path)), ORACLES["j13_missing_files"], connect(str(tmp_path))) == ""


def in_groups(df):
    """Whether a plan calls pandas once a group."""
    return "FlatMapGroupsInPandas" in df._jdf.queryExecution().optimizedPlan().toString()


def greedy(marks, rows, width=612.0):
    used, out = set(), []
    for i, x1, y, h in sorted(marks):
        found = [(x0, j) for j, x0, r in rows if j not in used and x0 >= x1 and x0 - x1 < width / 4 and abs(r - y) <= 0.6 * h]
        if found:
            used.add(min(found)[1])
            out.append((i, min(found)[1]))
    return out


def test_markers_of_many_pages_and_of_a_full_one(spark):
    import random

    rng, pages = random.Random(5), {}
    for p in range(120):
        n = 400 if p == 0 else rng.randrange(0, 30)
        marks = [(i, rng.choice([30.0, 60.0]), rng.randrange(0, 60) * 7.2, rng.choice([10.0, 12.0, 0.0])) for i in range(n)]
        pages[p] = marks, [(j, rng.randrange(0, 40) * 10.0, rng.randrange(0, 60) * 7.2) for j in range(rng.randrange(0, 2 * n + 1))]
    schema = "doc_id long, page long, idx long, x0 double, x1 double, y double, h double"
    m = spark.createDataFrame([(p % 7, p, i, 0.0, x1, y, h) for p, (marks, _) in pages.items() for i, x1, y, h in marks] + [(1, 1, 99, 0.0, 1.0, None, 9.0)], schema)
    r = spark.createDataFrame([(p % 7, p, j, x0, x0 + 9, y, 12.0) for p, (_, rows) in pages.items() for j, x0, y in rows] + [(1, 1, 99, None, 1.0, 7.2, 9.0)], schema)
    out = layout.attach_markers(m, r)
    assert not in_groups(out)
    assert sorted(tuple(x) for x in out.collect()) == sorted((p % 7, p, *found) for p, case in pages.items() for found in greedy(*case))


def test_numbered_paragraphs_without_groups(spark):
    from folioflow.plans import layout as plans

    assert not in_groups(plans.l17_rejoin_paragraphs(spark, "/root/testdata/sf0.001"))


def test_lines_of_many_pages(spark):
    import random

    def lines(page, share=0.45):
        known, out = [], []
        for y, _, seq, size in sorted(page):
            near = [i for i in range(len(known) - 1, max(-1, len(known) - 5), -1) if abs(known[i][0] - y) <= share * min(known[i][1], size)]
            if near:
                known[near[0]][1] = max(known[near[0]][1], size)
            else:
                known.append([y, size])
            out.append((seq, near[0] + 1 if near else len(known)))
        return out

    rng = random.Random(3)
    pages = {(d, p): [(rng.randrange(0, 200) * 1.5, float(rng.randrange(0, 5)), i, rng.choice([6.0, 12.0, 30.0])) for i in range(rng.choice([1, 40, 900]))] for d in range(3) for p in range(12)}
    items = spark.createDataFrame([(d, p, i, x, y, size) for (d, p), page in pages.items() for y, x, i, size in page], "doc_id long, page long, seq long, x double, y double, size double")
    out = layout.cluster_lines_exact(items)
    assert not in_groups(out)
    assert sorted(tuple(r) for r in out.collect()) == sorted((*k, *found) for k, page in pages.items() for found in lines(page))


def test_gutters_without_a_row_for_each_bin(spark):
    from folioflow.plans import layout as plans

    out = plans.l5_gutters(spark, "/root/testdata/sf0.001")
    assert "Generate explode(concat" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, 1, i, k, 72.0 + 300 * k, 240.0 + 300 * k, 3) for i in range(9) for k in (0, 1)] + [(1, 2, i, 0, 72.0, 240.0, 3) for i in range(9)] + [(1, 3, i, k, 72.0 + 300 * k, 240.0 + 300 * k, 3) for i in range(7) for k in (0, 1)]
    frags = spark.createDataFrame([*rows, (1, 1, 9, 0, 400.0, 80.0, 1), (1, 1, 10, 0, None, None, 1)], "doc_id long, page long, line long, frag long, x0 double, x1 double, n long")
    assert [tuple(r) for r in layout.gutters(frags).collect()] == [(1, 1, 79, 120, (79 + 121) / 2 * 612.0 / 200)]


def test_column_gaps_by_counting_edges(spark):
    """Rows in columns, crossing rows, rows of no width and from right to left, against a count of all rows between two edges."""
    import random

    def covered(rows, a, b):
        return sum(r[1] < b and r[2] > a for r in rows)

    def gap(rows, least, gap=6.0):
        edges = sorted({r[1] for r in rows} | {r[2] for r in rows})
        spans = [(a, b, covered(rows, a, b)) for a, b in zip(edges, edges[1:])]
        tries = 0
        for level in layout.LEVELS:
            runs = []
            for a, b, n in spans:
                if n <= level * len(rows):
                    if runs and runs[-1][1] == a:
                        runs[-1][1] = b
                    else:
                        runs.append([a, b])
            for a, b in sorted((r for r in runs if r[1] - r[0] >= gap), key=lambda r: (r[0] - r[1], r[0])):
                tries += 1
                if tries > layout.MOST_TRIES:
                    return None
                x = (a + b) / 2
                sides = [[r for r in rows if r[2] <= x], [r for r in rows if r[1] >= x]]
                if min(map(len, sides)) < least or len(rows) - sum(map(len, sides)) > 0.35 * len(rows):
                    continue
                tops, lows = [min(r[3] for r in s) for s in sides], [max(r[3] for r in s) for s in sides]
                if min(lows) - max(tops) < 0.4 * min(b - a for a, b in zip(tops, lows)):
                    continue
                extents = [max(r[2] for r in s) - min(r[1] for r in s) for s in sides]
                if all(sum(r[2] - r[1] >= 0.5 * e for r in s) >= min(4, 0.15 * len(s)) for e, s in zip(extents, sides)):
                    return x
        return None

    rng, told = random.Random(11), 0
    for _ in range(300):
        rows = []
        for i in range(rng.randrange(2, 60)):
            x0 = rng.choice([72.0, 330.0, rng.randrange(60, 500)])
            rows.append((i, x0, x0 + rng.choice([0.0, 200.0, 30.0, 230.0, -20.0, 400.0] if rng.random() < 0.3 else [200.0]), float(rng.randrange(0, 40))))
        got = layout._column_gap(rows, 5)
        assert got == gap(rows, 5)
        told += got is not None
    assert told > 20
    from folioflow.plans import layout as plans

    assert not in_groups(plans.l7_xy_cut(spark, "/root/testdata/sf0.001"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_lines_are_made_once(spark):
    from folioflow.plans import layout as plans

    out = plans.l12_without_running(spark, "/root/testdata/sf0.001")
    assert plan_of(out).count("posexplode") <= 1 and out.columns == ["doc_id", "page", "line"]
    heads = [(d, p, 1, "Report 7" if d == 1 else f"unlike {chr(97 + p)}", 72.0, 130.0, 40.0, 12.0) for d in (1, 2) for p in range(3)]
    body = [(d, p, i, "same words", 72.0, 300.0, 100.0 + 16 * i, 12.0) for d in (1, 2) for p in range(3) for i in (2, 3)]
    long = [(3, p, 1, "x" * 121, 72.0, 130.0, 40.0, 12.0) for p in range(3)] + [(4, 0, 1, "Report 7", 72.0, 130.0, 40.0, 12.0), (5, 0, 1, None, 1.0, 2.0, 40.0, 12.0), (5, 1, 1, None, 1.0, 2.0, 40.0, 12.0)]
    foot = [(6, p, 1, f"{p} / 3", 300.0, 320.0, 760.0, 12.0) for p in range(3)]
    lines = spark.createDataFrame(heads + body + long + foot, "doc_id long, page long, line long, text string, x0 double, x1 double, y double, size double")
    left = layout.without_running(lines)
    assert left.columns == lines.columns
    assert sorted((r.doc_id, r.page, r.line) for r in left.collect()) == sorted((r[0], r[1], r[2]) for r in heads[3:] + body + long)
    assert [tuple(r) for r in layout.running_headers(lines).orderBy("doc_id").collect()] == [(1, "header", "report #", 3, 3, "left"), (6, "footer", "# / #", 3, 3, "centre")]


def test_words_of_a_page_tree_are_not_shuffled(spark, tmp_path):
    from folioflow.plans import layout as plans
    from folioflow.plans.registry import ORACLES
    from tests.compare import connect, differences

    texts = [None, "", " \n ", "one", " ".join(f"w{i}" for i in range(8)), " ".join(f"w{i}" for i in range(320)), "\n".join(f"w{i}" for i in range(321)), " ".join(f"\t" if i % 5 == 0 else f"w{i}" for i in range(1000))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = plans.g4_flatten_ocr(spark, str(tmp_path))
    assert "hashpartitioning" not in plan_of(out)
    assert differences(out, ORACLES["g4_flatten_ocr"], connect(str(tmp_path))) == ""


def test_recognised_words_of_a_long_row(spark):
    """A page of one row of 3,000 words in two parts and one of two columns of 200 rows, without a sort of all words for each thing asked."""
    row = [(1, 1, i, "|" if i % 1000 == 0 else f"w{i}", 10.0 * i + (500.0 if i >= 1500 else 0.0), 100.0, 8.0, 12.0) for i in range(3000)]
    columns = [(1, 2, 2 * r + k, f"{'lr'[k]}{r}", 10.0 + 300 * k, 20.0 * (r + 1), 50.0, 24.0 if r == 0 else 12.0) for r in range(200) for k in (0, 1)]
    out = layout.structure_ocr(spark.createDataFrame(row + columns, "doc_id long, page long, seq long, str string, x double, y double, w double, size double"))
    assert "Window" not in plan_of(out) and out.columns == ["doc_id", "page", "place", "row", "box", "text", "level"]
    got = [tuple(r) for r in out.orderBy("page", "place").collect()]
    signs = [w[3].replace("|", "•") for w in row]
    assert got[:2] == [(1, 1, 0, 0, 0, " ".join(signs[:1500]), 0), (1, 1, 1, 0, 1, " ".join(signs[1500:]), 0)]
    assert got[2:] == [(1, 2, r + 200 * k, r, k, f"{'lr'[k]}{r}", 1 if r == 0 else 0) for k in (0, 1) for r in range(200)]
