"""Crawl audits, link graphs and bulk rewrites over a table of pages."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

# What of a page's head and links is read.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = r'(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"'
CANONICAL = r'(?is)<link[^>]+rel="canonical"[^>]+href="([^"]*)"'
ROBOTS = r'(?is)<meta[^>]+name="robots"[^>]+content="([^"]*)"'
H1 = r"(?i)<h1[\s>]"
IMAGE = r"(?i)<img\b[^>]*>"
ALT = r"(?i)\balt\s*="
HREF = r'(?i)<a\s[^>]*?href="([^"]*)"'
JSON_LD = r'(?is)<script type="application/ld\+json">(.*?)</script>'
FAQ = r'(?is)<div class="faq-question"[^>]*>(.*?)</div>\s*<div class="faq-answer"[^>]*>(.*?)</div>'
PRECONNECT = r'(?i)<link[^>]+rel="preconnect"[^>]+href="https?://([^/"]+)'
BASE = r"^(https?://[^/?#]+)"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_match(col: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(col, pattern, 1))


def page_head(pages: DataFrame) -> DataFrame:
    """Title, description, canonical address, robots rule, number of main headings and of images without an alt text."""
    h = F.col("html")
    images = F.regexp_extract_all(h, F.lit(IMAGE), F.lit(0))
    return pages.select(
        "page_id", "url", first_match(h, TITLE).alias("title"), first_match(h, DESCRIPTION).alias("description"), first_match(h, CANONICAL).alias("canonical"),
        first_match(h, ROBOTS).alias("robots"), F.regexp_count(h, F.lit(H1)).cast("long").alias("h1_count"),
        F.size(F.filter(images, lambda x: ~x.rlike(ALT))).cast("long").alias("no_alt"),
    )


def audit_pages(head: DataFrame) -> DataFrame:
    """One row for each rule that a page breaks."""
    rules = {
        "title": F.col("title").isNull(),
        "description": F.col("description").isNull(),
        "canonical": F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url")),
        "h1": F.col("h1_count") != 1,
        "noindex": F.coalesce(F.lower("robots").contains("noindex"), F.lit(False)),
        "alt": F.col("no_alt") > 0,
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]), lambda x: x.isNotNull())
    return head.select("page_id", F.explode(broken).alias("failure"))


def audit_schema(pages: DataFrame, is_article: Column, author: str) -> DataFrame:
    """One row for each JSON-LD rule that a page breaks: broken blocks, and on article pages one Article, one BreadcrumbList and an
    author whose address is the given one."""
    blocks = pages.select("page_id", is_article.alias("is_article"), F.regexp_extract_all("html", F.lit(JSON_LD), F.lit(1)).alias("blocks"))
    rows = blocks.select("page_id", "is_article", F.posexplode_outer("blocks").alias("block", "json")).withColumn("v", F.try_parse_json("json"))
    graph = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.when(F.col("v").isNotNull(), F.array("v")))
    nodes = rows.select("page_id", "is_article", "block", (F.col("json").isNotNull() & F.col("v").isNull()).alias("broken"), F.posexplode_outer(graph).alias("node", "n"))
    kind, url = F.try_variant_get("n", "$['@type']", "string"), F.try_variant_get("n", "$.author.url", "string")
    counts = nodes.groupBy("page_id", "is_article").agg(
        F.max("broken").alias("broken"), F.count_if(kind == "Article").alias("articles"), F.count_if(kind == "BreadcrumbList").alias("crumbs"),
        F.min(F.when(kind == "Article", F.struct("block", "node", url.alias("url")))).alias("first"),
    )
    rules = {
        "json-ld": F.col("broken"), "article": F.col("is_article") & (F.col("articles") != 1), "breadcrumb": F.col("is_article") & (F.col("crumbs") != 1),
        "author": F.col("is_article") & ~F.coalesce(F.col("first.url") == author, F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]), lambda x: x.isNotNull())
    return counts.select("page_id", F.explode(broken).alias("failure"))


def audit_sitemap(sitemap: DataFrame) -> DataFrame:
    """Addresses (loc) of a sitemap that stand in it several times."""
    return sitemap.groupBy("loc").agg(F.count("*").alias("n")).where("n > 1").select("loc", F.lit("duplicate").alias("failure"))


def audit_report(failures: DataFrame, pages: DataFrame) -> DataFrame:
    """One JSON row: pages, failures and the count of each failure."""
    n = pages.agg(F.count("*").alias("pages"))
    kinds = failures.groupBy("failure").agg(F.count("*").alias("n"))
    summary = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "failure", F.col("n").cast("string")))), ",").alias("kinds"))
    return n.join(F.broadcast(summary)).select(F.to_json(F.struct("pages", "failed", "kinds")).alias("report"))  # one row each


def without_dots(path: Column) -> Column:
    """A path that begins with / without its `.` and `..` parts; a path that ends in one ends in /."""
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")) - 1)
    joined = F.aggregate(
        parts, F.lit(""),
        lambda a, p: F.when(p == "..", F.regexp_replace(a, "/[^/]*$", "")).when(p == ".", a).otherwise(F.concat(a, F.lit("/"), p)),
    )
    return F.when(path.rlike(r"(?:^|/)\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)


def absolute(url: Column) -> Column:
    """An http address with its scheme and host in lower case, no default port, a path and no dot parts in it."""
    site = F.regexp_replace(F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)), r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.concat(site, without_dots(F.when(path == "", F.lit("/")).otherwise(path)), F.regexp_extract(url, r"^[^?#]*((?s:.*))$", 1))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute http target of a link on a page, resolved as a browser does; null for other schemes and empty links. A bare query or
    fragment belongs to the page itself."""
    site = F.regexp_extract(base, BASE, 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    asked = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)[^/?#]*", 1)
    root = F.when(F.length(folder) > F.length(site), folder).otherwise(F.concat(site, F.lit("/")))
    h = F.trim(href)
    whole = (
        F.when(h.rlike(r"(?i)^https?://[^/]"), h)
        .when(h.rlike(r"^//[^/]"), F.concat(F.regexp_extract(base, "^(https?:)", 1), h))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (h == "") | (site == ""), F.lit(None))
        .when(h.startswith("#"), F.concat(asked, h))
        .when(h.startswith("?"), F.concat(page, h))
        .when(h.startswith("/"), F.concat(site, h))
        .otherwise(F.concat(root, h))
    )
    return absolute(whole)


def extract_links(pages: DataFrame) -> DataFrame:
    """Every link of every page with its absolute target, in order."""
    links = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("at", "href"))
    return links.select("page_id", F.col("at").cast("long").alias("at"), "href", resolve_link(F.col("url"), F.col("href")).alias("target")).where("target is not null")


def inbound_links(links: DataFrame, known: DataFrame, site_of: str = "site") -> DataFrame:
    """Links into each known (site, path), 0 kept: the targets are counted before they are joined."""
    target = links.select(F.regexp_extract("target", BASE, 1).alias("site"), F.regexp_extract("target", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    counts = target.groupBy("site", "path").agg(F.count("*").alias("n"))
    return known.join(counts, ["site", "path"], "left").select(*known.columns, F.coalesce("n", F.lit(0)).alias("inbound"))


def known_pages(pages: DataFrame) -> DataFrame:
    """The different (site, path) of the addresses of pages; an address without a path is /, one that is no http address is left out."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return pages.select(F.regexp_extract("url", BASE, 1).alias("site"), F.when(path == "", "/").otherwise(path).alias("path")).where("site <> ''").distinct()


def link_audit(links: DataFrame, known: DataFrame) -> DataFrame:
    """Inbound links of each known page, whether it is an orphan, and the fewest that a page of its site has, which are counted a site first."""
    counted = inbound_links(links, known)
    least = counted.groupBy(F.col("site").alias("least_of")).agg(F.min("inbound").alias("site_least"))
    return counted.join(least, F.col("site") == F.col("least_of")).drop("least_of").withColumn("orphan", F.col("inbound") == 0)


def explode_jsonld(pages: DataFrame) -> DataFrame:
    """Each JSON-LD node with its type: the members of @graph, or the single object; broken JSON gives an error row."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(JSON_LD), F.lit(1))).alias("block", "json"))
    parsed = blocks.withColumn("v", F.try_parse_json("json"))
    graph = F.try_variant_get("v", "$['@graph']", "array<variant>")
    nodes = F.when(F.col("v").isNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.coalesce(graph, F.array("v")))
    out = parsed.select("page_id", F.col("block").cast("long").alias("block"), F.posexplode(nodes).alias("node", "n"))
    return out.select("page_id", "block", F.col("node").cast("long").alias("node"), F.try_variant_get("n", "$['@type']", "string").alias("type"), F.col("n").isNull().alias("invalid"))


def extract_faqs(pages: DataFrame) -> DataFrame:
    """Visible question and answer pairs as plain text, in order; pairs with an empty side go."""
    q, a = (F.regexp_extract_all("html", F.lit(FAQ), F.lit(i)) for i in (1, 2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(q.alias("q"), a.alias("a"))).alias("at", "qa"))
    rows = rows.select("page_id", F.col("at").cast("long").alias("at"), T.html_to_text(F.col("qa.q")).alias("question"), T.html_to_text(F.col("qa.a")).alias("answer"))
    return rows.where("question <> '' and answer <> ''")


def faq_schema(faqs: DataFrame) -> DataFrame:
    """One FAQPage JSON text for each page."""
    pair = F.struct("at", F.col("question").alias("name"), F.col("answer").alias("text"))
    many = faqs.groupBy("page_id").agg(F.array_sort(F.collect_list(pair)).alias("qa"))
    entity = F.transform(
        "qa",
        lambda x: F.struct(
            F.lit("Question").alias("@type"), x["name"].alias("name"), F.struct(F.lit("Answer").alias("@type"), x["text"].alias("text")).alias("acceptedAnswer")
        ),
    )
    return many.select("page_id", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), entity.alias("mainEntity"))).alias("schema"))


def sync_faq_schema(pages: DataFrame) -> DataFrame:
    """Pages with visible FAQs and an FAQPage block: the first block is written anew from the FAQs and later ones go;
    `changed` tells whether the page differs. A second run changes nothing."""
    block = r'(?is)<script type="application/ld\+json">(?:(?!</script>).)*?"FAQPage".*?</script>\s*'
    made = faq_schema(extract_faqs(pages))
    mark = "\x00faq\x00"
    fresh = F.concat(F.lit('<script type="application/ld+json">'), F.col("schema"), F.lit("</script>"))
    marked = F.regexp_replace("html", block, mark)
    rest = F.replace(F.expr("substring(m, at + 5)"), F.lit(mark), F.lit(""))
    out = pages.join(made, "page_id", "left").withColumn("m", marked).withColumn("at", F.locate(mark, F.col("m")))
    new = F.when((F.col("at") > 0) & F.col("schema").isNotNull(), F.concat(F.expr("substring(m, 1, at - 1)"), fresh, rest)).otherwise(F.col("html"))
    return out.select("page_id", new.alias("html"), (new != F.col("html")).alias("changed"))


def fill_head_tags(head: DataFrame) -> DataFrame:
    """Tags to add to each titled page: canonical and Open Graph ones where they are absent; the description falls back to the
    title."""
    desc = F.coalesce("description", "title")
    tags = F.array(
        F.when(F.col("canonical").isNull(), F.concat(F.lit('<link rel="canonical" href="'), F.col("url"), F.lit('">'))),
        F.when(~F.col("has_og"), F.concat(F.lit('<meta property="og:title" content="'), F.col("title"), F.lit('">'))),
        F.when(~F.col("has_og"), F.concat(F.lit('<meta property="og:description" content="'), desc, F.lit('">'))),
        F.when(~F.col("has_twitter"), F.lit('<meta name="twitter:card" content="summary">')),
    )
    return head.where("title is not null").select("page_id", F.array_join(F.filter(tags, lambda x: x.isNotNull()), "\n").alias("added"))


def _after(html: Column, anchor: Column, added: Column) -> Column:
    """html with a text put after the first place of an anchor text."""
    end = F.instr(html, anchor) + F.length(anchor) - 1
    return F.concat(F.substring(html, F.lit(1), end), added, F.substring(html, end + 1, F.length(html)))


def fill_head(pages: DataFrame, site_name: str, image: str, is_article: Column) -> DataFrame:
    """Pages with the head tags that they lack: a canonical address after the description or title, and after that alternate languages and the
    Open Graph and Twitter tags. The description falls back to the title; pages without a title stay. The flags tell what was
    added."""
    h, esc = F.col("html"), lambda c: F.replace(c, F.lit('"'), F.lit("&quot;"))
    title, described = F.regexp_extract(h, r"(?is)<title>.*?</title>", 0), F.regexp_extract(h, r"""(?is)<meta\s+name=["']description["'].*?>""", 0)
    rows = pages.select(
        "page_id", "url", "html", is_article.alias("is_article"), F.trim(F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(h, r"""(?is)<meta\s+name=["']description["']\s+content=["'](.*?)["']\s*/?>""", 1).alias("description"),
        F.when(described != "", described).otherwise(title).alias("anchor"), (~h.rlike(r"""(?i)rel=["']canonical["']""")).alias("canonical_added"),
        (~h.rlike("(?i)hreflang=")).alias("hreflang_added"), (~h.rlike(r"""(?i)property=["']og:""")).alias("og_added"),
    )
    known = F.col("title") != ""
    rows = rows.withColumns({c: known & F.col(c) for c in ("canonical_added", "hreflang_added", "og_added")})
    canonical = F.concat(F.lit('\n<link rel="canonical" href="'), F.col("url"), F.lit('">'))
    rows = rows.withColumn("new", F.when(F.col("canonical_added"), _after(F.col("html"), F.col("anchor"), canonical)).otherwise(F.col("html")))
    line = F.regexp_extract("new", r"""(?i)<link\s+rel=["']canonical["'][^>]*>""", 0)
    rows = rows.withColumn("anchor", F.when(line != "", line).otherwise(F.col("anchor")))
    languages = F.concat(*[F.concat(F.lit(f'\n<link rel="alternate" hreflang="{lang}" href="'), F.col("url"), F.lit('">')) for lang in ("en", "x-default")])
    shown = esc(F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")))
    kind = F.when(F.col("is_article"), "article").otherwise("website")
    graph = [("og:type", kind), ("og:site_name", F.lit(site_name)), ("og:url", F.col("url")), ("og:title", esc(F.col("title"))), ("og:description", shown), ("og:image", F.lit(image))]
    cards = [("twitter:card", F.lit("summary_large_image")), ("twitter:title", esc(F.col("title"))), ("twitter:description", shown), ("twitter:image", F.lit(image))]
    tags = [F.concat(F.lit(f'\n<meta property="{n}" content="'), v, F.lit('">')) for n, v in graph] + [F.concat(F.lit(f'\n<meta name="{n}" content="'), v, F.lit('">')) for n, v in cards]
    added = F.concat(F.when(F.col("hreflang_added"), languages).otherwise(""), F.when(F.col("og_added"), F.concat(*tags)).otherwise(""))
    new = F.when(known & (added != ""), _after(F.col("new"), F.col("anchor"), added)).otherwise(F.col("new"))
    return rows.select("page_id", new.alias("html"), "canonical_added", "hreflang_added", "og_added", (~known).alias("no_title"))


def head_report(filled: DataFrame) -> DataFrame:
    """How many pages got what."""
    flags = ("canonical_added", "hreflang_added", "og_added", "no_title")
    return filled.agg(F.count("*").alias("pages"), *[F.count_if(F.col(c)).alias(c) for c in flags])


def stamp_assets(pages: DataFrame, version: str) -> DataFrame:
    """Local style sheet and script references get ?v=version; external ones stay; the references are counted."""
    ref = r'((?:href|src)="/?[A-Za-z0-9_][A-Za-z0-9_./-]*\.(?:css|js))(?:\?v=[^"]*)?"'
    return pages.select(
        "page_id", F.regexp_replace("html", ref, f'$1?v={version}"').alias("html"), F.regexp_count("html", F.lit(ref)).cast("long").alias("stamped")
    )


def strip_retired(pages: DataFrame, ids: list[str]) -> DataFrame:
    """Links to retired ids go, and `removed` counts them; blank lines that are left become one."""
    link = rf'<li><a href="/(?:{"|".join(ids)})">[^<]*</a></li>'
    clean = F.regexp_replace(F.regexp_replace("html", link, ""), r"\n{3,}", "\n\n")
    return pages.select("page_id", clean.alias("html"), F.regexp_count("html", F.lit(link)).cast("long").alias("removed"))


def drop_retired_lines(files: DataFrame, text: str, ids: list[str]) -> DataFrame:
    """A text (a sitemap or list) without the lines that name a retired id's page."""
    named = F.lit(False)
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~functools.reduce(lambda a, i: a | x.contains(f"/{i}.html"), ids, named))
    clean = F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
    return files.withColumns({text: clean, "dropped": (F.size(lines) - F.size(kept)).cast("long")})


def retired_redirects(retired: DataFrame, target: str) -> DataFrame:
    """A permanent redirect row of each retired id."""
    return retired.select(F.concat(F.lit("/tools/"), F.col("id"), F.lit(".html")).alias("source"), F.lit(target).alias("target"), F.lit(301).alias("status"))


def touch_sitemap(sitemap: DataFrame, changed: DataFrame, date: str) -> DataFrame:
    """lastmod becomes the date for changed addresses."""
    hit = changed.select("loc").distinct().withColumn("hit", F.lit(True))
    return sitemap.join(hit, "loc", "left").select("loc", F.when(F.col("hit"), F.lit(date)).otherwise(F.col("lastmod")).alias("lastmod"))


def move_block(pages: DataFrame, block: str, anchor: str) -> DataFrame:
    """The first block (a pattern) moves to just before the first anchor (plain text), unless it stands there already."""
    out = pages.withColumn("block", F.regexp_extract("html", f"({block})", 1)).withColumn("from", F.expr("locate(block, html)"))
    cut = F.expr("concat(substring(html, 1, from - 1), substring(html, from + length(block)))")
    out = out.withColumn("without", F.when(F.col("block") != "", cut).otherwise(F.col("html"))).withColumn("at", F.locate(anchor, F.col("without")))
    moved = F.expr("concat(substring(without, 1, at - 1), block, substring(without, at))")
    new = F.when((F.col("block") != "") & (F.col("at") > 0), moved).otherwise(F.col("html"))
    return out.select("page_id", new.alias("html"), (new != F.col("html")).alias("moved"))


def defer_scripts(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """Scripts of the listed hosts get `defer` unless they have async, defer or type=module."""
    c = F.col("html")
    for host in hosts:
        c = F.regexp_replace(c, rf'<script((?:(?!async|defer|module)[^>])*?src="https://{host}/(?:(?!async|defer|module)[^>])*)>', "<script defer$1>")
    return pages.select("page_id", c.alias("html"), (c != F.col("html")).alias("changed"))


def unused_hints(pages: DataFrame) -> DataFrame:
    """Preconnect hosts that nothing else in the page refers to."""
    hints = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(PRECONNECT), F.lit(1))).alias("host")).distinct()
    used = pages.select("page_id", F.explode(F.regexp_extract_all(F.regexp_replace("html", r'(?i)<link[^>]+rel="preconnect"[^>]*>', ""), F.lit(r"https?://([^/\"'?#\s<]+)"), F.lit(1))).alias("host"))
    return hints.join(used.distinct(), ["page_id", "host"], "left_anti")


# Fixed value: the heading and paragraph of the Related region.
RELATED = r"<h2>Related Tools</h2>\s*<p>([\s\S]*?)</p>"


def related_links(pages: DataFrame, icons: DataFrame, default: str) -> DataFrame:
    """Links of a page's first Related region, the paragraph under its heading: the file's name without folders and ending, the label, and the name's
    icon or the default one."""
    region = F.regexp_extract("html", RELATED, 1)
    pair = F.lit(r'(?s)<a\s+href="([^"]+)"[^>]*>(.*?)</a>')
    links = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(region, pair, F.lit(1)).alias("href"), F.regexp_extract_all(region, pair, F.lit(2)).alias("label"))).alias("at", "x"))
    slug = F.regexp_replace(F.regexp_replace("x.href", r"^.*/", ""), r"\.html$", "")
    links = links.select("page_id", F.col("at").cast("long").alias("at"), slug.alias("slug"), F.regexp_replace("x.label", r"^\s+|\s+$", "").alias("label"))
    return links.join(icons, "slug", "left").select("page_id", "at", "slug", "label", F.coalesce("icon", F.lit(default)).alias("icon"))


def normalize_article(pages: DataFrame, publisher: str) -> DataFrame:
    """A canonical Article node for each titled page, as JSON."""
    node = F.struct(
        F.lit("Article").alias("@type"), F.concat("url", F.lit("#article")).alias("@id"), F.col("url"), F.col("title").alias("headline"),
        F.struct(F.lit("Organization").alias("@type"), F.lit(publisher).alias("name")).alias("publisher"), F.substring("modified", 1, 10).alias("dateModified"),
    )
    return pages.where("title is not null").select("page_id", F.to_json(node).alias("article"))


def rewrite_articles(pages: DataFrame, name: str, site: str) -> DataFrame:
    """Pages (page_id, url, html) whose first JSON-LD block of an Article is written anew as a graph of the canonical article, with author,
    publisher and the date part of its modified_time, and a breadcrumb list; later blocks of articles go. Pages without one stay."""
    block = r'(?is)<script type="application/ld\+json">.*?</script>'
    arts = F.filter(F.regexp_extract_all("html", F.lit(block), F.lit(0)), lambda b: b.rlike(r'"@type"\s*:\s*"Article"'))
    rows = pages.withColumn("arts", arts).withColumn("first", F.get("arts", F.lit(0)))
    inner = F.regexp_extract("first", JSON_LD, 1)
    headline = F.coalesce(F.get_json_object(inner, "$.headline"), F.get_json_object(inner, "$['@graph'][0].headline"))
    modified = F.nullif(F.substring(F.regexp_extract("html", r'(?i)<meta\s+property="article:modified_time"\s+content="([^"]+)"', 1), 1, 10), F.lit(""))
    item = lambda i, label, at: F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"), label.alias("name"), at.alias("item"))
    org = lambda *more: F.struct(F.lit("Organization").alias("@type"), *more)
    article = F.struct(
        F.lit("Article").alias("@type"), F.concat("url", F.lit("#article")).alias("@id"), F.col("url"), headline.alias("headline"),
        org(F.lit(f"{name} Editorial Team").alias("name"), F.lit(f"{site}/about.html").alias("url")).alias("author"), org(F.lit(name).alias("name"), F.lit(site).alias("url")).alias("publisher"),
        F.lit("en").alias("inLanguage"), modified.alias("dateModified"),
    )
    crumbs = F.struct(
        F.lit("BreadcrumbList").alias("@type"), F.concat("url", F.lit("#breadcrumb")).alias("@id"),
        F.array(item(1, F.lit("Home"), F.lit(f"{site}/")), item(2, F.lit("Blog"), F.lit(f"{site}/blog/index.html")), item(3, headline, F.col("url"))).alias("itemListElement"),
    )
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.to_json(article), F.lit(","), F.to_json(crumbs), F.lit("]}"))
    fresh = F.concat(F.lit('<script type="application/ld+json">'), graph, F.lit("</script>"))
    at = F.instr("html", F.col("first"))
    before, after = F.substring("html", F.lit(1), at - 1), F.substring("html", at + F.length("first"), F.length("html"))
    rest = F.aggregate(F.slice("arts", 2, F.greatest(F.size("arts") - 1, F.lit(1))), after, lambda a, b: F.replace(a, b, F.lit("")))
    new = F.when(F.size("arts") > 0, F.concat(before, fresh, rest)).otherwise(F.col("html"))
    return rows.select("page_id", new.alias("html"), (F.size("arts") > 0).alias("changed"))


def replace_section(pages: DataFrame, rendered: DataFrame, section: str) -> DataFrame:
    """Pages (page_id, tool, html) whose first part that the pattern finds becomes the tool's rendered text; pages without such a part or a
    tool without a text are skipped and stay."""
    rows = pages.join(rendered.select("tool", F.col("html").alias("made")), "tool", "left").withColumn("old", F.regexp_extract("html", section, 0))
    good = (F.col("old") != "") & F.col("made").isNotNull()
    at = F.instr("html", F.col("old"))
    new = F.concat(F.substring("html", F.lit(1), at - 1), F.col("made"), F.substring("html", at + F.length("old"), F.length("html")))
    return rows.select("page_id", F.when(good, new).otherwise(F.col("html")).alias("html"), F.when(good, "updated").otherwise("skipped").alias("state"))


def update_schema(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages whose first FAQPage block has the new answers (question, answer) in it; `changed` counts them. Pages without such a block stay."""
    kind = "struct<`@context`:string,`@type`:string,mainEntity:array<struct<`@type`:string,name:string,acceptedAnswer:struct<`@type`:string,text:string>>>>"
    block = F.filter(F.regexp_extract_all("html", F.lit(JSON_LD), F.lit(1)), lambda b: b.contains('"FAQPage"'))
    rows = pages.select("page_id", "html", F.get(block, F.lit(0)).alias("json")).withColumn("faq", F.from_json("json", kind))
    asked = rows.select("page_id", F.posexplode("faq.mainEntity").alias("at", "e")).join(answers.select(F.col("question").alias("q"), F.col("answer").alias("new_answer")), F.col("e.name") == F.col("q"), "left")
    text = F.struct(F.lit("Answer").alias("@type"), F.coalesce("new_answer", "e.acceptedAnswer.text").alias("text"))
    entity = F.struct("at", F.struct(F.lit("Question").alias("@type"), F.col("e.name").alias("name"), text.alias("acceptedAnswer")).alias("e"))
    made = asked.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(entity)), lambda x: x["e"]).alias("entities"), F.count("new_answer").alias("changed"))
    fresh = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.col("entities").alias("mainEntity")))
    out = rows.join(made, "page_id", "left")
    new = F.when(F.coalesce("changed", F.lit(0)) > 0, F.replace(F.col("html"), F.col("json"), fresh)).otherwise(F.col("html"))
    return out.select("page_id", new.alias("html"), F.coalesce("changed", F.lit(0)).alias("changed"))


def render_faq(tools: DataFrame, base: DataFrame, special: DataFrame) -> DataFrame:
    """One FAQ block a tool: base questions, its own, joined in order; `base` is a handful of template rows."""
    rows = tools.join(F.broadcast(base)).select("tool", "ord", F.replace(F.col("q"), F.lit("{tool}"), F.col("tool")).alias("q"), F.replace(F.col("a"), F.lit("{tool}"), F.col("tool")).alias("a"))
    rows = rows.unionByName(special.join(tools, "tool", "left_semi").select("tool", "ord", "q", "a"))
    line = F.struct("ord", F.concat(F.lit("<dt>"), F.col("q"), F.lit("</dt><dd>"), F.col("a"), F.lit("</dd>")).alias("h"))
    return rows.groupBy("tool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["h"]), "\n").alias("html"))


def update_answers(faqs: DataFrame, answers: DataFrame) -> DataFrame:
    """New answers by question; answers whose question no page has come back as errors."""
    new = answers.select("question", F.col("answer").alias("new_answer"))
    done = faqs.join(new, "question", "left").select("page_id", "at", "question", F.coalesce("new_answer", "answer").alias("answer"), F.lit(None).cast("string").alias("error"))
    lost = new.join(faqs.select("question"), "question", "left_anti").select(
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("long").alias("at"), "question", F.col("new_answer").alias("answer"), F.lit("missing").alias("error")
    )
    return done.unionByName(lost)


def _first_rule(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) with the first rule (ord, destination, status) that matches, as `hit`, or null. A path meets the exact rules and the prefix
    rules by equality, of itself or of its beginnings that are as long as some prefix, so that no address is compared with all rules."""
    small = rules.select(F.col("ord"), F.col("host").alias("r_host"), "pattern", "kind", "destination", F.col("status").alias("r_status"))
    lengths = sorted(r["n"] for r in rules.where("kind = 'prefix'").select(F.length("pattern").alias("n")).distinct().collect())  # a number a length
    starts = F.filter(F.array(F.lit(0), *[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    tried = F.transform(starts, lambda n: F.struct(F.when(n == 0, "exact").otherwise("prefix").alias("kind"), F.when(n == 0, F.col("path")).otherwise(F.substring(F.col("path"), F.lit(1), n)).alias("pattern")))
    rows = addresses.select("host", "path", F.explode(tried).alias("t")).select("host", "path", "t.kind", "t.pattern")
    met = rows.join(small, ["kind", "pattern"]).where(F.col("r_host").isNull() | (F.col("r_host") == F.col("host")))
    best = met.groupBy("host", "path").agg(F.min(F.struct("ord", "destination", F.col("r_status").alias("status"))).alias("hit"))
    b = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "hit")
    return addresses.join(b, F.col("host").eqNullSafe(F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select("host", "path", "hit")


def resolve_redirects(urls: DataFrame, rules: DataFrame, checkpointed) -> DataFrame:
    """Follow (key, host, path) through ordered rules (ord, host, pattern, kind exact or prefix, destination, status) until none matches or one has the
    status 410: key, the last path, the number of rules and the last status (200 without any). An address that runs into a circle stays where it is, with
    the status 508 and no number.

    After one step an address stands at some rule's destination. Where these lead is a graph of destinations and the hosts that rules name (all
    others are alike), whose ways double with each round, so that chains of any length end in a logarithm of rounds, and the addresses meet the rules
    once. The graph is as large as the rules allow, whatever the number of addresses."""
    named = rules.where("host is not null").select(F.col("host").alias("named")).distinct()
    ends = rules.select(F.col("destination").alias("path")).distinct()
    hosts = sorted(r["named"] for r in named.collect())  # configuration
    nodes = ends.select(F.explode(F.array(F.lit(None).cast("string"), *[F.lit(h) for h in hosts])).alias("host"), "path")

    def step(rows: DataFrame) -> DataFrame:
        on = F.col("hit").isNotNull() & (F.col("hit.status") != 410)
        return _first_rule(rows, rules).select(
            "host", "path", F.when(on, F.col("hit.destination")).alias("at"), F.col("hit").isNotNull().cast("int").alias("steps"), F.when(~on, F.col("path")).alias("end"), F.col("hit.status").alias("status")
        )

    def ahead(rows: DataFrame, graph: DataFrame, host: Column) -> DataFrame:
        g = graph.select(F.col("host").alias("g_host"), F.col("path").alias("g_path"), F.col("at").alias("g_at"), F.col("steps").alias("g_steps"), F.col("end").alias("g_end"), F.col("status").alias("g_status"))
        moved = F.col("at").isNotNull()
        return rows.join(g, host.eqNullSafe(g["g_host"]) & (rows["at"] == g["g_path"]), "left").select(
            *[c for c in rows.columns if c not in ("at", "steps", "end", "status")], F.col("g_at").alias("at"), (F.col("steps") + F.coalesce("g_steps", F.lit(0))).alias("steps"),
            F.when(moved, F.col("g_end")).otherwise(F.col("end")).alias("end"), F.coalesce("g_status", "status").alias("status"),
        )

    graph = checkpointed(step(nodes))
    for _ in range(graph.count().bit_length() + 1):
        if not graph.where("at is not null").take(1):
            break
        graph = checkpointed(ahead(graph, graph, F.col("host")))
    first = step(urls.select("host", "path").distinct())
    known = F.when(F.col("host").isin(hosts), F.col("host")) if hosts else F.lit(None).cast("string")
    told = ahead(first, graph, known).select(F.col("host").alias("t_host"), F.col("path").alias("t_path"), "at", "steps", "end", "status")
    out = urls.join(told, F.col("host").eqNullSafe(F.col("t_host")) & (F.col("path") == F.col("t_path")))
    circle = F.col("end").isNull()
    return out.select("key", F.coalesce("end", "path").alias("path"), F.when(~circle, F.col("steps")).alias("steps"), F.when(circle, 508).otherwise(F.coalesce("status", F.lit(200))).alias("status"))


def match_headers(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """All header rules (pattern, name, value) whose pattern matches the path; the rules are a small configuration table."""
    return urls.join(F.broadcast(rules), F.expr("path rlike pattern")).select("key", "name", "value")


def resolve_assets(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets by normalised lower-case path, else by file name (first registered); external references give null."""
    norm = F.lower(T.normalize_path(F.col("ref")))
    by_path = assets.select(F.lower(T.normalize_path(F.col("path"))).alias("p"), F.col("asset_id").alias("by_path")).groupBy("p").agg(F.min("by_path").alias("by_path"))
    name = F.element_at(F.split(F.lower("path"), "/"), -1)
    by_name = assets.groupBy(name.alias("b")).agg(F.min("asset_id").alias("by_name"))
    rows = refs.withColumn("p", F.when(F.col("ref").rlike("(?i)^(https?:|data:|//)"), None).otherwise(norm)).withColumn("b", F.element_at(F.split("p", "/"), -1))
    return rows.join(by_path, "p", "left").join(by_name, "b", "left").select(*refs.columns, F.coalesce("by_path", "by_name").alias("asset_id"))


def reachable(edges: DataFrame, roots: DataFrame, dead: DataFrame, checkpointed) -> DataFrame:
    """Nodes reached from the roots without passing a dead node; each round goes one edge further and is checkpointed, until
    none is new."""
    live = edges.join(dead.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    seen = checkpointed(roots.join(dead, "node", "left_anti").select("node").distinct())
    front = seen
    while True:
        front = checkpointed(live.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not front.take(1):
            break
        seen = checkpointed(seen.union(front))
    return seen
