"""SQL that says what some of the training-data queries compute, by brute force over whole tables."""

from __future__ import annotations

from folioflow.llm import mixing, warc
from folioflow.llm.common import GAP

PASSES = 12  # more than the mix of the given tables takes; each is as the one before
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mix_sql() -> str:
    """Targets by running sums over sources in order of size / weight, then passes over the rows not taken yet that fit what is
    open, in order of their draw, equal rows one by one."""
    weights = ", ".join(f"{w}.0" for w in mixing.WEIGHTS)
    n = len(mixing.WEIGHTS)
    passes = []
    for k in range(1, PASSES + 1):
        before = "c0" if k == 1 else f"p{k - 1}"
        passes.append(
            f"""n{k} AS (SELECT source, any_value(need0) - coalesce(sum(size) FILTER (WHERE taken), 0) AS need FROM {before} GROUP BY source),
      e{k} AS (SELECT b.*, n.need, NOT taken AND size > 0 AND size <= n.need AND n.need >= 1 AND n.need >= {mixing.CLOSE}::DOUBLE * target AS fits FROM {before} b JOIN n{k} n ON b.source IS NOT DISTINCT FROM n.source),
      s{k} AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY draw, rid ROWS UNBOUNDED PRECEDING) AS upto FROM e{k}),
      p{k} AS MATERIALIZED (SELECT * EXCLUDE (need, fits, upto, taken), taken OR (fits AND upto <= need) AS taken FROM s{k})"""
        )
    return f"""WITH i AS (SELECT doc_id, source, row_number() OVER () AS rid, ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS draw,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
      z AS (SELECT source, sum(size)::BIGINT AS source_size FROM i GROUP BY source),
      w AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1)::INTEGER]::DOUBLE AS weight, (source_size * {mixing.MOST})::DOUBLE AS cap FROM z),
      q AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * {mixing.SHARE}::DOUBLE AS budget, sum(weight) OVER () AS w_all FROM w),
      a AS (SELECT *, sum(cap) OVER o - cap AS cap_before, sum(weight) OVER o - weight AS w_before FROM q WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
      l AS (SELECT *, (budget - cap_before) / (w_all - w_before) AS level FROM a),
      c AS (SELECT arg_min(level, ratio) AS cut FROM l WHERE level < ratio),
      t AS (SELECT source, source_size, CASE WHEN level < ratio THEN weight * cut ELSE cap END AS target FROM l, c),
      h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
      c0 AS (SELECT i.*, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS need0, false AS taken FROM i JOIN h ON i.source IS NOT DISTINCT FROM h.source),
      {', '.join(passes)}
      SELECT doc_id, size, source_size, target, (whole + CASE WHEN taken THEN 1 ELSE 0 END) * size AS taken FROM p{PASSES}"""


def jaccard_sql(k: int = 3, percent: int = 90) -> str:
    grams = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{GAP}'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: {grams}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
      r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
      SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.y AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id"""


def fixity_sql() -> str:
    """Every record is compared with every record of the replica at its place."""

    def index(body: str, name: str) -> str:
        record = f"""'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:md5:' || md5(coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')) || '>' || nl || 'WARC-Date: {warc.DATE}' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'Content-Length: ' || strlen({body}) || nl || nl || {body} || nl || nl"""
        return f"""{name}0 AS (SELECT page_id, url, floor(page_id / {warc.RECORDS_PER_FILE})::BIGINT AS file_id, strlen({record})::BIGINT AS size, sha256({record}) AS digest FROM b),
      {name} AS (SELECT *, (sum(size) OVER (PARTITION BY file_id ORDER BY page_id, url, digest ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM {name}0)"""

    return f"""WITH b AS (SELECT *, chr(13) || chr(10) AS nl, coalesce(html, '') AS body, CASE WHEN (page_id * 7919 + 13) % 53 = 7 AND starts_with(html, '<') THEN '#' || substr(html, 2) ELSE coalesce(html, '') END AS other FROM pages),
      {index('body', 'x')}, {index('other', 'y')},
      k AS (SELECT * FROM y WHERE (page_id * 7919 + 13) % 97 <> 5)
      SELECT coalesce(x.file_id, k.file_id) AS file_id, coalesce(x.page_id, k.page_id) AS page_id, coalesce(x.start, k.start) AS start, x.size AS expected_size, k.size AS found_size, x.digest AS expected, k.digest AS found,
        CASE WHEN k.digest IS NULL THEN 'missing' WHEN x.digest IS NULL THEN 'extra' ELSE 'changed' END AS status
      FROM x FULL JOIN k ON x.file_id = k.file_id AND x.start = k.start WHERE x.digest IS DISTINCT FROM k.digest"""


# Text of SQL: the crc32 of each byte value, and that of the bytes of a text.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    data = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


def spelling_sql(letters: int = 5, count: int = 3, times: int = 2) -> str:
    """All words with one code point left out meet the words, and each other at the same place."""
    return f"""WITH RECURSIVE {CRC_TABLE},
      o AS (SELECT doc_id, translate(w, '{UPPER}', '{UPPER.lower()}') AS w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
      h AS (SELECT w, k, CASE WHEN doc_id IS NOT NULL THEN {crc_sql("(doc_id::VARCHAR || ':' || w)")} END AS h FROM o, crc),
      e AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM h),
      v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM e WHERE length(word) >= {letters} GROUP BY 1 HAVING sum(k) >= {count}),
      d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
      p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.i = y.i AND x.less = y.less AND x.word <> y.word
            UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
      f AS (SELECT p.a, count(*) AS n_near, arg_min(v.word, (-v.n, v.word)) AS b, max(v.n) AS bn FROM p JOIN v ON p.b = v.word GROUP BY 1),
      w AS MATERIALIZED (SELECT v.word, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= {times} * v.n THEN b END AS form, CASE WHEN bn >= {times} * v.n THEN bn END AS form_n FROM v LEFT JOIN f ON f.a = v.word),
      r(word, up) AS (SELECT word, word FROM w UNION ALL SELECT r.word, w.form FROM r JOIN w ON w.word = r.up WHERE w.form IS NOT NULL)
      SELECT w.word, w.form, e.up AS root, w.n, w.n_near, w.form_n FROM w JOIN (SELECT r.word, r.up FROM r JOIN w ON w.word = r.up WHERE w.form IS NULL) e ON e.word = w.word"""


def periodic_sql(length: int = 6, power: int = 4) -> str:
    """Stretches of places whose word is that of q places on, of every q; those with a smaller period go."""
    return f"""WITH {CRC_TABLE},
      d0 AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '') AS w, {crc_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
      d1 AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0),
      d AS MATERIALIZED (SELECT k, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END + 1]) END AS w FROM d1),
      t AS MATERIALIZED (SELECT k, unnest(w) AS x, unnest(range(0, len(w))) AS i, len(w) AS n FROM d),
      m AS (SELECT a.k, a.i, b.i - a.i AS q FROM t a JOIN t b ON a.k = b.k AND a.x = b.x AND b.i > a.i AND {power} * (b.i - a.i) <= a.n),
      s AS (SELECT k, q, min(i) AS s, count(*) + q AS l FROM (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM m) GROUP BY k, q, g HAVING count(*) + q >= greatest({length}, {power} * q)),
      r AS MATERIALIZED (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.k = x.k AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
      g AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS told, arg_min(struct_pack(s := s, l := l, q := q), (-l, s, q)) AS best FROM r GROUP BY k),
      c AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS told FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = t.k AND t.i >= r.s + r.q AND t.i < r.s + r.l) GROUP BY k)
      SELECT d.doc_id, coalesce(g.n_runs, 0)::BIGINT AS n_runs, g.best.s::BIGINT AS start, g.best.l::BIGINT AS length, g.best.q::BIGINT AS period, (1000 * g.best.l // g.best.q)::BIGINT AS exponent_milli,
        sha256(coalesce(g.told, '')) AS runs_sha256, sha256(coalesce(c.told, '')) AS collapsed_sha256 FROM d LEFT JOIN g USING (k) LEFT JOIN c USING (k)"""


ORACLES = {"op2_mixing": mix_sql(), "op7_ngram_join": jaccard_sql(), "op9_fixity": fixity_sql(), "op11_spelling": spelling_sql(), "op12_periodic": periodic_sql()}
