from itertools import product

import pytest

from folioflow.functions import table_functions
from folioflow.operators import manifest
from folioflow.sources import files


def test_html_tree_and_sitemap(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.html").write_text("<p>1</p>\n<p>2</p>")
    (tmp_path / "a/b/y.html").write_text("<p>3</p>")
    (tmp_path / "a/z.txt").write_text("no")
    rows = {r.path.rsplit("/", 1)[1]: r.html for r in files.scan_html_tree(spark, str(tmp_path / "a")).collect()}
    assert rows == {"x.html": "<p>1</p>\n<p>2</p>", "y.html": "<p>3</p>"}
    (tmp_path / "s.xml").write_text("<urlset><url><loc>u1</loc><lastmod>2024-01-01</lastmod></url><url><loc>u2</loc></url></urlset>")
    assert [tuple(r) for r in files.scan_sitemap(spark, str(tmp_path / "s.xml")).orderBy("loc").collect()] == [("u1", "2024-01-01"), ("u2", None)]


def test_parts_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "part_name string, page long")
    files.write_parts(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["part_name=a", "part_name=b"]
    files.write_log_csv(spark.createDataFrame([('"x",1',)], "line string").coalesce(1), ["t", "n"], str(tmp_path / "c"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*"))
    assert text == '﻿"t","n"\r\n"x",1\r\n'.encode()
    files.append_usage(spark.createDataFrame([(None, None)], "tool string, pages long"), str(tmp_path / "u"))
    files.append_usage(spark.createDataFrame([("split", 2)], "tool string, pages long"), str(tmp_path / "u"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [("", 0), ("split", 2)]


@pytest.mark.parametrize("spec,pages", [("1-3, 5", [1, 2, 3, 5]), ("3-1", [None]), ("11", [None])])
def test_expand_ranges_in_sql(spark, spec, pages):
    table_functions.register(spark)
    assert [r.page for r in spark.sql(f"SELECT * FROM expand_ranges('{spec}', 10, 'strict')").collect()] == pages


def test_table_function_and_columns_agree(spark):
    """Every text of up to four signs out of these, and longer ones, in all dialects."""
    table_functions.register(spark)
    signs = ["1", "3", "12", "-", ",", ";", " "]
    specs = {"".join(t) for n in range(5) for t in product(signs, repeat=n)} | {"99999999999", "12345678901-", "-99999999999", "00000000000002", "2 - 4, 3-1, x, 8-", "1,1,1"}
    df = spark.createDataFrame([(i, s, 10) for i, s in enumerate(sorted(specs))], "k long, spec string, total int")
    for dialect in manifest.DIALECTS:
        rows = manifest.expand_ranges(df, "k", dialect=dialect).collect()
        more = spark.sql("SELECT k, page, error FROM {df}, LATERAL expand_ranges(spec, total, '" + dialect + "')", df=df).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, more), key=str)
    empty = spark.createDataFrame([(None, 10), ("1", None)], "spec string, total int")
    assert spark.sql("SELECT page FROM {df}, LATERAL expand_ranges(spec, total, 'open')", df=empty).count() == 0
