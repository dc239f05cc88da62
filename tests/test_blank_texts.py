"""Queries against their SQL on rows that the given tables don't have: empty, blank and odd texts, times with fractions, nulls."""

from __future__ import annotations

import os

import duckdb
import pytest
from oracle_check import TABLES, check, duck

from pagegrain.plans.registry import load_all

TEXTS = ["", "\n", "\n\n\n", "  ", " \n ", "\t\n \n\t", " " * 600, "x", "a\tb\nc\td, e\t\n \tf", "\u00a0", "a\n \nb, c", ", , \nq", " , ", "\u00e9", "a\r\nb", "\u3000\n\u2003z", "a|b", "<b>, </b>", "\U0001f600 x, y\nz"]
NAMES = [
    "txt9_integrity_score", "agg23_document_text", "snk2_corrected_markdown", "jn8_corrected_text", "md2_document_markdown", "md3_anchored_markdown", "md5_without_anchors", "md7_html_fragments", "txt2_given_encoding", "tab3_list_table",
]


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The smallest data with 211 further documents of every odd text, so that each rule on doc_id meets each text."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", f"{folder}/{t}.parquet")
    texts = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TEXTS))
    duckdb.connect().execute(f"""COPY (SELECT * FROM '{sf}/documents.parquet' UNION ALL BY NAME
 SELECT 1000000 + i * 211 + k AS doc_id, t AS text, 'en' AS lang, 'web' AS source, length(t) AS n_chars FROM (VALUES {texts}) v(i, t), range(0, 211) r(k)) TO '{folder}/documents.parquet' (FORMAT parquet)""")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql_on_odd_texts(spark, odd, name):
    assert check(spark, duck(odd), odd, name, load_all()[name])[0] is None


def test_json_repair_matches_sql_on_odd_times(spark, sf, tmp_path):
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (CASE WHEN l_partkey % 5 = 1 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
 CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN l_shipdate + INTERVAL 1234567 MICROSECOND WHEN 2 THEN l_shipdate - INTERVAL 40 YEAR - INTERVAL 1 MICROSECOND ELSE l_shipdate END AS l_shipdate)
 FROM '{sf}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    name = "jsn3_json_repair"
    assert check(spark, duck(str(tmp_path)), str(tmp_path), name, load_all()[name])[0] is None
