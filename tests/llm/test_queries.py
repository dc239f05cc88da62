"""Every query of the package that SQL can state, and whole results of the others."""

from __future__ import annotations

import pytest

from pagegrain.llm.queries import QUERIES, SQL


def rows(cols, values):
    return sorted((tuple(None if v != v else v for v in r) for r in values), key=repr), cols


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(names, map(tuple, got.select(*names).collect())) == rows(names, want.fetchall())


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_package_is_optional():
    import subprocess
    import sys
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('pagegrain.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q, s = e.queries(), e.oracle_sql()\n"
            "assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in [*q, *s])")
    import os
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
