from __future__ import annotations

import duckdb
import pytest

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names could clash."""
    def make(rows, extra=True):
        schema = "doc_id long, text string" + (", lang string, source string, n_chars long, found string, bucket int, key string, n long" if extra else "")
        return spark.createDataFrame([(*r, *(["en", "s", len(r[1] or ""), "x", 1, "k", 5] if extra else [])) for r in rows], schema)
    return make


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def texts(con):
    """doc_id -> text of the smallest documents table."""
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


#: Texts that try an operator: null, empty, white space, control and wide characters, very long, equal.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "It's 12,345 déjà vu　 ½ x"), (6, "\x1c\x1d a\x85b c d  e \n\n f"), (7, "word " * 20_000), (8, "ab" * 3_000), (9, "a"), (9, "a"), (None, "null key"), (10, "'ll 's  \r\n  end ")]
