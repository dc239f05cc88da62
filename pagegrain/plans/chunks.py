"""Chunking of documents and paged conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.operators import chunking
from pagegrain.operators.retrieval import index_rows
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_strip
from pagegrain.plans.registry import query


_DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"
_PARA = f"""b AS (SELECT doc_id, {s_strip(_DOUBLED)} AS t FROM documents),
r AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n\\s*\\n')) AS raw, unnest(list_concat([0], list_transform(regexp_extract_all(t, '\\n\\s*\\n'), lambda g: length(g)))) AS gap,
   generate_subscripts(regexp_split_to_array(t, '\\n\\s*\\n'), 1) AS k FROM b),
l AS (SELECT *, sum(gap) OVER w + coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw)) AS off, {s_strip('raw')} AS p
   FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
pc AS (SELECT doc_id, p, off, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM l WHERE p <> '')"""
_ENDS = chunking.ENDINGS


def _sent(source: str, key: str, text: str) -> str:
    """Sentences with their starts, of ``text`` in ``source``."""
    pat = f"([^{_ENDS}]+[{_ENDS}]?)([{_ENDS}]*)"
    return f"""sb AS (SELECT {key}, {s_strip(text)} AS t FROM {source}),
sr AS (SELECT {key}, length(regexp_extract(t, '^[{_ENDS}]+')) AS skip, unnest(regexp_extract_all(t, '{pat}', 1)) AS raw, unnest(regexp_extract_all(t, '{pat}', 2)) AS tail, generate_subscripts(regexp_extract_all(t, '{pat}', 1), 1) AS k FROM sb),
sl AS (SELECT *, skip + coalesce(sum(length(raw) + length(tail)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(regexp_replace(raw, '^[\\t-\\r ]+', '')) AS off, {s_strip('raw')} AS p FROM sr),
pc AS (SELECT {key}, p, off, row_number() OVER (PARTITION BY {key} ORDER BY k) AS i FROM sl WHERE p <> '')"""


def _fold(key: str, joiner: int, extra: int, size: int) -> str:
    return f"""f AS (SELECT {key}, i, p, off, length(p) AS n, 0::BIGINT AS c FROM pc WHERE i = 1
 UNION ALL SELECT pc.{key.replace(', ', ', pc.')}, pc.i, pc.p, pc.off, CASE WHEN f.n + length(pc.p) + {extra} > {size} THEN length(pc.p) ELSE f.n + length(pc.p) + {joiner} END, CASE WHEN f.n + length(pc.p) + {extra} > {size} THEN f.c + 1 ELSE f.c END
 FROM f JOIN pc ON {" AND ".join(f"pc.{k.strip()} = f.{k.strip()}" for k in key.split(","))} AND pc.i = f.i + 1)"""


_OUT = "md5(content) AS digest, length(content) AS n, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char"


def _chunks_sql(key: str, joiner: str) -> str:
    return f"""g AS (SELECT {key}, c, string_agg(p, {joiner} ORDER BY i) AS content, min(off) AS start_char, max(off + length(p)) AS end_char FROM f GROUP BY {key}, c),
k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY c) - 1 AS idx FROM g WHERE length(content) >= 50)"""


def _shown(c, *key):
    return c.select(*key, "idx", F.md5(F.col("content").cast("binary")).alias("digest"), F.length("content").alias("n"), "start_char", "end_char")


def _doubled(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query("chk2_paragraph_chunks", f"WITH RECURSIVE {_PARA}, {_fold('doc_id', 2, 1, 500)}, {_chunks_sql('doc_id', 'chr(10) || chr(10)')} SELECT doc_id, idx, {_OUT} FROM k")
def paragraph_chunks(spark, sf):
    return _shown(chunking.chunks(_doubled(spark, sf), "doc_id", strategy="paragraph"), "doc_id")


@query("chk3_sentence_chunks", f"WITH RECURSIVE {_sent('documents', 'doc_id', 'text')}, {_fold('doc_id', 0, 0, 500)}, {_chunks_sql('doc_id', chr(39) * 2)} SELECT doc_id, idx, {_OUT} FROM k")
def sentence_chunks(spark, sf):
    return _shown(chunking.chunks(inputs.table(spark, sf, "documents"), "doc_id", strategy="sentence"), "doc_id")


def _mixed_sql(compat: bool) -> str:
    flush = "f.n >= 50" if compat else "true"
    # Groups carry the position they are emitted at: a long paragraph at its own, a pending group where it is flushed.
    return f"""WITH RECURSIVE {_PARA},
f AS (SELECT doc_id, i, CASE WHEN length(p) > 500 THEN 0 ELSE length(p) END AS n, CASE WHEN length(p) > 500 THEN 0 ELSE 1 END::BIGINT AS c, CASE WHEN length(p) > 500 THEN -1 ELSE 1 END::BIGINT AS g FROM pc WHERE i = 1
 UNION ALL SELECT pc.doc_id, pc.i,
  CASE WHEN length(pc.p) > 500 THEN CASE WHEN {flush} THEN 0 ELSE f.n END WHEN f.n > 0 AND f.n + length(pc.p) + 2 > 500 THEN length(pc.p) WHEN f.n = 0 THEN length(pc.p) ELSE f.n + length(pc.p) + 2 END,
  CASE WHEN length(pc.p) > 500 THEN f.c WHEN f.n = 0 OR f.n + length(pc.p) + 2 > 500 THEN f.c + 1 ELSE f.c END,
  CASE WHEN length(pc.p) > 500 THEN -pc.i WHEN f.n = 0 OR f.n + length(pc.p) + 2 > 500 THEN f.c + 1 ELSE f.c END
 FROM f JOIN pc ON pc.doc_id = f.doc_id AND pc.i = f.i + 1),
a AS (SELECT f.doc_id, f.g, f.i, pc.p, pc.off FROM f JOIN pc ON pc.doc_id = f.doc_id AND pc.i = f.i),
short AS (SELECT doc_id, g, string_agg(p, chr(10) || chr(10) ORDER BY i) AS content, min(off) AS start_char, max(off + length(p)) AS end_char, max(i) AS pos, 0::BIGINT AS sub FROM a WHERE g > 0 GROUP BY doc_id, g),
lng AS (SELECT doc_id, i AS para, p AS body, off AS base FROM a WHERE g < 0),
{_sent('lng', 'doc_id, para', 'body').replace('pc AS (', 'ps AS (')},
{_fold('doc_id, para', 0, 0, 500).replace('f AS (', 'h AS (', 1).replace(' pc', ' ps').replace('pc.', 'ps.').replace('f.', 'h.').replace('FROM f ', 'FROM h ')},
long_c AS (SELECT h.doc_id, h.para, h.c, string_agg(h.p, '' ORDER BY h.i) AS content, min(h.off) + any_value(base) AS start_char, max(h.off + length(h.p)) + any_value(base) AS end_char FROM h JOIN lng ON lng.doc_id = h.doc_id AND lng.para = h.para GROUP BY h.doc_id, h.para, h.c),
every AS (SELECT doc_id, content, start_char, end_char, pos, sub, 0 AS late FROM short UNION ALL SELECT doc_id, content, start_char, end_char, para, c, 1 FROM long_c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS idx FROM every WHERE length(content) >= 50)
SELECT doc_id, idx, {_OUT} FROM k"""


@query("chk4_mixed_chunks", _mixed_sql(False))
def mixed_chunks(spark, sf):
    return _shown(chunking.chunks(_doubled(spark, sf), "doc_id", strategy="mixed"), "doc_id")


@query("chk4_mixed_chunks_compat", _mixed_sql(True))
def mixed_chunks_compat(spark, sf):
    return _shown(chunking.chunks(_doubled(spark, sf), "doc_id", strategy="mixed", compat=True), "doc_id")


_FIXED = f"""WITH RECURSIVE b AS (SELECT doc_id, {s_strip('text')} AS t FROM documents),
s AS (SELECT doc_id, t, 0::BIGINT AS start, 500::BIGINT AS aim, NULL::BIGINT AS last, 0 AS step, NULL::BIGINT AS s0, NULL::BIGINT AS e0 FROM b WHERE t <> ''
 UNION ALL SELECT doc_id, t, nxt, nxt + 500, l, step + 1, start, e FROM (
  SELECT *, CASE WHEN e >= n THEN n WHEN e - 50 <= l THEN e ELSE greatest(e - 50, 0) END AS nxt FROM (
   SELECT *, CASE WHEN length({s_strip('substr(t, start + 1, e - start)')}) >= 50 THEN start ELSE last END AS l FROM (
    SELECT *, CASE WHEN aim >= n THEN n WHEN cut > 0 THEN low + cut ELSE aim END AS e FROM (
     SELECT *, length(regexp_extract(substr(t, low + 1, aim - low), '(?s)^.*[{_ENDS}\\n]')) AS cut FROM (
      SELECT *, length(t) AS n, greatest(start + 50, aim - 100) AS low FROM s WHERE start < length(t)))))))
, o AS (SELECT doc_id, s0 AS start_char, e0 AS end_char, {s_strip('substr(t, s0 + 1, e0 - s0)')} AS content FROM s WHERE s0 IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS idx FROM o WHERE length(content) >= 50)
SELECT doc_id, idx, {_OUT} FROM k"""


@query("chk1_fixed_chunks", _FIXED)
def fixed_chunks(spark, sf):
    return _shown(chunking.chunks(inputs.table(spark, sf, "documents"), "doc_id", strategy="fixed"), "doc_id")


_CONV = f"WITH RECURSIVE {_sent('conversations', 'conv_id, turn', 'text')}, {_fold('conv_id, turn', 0, 0, 300)}, {_chunks_sql('conv_id, turn', chr(39) * 2)}"


@query("win11_page_chunks", _CONV + f" SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, idx) - 1 AS idx, {_OUT} FROM k")
def page_chunks(spark, sf):
    c = chunking.page_chunks(inputs.table(spark, sf, "conversations"), "conv_id", "turn", strategy="sentence", size=300, width=4)
    return _shown(c, "conv_id", "turn")


def _by_line(text, **_):
    """A user strategy: every line of at least 20 characters is a chunk."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.struct(l.alias("content"), F.lit(0).alias("start_char"), F.length(l).alias("end_char")))
    return F.filter(lines, lambda c: c["end_char"] >= 20)


@query("udf2_custom_strategy", """
SELECT doc_id, count(*) AS n_chunks, sum(length(l))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) >= 20 GROUP BY doc_id""")
def custom_strategy(spark, sf):
    chunking.register_strategy("line", _by_line)
    c = chunking.chunks(inputs.table(spark, sf, "documents"), "doc_id", strategy="line")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


@query("chk5_chunk_metadata", f"WITH RECURSIVE {_PARA}, {_fold('doc_id', 2, 1, 500)}, {_chunks_sql('doc_id', 'chr(10) || chr(10)')} SELECT doc_id || '_chunk_' || idx AS chunk_id, doc_id, json_object('index', idx, 'start_char', start_char::BIGINT, 'end_char', end_char::BIGINT)::VARCHAR AS metadata FROM k")
def chunk_metadata(spark, sf):
    return index_rows(chunking.chunks(_doubled(spark, sf), "doc_id", strategy="paragraph"), "doc_id").select("chunk_id", "doc_id", "metadata")
