"""Small SQL text helpers shared by the oracle statements."""

from __future__ import annotations

# The code points Python treats as whitespace.
_WS_CODES = (
    [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760]
    + list(range(8192, 8203)) + [8232, 8233, 8239, 8287, 12288]
)
WS_SET = "'" + "".join(chr(c) for c in _WS_CODES) + "'"
WS_RE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def s_strip(e: str) -> str:
    return f"trim({e}, {WS_SET})"


def s_words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS_RE}+'), lambda w: w <> '')"


def s_squeeze(e: str) -> str:
    return f"array_to_string({s_words(e)}, ' ')"


def s_contains_any(e: str, pieces: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, '{p}')" for p in pieces) + ")"


def s_starts_any(e: str, pieces: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({e}, '{p}')" for p in pieces) + ")"


def s_map(e: str, pairs: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"(CASE {e} {arms} ELSE {default} END)"


_LL = """ll AS (
  SELECT doc_id, line_no, t AS text,
         CASE WHEN h < 2 THEN NULL ELSE 0.5::DOUBLE + h / 100.0::DOUBLE END AS confidence,
         (line_no % 3 * 10)::DOUBLE AS x1, (line_no * 24)::DOUBLE AS y1,
         (line_no % 3 * 10 + least(length(t), 120) * 7)::DOUBLE AS x2, (line_no * 24 + 18)::DOUBLE AS y2
  FROM (SELECT doc_id, line_no, t, (doc_id * 31 + line_no * 17) % 50 AS h
        FROM (SELECT doc_id, unnest(ls) AS t, (generate_subscripts(ls, 1) - 1)::BIGINT AS line_no
              FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS ls FROM documents))))"""

_LR = """lr AS (
  SELECT doc_id, ord, x1, y1, x2, y2, content, n_lines,
         CASE ord % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'text' WHEN 3 THEN 'table'
                      WHEN 4 THEN 'figure' WHEN 5 THEN 'header' ELSE 'reference' END AS type,
         CASE WHEN ord % 5 = 4 THEN NULL ELSE 0.6::DOUBLE + ((doc_id * 13 + ord * 7) % 40) / 100.0::DOUBLE END AS confidence
  FROM (SELECT doc_id, (line_no // 4)::BIGINT AS ord, min(x1) AS x1, min(y1) - 2 AS y1, max(x2) AS x2, max(y2) + 2 AS y2,
               string_agg(text, chr(10) ORDER BY line_no) AS content, count(*) AS n_lines
        FROM ll GROUP BY doc_id, line_no // 4))"""


def with_ll(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_LL} {body}"


def with_lr(body: str, recursive: bool = False) -> str:
    """``body`` starts with SELECT, or with a comma and further named queries."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{_LL}, {_LR} {body}"


_GRID = """g AS (SELECT c_custkey // 32 AS table_no, c_custkey % 32 AS r,
  CASE WHEN (c_custkey // 32) % 2 = 0 AND c_custkey % 32 = 0 THEN ['Key', 'Name', 'Balance', 'Segment']
   WHEN c_custkey % 13 IN (5, 9) THEN ['', '', '', ''] WHEN c_custkey % 13 = 6 THEN [c_custkey::VARCHAR, '', '', '']
   ELSE [CASE WHEN c_custkey * 7 % 11 = 0 THEN '' ELSE c_custkey::VARCHAR END,
         CASE WHEN (c_custkey * 7 + 3) % 11 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '  ' || c_name || ' │' ELSE c_name END,
         CASE WHEN (c_custkey * 7 + 6) % 11 = 0 THEN '' ELSE '$' || c_acctbal::VARCHAR END,
         CASE WHEN (c_custkey * 7 + 9) % 11 = 0 THEN '' ELSE c_mktsegment END][1:CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 4 END] END AS cells
  FROM customer)"""
_HTML = """h AS (SELECT table_no, r, '<tr>' || array_to_string(list_transform(cells, lambda c, j: CASE
   WHEN table_no % 2 = 0 AND r = 0 THEN '<th>' || c || '</th>'
   WHEN j = 1 THEN '<td' || CASE WHEN r % 4 = 2 AND table_no % 3 = 0 THEN ' colspan="2"' WHEN r % 5 = 3 THEN ' colspan="1"' ELSE '' END || '><b>' || c || '</b></td>'
   ELSE '<TD> a|' || c || '</TD>' END), '') || '</tr>' AS tr FROM g),
ht AS (SELECT table_no, '<table>' || string_agg(tr, chr(10) ORDER BY r) || '</table>' AS html FROM h GROUP BY table_no)"""
_CELLS = """cells AS (SELECT c_nationkey::BIGINT AS table_no, c_custkey AS r, c, CASE WHEN (c_custkey * 7 + c * 3) % 11 = 0 THEN '' ELSE v END AS text
 FROM (SELECT c_nationkey, c_custkey, unnest([0, 1, 2, 3, 4])::BIGINT AS c, unnest([c_custkey::VARCHAR, c_name, '$' || c_acctbal::VARCHAR, c_mktsegment,
   CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE '12%' END]) AS v FROM customer))"""


def with_grid(body: str) -> str:
    return f"WITH {_GRID}, {_HTML} {body}"


def with_cells(body: str) -> str:
    return f"WITH {_CELLS} {body}"


def s_clean_cell(e: str) -> str:
    return s_strip(f"translate({s_squeeze(e)}, '|│─┌┐└┘├┤┬┴┼', '')")


_AS_TABLE = "'<table><tr><td>' || replace(replace(content, chr(10), '</td></tr><tr><td>'), ', ', '</td><td>') || '</td></tr></table>'"
_BR = f"""br AS (SELECT doc_id, ord, type, x1, y1, x2, y2, confidence,
  CASE ord % 7 WHEN 0 THEN 'header' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'table' WHEN 4 THEN 'image' WHEN 5 THEN 'header' ELSE 'list' END AS region_type,
  CASE WHEN ord % 7 = 3 THEN {_AS_TABLE} ELSE content END AS content FROM lr)"""
_IT = f"""it AS (SELECT doc_id, ord, x1, y1, x2, y2, confidence,
  CASE ord % 11 WHEN 10 THEN 'list' WHEN 9 THEN 'equation' WHEN 8 THEN 'figure_caption' ELSE type END AS type,
  CASE WHEN ord % 11 < 8 AND ord % 7 = 3 THEN '' ELSE content END AS text,
  CASE WHEN ord % 11 < 8 AND ord % 7 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN {_AS_TABLE} ELSE '<table><tr><td colspan="2">' || content || '</td></tr></table>' END END AS html FROM lr)"""


def with_br(body: str) -> str:
    return with_lr(f", {_BR} {body}")


def with_it(body: str, recursive: bool = False) -> str:
    return with_lr(f", {_IT} {body}", recursive)
