"""Tables held as array<array<string>>: one grid per table, rows in order.

A grid is one record, as a table on a page is, so every function here works
inside its row and moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions.clean import let
from pagegrain.functions.text import squeeze, strip, words

# Table-drawing characters that recognition leaves in cells.
ARTEFACTS = "|│─┌┐└┘├┤┬┴┼"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
HEAD = r"(?is)<th[^>]*>(.*?)</th>"
DATA = r"(?is)<td[^>]*>(.*?)</td>"
CELL = r"(?is)<t[hd][^>]*>.*?</t[hd]>"


def width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))


def padded(grid: Column) -> Column:
    """Every row filled with empty cells to the widest."""
    return let(width(grid), lambda w: F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))


def clean_cell(c: Column) -> Column:
    return strip(F.translate(squeeze(F.coalesce(c, F.lit(""))), ARTEFACTS, ""))


def cleaned(grid: Column) -> Column:
    return F.transform(grid, lambda r: F.transform(r, clean_cell))


def filled(cell: Column) -> Column:
    return F.coalesce(strip(cell) != "", F.lit(False))


def normalised(grid: Column) -> Column:
    """Padded, without all-blank rows, and never smaller than one empty cell."""
    kept = F.filter(padded(grid), lambda r: F.exists(r, filled))
    one = F.array(F.array(F.lit("")))
    return F.when(F.size(grid) == 0, grid).otherwise(let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(one)))


def has_header(grid: Column) -> Column:
    """First row looks like headings: short words, or words over digits."""
    def votes(a: Column, b: Column) -> Column:
        live = a != ""
        short = (live & (F.length(a) < 50) & a.rlike(r"\p{L}")).cast("int")
        over = (live & F.coalesce(b != "", F.lit(False)) & F.replace(a, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$") & b.rlike(r"\p{Nd}")).cast("int")
        return short + F.coalesce(over, F.lit(0))

    first = F.try_element_at(grid, F.lit(1))
    second = F.slice(F.try_element_at(grid, F.lit(2)), F.lit(1), F.size(first))
    total = F.aggregate(F.zip_with(first, second, votes), F.lit(0), lambda s, v: s + v)
    return (F.size(grid) >= 2) & F.coalesce(total > F.size(first) / 2, F.lit(False))


def to_html(grid: Column, header: Column) -> Column:
    def row(r: Column, i: Column) -> Column:
        tag = F.when(header & (i == 0), "th").otherwise("td")
        cell = lambda c: F.concat(F.lit("<"), tag, F.lit(">"), c, F.lit("</"), tag, F.lit(">"))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))

    body = F.array_join(F.transform(grid, row), "")
    return F.when(F.size(grid) == 0, "<table><tr><td>Empty table</td></tr></table>").otherwise(
        F.concat(F.lit("<table>"), body, F.lit("</table>")))


def tag_free(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def from_html(html: Column) -> Column:
    """Grid of an HTML table, header cells before data cells in a row; raw text when there are no rows."""
    def cells(row: Column) -> Column:
        found = F.concat(F.regexp_extract_all(row, F.lit(HEAD), 1), F.regexp_extract_all(row, F.lit(DATA), 1))
        return F.transform(found, tag_free)

    rows = F.filter(F.transform(F.regexp_extract_all(html, F.lit(ROW), 1), cells), lambda r: F.size(r) > 0)
    return let(rows, lambda g: F.when(F.size(g) > 0, padded(g)).otherwise(F.array(F.array(html))))


def from_html_in_order(html: Column) -> Column:
    """Grid of an HTML table with cells in document order; null when there is no table or row."""
    def cells(row: Column) -> Column:
        return F.transform(F.regexp_extract_all(row, F.lit(CELL), 0), tag_free)

    rows = F.transform(F.regexp_extract_all(html, F.lit(ROW), 1), cells)
    return F.when(html.rlike(r"(?i)<table"), let(rows, lambda g: F.when(F.size(g) > 0, padded(g))))


def any_header_cell(html: Column) -> Column:
    return html.rlike(r"(?is)<th[^>]*>.*?</th>")


def first_row_header(html: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(html, F.lit(ROW), 1), F.lit(1)).rlike(r"(?i)<th[^>]*>"), F.lit(False))


def span_of(cell: Column, name: str) -> Column:
    """Integer value of a span attribute of a cell tag; 1 when absent, null when not a number."""
    raw = F.regexp_extract(cell, rf"(?i)^<t[hd][^>]*\s{name}\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return F.when(raw == "", 1).otherwise(raw.try_cast("int"))


def is_complex(html: Column) -> Column:
    """True when a cell spans more than one row or column; unreadable spans are skipped cell by cell."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<t[hd][^>]*>"), 0)
    return F.exists(tags, lambda t: F.coalesce((span_of(t, "colspan") > 1) | (span_of(t, "rowspan") > 1), F.lit(False))
                    & span_of(t, "colspan").isNotNull() & span_of(t, "rowspan").isNotNull())


def _pipe_row(r: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))


def html_to_markdown(html: Column, pad: bool = True) -> Column:
    """HTML table to a pipe table. The unpadded form ignores spans and skips rows without cells."""
    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(CELL), 0)
        text = lambda c: F.replace(tag_free(c), F.lit("|"), F.lit("\\|"))
        if not pad:
            return F.transform(found, text)
        fill = lambda c: F.concat(F.array(F.replace(text(c), F.lit("\n"), F.lit(" "))),
                                  F.array_repeat(F.lit(""), F.coalesce(span_of(c, "colspan"), F.lit(1)) - 1))
        return F.flatten(F.transform(found, fill))

    rows = F.transform(F.regexp_extract_all(html, F.lit(ROW), 1), cells)

    def render(g: Column) -> Column:
        rule = F.array_repeat(F.lit("---"), F.size(F.element_at(g, 1)))
        return F.array_join(F.concat(F.array(_pipe_row(F.element_at(g, 1)), _pipe_row(rule)),
                                     F.transform(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), _pipe_row)), "\n")

    if pad:
        shown = let(F.when(F.size(rows) > 0, padded(rows)), lambda g: F.when(width(g) == 0, "[空表格]").otherwise(render(g)))
        return (F.when(html.isNull() | (html == ""), "[空表格]").when(~html.rlike(r"(?i)<table"), "[表格解析失败]")
                .otherwise(F.coalesce(shown, F.lit("[空表格]"))))
    some = F.filter(rows, lambda r: F.size(r) > 0)
    return F.when(html.rlike(r"(?i)<table"), let(some, lambda g: F.when(F.size(g) > 0, render(g)).otherwise(""))).otherwise("")


def text_cells(t: Column) -> Column:
    """Cells of a text row: tab-separated pieces, else whitespace-separated words."""
    tabbed = F.filter(F.transform(F.split(t, "\t"), strip), lambda c: c != "")
    return F.when(F.size(tabbed) > 0, tabbed).otherwise(words(t))


def from_lines(rows: Column | str, cells=text_cells) -> Column:
    """Grid from rows, each cut by ``cells``: text rows, unless told otherwise."""
    return padded(F.transform(rows, cells))


def split_at_blank_rows(grid: Column, min_rows: int = 5) -> Column:
    """Grids between runs of two or more near-empty rows (at most one filled cell).

    Single near-empty rows vanish; segments under two rows are dropped; small
    tables and tables without a segment stay whole. The fold carries integers only.
    """
    blank = F.transform(grid, lambda r: F.size(F.filter(r, filled)) <= 1)

    def step(s: Column, b: Column) -> Column:
        run = F.when(b, s["run"] + 1).otherwise(F.lit(0))
        seg = F.when(run == 2, s["seg"] + 1).otherwise(s["seg"])
        return F.struct(run.alias("run"), seg.alias("seg"), F.array_append(s["ids"], F.when(b, F.lit(-1)).otherwise(seg)).alias("ids"))

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("seg"), F.array().cast("array<int>").alias("ids"))
    folded = F.aggregate(blank, start, step)

    def segments(f: Column) -> Column:
        tagged = F.zip_with(grid, f["ids"], lambda r, i: F.struct(r.alias("r"), i.alias("i")))
        parts = F.transform(F.sequence(F.lit(0), f["seg"]), lambda k: F.transform(
            F.filter(tagged, lambda t: t["i"] == k), lambda t: t["r"]))
        return F.filter(parts, lambda p: F.size(p) >= 2)

    split = let(folded, segments)
    return F.when(F.size(grid) <= min_rows, F.array(grid)).otherwise(
        let(split, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(grid))))


def add_row(grid: Column, position: int = -1) -> Column:
    blank = F.array_repeat(F.lit(""), F.greatest(F.size(F.element_at(grid, 1)), F.lit(1)))
    if position < 0:
        return F.array_append(grid, blank)
    return F.when(F.size(grid) <= position, F.array_append(grid, blank)).otherwise(F.array_insert(grid, position + 1, blank))


def remove_row(grid: Column, index: int) -> Column:
    return F.when(F.size(grid) <= 1, grid).otherwise(F.filter(grid, lambda r, i: i != index))


def add_column(grid: Column, position: int = -1) -> Column:
    def widen(r: Column) -> Column:
        end = F.array_append(r, F.lit(""))
        return end if position < 0 else F.when(F.size(r) <= position, end).otherwise(F.array_insert(r, position + 1, F.lit("")))
    return F.transform(grid, widen)


def remove_column(grid: Column, index: int) -> Column:
    return F.when(F.size(F.element_at(grid, 1)) <= 1, grid).otherwise(
        F.transform(grid, lambda r: F.filter(r, lambda c, i: i != index)))


def shape_check(grid: Column) -> Column:
    """Struct of verdict, error and the rows whose width differs from the first."""
    cols = F.size(F.try_element_at(grid, F.lit(1)))
    odd = F.filter(F.transform(grid, lambda r, i: F.struct(i.alias("row"), F.size(r).alias("actual"))), lambda s: s["actual"] != cols)
    error = (F.when(F.size(grid) == 0, "Table content must be a non-empty array").when(cols == 0, "Table must have at least one column")
             .when(F.size(odd) > 0, "All table rows must have the same number of columns"))
    return F.struct(error.isNull().alias("is_valid"), error.alias("error"), F.size(grid).alias("rows"), cols.alias("columns"), odd.alias("inconsistent"))


def statistics(grid: Column) -> Column:
    cells = F.flatten(grid)
    full = F.filter(cells, filled)
    total = F.size(grid) * F.size(F.element_at(grid, 1))
    n_chars = F.aggregate(F.transform(full, F.length), F.lit(0), lambda a, n: a + n)
    return F.struct(F.size(grid).alias("rows"), F.size(F.element_at(grid, 1)).alias("columns"), total.alias("total_cells"),
                    F.size(full).alias("non_empty"), (total - F.size(full)).alias("empty"), n_chars.alias("characters"),
                    F.when(F.size(full) > 0, n_chars / F.size(full)).otherwise(0.0).alias("mean_length"))


def is_numeric(cell: Column) -> Column:
    """A number once comma, dollar and percent signs are gone; digit grouping by underscore is refused."""
    bare = strip(F.regexp_replace(cell, "[,$%]", ""))
    return F.coalesce(bare.try_cast("double").isNotNull() & ~bare.rlike("[_dDfF]$|_"), F.lit(False))


def table_confidence(grid: Column, base: float = 0.7) -> Column:
    """Mean of fill, row-width agreement, share of cells of sane length, and a base score."""
    cells = F.flatten(grid)
    full = F.filter(cells, filled)
    total = F.size(grid) * F.size(F.element_at(grid, 1))
    even = F.size(F.filter(grid, lambda r: F.size(r) == F.size(F.element_at(grid, 1)))) / F.size(grid)
    sane = F.size(F.filter(full, lambda c: F.length(strip(c)) <= 100))
    parts = F.filter(F.array(F.when(total > 0, F.size(full) / total), F.when(F.size(grid) > 0, even),
                             F.when(F.size(full) > 0, sane / F.size(full)), F.lit(base)), lambda p: p.isNotNull())
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a + p) / F.size(parts)
