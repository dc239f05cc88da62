"""Markdown, anchors and HTML fragments of layout items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions import grids
from pagegrain.functions.arrays import scan
from pagegrain.functions.clean import let
from pagegrain.functions.text import strip

ANCHOR = r"<!--\s*@block:(\S+)\s+(\d+),(\d+),(\d+),(\d+)\s*-->"
# Markers put in place of a picture or an unreadable table.
TABLE_MARK, PICTURE_MARK, PICTURE_LINK = "[表格]", "*[图片]*", "![图像]()"


def _around(text: Column, before: str, after: str = "") -> Column:
    return F.when(text != "", F.concat(F.lit(before), text, F.lit(after))).otherwise("")


def block_markdown(item: Column, text: Column, html: Column, dialect: str = "anchor") -> Column:
    """Markdown of one layout item in one of three dialects: anchor, route or file."""
    simple = grids.html_to_markdown(html)
    if dialect == "anchor":
        table = F.when(html.isNull(), TABLE_MARK).when(grids.is_complex(html), F.concat(F.lit("\n"), html, F.lit("\n"))).otherwise(
            F.concat(F.lit("\n"), simple, F.lit("\n")))
        bullets = F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda l: strip(l) != ""), lambda l: F.concat(F.lit("- "), strip(l))), "\n")
        return (F.when(item.isin("title", "doc_title"), _around(text, "# ")).when(item.isin("header", "footer", "reference"), _around(text, "*", "*"))
                .when(item == "table", table).when(item == "figure_caption", _around(text, "**", "**")).when(item == "equation", _around(text, "$", "$"))
                .when(item == "figure", PICTURE_MARK).when(item == "list", bullets).otherwise(text))
    if dialect == "route":
        return (F.when(item.isin("title", "doc_title"), _around(text, "# ")).when(item.isin("header", "footer", "reference"), _around(text, "*", "*"))
                .when(item == "table", F.coalesce(grids.html_to_markdown(html, pad=False), F.lit("")))
                .when(item == "figure_caption", _around(text, "**", "**")).when(item == "equation", _around(text, "$", "$"))
                .when(item == "figure", PICTURE_MARK).otherwise(text))
    return (F.when(item == "title", _around(text, "# ")).when(item.isin("header", "footer"), _around(text, "*", "*"))
            .when(item == "table", F.coalesce(grids.html_to_markdown(html, pad=False), F.lit(""))).when(item == "figure", PICTURE_LINK)
            .when(item == "figure_caption", _around(text, "*图: ", "*")).when(item == "table_caption", _around(text, "*表: ", "*"))
            .when(item == "reference", _around(text, "> ")).when(item == "equation", _around(text, "$", "$")).otherwise(text))


def block_id(rank: Column, padded: bool = True) -> Column:
    """Identifier of the rank-th block: ``block_001`` from 1, or ``block_0`` from 0."""
    if not padded:
        return F.concat(F.lit("block_"), rank.cast("string"))
    n = (rank + 1).cast("string")
    return F.concat(F.lit("block_"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))


def anchor(ident: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.concat(F.lit("<!-- @block:"), ident, F.lit(" "), F.concat_ws(",", x, y, width, height), F.lit(" -->"))


def parsed_anchors(markdown: Column) -> Column:
    """Array of block id, box and character offset of every anchor; other comment forms are ignored."""
    found, parts = F.regexp_extract_all(markdown, F.lit(ANCHOR), 0), F.split(markdown, ANCHOR)

    def step(s: Column, p: Column) -> dict[str, Column]:
        here = s["at"] + F.length(p["gap"])
        return {"at": here + F.length(p["mark"]), "emit": here}

    pairs = F.filter(F.zip_with(parts, found, lambda g, m: F.struct(g.alias("gap"), m.alias("mark"))), lambda p: p["mark"].isNotNull())

    def build(ps: Column) -> Column:
        offsets = scan(ps, {"at": F.lit(0)}, step, "int")
        part = lambda m, g: F.regexp_extract(m, ANCHOR, g)
        return F.zip_with(ps, offsets, lambda p, o: F.struct(
            part(p["mark"], 1).alias("block_id"), *[part(p["mark"], i + 2).cast("bigint").alias(n) for i, n in enumerate(("x", "y", "width", "height"))],
            o.alias("position")))

    return let(pairs, build)


def without_anchors(markdown: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(markdown, ANCHOR, ""), r"\n{3,}", "\n\n"))


def is_anchor(text: Column) -> Column:
    return text.rlike(ANCHOR)


def html_fragment(rank: Column, item: Column, text: Column, html: Column, box: Column) -> Column:
    """Annotated HTML of one item: region number, kind and box as JSON; empty text gives nothing."""
    css = {"title": "title", "text": "text-block", "header": "header", "footer": "footer", "figure_caption": "figure-caption",
           "table_caption": "table-caption", "reference": "reference"}
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in css.items() for x in kv]), item), F.lit("text-block"))
    attrs = lambda kind: F.concat(F.lit('" data-region-id="'), rank.cast("string"), F.lit(f'" data-region-type="{kind}" data-bbox=\''), box, F.lit("'>"))
    bare = html
    for tag in ("<html>", "</html>", "<body>", "</body>"):
        bare = F.replace(bare, F.lit(tag), F.lit(""))
    table = F.concat(F.lit('<div class="ocr-region table-wrapper'), attrs("table"), F.lit("\n"), strip(bare), F.lit("\n</div>"))
    figure = F.concat(F.lit('<div class="ocr-region figure-placeholder'), attrs("figure"), F.lit("[图像]</div>"))
    words_ = lambda c, inner: F.concat(F.lit('<div class="ocr-region '), c, attrs("text"), F.lit('\n<span class="editable-content">'), inner, F.lit("</span>\n</div>"))
    math = words_(F.lit("equation"), F.concat(F.lit("<em>"), text, F.lit("</em>")))
    return (F.when(item == "table", F.coalesce(table, F.lit(""))).when(text == "", "").when(item == "figure", figure)
            .when(item == "equation", math).otherwise(words_(name, text)))


def line_kind(line: Column) -> Column:
    """Kind of a trimmed Markdown line. Lists come before emphasis, so ``*text*`` is a list line."""
    return (F.when(line == "", "blank").when(F.startswith(line, F.lit("#")), "header").when(F.startswith(line, F.lit("|")), "table")
            .when(F.startswith(line, F.lit(">")), "quote")
            .when(line.rlike(r"^[-*]") | (line.rlike(r"^\p{Nd}") & F.contains(F.substring(line, 1, 3), F.lit("."))), "list")
            .when(F.startswith(line, F.lit("$$")), "formula").when(F.startswith(line, F.lit("![")), "image").otherwise("paragraph"))


def markdown_runs(markdown: Column) -> Column:
    """Array of (kind, lines): table and list lines run together, every other line stands alone."""
    lines = F.transform(F.split(markdown, "\n"), lambda l: let(strip(l), lambda t: F.struct(line_kind(t).alias("kind"), t.alias("t"))))

    def starts(ls: Column) -> Column:
        def step(s: Column, l: Column) -> dict[str, Column]:
            joins = (l["kind"] == s["kind"]) & l["kind"].isin("table", "list")
            return {"kind": l["kind"], "n": s["n"] + 1, "emit": F.when(~joins, s["n"])}
        return F.array_append(scan(ls, {"kind": F.lit(""), "n": F.lit(1)}, step, "int"), F.size(ls) + 1)

    def cut(ls: Column) -> Column:
        return let(starts(ls), lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, i: F.struct(
            F.element_at(ls, a)["kind"].alias("kind"),
            F.transform(F.slice(ls, a, F.element_at(at, i + 2) - a), lambda l: l["t"]).alias("lines"))))

    return F.filter(let(lines, cut), lambda r: r["kind"] != "blank")


def run_block(kind: Column, lines: Column) -> list[Column]:
    """Block fields of a run: type, text, level, style, items, grid, heading flag, caption and url."""
    first = F.element_at(lines, 1)
    marks = F.length(F.regexp_extract(first, "^#+", 0))
    after = lambda n: strip(F.substring(first, n, 1 << 30))
    numbered = lambda l: l.rlike(r"^\p{Nd}") & F.contains(F.substring(l, 1, 3), F.lit("."))
    item = lambda l: F.when(numbered(l), strip(F.regexp_replace(l, r"^[^.]*\.", ""))).otherwise(strip(F.substring(l, 2, 1 << 30)))
    items = F.filter(F.transform(lines, item), lambda i: i != "")
    rule = lambda l: F.contains(l, F.lit("---"))
    grid = F.filter(F.transform(F.filter(lines, lambda l: ~rule(l)), lambda l: F.filter(F.transform(F.split(l, r"\|"), strip), lambda c: c != "")), lambda r: F.size(r) > 0)
    formula = F.when(F.endswith(first, F.lit("$$")) & (F.length(first) > 4), F.expr("substring(lines[0], 3, length(lines[0]) - 4)")).otherwise(F.substring(first, 3, 1 << 30))
    text = (F.when(kind == "header", strip(F.regexp_replace(first, "^#+", ""))).when(kind == "quote", F.concat(F.lit("<blockquote>"), after(2), F.lit("</blockquote>")))
            .when(kind == "formula", F.concat(F.lit("<em>公式: "), formula, F.lit("</em>"))).when(kind == "paragraph", first))
    image = kind == "image"
    return [
        F.when(kind.isin("quote", "formula"), "paragraph").otherwise(kind).alias("type"), text.alias("text"),
        F.when(kind == "header", F.least(marks, F.lit(6))).alias("level"),
        F.when(kind == "list", F.when(F.exists(lines, numbered), "ordered").otherwise("unordered")).alias("style"),
        F.when(kind == "list", items).alias("items"), F.when(kind == "table", grid).alias("grid"),
        F.when(kind == "table", F.exists(lines, rule)).alias("with_headings"),
        F.when(image, F.regexp_extract(first, r"^[^\[]*\[([^\]]*)\]", 1)).alias("caption"), F.when(image, F.regexp_extract(first, r"^[^(]*\(([^)]*)\)", 1)).alias("url")]
