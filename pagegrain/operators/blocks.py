"""Typed blocks: building, rebuilding, numbering, assembling and validating them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import classify, grids, markdown
from pagegrain.functions.arrays import unnest, unnest_at
from pagegrain.functions.clean import html_text, let
from pagegrain.functions.labels import display_type
from pagegrain.functions.text import strip

DOC = "doc_id"
VERSION = "2.28.2"
# Required fields, field types and names used in messages, by block type.
REQUIRED = {"header": ["text", "level"], "paragraph": ["text"], "table": ["content", "withHeadings"], "list": ["style", "items"], "image": ["file"]}
FIELD_TYPES = {
    "header": {"text": "str", "level": "int"}, "paragraph": {"text": "str"},
    "table": {"content": "list", "withHeadings": "bool", "stretched": "bool"}, "list": {"style": "str", "items": "list"},
    "image": {"file": "dict", "caption": "str", "withBorder": "bool", "withBackground": "bool", "stretched": "bool"},
}
RECOMMENDED = ["confidence", "originalCoordinates", "processingNotes"]
NODE_NAMES = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "VOID": "NoneType"}


def block_data(region: Column, content: Column, text: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """JSON data of a block from its region; ``text`` is the trimmed content."""
    off = F.lit(False)
    header = F.to_json(F.struct(text.alias("text"), classify.header_level(text, y1).alias("level")))
    paragraph = F.to_json(F.struct(F.replace(text, F.lit("\n"), F.lit("<br>")).alias("text")))
    items = F.to_json(F.struct(classify.list_style(text).alias("style"), classify.list_items(text).alias("items")))
    file = F.struct(F.lit("").alias("url"), (x2 - x1).cast("int").alias("width"), (y2 - y1).cast("int").alias("height"))
    image = F.to_json(F.struct(file.alias("file"), content.alias("caption"), off.alias("withBorder"), off.alias("withBackground"), off.alias("stretched")))
    table = F.to_json(F.struct(grids.any_header_cell(content).alias("withHeadings"), grids.from_html(content).alias("content"), off.alias("stretched"), content.alias("tableHtml")))
    return F.when(region == "header", header).when(region == "list", items).when(region == "image", image).when(region == "table", table).otherwise(paragraph)


def region_blocks(regions: DataFrame) -> DataFrame:
    """Typed blocks with metadata; ids are a hash of document and position, so reruns agree.

    Blank regions are dropped by a test on their text, not on the built JSON: a
    filter on the JSON would build it twice.
    """
    rt, c = F.col("region_type"), F.col("content")
    box = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    full = regions.where(c.rlike(r"(?U)[^\s\x1c-\x1f]")).withColumn("_text", strip(c))
    return full.withColumns({
        "block_id": F.substring(F.sha2(F.concat_ws(":", DOC, "ord"), 256), 1, 16),
        "block_type": F.when(rt.isin("header", "paragraph", "table", "list", "image"), rt).otherwise("paragraph"),
        "data": block_data(rt, c, F.col("_text"), *box), "font_size": classify.font_size(c, F.col("y2") - F.col("y1")),
        "edit_type": F.when(rt == "table", "table").otherwise("text")}).drop("_text")


def display_blocks(items: DataFrame) -> DataFrame:
    """Display rows of y-ordered items: id, integer box, tolerant confidence and text.

    Needs ``rank``, ``type``, the box, ``score`` and ``confidence`` as text and ``text``.
    """
    def score(c: Column) -> Column:
        return F.coalesce(c.try_cast("double"), F.lit(0.9))

    conf = F.when(F.col("score").isNotNull(), score(F.col("score"))).when(F.col("confidence").isNotNull(), score(F.col("confidence"))).otherwise(0.9)
    whole = lambda a, b: (F.col(a) - F.col(b)).cast("int")
    return items.select(
        DOC, "ord", markdown.block_id(F.col("rank")).alias("block_id"), display_type(F.col("type")).alias("type"),
        F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y"), whole("x2", "x1").alias("width"), whole("y2", "y1").alias("height"),
        F.bround(conf, 4).alias("confidence"), strip("text").alias("text"))


def rebuilt_blocks(items: DataFrame, scale_x: Column, scale_y: Column) -> DataFrame:
    """Blocks from stored y-ordered items, boxes scaled, with the defaults of an absent box, score or table."""
    box = F.col("bbox")
    part = lambda i: F.coalesce(F.try_element_at(box, F.lit(i)), F.lit(0.0))
    n, table = F.size(box), F.col("type") == "table"
    return items.select(
        DOC, "ord", markdown.block_id(F.col("rank"), padded=False).alias("block_id"), F.when(table, "table").otherwise("paragraph").alias("type"),
        (part(1) * scale_x).alias("x"), (part(2) * scale_y).alias("y"),
        F.when(n > 2, (part(3) - part(1)) * scale_x).otherwise(100.0).alias("width"), F.when(n > 3, (part(4) - part(2)) * scale_y).otherwise(30.0).alias("height"),
        F.when(F.col("has_confidence"), F.col("confidence")).otherwise(0.85).alias("confidence"),
        F.when(table, F.coalesce("html", F.lit("<table><tr><td>表格</td></tr></table>"))).otherwise(F.coalesce("text", F.lit(""))).alias("body"))


def block_regions(blocks: DataFrame) -> DataFrame:
    """Region rows of blocks: text or comma-joined items, and a default box where there is none."""
    v = F.try_parse_json("data")
    text = F.try_variant_get(v, "$.text", "string")
    items = F.try_variant_get(v, "$.items", "array<string>")
    d = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return blocks.select(
        DOC, "ord", "block_id", "block_type", F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce(F.array_join(items, ", "), F.lit(""))).alias("text"),
        d("x", 0.0).alias("x"), d("y", 0.0).alias("y"), d("width", 100.0).alias("width"), d("height", 30.0).alias("height"), F.col("x").isNotNull().alias("has_box"))


def rendered_blocks(pages: DataFrame, array: str = "blocks") -> DataFrame:
    """Render index, first and last flags, hierarchy level and spacing from the previous block.

    Blocks come as an ordered array of (ord, block_type, level) per document.
    """
    b = F.col(array)
    rows = F.transform(b, lambda e, i: F.struct(e.alias("e"), F.try_element_at(b, F.when(i > 0, i))["block_type"].alias("before"), (i == F.size(b) - 1).alias("last")))
    out = unnest_at(pages, rows, DOC, pos="render_index", item="r")
    t, before, i = F.col("r.e.block_type"), F.col("r.before"), F.col("render_index")
    level = F.when((t == "header") & (F.coalesce(F.col("r.e.level"), F.lit(0)) > 0), F.col("r.e.level")).when(t == "table", 3).when(t == "image", 4).otherwise(5)
    spacing = (F.when(i == 0, "none").when(before == "header", "large").when(before == "table", "medium").when(t == "header", "medium")
               .when((t == "paragraph") & (before == "paragraph"), "small").otherwise("medium"))
    return out.select(DOC, F.col("r.e.ord").alias("ord"), "render_index", (i == 0).alias("is_first"), F.col("r.last").alias("is_last"),
                      level.alias("hierarchy_level"), spacing.alias("spacing"))


def repeated_ids(pages: DataFrame, ids: str = "ids") -> DataFrame:
    """Blocks whose non-empty id already occurred earlier in the same document; equal ids are neighbours after a sort."""
    by_id = F.array_sort(F.transform(ids, lambda x, i: F.struct(x.alias("block_id"), i.alias("index"))))
    again = lambda xs: F.filter(F.transform(xs, lambda x, k: F.struct(
        x["index"].alias("index"), x["block_id"].alias("block_id"), ((x["block_id"] != "") & (F.get(xs, k - 1)["block_id"] == x["block_id"])).alias("again"))), lambda x: x["again"])
    return unnest(pages, let(by_id, again), DOC, guard="index").select(DOC, "index", "block_id")


def document_text(pages: DataFrame, array: str = "blocks") -> DataFrame:
    """Plain text of a document: paragraph, header, table and list text joined by blank lines.

    Blocks come as an ordered array of (block_type, text, html, items).
    """
    def texts(e: Column) -> Column:
        one = F.when(e["block_type"].isin("paragraph", "header"), e["text"]).when(e["block_type"] == "table", html_text(e["html"]))
        return F.when(e["block_type"] == "list", e["items"]).otherwise(F.filter(F.array(one), lambda t: t.isNotNull() & (t != "")))

    joined = F.array_join(F.flatten(F.transform(array, lambda e: F.coalesce(texts(e), F.array().cast("array<string>")))), "\n\n")
    return pages.select(DOC, joined.alias("text"))


def _name(v: Column) -> Column:
    head = F.element_at(F.split(F.schema_of_variant(v), "[<(]"), 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NODE_NAMES.items() for x in kv]), head), F.when(v.isNotNull(), "float"))


def _field_checks(kind: str) -> list[Column]:
    """Error or warning structs of the declared fields of one block type."""
    out = []
    say = lambda sev, *parts: F.struct(F.lit(sev).alias("severity"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("message"))
    items, content = F.col("items_v"), F.col("content_v")
    limits = {
        ("header", "level"): F.try_variant_get("level", "$", "bigint").between(1, 6),
        ("header", "text"): strip(F.try_variant_get("text", "$", "string")) != "",
        ("table", "content"): (F.size(content) > 0) & F.forall(content, lambda r: _name(r) == "list"),
        ("list", "style"): F.try_variant_get("style", "$", "string").isin("ordered", "unordered"),
        ("list", "items"): (F.size(items) > 0) & F.forall(items, lambda r: _name(r) == "str"),
        ("image", "file"): F.col("file_ok"),
    }
    for name, want in FIELD_TYPES[kind].items():
        got = F.col(f"{name}_t")
        fits = got.isin("int", "bool") if want == "int" else got == want
        if name in REQUIRED[kind]:
            out.append(F.when(got.isNull(), say("error", f"Missing required field '{name}' for {kind} block"))
                       .when(~fits, say("error", f"Field '{name}' must be of type {want}, got ", got)))
            if (kind, name) in limits:
                out.append(F.when(fits & ~F.coalesce(limits[kind, name], F.lit(False)), say("error", f"Field '{name}' violates constraint for {kind} block")))
        else:
            out.append(F.when(got.isNotNull() & ~fits, say("warning", f"Optional field '{name}' should be of type {want}")))
    return out


def validated_blocks(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row per error or warning of each block: structure, declared fields, type rules and metadata.

    Needs ``index``, ``block_id``, ``block_type`` and ``data``, ``metadata`` as JSON text.
    """
    cols = keep or (DOC, "index")
    names = sorted({n for f in FIELD_TYPES.values() for n in f})
    d = F.col("_d")
    fields = blocks.select(*cols, "block_id", "block_type", F.try_parse_json("data").alias("_d"), F.try_parse_json("metadata").alias("_m"))
    fields = fields.select("*", *[F.try_variant_get(d, f"$.{n}", "variant").alias(n) for n in names])
    fields = fields.select(
        "*", *[_name(F.col(n)).alias(f"{n}_t") for n in names],
        F.coalesce(F.try_variant_get("items", "$", "array<variant>"), F.array().cast("array<variant>")).alias("items_v"),
        F.coalesce(F.try_variant_get("content", "$", "array<variant>"), F.array().cast("array<variant>")).alias("content_v"),
        (F.try_variant_get("file", "$.url", "variant").isNotNull() | F.try_variant_get("file", "$.width", "variant").isNotNull()
         | F.try_variant_get("file", "$.height", "variant").isNotNull()).alias("file_ok"),
        *[_name(F.try_variant_get("file", f"$.{k}", "variant")).alias(f"file_{k}") for k in ("url", "width", "height")],
        *[_name(F.try_variant_get("_m", f"$.{k}", "variant")).alias(f"m_{k}") for k in RECOMMENDED],
        F.try_variant_get("_m", "$.confidence", "double").alias("m_value"), _name(F.col("_m")).alias("m_t"))
    say = lambda sev, *parts: F.struct(F.lit(sev).alias("severity"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("message"))
    t = F.col("block_type")
    structure = [F.when(F.coalesce("block_id", F.lit("")) == "", say("error", "Missing or empty 'id' field")),
                 F.when(F.coalesce(t, F.lit("")) == "", say("error", "Missing or empty 'type' field"))
                 .when(~t.isin(*FIELD_TYPES), say("error", "Unsupported block type '", t, "'")),
                 F.when(d.isNull(), say("error", "Missing 'data' field")).when(_name(d) != "dict", say("error", "Field 'data' must be a dictionary"))]
    some = lambda a: F.filter(F.array(*a), lambda e: e.isNotNull())
    none = F.array().cast("array<struct<severity:string,message:string>>")
    by_type = None
    for kind in FIELD_TYPES:
        arm = some(_field_checks(kind))
        by_type = F.when(t == kind, arm) if by_type is None else by_type.when(t == kind, arm)

    # Rules that only one type has.
    rows, first = F.col("content_v"), F.try_element_at("content_v", F.lit(1))
    cells = lambda r: F.try_variant_get(r, "$", "array<variant>")
    wide = F.coalesce(F.size(cells(first)), F.lit(0))
    per_row = F.flatten(F.transform(rows, lambda r, i: F.when(_name(r) != "list", F.array(say("error", "Table row ", i.cast("string"), " must be a list"))).otherwise(F.concat(
        F.when(F.size(cells(r)) != wide, F.array(say("error", "Table row ", i.cast("string"), " has ", F.size(cells(r)).cast("string"), " columns, expected ", wide.cast("string")))).otherwise(none),
        F.transform(F.filter(F.transform(cells(r), lambda c, j: F.struct(_name(c).alias("t"), j.alias("j"))), lambda c: c["t"] != "str"),
                    lambda c: say("error", "Table cell [", i.cast("string"), "][", c["j"].cast("string"), "] must be a string"))))))
    table = F.when(F.col("content_t").isNull(), none).when((F.col("content_t") == "list") & (F.size(rows) == 0), F.array(say("error", "Table content cannot be empty"))).when(
        F.col("content_t") == "list", F.concat(F.when(wide == 0, F.array(say("error", "Table first row cannot be empty"))).otherwise(none), per_row)).when(
        F.col("content_t") == "str", F.array(say("error", "Table row 0 must be a list"))).otherwise(none)
    per_item = F.flatten(F.transform("items_v", lambda v, i: F.when(_name(v) != "str", F.array(say("error", "List item ", i.cast("string"), " must be a string"))).when(
        strip(F.try_variant_get(v, "$", "string")) == "", F.array(say("error", "List item ", i.cast("string"), " cannot be empty"))).otherwise(none)))
    listed = F.when(F.col("items_t").isNull(), none).when(F.size("items_v") == 0, F.array(say("error", "List items cannot be empty"))).otherwise(per_item)
    number = lambda c: F.col(c).isin("int", "float", "bool")
    image = F.when(F.col("file_t").isNull(), none).when(F.col("file_t") != "dict", F.array(say("error", "Image file field must be a dictionary"))).otherwise(some([
        F.when(~F.col("file_ok"), say("error", "Image file must contain at least one of: ['url', 'width', 'height']")),
        F.when(F.col("file_url") != "str", say("error", "Image file URL must be a string")), F.when(~number("file_width"), say("error", "Image file width must be a number")),
        F.when(~number("file_height"), say("error", "Image file height must be a number"))]))
    special = F.when(t == "table", table).when(t == "list", listed).when(t == "image", image).otherwise(none)
    meta = F.when(F.col("m_t").isNull(), none).when(F.col("m_t") != "dict", F.array(say("warning", "Metadata should be a dictionary"))).otherwise(some(
        [F.when(F.col(f"m_{k}").isNull(), say("warning", f"Missing recommended metadata field '{k}'")) for k in RECOMMENDED]
        + [F.when(F.col("m_confidence").isNotNull() & ~number("m_confidence"), say("warning", "Metadata confidence should be a number"))
           .when(~F.col("m_value").between(0.0, 1.0), say("warning", "Metadata confidence should be between 0.0 and 1.0"))]))
    checked = fields.select(*cols, some(structure).alias("_s"), by_type.alias("_f"), special.alias("_x"), meta.alias("_w"))
    found = checked.select(*cols, F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.concat(F.coalesce("_f", none), "_x", "_w")).alias("_e"))
    return found.select(*cols, F.explode_outer("_e").alias("e")).select(*cols, "e.severity", "e.message")


def verdicts(findings: DataFrame, documents: DataFrame, repeats: DataFrame) -> DataFrame:
    """Validity of each document from its block findings, repeated ids and header fields.

    ``documents`` holds ``time`` (positive) and ``version`` (not blank) per
    document. Findings and repeats are summed before they meet.
    """
    f = findings.select(DOC, (F.col("severity") == "error").cast("int").alias("err"), (F.col("severity") == "warning").cast("int").alias("warn"),
                        F.struct(F.col("index"), F.lit(0).alias("k")).alias("i"))
    r = repeats.select(DOC, F.lit(1).alias("err"), F.lit(0).alias("warn"), F.lit(None).cast("struct<index:bigint,k:int>").alias("i"))
    seen = f.withColumn("i", F.col("i").cast("struct<index:bigint,k:int>")).unionByName(r)
    sums = seen.groupBy(DOC).agg(F.coalesce(F.sum("err"), F.lit(0)).alias("block_errors"), F.coalesce(F.sum("warn"), F.lit(0)).alias("warnings"),
                                 (F.max("i.index") + 1).alias("block_count"))
    out = documents.join(sums, DOC, "left")
    fine = (F.col("time") > 0) & (strip("version") != "")
    heads = F.size(F.filter(F.array(~F.coalesce(F.col("time") > 0, F.lit(False)), ~F.coalesce(strip("version") != "", F.lit(False))), lambda x: x))
    # A broken header stops the block checks.
    n = F.when(fine, F.coalesce("block_errors", F.lit(0))).otherwise(F.lit(0))
    errors = heads + n
    return out.select(DOC, fine.alias("structure_valid"), (n == 0).alias("blocks_valid"), (errors == 0).alias("is_valid"), errors.alias("errors"),
                      F.when(fine, F.coalesce("warnings", F.lit(0))).otherwise(0).alias("warnings"), F.when(fine, F.coalesce("block_count", F.lit(0))).otherwise(0).alias("block_count"))


def verdict_report(verdict: DataFrame) -> DataFrame:
    """Readable summary of a verdict."""
    t = lambda c: F.initcap(F.col(c).cast("string"))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Editor.js Schema Validation Report - "), F.when(F.col("is_valid"), "PASSED").otherwise("FAILED")), F.lit("=" * 50),
        F.concat(F.lit("Total Blocks: "), F.col("block_count")), F.concat(F.lit("Errors: "), F.col("errors")), F.concat(F.lit("Warnings: "), F.col("warnings")), F.lit(""),
        F.lit("Validation Details:"), F.concat(F.lit("  Structure Valid: "), t("structure_valid")), F.concat(F.lit("  Blocks Valid: "), t("blocks_valid")))
    return verdict.withColumn("report", lines)
