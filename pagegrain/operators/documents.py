"""Whole-document text: anchored Markdown, its inverse, HTML, corrections and reports.

Each document is read from its own item array, so the ordered joins need no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import markdown
from pagegrain.functions.arrays import scan, unnest_at
from pagegrain.functions.clean import let
from pagegrain.functions.text import strip

DOC = "doc_id"


def anchored_parts(pages: DataFrame, items: str = "items") -> DataFrame:
    """Per document the ordered array of (ord, block_id, box, anchor, content, position).

    ``position`` is where the anchor starts in the emitted Markdown.
    """
    def part(i: Column, n: Column) -> Column:
        x, y = i["x1"].cast("int"), i["y1"].cast("int")
        w, h = i["x2"].cast("int") - x, i["y2"].cast("int") - y
        ident = markdown.block_id(n)
        return F.struct(i["ord"].alias("ord"), ident.alias("block_id"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"),
                        markdown.anchor(ident, x, y, w, h).alias("anchor"), markdown.block_markdown(i["type"], i["text"], i["html"]).alias("content"))

    parts = pages.withColumn("parts", F.transform(items, part))
    size = lambda p: F.length(p["anchor"]) + 1 + F.when(p["content"] != "", F.length(p["content"]) + 1).otherwise(0) + 1
    fold = scan(F.col("parts"), {"at": F.lit(0)}, lambda s, p: {"at": s["at"] + size(p), "emit": s["at"]}, "int")
    return parts.withColumn("offsets", fold).select(DOC, F.zip_with("parts", "offsets", lambda p, o: F.struct(
        p["ord"], p["block_id"], p["x"], p["y"], p["width"], p["height"], p["anchor"], p["content"], o.alias("position"))).alias("parts"))


def anchored_markdown(parts: DataFrame) -> DataFrame:
    lines = F.flatten(F.transform("parts", lambda p: F.concat(
        F.array(p["anchor"]), F.when(p["content"] != "", F.array(p["content"])).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))))
    return parts.select(DOC, F.array_join(lines, "\n").alias("markdown"))


def plain_markdown(pages: DataFrame, items: str = "items", **dialects: str) -> DataFrame:
    """Document Markdown, a column a dialect: the non-empty blocks, each followed by a blank line."""
    def text(dialect: str) -> Column:
        blocks = F.filter(F.transform(items, lambda i: markdown.block_markdown(i["type"], i["text"], i["html"], dialect)), lambda b: b != "")
        return F.array_join(F.flatten(F.transform(blocks, lambda b: F.array(b, F.lit("")))), "\n")

    return pages.select(DOC, *(text(d).alias(name) for name, d in (dialects or {"markdown": "file"}).items()))


def raw_markdown(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """Markdown of raw lines: trimmed non-empty texts as paragraphs."""
    texts = F.filter(F.transform(lines, lambda l: strip(l["text"])), lambda t: t != "")
    return pages.select(DOC, F.array_join(texts, "\n\n").alias("markdown"))


def anchors(documents: DataFrame, text: str = "markdown") -> DataFrame:
    rows = unnest_at(documents, markdown.parsed_anchors(F.col(text)), DOC, pos="n", item="a")
    return rows.select(DOC, "n", "a.*")


def markdown_blocks(documents: DataFrame, text: str = "markdown") -> DataFrame:
    rows = unnest_at(documents, markdown.markdown_runs(F.col(text)), DOC, pos="index", item="run")
    flat = rows.select(DOC, "index", "run.kind", "run.lines")
    return flat.select(DOC, "index", *markdown.run_block(F.col("kind"), F.col("lines")))


def html_fragments(pages: DataFrame, items: str = "items") -> DataFrame:
    box = lambda i: F.concat(F.lit('{"x": '), i["x1"].cast("string"), F.lit(', "y": '), i["y1"].cast("string"), F.lit(', "x2": '), i["x2"].cast("string"), F.lit(', "y2": '), i["y2"].cast("string"), F.lit("}"))
    parts = F.filter(F.transform(items, lambda i, n: markdown.html_fragment(n, i["type"], i["text"], i["html"], box(i))), lambda h: h != "")
    return pages.select(DOC, F.array_join(parts, "\n").alias("html"))


def anchor_lookup(requests: DataFrame, anchor_rows: DataFrame) -> DataFrame:
    """First position of each requested block in its document; -1 when it is absent."""
    first = anchor_rows.groupBy(DOC, "block_id").agg(F.min("position").alias("position"))
    return requests.join(first, [DOC, "block_id"], "left").withColumn("position", F.coalesce("position", F.lit(-1)))


def corrected_text(pages: DataFrame, corrections: DataFrame, regions: str = "regions", order: tuple[str, ...] = ()) -> DataFrame:
    """Final text of a document: corrected text where there is a correction, even an empty one.

    Of several corrections of a block the last by ``order`` counts, without one the
    text that sorts last; so a document has one per block, and its map is as small
    as its blocks.
    """
    last = F.max_by("corrected", F.struct(*order)) if order else F.max("corrected")
    latest = corrections.where(F.col("block_index").isNotNull()).groupBy(DOC, "block_index").agg(last.alias("corrected"))
    by_doc = latest.groupBy(DOC).agg(F.map_from_entries(F.collect_list(F.struct("block_index", "corrected"))).alias("_m"))
    joined = pages.join(by_doc, DOC, "left")
    m = F.col("_m")
    texts = F.transform(regions, lambda r, i: F.when(F.coalesce(F.map_contains_key(m, i), F.lit(False)), F.try_element_at(m, i)).otherwise(F.coalesce(r["text"], F.lit(""))))
    blocks = F.filter(F.transform(regions, lambda r: F.coalesce(F.nullif(r["text"], F.lit("")), F.array_join(r["items"], ", "), F.lit(""))), lambda t: t != "")
    whole = let(strip(F.array_join(texts, "\n\n")), lambda t: F.when(t != "", t).otherwise(F.array_join(blocks, "\n\n")))
    return joined.select(DOC, whole.alias("text"))


# Headings, labels and rules of the confidence log. A rule is a line of its own.
LOG_TITLE = "# 置信度计算详细日志\n\n**任务 ID**: `%s`\n"
LOG_WRITTEN = "**生成时间**: %s\n"
LOG_TIMES = "\n---\n## 处理时间信息\n\n"
LOG_STARTED = "- **开始时间**: %s\n"
LOG_ENDED = "- **结束时间**: %s\n"
LOG_SECONDS = "- **处理耗时**: %.2fs\n"
LOG_OVERVIEW = "\n---\n## 1. 区域概览\n\n- **总区域数**: %d\n- **有置信度的区域**: %d\n- **无置信度的区域**: %d\n- **置信度覆盖率**: %s\n"
LOG_REGIONS = "\n---\n## 2. 各区域置信度详情\n\n"
LOG_REGION_HEAD = "| 序号 | 类型 | 位置 (x,y) | 尺寸 (w×h) | 置信度 | 内容预览 |\n|------|------|------------|------------|--------|----------|\n"
LOG_REGION = "| %d | %s | (%s, %s) | %s×%s | %s | %s |"
LOG_NO_REGIONS = "*无识别区域*"
LOG_NONE = "无"
LOG_TEXT = "\n\n---\n## 3. 文本置信度计算\n\n"
LOG_TEXT_VALUE = "  区域 %d: %s"
LOG_TEXT_SUM = ("### 3.1 有效置信度值列表\n\n```\n%s\n```\n\n### 3.2 计算过程\n\n```\n文本置信度 = 所有有效置信度的平均值\n"
                "           = (%s) / %d\n           = %s / %d\n           = %s\n```\n")
LOG_NO_TEXT = "*无有效置信度数据，文本置信度 = 0.0*\n"
LOG_LAYOUT = "\n---\n## 4. 布局置信度计算\n\n"
LOG_LAYOUT_SUM = ("### 4.1 类型多样性因子\n\n- 检测到的区域类型: %s\n- 类型数量: %d\n- 多样性评分规则: ≥3种类型=1.0, 2种类型=0.9, 1种类型=0.7\n- **类型多样性因子**: %.2f\n\n"
                  "### 4.2 尺寸合理性因子\n\n- 合理尺寸范围: 50 < 面积 < 10,000,000 像素\n- 合理尺寸区域数: %d / %d\n- **尺寸合理性因子**: %s\n\n"
                  "### 4.3 内容质量因子\n\n- 有效内容标准: 内容长度 > 3 字符\n- 有效内容区域数: %d / %d\n- **内容质量因子**: %s\n\n"
                  "### 4.4 布局置信度计算\n\n```\n布局置信度 = 内容质量因子 × 0.5 + 尺寸合理性因子 × 0.3 + 类型多样性因子 × 0.2\n"
                  "           = %s × 0.5 + %s × 0.3 + %s × 0.2\n           = %s + %s + %s\n           = %s\n```\n")
LOG_NO_LAYOUT = "*无区域数据，布局置信度 = 0.0*\n"
LOG_OVERALL = "\n---\n## 5. 总体置信度计算\n\n"
LOG_BASE = ("### 5.1 基础置信度\n\n```\n基础置信度 = 文本置信度 × 0.7 + 布局置信度 × 0.3\n           = %s × 0.7 + %s × 0.3\n           = %s + %s\n           = %s\n```\n\n"
            "### 5.2 覆盖率惩罚\n\n- 置信度覆盖率: %s (%s)\n- 惩罚规则: 覆盖率 < 50%% 时开始惩罚\n")
LOG_PENALTY = "- 惩罚因子 = min(1.0, %s / 0.5) = %s\n"
LOG_NO_PENALTY = "- 覆盖率 ≥ 50%，无惩罚，惩罚因子 = 1.0\n"
LOG_FINAL = ("\n### 5.3 最终计算\n\n```\n总体置信度 = 基础置信度 × (0.5 + 0.5 × 惩罚因子)\n           = %s × (0.5 + 0.5 × %s)\n           = %s × %s\n           = %s\n```\n")
LOG_NO_OVERALL = "*无区域数据，总体置信度 = 0.0*\n"
LOG_SUMMARY = ("\n---\n## 6. 结果汇总\n\n| 指标 | 值 |\n|------|-----|\n| 总区域数 | %d |\n| 有置信度区域 | %d |\n| 无置信度区域 | %d |\n| 置信度覆盖率 | %s |\n"
               "| 文本置信度 | %s |\n| 布局置信度 | %s |\n| **总体置信度** | **%s** |\n")


def figure(c: Column) -> Column:
    """A number of the log: twelve decimals at most, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.12f", c), r"(\.\d+?)0+$", "$1")


def confidence_log(pages: DataFrame, regions: str = "regions", kind: str = "type", preview: int = 30, written: Column | None = None,
                   started: Column | None = None, ended: Column | None = None, seconds: Column | None = None) -> DataFrame:
    """Confidence log of a document as Markdown: its regions and each step from their scores to the overall one.

    ``kind`` names the field that holds a region's type; types are listed in order of
    appearance, unknown ones do not count. Times are left out where no column is
    given or its value is null. A document without regions gets the log that says so.
    All steps read the record's own array, so nothing is shuffled or gathered.
    """
    r = F.coalesce(F.col(regions), F.array().cast(pages.schema[regions].dataType))
    fs = F.format_string
    one, zero = F.lit(1.0), F.lit(0.0)
    whole = lambda c: fs("%.0f", c)
    optional = lambda text, c: F.lit("") if c is None else F.coalesce(F.when(c.isNotNull(), fs(text, c)), F.lit(""))
    percent = lambda n, k: F.when(n > 0, fs("%.1f%%", F.bround(k * 100.0 / n, 1))).otherwise("0%")

    def row(x: Column, i: Column) -> Column:
        text = F.coalesce(x["content"], F.lit(""))
        text = F.when(F.length(text) > preview, F.concat(F.substring(text, 1, preview), F.lit("..."))).otherwise(text)
        text = F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        conf = F.when(x["confidence"].isNull(), LOG_NONE).otherwise(figure(x["confidence"]))
        return fs(LOG_REGION, i + 1, x[kind], whole(x["x1"]), whole(x["y1"]), whole(x["x2"] - x["x1"]), whole(x["y2"] - x["y1"]), conf, text)

    def holds(cond) -> Column:
        return F.size(F.filter(r, lambda x: F.coalesce(cond(x), F.lit(False))))

    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    scores = F.transform(F.filter(r, lambda x: x["confidence"] > 0), lambda x: x["confidence"])
    counted = F.struct(
        F.size(r).alias("n"), scores.alias("scores"), F.size(scores).alias("k"), F.aggregate(scores, zero, lambda a, c: a + c).alias("total"),
        F.array_compact(F.array_distinct(F.transform(r, lambda x: x[kind]))).alias("kinds"),
        holds(lambda x: (area(x) > 50) & (area(x) < 10000000)).alias("fair"), holds(lambda x: F.length(strip(x["content"])) > 3).alias("said"))

    def factors(c: Column) -> Column:
        share = lambda k: F.when(c["n"] > 0, k / c["n"]).otherwise(zero)
        types = F.size(c["kinds"])
        return F.struct(*(c[f].alias(f) for f in ("n", "scores", "k", "total", "kinds", "fair", "said")),
                        F.when(c["k"] > 0, c["total"] / c["k"]).otherwise(zero).alias("text"), share(c["fair"]).alias("size"), share(c["said"]).alias("content"),
                        share(c["k"]).alias("cover"), F.when(types >= 3, 1.0).when(types == 2, 0.9).otherwise(0.7).alias("variety"))

    def scored(f: Column) -> Column:
        layout = F.when(f["n"] > 0, f["content"] * 0.5 + f["size"] * 0.3 + f["variety"] * 0.2).otherwise(zero)
        return F.struct(f.alias("f"), layout.alias("layout"), (f["text"] * 0.7 + layout * 0.3).alias("base"), F.least(one, f["cover"] / 0.5).alias("penalty"))

    def log(s: Column) -> Column:
        f, layout, base, penalty = s["f"], s["layout"], s["base"], s["penalty"]
        n, k, none = f["n"], f["k"], f["n"] == 0
        share = percent(n, k)
        overall = F.when(none, zero).otherwise(base * (penalty * 0.5 + 0.5))
        shown = F.transform(f["scores"], figure)
        values = F.transform(shown, lambda c, i: fs(LOG_TEXT_VALUE, i + 1, c))
        text = F.when(k > 0, fs(LOG_TEXT_SUM, F.array_join(values, "\n"), F.array_join(shown, " + "), k, figure(f["total"]), k, figure(f["text"])))
        parts = (f["content"] * 0.5, f["size"] * 0.3, f["variety"] * 0.2)
        shaped = fs(LOG_LAYOUT_SUM, F.array_join(f["kinds"], ", "), F.size(f["kinds"]), f["variety"], f["fair"], n, figure(f["size"]), f["said"], n, figure(f["content"]),
                    *(figure(f[x]) for x in ("content", "size", "variety")), *(figure(x) for x in parts), figure(layout))
        summed = F.concat(fs(LOG_BASE, figure(f["text"]), figure(layout), figure(f["text"] * 0.7), figure(layout * 0.3), figure(base), figure(f["cover"]), share),
                          F.when(f["cover"] < 0.5, fs(LOG_PENALTY, figure(f["cover"]), figure(penalty))).otherwise(LOG_NO_PENALTY),
                          fs(LOG_FINAL, figure(base), figure(penalty), figure(base), figure(penalty * 0.5 + 0.5), figure(overall)))
        return F.concat(
            fs(LOG_TITLE, F.col(DOC)), optional(LOG_WRITTEN, written), F.lit(LOG_TIMES), optional(LOG_STARTED, started), optional(LOG_ENDED, ended), optional(LOG_SECONDS, seconds),
            fs(LOG_OVERVIEW, n, k, n - k, share), F.lit(LOG_REGIONS),
            F.when(none, LOG_NO_REGIONS).otherwise(F.concat(F.lit(LOG_REGION_HEAD), F.array_join(F.transform(r, row), "\n"))),
            F.lit(LOG_TEXT), F.coalesce(text, F.lit(LOG_NO_TEXT)), F.lit(LOG_LAYOUT), F.when(none, LOG_NO_LAYOUT).otherwise(shaped),
            F.lit(LOG_OVERALL), F.when(none, LOG_NO_OVERALL).otherwise(summed),
            fs(LOG_SUMMARY, n, k, n - k, share, figure(f["text"]), figure(layout), figure(overall)))

    return pages.select(DOC, let(let(let(counted, factors), scored), log).alias("log"))
