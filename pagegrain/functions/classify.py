"""Rules that name or grade a piece of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions.text import contains_any, is_upper, lines_of, starts_any, strip

# Bullets, heading keywords by level, font sizes and error keywords.
BULLETS = ["•", "-", "*", "○", "▪", "▫"]
HEADING_WORDS = {
    1: ["title", "主题", "标题", "chapter", "章节"],
    2: ["section", "部分", "节", "subtitle", "副标题"],
    3: ["subsection", "小节", "子部分"],
    4: ["subsubsection", "子小节"],
    5: ["paragraph", "段落标题"],
    6: ["subparagraph", "子段落"],
}
FONT_SIZES = [8, 9, 10, 11, 12, 14, 16, 18, 20, 24, 28, 32, 36, 48, 72]
ERROR_RULES = [
    ("validation_error", ["validation", "value", "type"], ["invalid", "unsupported", "format", "size"]),
    ("processing_error", ["ocr", "pdf", "processing"], ["corrupt", "extract", "analyze", "convert"]),
    ("network_error", ["connection", "timeout", "network"], ["connection", "timeout", "network", "unreachable"]),
    ("resource_error", ["memory", "disk", "resource"], ["memory", "disk", "space", "resource"]),
    ("authentication_error", ["auth", "permission", "access"], []),
]
ERROR_STATUS = {"validation_error": 400, "authentication_error": 401, "resource_error": 503, "network_error": 408}
ERROR_MESSAGES = {
    "file_type": "The uploaded file format is not supported.",
    "file_size": "The uploaded file is too large.",
    "file_empty": "The uploaded file appears to be empty.",
    "validation_error": "The uploaded file could not be validated.",
    "pdf_locked": "The PDF file is password-protected.",
    "pdf_corrupt": "The PDF file appears to be corrupted.",
    "ocr": "Text recognition processing failed.",
    "processing_error": "Document processing encountered an error.",
    "network_error": "A network connection error occurred.",
    "resource_error": "The system is currently experiencing high load.",
    "authentication_error": "Access to this resource is not authorized.",
    "system_error": "An unexpected system error occurred.",
}
ERROR_GUIDANCE = {
    "file_type": "Please upload a PDF, JPG, or PNG file and try again.",
    "file_size": "Please upload a file smaller than 10MB.",
    "file_empty": "Please check your file and upload a valid document.",
    "validation_error": "Please ensure your file is a valid PDF, JPG, or PNG document.",
    "pdf_locked": "Please remove the password protection and try again.",
    "pdf_corrupt": "Please try uploading a different PDF file.",
    "ocr": "This may be due to poor image quality or complex layouts.",
    "processing_error": "This may be temporary. Please try again in a few moments.",
    "network_error": "Please check your internet connection and try again.",
    "resource_error": "Please wait a few minutes and try again.",
    "authentication_error": "Please check your permissions or contact support.",
    "system_error": "This appears to be a temporary issue with our service.",
}
ERROR_ACTIONS = {
    "file_type": "Select a different file with a supported format.",
    "file_size": "Compress your file or select a smaller file.",
    "file_empty": "Select a different file that contains content.",
    "validation_error": "Try uploading a different file or check the file integrity.",
    "pdf_locked": "Upload an unencrypted version of your PDF.",
    "pdf_corrupt": "Check the file integrity or try saving the PDF again.",
    "ocr": "Try uploading a higher quality scan or a simpler document layout.",
    "processing_error": "If the problem persists, try uploading a different document.",
    "network_error": "Refresh the page and retry your upload.",
    "resource_error": "Try again later when system resources are available.",
    "authentication_error": "Verify your access rights or contact an administrator.",
    "system_error": "Please try again later. If the problem persists, contact support.",
}
RETRY_WORDS = ["connection", "timeout", "network", "unavailable", "temporary", "rate limit", "too many requests"]
RETRY_STATUS = [408, 429, 500, 502, 503, 504]
NUMBERED = r"^\p{Nd}[^.]{0,3}\."


def list_items(text: Column) -> Column:
    """Items of a list text: one per line, bullet and short number prefix removed."""
    def item(line: Column) -> Column:
        bare = F.when(line.rlike(r"^[•\-*○▪▫]"), strip(F.substring(line, 2, 1 << 30))).otherwise(line)
        return F.when(bare.rlike(NUMBERED), strip(F.regexp_replace(bare, r"^[^.]*\.", ""))).otherwise(bare)

    items = F.filter(F.transform(lines_of(text), lambda l: item(strip(l))), lambda i: i != "")
    return F.when(F.size(items) > 0, items).otherwise(F.array(text))


def list_style(text: Column) -> Column:
    """Ordered when more than half of all lines are numbered, judged by the first five."""
    lines = lines_of(text)
    numbered = F.size(F.filter(F.slice(lines, 1, 5), lambda l: strip(l).rlike(NUMBERED)))
    return F.when(numbered > F.size(lines) / 2, "ordered").otherwise("unordered")


def header_level(text: Column, y: Column) -> Column:
    low, n = F.lower(text), F.length(text)
    out = None
    for level, found in HEADING_WORDS.items():
        hit = contains_any(low, found)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return (out.when((y < 100) & (n < 30), 1).when(y < 100, 2).when(n < 20, 3).when(n < 40, 4).otherwise(5))


def _is_list(text: Column) -> Column:
    return (starts_any(text, BULLETS) | text.rlike(r"^([1-9]|1[0-9])\.")
            | text.rlike(r"\n[•\-*○▪▫]") | text.rlike(r"\n([1-9]|1[0-9])\."))


def region_class(content: Column, y: Column) -> Column:
    """Class of a region from its text and top edge."""
    text = strip(content)
    head = (F.length(text) < 100) & (is_upper(text) | F.substring(text, 1, 10).rlike(r"\p{Nd}") | (y < 100))
    return F.when(content.isNull() | (text == ""), "image").when(_is_list(text), "list").when(head, "header").otherwise("paragraph")


def refined_class(content: Column, y_ratio: Column, width_ratio: Column, height_ratio: Column) -> Column:
    """Class of a region from its text and its place on the page."""
    text = strip(content)
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    head = (y_ratio < 0.2) | ((F.length(text) < 80) & (
        is_upper(text) | contains_any(F.lower(text), ["title", "chapter", "section"]) | (width_ratio > 0.6)))
    grid = (F.contains(text, F.lit("\t")) | F.contains(text, F.lit("|")) | (spaces > F.length(text) * 0.3)) & (height_ratio > 0.1)
    return (F.when(content.isNull() | (content == ""), "image").when(_is_list(text), "list")
            .when(head, "header").when(grid, "table").otherwise("paragraph"))


def font_size(content: Column, height: Column) -> Column:
    """Estimated font size snapped to the nearest common size; the smaller wins a tie."""
    n_lines = F.greatest(F.lit(1), F.size(lines_of(strip(content))))
    raw = F.greatest(F.lit(8), F.least(F.lit(72), (height / n_lines * 0.75).cast("int")))
    near = [F.struct(F.abs(raw - s).alias("gap"), F.lit(s).alias("size")) for s in FONT_SIZES]
    return F.when(content.isNull() | (content == "") | height.isNull(), 14).otherwise(F.array_min(F.array(*near))["size"])


def answer_confidence(answer: Column) -> Column:
    return F.when(contains_any(answer, ["未找到", "没有", "不确定"]), 0.3).when(F.length(answer) > 50, 0.9).otherwise(0.8)


def qa_confidence(parsed: Column, found: Column, n_references: Column) -> Column:
    return F.when(~parsed, 0.3).when(F.coalesce(found, F.lit(True)) & (n_references > 0), 0.9).otherwise(0.5)


def error_category(error_type: Column, message: Column) -> Column:
    """Category by type keywords then message keywords, in a fixed order."""
    kind, msg = F.lower(error_type), F.lower(message)
    out = None
    for name, in_type, in_message in ERROR_RULES:
        hit = contains_any(kind, in_type) | contains_any(msg, in_message)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("system_error")


def error_severity(category: Column, message: Column) -> Column:
    msg = F.lower(message)
    return (F.when((category == "system_error") & contains_any(msg, ["critical", "fatal", "crash"]), "critical")
            .when(category.isin("resource_error", "authentication_error"), "high")
            .when(contains_any(msg, ["corrupt", "failed", "error"]), "high")
            .when(category.isin("processing_error", "network_error"), "medium").otherwise("low"))


def error_status(category: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, code in ERROR_STATUS.items():
        out = out.when(category == name, code)
    return out.otherwise(500)


def error_reason(category: Column, message: Column) -> Column:
    """Key of the message shown to a user."""
    m = F.lower(message)
    has = lambda *w: contains_any(m, list(w))
    v, p = category == "validation_error", category == "processing_error"
    return (F.when(v & has("file type", "unsupported"), "file_type").when(v & has("size", "limit"), "file_size")
            .when(v & has("empty"), "file_empty").when(p & has("pdf") & has("encrypted"), "pdf_locked")
            .when(p & has("pdf") & has("corrupt"), "pdf_corrupt").when(p & has("ocr"), "ocr").otherwise(category))


def error_texts(reason: Column) -> list[Column]:
    def pick(d: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[reason]
    return [pick(ERROR_MESSAGES).alias("message"), pick(ERROR_GUIDANCE).alias("guidance"), pick(ERROR_ACTIONS).alias("action")]


def retryable(message: Column, status: Column | None = None) -> Column:
    """Worth another try: by status code where there is one, else by message."""
    by_text = contains_any(F.lower(message), RETRY_WORDS)
    return by_text if status is None else F.when(status.isNotNull(), status.isin(RETRY_STATUS)).otherwise(by_text)


def backoff_delay(attempt: Column, strategy: Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0,
                  jitter: float = 0.0, seed: int = 0) -> Column:
    """Seconds before the next attempt (0-based), capped, with optional relative jitter."""
    raw = (F.when(strategy == "exponential_backoff", F.pow(F.lit(factor), attempt) * base)
           .when(strategy == "linear_backoff", (attempt + 1) * base).when(strategy == "fixed_delay", base).otherwise(0.0))
    delay = F.least(raw, F.lit(cap))
    return delay if jitter == 0 else F.greatest(F.lit(0.0), delay * (F.lit(1.0) + (F.rand(seed) * 2 - 1) * jitter))
