"""Label dictionaries and confidence bands."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label dictionaries that results must agree with.
MODEL_TO_ITEM = {
    "table": "table", "figure": "figure", "figure_title": "figure_caption", "text": "text",
    "title": "title", "header": "header", "footer": "footer", "reference": "reference",
    "equation": "equation", "table_title": "table_caption", "chart": "figure", "seal": "figure",
    "doc_title": "doc_title", "paragraph_title": "title",
}
ITEM_TO_REGION = {
    "table": "table", "text": "paragraph", "title": "header", "header": "header", "footer": "paragraph",
    "figure": "image", "figure_caption": "paragraph", "table_caption": "paragraph",
    "reference": "paragraph", "equation": "paragraph", "chart": "image", "seal": "image",
}
RAW_TO_DISPLAY = {
    "text": "text", "title": "title", "doc_title": "title", "table": "table", "figure": "figure",
    "figure_caption": "caption", "list": "list", "reference": "reference", "header": "header",
    "footer": "footer", "equation": "equation",
}
REGION_TO_BLOCK = {
    "header": "header", "paragraph": "paragraph", "table": "table", "list": "list", "image": "image",
}
STAGE_TO_STATUS = {"completed": "completed", "failed": "failed"}
# Lower bounds of the confidence bands, best first, then the rest.
BANDS = {
    "monitor": ([(0.90, "excellent"), (0.75, "good"), (0.60, "fair"), (0.40, "poor")], "very_poor"),
    "cached": ([(0.95, "excellent"), (0.85, "good"), (0.70, "fair")], "poor"),
    "colour": ([(0.9, "#28a745"), (0.8, "#ffc107")], "#dc3545"),
}


def map_label(c: Column, pairs: dict[str, str], default: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(table, c), fallback)


def item_type(label: Column) -> Column:
    """Model label to layout item type; an unknown label keeps its own name."""
    return map_label(label, MODEL_TO_ITEM, label)


def region_type(item: Column, doc_title: str = "paragraph") -> Column:
    """Layout item type to region type; ``doc_title`` overrides where titles of that kind go."""
    return map_label(item, {**ITEM_TO_REGION, "doc_title": doc_title}, "paragraph")


def display_type(raw: Column) -> Column:
    return map_label(F.lower(raw), RAW_TO_DISPLAY, "text")


def block_type(region: Column) -> Column:
    return map_label(region, REGION_TO_BLOCK, "paragraph")


def job_status(stage: Column) -> Column:
    return map_label(stage, STAGE_TO_STATUS, "processing")


def confidence_band(score: Column, scale: str = "monitor") -> Column:
    """Name of the band a score falls in; the two named scales share level names."""
    bounds, rest = BANDS[scale]
    out = None
    for bound, name in bounds:
        out = F.when(score >= bound, name) if out is None else out.when(score >= bound, name)
    return out.otherwise(rest)
