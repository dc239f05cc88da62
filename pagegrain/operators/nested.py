"""Nested records walked level by level, without a schema known beforehand.

A level holds one row a value. Its containers are opened inside their row, each child
becomes a row of the next level, and the walk ends with the first level that has no
container. Only containers carry their content on, and a level is written before the
next one is made, so a record of any shape costs one narrow job a level and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.clean import let
from pagegrain.functions.text import middles, squeeze
from pagegrain.operators.integrity import BAD, SAFE_INTEGER, SIMILAR, bad_characters
from pagegrain.session import written

# Limits of the check, and the names of variant kinds; every other kind can't be written as JSON.
MAX_DEPTH, MAX_TEXT, MAX_ITEMS, MAX_SIZES = 100, 1_000_000, 10_000, 100_000
KINDS = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "VOID": "null", "DOUBLE": "float", "FLOAT": "float", "DECIMAL": "float"}
CONTAINERS = ("dict", "list")
SHREDDING = "spark.sql.variant.inferShreddingSchema"
ISSUE = "array<struct<severity:string,issue:string,path:string,detail:string>>"
NUMBERS = ("int", "float", "bool")


def kinds(rows: DataFrame, **of: str) -> DataFrame:
    """``rows`` with the kind of the variant column ``of[name]`` as column ``name``; null where it is null.

    The shape of a value is as long to find as the value, so it is a column of its own and found once.
    """
    def kind(shape: Column) -> Column:
        # Whole numbers beyond a long are decimals of 19 digits or more; 1.0 is a short decimal.
        out = F.when(shape.rlike("^DECIMAL.(19|[23][0-9]),0"), "int")
        for k, n in KINDS.items():
            out = out.when(F.startswith(shape, F.lit(k)), n)
        return F.when(shape.isNotNull(), out.otherwise(F.lower(F.element_at(F.split(shape, "[<(]"), 1))))

    shaped = rows.withColumns({f"_{n}": F.when(F.col(v).isNotNull(), F.schema_of_variant(v)) for n, v in of.items()})
    return shaped.withColumns({n: kind(F.col(f"_{n}")) for n in of}).drop(*[f"_{n}" for n in of])


def _get(v: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$', '{kind}')")


def _size(kind: Column, v: str) -> Column:
    return (F.when(kind == "dict", F.size(_get(v, "map<string,variant>"))).when(kind == "list", F.size(_get(v, "array<variant>")))
            .when(kind == "str", F.length(_get(v, "string"))))


def _issue(severity: str, issue: str, path: Column, when: Column, detail: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), path.alias("path"), text.alias("detail")))


def _text_issues(text: Column, path: Column) -> list[Column]:
    return [_issue("warning", "very_long", path, F.length(text) > MAX_TEXT, F.length(text)),
            _issue("warning", "control_characters", path, F.size(bad_characters(text)) > 0, F.array_join(bad_characters(text), ","))]


def _judged(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Kind, size and issues of the values in ``v``; content stays where it has to be opened."""
    kind, path, v = F.col("kind"), F.col("path"), "v"
    number, size = _get(v, "double"), F.col("size")
    deep = F.col("depth") > limit
    text = F.when(kind == "str", _get(v, "string"))
    found = [
        _issue("error", "too_deep", path, deep, F.col("depth")),
        *_text_issues(F.col("key"), F.concat(path, F.lit("(key)"))),
        *[F.when(~deep, i) for i in (
            _issue("error", "not_serialisable", path, ~kind.isin(*KINDS.values()), kind),
            *_text_issues(text, path),
            _issue("error", "nan", path, (kind == "float") & F.isnan(number)), _issue("error", "infinity", path, (kind == "float") & (F.abs(number) == float("inf"))),
            _issue("warning", "very_large", path, (kind == "float") & (F.abs(number) > 1e308) & (F.abs(number) < float("inf"))),
            _issue("warning", "unsafe_integer", path, (kind == "int") & (F.abs(_get(v, "decimal(38,0)")) > SAFE_INTEGER)),
            _issue("warning", "large_array", path, (kind == "list") & (size > MAX_ITEMS), size), _issue("warning", "large_object", path, (kind == "dict") & (size > MAX_ITEMS), size))]]
    # Most values have no issue: whether one can be is told from the value by its kind alone, and the list is made for those where it can.
    odd = lambda t: (F.length(t) > MAX_TEXT) | t.rlike(BAD)
    suspect = (deep | F.coalesce(odd(F.col("key")), F.lit(False)) | F.when(kind == "str", odd(text)).when(kind == "float", F.isnan(number) | (F.abs(number) > 1e308))
               .when(kind == "int", F.abs(_get(v, "decimal(38,0)")) > SAFE_INTEGER).when(kind.isin(*CONTAINERS), size > MAX_ITEMS).otherwise(~kind.isin(*KINDS.values())))
    listed = F.filter(F.array(*found), lambda i: i.isNotNull()).cast(ISSUE)
    out = kinds(rows, kind=v).withColumn("size", _size(F.col("kind"), v))
    return out.select(*keys, "path", "depth", "kind", F.when(~deep, size).alias("size"), F.when(suspect, listed).otherwise(F.array().cast(ISSUE)).alias("issues"),
                      F.when(kind.isin(*CONTAINERS) & ~deep, F.col(v)).alias("v"))


def _levels(first: DataFrame, step, label: str) -> DataFrame:
    """All levels as one table; ``step`` makes a level's children, and the walk ends where there are none."""
    parts, level, conf = [], first, first.sparkSession.conf
    before = conf.get(SHREDDING, None)
    # Values are read back whole and once, so cutting them into columns by a schema guessed from the rows is not worth its time.
    conf.set(SHREDDING, "false")
    try:
        while level is not None:
            table, containers = written(level, f"{label}-{len(parts)}", F.count_if(F.col("v").isNotNull()))
            parts.append(table)
            level = step(table.where("v IS NOT NULL")) if containers else None
    finally:
        conf.set(SHREDDING, before) if before else conf.unset(SHREDDING)
    return reduce(DataFrame.unionByName, [p.drop("v", "a", "b") for p in parts])


def walk(records: DataFrame, v: str, *keys: str, root: str = "root", limit: int = MAX_DEPTH) -> DataFrame:
    """One row a value of every record: path, depth, kind, size (items, keys or characters) and issues.

    ``v`` is a variant column (``try_parse_json`` of a text, ``to_variant_object`` of a
    row). Null records give no row. Values below depth ``limit`` count as too deep
    and are not opened. A whole decimal is an integer, any other a float.
    """
    names = list(keys)
    top = records.select(*names, F.lit(root).alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), F.col(v).alias("v")).where("v IS NOT NULL")

    def children(rows: DataFrame) -> DataFrame:
        fields = F.transform(F.map_entries(_get("v", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("end"), e["key"].alias("key"), e["value"].alias("v")))
        items = F.transform(_get("v", "array<variant>"), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("end"), F.lit(None).cast("string").alias("key"), x.alias("v")))
        opened = rows.select(*names, "path", "depth", F.explode_outer(F.when(F.col("kind") == "dict", fields).otherwise(items)).alias("c"))
        below = opened.where("c IS NOT NULL").select(*names, F.concat("path", "c.end").alias("path"), (F.col("depth") + 1).alias("depth"), F.col("c.key").alias("key"), F.col("c.v").alias("v"))
        return _judged(below, names, limit)

    return _levels(_judged(top, names, limit), children, "walk")


def issues(nodes: DataFrame, *keys: str) -> DataFrame:
    """One row an issue: severity, issue, path, detail."""
    return nodes.select(*keys, F.explode_outer("issues").alias("i")).where("i IS NOT NULL").select(*keys, "i.*")


def verdicts(nodes: DataFrame, *keys: str) -> DataFrame:
    """One row a record: whether it can be written as JSON, depth, sizes by kind, and how many errors and warnings."""
    count = lambda s: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s)))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("size"))), F.lit(0))
    agg = nodes.groupBy(*keys).agg(F.max("depth").alias("depth"), total("str").alias("string_length"), total("list").alias("array_length"), total("dict").alias("object_keys"),
                                   count("error").alias("errors"), count("warning").alias("warnings"))
    large = F.col("string_length") + F.col("array_length") + F.col("object_keys") > MAX_SIZES
    return agg.select(*keys, (F.col("errors") == 0).alias("is_serialisable"), "depth", "string_length", "array_length", "object_keys", large.alias("large"),
                      "errors", (F.col("warnings") + large.cast("int")).alias("warnings"))


def changed_text(a: Column, b: Column, floor: float = SIMILAR) -> Column:
    """Whether two texts differ beyond white space by more than 1 - ``floor`` of the longer one, in edits.

    Lengths that differ by more than that decide without a distance.
    """
    def judged(p: Column) -> Column:
        x, y = p["x"], p["y"]
        longest = F.greatest(F.length(x), F.length(y))
        allowed = F.floor(longest * (1 - floor) + 1e-9).cast("int")
        # Equal texts and lengths that decide come first, so that the distance, followed as far as allowed, is worked out for the other pairs alone.
        far = let(middles(x, y), lambda m: F.call_function("levenshtein", m["x"], m["y"], allowed) < 0)
        return F.when(x == y, False).when(F.abs(F.length(x) - F.length(y)) > allowed, True).otherwise(far)

    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return let(pair(a, b), lambda p: F.when(p["x"] == p["y"], False).otherwise(let(pair(squeeze(p["x"]), squeeze(p["y"])), judged)))


def changes(pairs: DataFrame, original: str, processed: str, *keys: str, root: Column | str = "root", limit: int = MAX_DEPTH) -> DataFrame:
    """Differences of two nested records on the same row, one row a change; rows without a change keep one with a null kind.

    Both records are walked together, so nothing below a missing, added or retyped value
    is opened, nor list items past the shorter list. Kinds: missing_key, added_key,
    type_change, length_change, value_change. Numbers of equal value count as equal
    whatever their kind; texts changed as ``changed_text`` says. Null records compare
    as values that are not there: both null is no change.
    """
    names = list(keys)
    start = root if isinstance(root, Column) else F.lit(root)
    top = pairs.select(*names, start.alias("path"), F.lit(0).alias("depth"), F.col(original).alias("a"), F.col(processed).alias("b"))

    def judged(rows: DataFrame) -> DataFrame:
        ka, kb = F.col("ka"), F.col("kb")
        retyped, both = ka != kb, ka == kb
        text = both & (ka == "str")
        na, nb = _get("a", "double"), _get("b", "double")
        same = ka.isin(*NUMBERS) & kb.isin(*NUMBERS) & (na == nb)
        plain = both & ~ka.isin("dict", "list", "str") & ~F.coalesce(_get("a", "string") == _get("b", "string"), F.col("ka") == "null")
        found = F.array(F.when(kb.isNull() & ka.isNotNull(), "missing_key"), F.when(ka.isNull() & kb.isNotNull(), "added_key"), F.when(retyped, "type_change"),
                        F.when(both & (ka == "list") & (_size(ka, "a") != _size(kb, "b")), "length_change"),
                        F.when((retyped & ~F.coalesce(same, F.lit(False))) | (plain & ~F.coalesce(same, F.lit(False))) | F.when(text, changed_text(_get("a", "string"), _get("b", "string"))).otherwise(text), "value_change"))
        opened = both & ka.isin(*CONTAINERS) & (F.col("depth") < limit)
        out = kinds(rows, ka="a", kb="b")
        return out.select(*names, "path", "depth", F.filter(found, lambda k: k.isNotNull()).alias("kinds"), F.when(opened, F.col("ka")).alias("v"), F.when(opened, F.col("a")).alias("a"), F.when(opened, F.col("b")).alias("b"))

    def children(rows: DataFrame) -> DataFrame:
        m, l = "map<string,variant>", "array<variant>"
        fields = F.transform(F.map_entries(F.map_zip_with(_get("a", m), _get("b", m), lambda k, x, y: F.struct(x.alias("a"), y.alias("b")))),
                             lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("end"), e["value"]["a"].alias("a"), e["value"]["b"].alias("b")))
        least = F.least(F.size(_get("a", l)), F.size(_get("b", l)))
        items = F.transform(F.slice(F.arrays_zip(_get("a", l).alias("a"), _get("b", l).alias("b")), F.lit(1), least),
                            lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("end"), x["a"].alias("a"), x["b"].alias("b")))
        opened = rows.select(*names, "path", "depth", F.explode_outer(F.when(F.col("v") == "dict", fields).otherwise(items)).alias("c"))
        return judged(opened.where("c IS NOT NULL").select(*names, F.concat("path", "c.end").alias("path"), (F.col("depth") + 1).alias("depth"), F.col("c.a").alias("a"), F.col("c.b").alias("b")))

    every = _levels(judged(top), children, "changes").select(*names, "path", "depth", "kinds")
    # The root row keeps a record that has no change.
    shown = F.when(F.col("depth") == 0, F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit(None).cast("string")))).otherwise(F.col("kinds"))
    rows = every.select(*names, "path", F.explode_outer(shown).alias("kind"), "depth").where("kind IS NOT NULL OR depth = 0")
    return rows.select(*names, F.when(F.col("kind").isNotNull(), F.col("path")).alias("path"), "kind")
