"""Scalar text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import classify, clean
from pagegrain.functions.text import words
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_contains_any, s_map, s_squeeze, s_starts_any, s_strip, s_words, with_ll, with_lr
from pagegrain.plans.registry import query


def _docs(spark, sf):
    return inputs.table(spark, sf, "documents")


# Decomposed accents, typographic marks and control characters, so that every rule has work.
_ROUGH = [("\u00e9", "e\u0301"), (" an ", " \u201can\u2026\u00a0"), (" the ", " the\u200b "), (" le ", " \u2014le\x01 "), ("der ", "d\u00ader\ufeff ")]


def _rough(c):
    for a, b in _ROUGH:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _rough_sql(e):
    for a, b in _ROUGH:
        e = f"replace({e}, '{a}', '{b}')"
    return e


def _norm_sql(e):
    e = f"nfc_normalize({e})"
    for k, v in clean.TYPOGRAPHIC.items():
        e = f"replace({e}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace({e}, '[^\P{{C}}\n\r\t]', '', 'g')"


@query("txt1_normalize_unicode", f"SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, {_norm_sql(_rough_sql('text'))} AS t FROM documents)")
def normalize_unicode(spark, sf):
    d = _docs(spark, sf).select("doc_id", clean.normalize_unicode(_rough(F.col("text"))).alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").alias("n"))


@query("txt2_bytes_to_text", r"""
SELECT doc_id, md5(text) AS digest, CASE WHEN doc_id % 2 = 1 AND regexp_matches(text, '[^\x00-\x7f]') THEN 'latin-1' ELSE 'utf-8' END AS encoding, 0.7::DOUBLE AS confidence
FROM documents""")
def bytes_to_text(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 1, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    d = _docs(spark, sf).select("doc_id", clean.decoded(raw).alias("d"))
    return d.select("doc_id", F.md5(F.col("d.text").cast("binary")).alias("digest"), "d.encoding", "d.confidence")


@query("txt2_given_encoding", r"""
SELECT doc_id, md5(text) AS digest, CASE doc_id % 3 WHEN 0 THEN 'utf-16le' WHEN 1 THEN 'utf-16' ELSE CASE WHEN regexp_matches(text, '[^\x00-\x7f]') THEN 'utf-8' ELSE 'ascii' END END AS encoding,
 CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 2 AND NOT regexp_matches(text, '[^\x00-\x7f]') THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM documents""")
def given_encoding(spark, sf):
    """UTF-16 that is told, UTF-16 that its mark tells, and ASCII that is told but not always true."""
    k, t = F.col("doc_id") % 3, F.col("text")
    told = clean.decoded(F.encode(t, "UTF-16LE"), "utf-16le")
    # An encoder leaves the mark out where there is no text; here every text has it.
    marked = clean.decoded(F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE")))
    plain = clean.decoded(F.encode(t, "UTF-8"), "ascii")
    d = _docs(spark, sf).select("doc_id", F.when(k == 0, told).when(k == 1, marked).otherwise(plain).alias("d"))
    return d.select("doc_id", F.md5(F.col("d.text").cast("binary")).alias("digest"), "d.encoding", "d.confidence")


_BAD = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(65533) || chr(65533) || 'x' || chr(1) WHEN 2 THEN replace(text, 'the', 'éèê') ELSE text || 'Ω' END"


@query("txt3_corruption", rf"""
SELECT doc_id, marks AS replacement_chars, n AS issues, n > 0 AS is_corrupted, round(CASE WHEN n > 0 THEN greatest(0.1, 1.0 - n * 0.1) ELSE 1.0 END, 6)::DOUBLE AS confidence
FROM (SELECT doc_id, length(t) - length(replace(t, chr(65533), '')) AS marks,
  (length(t) - length(replace(t, chr(65533), '')) + len(regexp_extract_all(t, '[^\x00-\x7f]{{3,}}')) + len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]'))
  + len(regexp_extract_all(t, '\x{{fffd}}+')) + regexp_matches(t, '[^\x00-\x{{ff}}]')::INT + regexp_matches(t, '[^\x00-\x7f\x{{a0}}-\x{{ff}}]')::INT)::BIGINT AS n
 FROM (SELECT doc_id, {_BAD} AS t FROM documents))""")
def corruption(spark, sf):
    t = F.col("text")
    bad = (F.when(F.col("doc_id") % 4 == 0, t).when(F.col("doc_id") % 4 == 1, F.concat(t, F.lit("��x\x01")))
           .when(F.col("doc_id") % 4 == 2, F.replace(t, F.lit("the"), F.lit("éèê"))).otherwise(F.concat(t, F.lit("Ω"))))
    d = _docs(spark, sf).select("doc_id", bad.alias("t")).select("doc_id", clean.corruption(F.col("t")).alias("c"))
    return d.select("doc_id", "c.replacement_chars", "c.issues", "c.is_corrupted", F.round("c.confidence", 6).alias("confidence"))


_DIRTY = "replace(replace(replace(text, ' i', ' 1i'), 'o ', 'o0 '), '. ', '.. ')"


def _fixed_sql(e):
    for p, t in [(r"\b0([a-zA-Z])", r"O\1"), (r"\b1([a-zA-Z])", r"I\1"), (r"([a-zA-Z])0\b", r"\1O"), (r"([a-zA-Z])1\b", r"\1l"),
                 ("rn", "m"), ("cl", "d"), ("vv", "w"), (",,", ","), (r"\.\.", ".")]:
        e = f"regexp_replace({e}, '{p}', '{t}', 'g')"
    return s_squeeze(e)


def _dirty(c):
    for a, b in ((" i", " 1i"), ("o ", "o0 "), (". ", ".. ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query("txt4_recognition_repair", f"SELECT item_id, {_fixed_sql(_DIRTY)} AS fixed FROM benchmark")
def recognition_repair(spark, sf):
    return inputs.table(spark, sf, "benchmark").select("item_id", clean.repaired(_dirty(F.col("text"))).alias("fixed"))


@query("txt5_text_integrity", f"""
SELECT doc_id, length(b) - length(a) AS length_change, n AS character_changes, round(s, 6) AS integrity_score, s >= 0.9 AS content_preserved,
  abs(length(b) - length(a)) > length(a) * 0.1 AS large_length_change, n > length(a) * 0.05 AS high_change_rate
FROM (SELECT *, CASE WHEN length(a) > 0 THEN greatest(0, 1.0 - n / length(a)) ELSE 1.0 END::DOUBLE AS s FROM (
 SELECT *, len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] <> p[2])) + abs(length(a) - length(b)) AS n
 FROM (SELECT doc_id, text AS a, CASE WHEN doc_id % 3 = 0 THEN text ELSE replace({s_squeeze('text')}, 'th', 'zz') END AS b FROM documents)))""")
def text_integrity(spark, sf):
    a = F.col("text")
    b = F.when(F.col("doc_id") % 3 == 0, a).otherwise(F.replace(clean.squeeze(a), F.lit("th"), F.lit("zz")))
    d = _docs(spark, sf).select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", clean.text_integrity(F.col("a"), F.col("b")).alias("r"))
    return d.select("doc_id", "r.*").withColumn("integrity_score", F.round("integrity_score", 6))


@query("txt6_checksums", f"""SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, md5(text) = md5({s_squeeze('text')}) AS verified,
 length(text) AS content_length, len({s_words('text')}) AS word_count FROM documents""")
def checksums(spark, sf):
    b = F.col("text").cast("binary")
    return _docs(spark, sf).select("doc_id", F.md5(b).alias("md5"), F.sha2(b, 256).alias("sha256"),
                                   (F.md5(b) == F.md5(clean.squeeze("text").cast("binary"))).alias("verified"),
                                   F.length("text").alias("content_length"), F.size(words("text")).alias("word_count"))


@query("txt7_comparable_text", f"SELECT doc_id, md5(nfc_normalize(lower({s_squeeze(_rough_sql('text'))}))) AS digest FROM documents")
def comparable_text(spark, sf):
    t = clean.comparable(_rough(F.col("text")), ignore_case=True, unicode=True)
    return _docs(spark, sf).select("doc_id", F.md5(t.cast("binary")).alias("digest"))


@query("txt8_similarity_ratio")
def similarity_ratio(spark, sf):
    """Exact matching-block ratio of every conversation turn and its repaired form."""
    d = inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn", clean.comparable(F.col("text")).alias("a"), clean.repaired(F.col("text")).alias("b"))
    r = d.select("conv_id", "turn", clean.similarity_ratio(F.col("a"), F.col("b")).alias("ratio"))
    return r.select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= 0.95).alias("preserved"))


_FIX_CONV = _fixed_sql("text")


@query("txt8_edit_similarity", f"""
SELECT conv_id, turn, a = b AS is_identical, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6)::DOUBLE AS ratio
FROM (SELECT conv_id, turn, {s_squeeze('text')} AS a, {_FIX_CONV} AS b FROM conversations)""")
def edit_similarity(spark, sf):
    d = inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn", clean.comparable(F.col("text")).alias("a"), clean.repaired(F.col("text")).alias("b"))
    return d.select("conv_id", "turn", (F.col("a") == F.col("b")).alias("is_identical"),
                    F.round(clean.edit_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


_PART = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, length(text) // 2) WHEN 2 THEN text || ' added words at the end' ELSE replace(text, ' ', '') END"


@query("txt9_integrity_score", f"""
SELECT doc_id, round(greatest(0, least(1, r * CASE WHEN bl > 0.05 THEN 1 - bl ELSE 1 END * CASE WHEN bw > 0.05 THEN 1 - bw * 0.5::DOUBLE ELSE 1 END)), 6)::DOUBLE AS score
FROM (SELECT doc_id, 2.0 * least(length(a), length(b)) / (length(a) + length(b)) AS r, abs(length(b) - length(a)) / length(a) AS bl, abs(wb - wa) / wa AS bw
 FROM (SELECT *, len({s_words('a')}) AS wa, len({s_words('b')}) AS wb FROM (SELECT doc_id, text AS a, {_PART} AS b FROM documents)))""")
def integrity_score(spark, sf):
    """Changes of a text without characters or words are divided by zero as doubles are, and the score stays in its bounds."""
    a, k = F.col("text"), F.col("doc_id") % 4
    b = (F.when(k == 0, a).when(k == 1, F.expr("substring(text, 1, length(text) div 2)"))
         .when(k == 2, F.concat(a, F.lit(" added words at the end"))).otherwise(F.replace(a, F.lit(" "), F.lit(""))))
    ratio = clean.quotient(F.least(F.length("a"), F.length("b")) * 2.0, F.length("a") + F.length("b"))
    d = _docs(spark, sf).select("doc_id", a.alias("a"), b.alias("b"))
    score = clean.integrity_score(ratio, F.col("a"), F.col("b"), of_nothing=lambda change: clean.quotient(change, F.lit(0)))
    return d.select("doc_id", F.round(score, 6).alias("score"))


def _redact_sql(e):
    for p, t in clean.REDACTIONS:
        e = f"regexp_replace({e}, '{p}', '{t}', 'g')"
    pair = clean.PATH_PAIR
    return (f"array_to_string(list_transform(list_zip(regexp_split_to_array({e}, '{pair}'), regexp_extract_all({e}, '{pair}')), "
            f"lambda p: coalesce(p[1], '') || CASE WHEN p[2] IS NULL THEN '' ELSE '/[PATH_HASH_' || substr(md5(p[2]), 1, 8) || ']' END), '')")


_PII = "text || ' see /usr/local/share/x and 123-45-6789 or 555-123-4567 or 4111 1111 1111 1111.'"


@query("txt11_redaction", f"SELECT doc_id, md5({_redact_sql(_PII)}) AS digest, length({_redact_sql(_PII)}) AS n FROM documents")
def redaction(spark, sf):
    t = clean.redacted(F.concat("text", F.lit(" see /usr/local/share/x and 123-45-6789 or 555-123-4567 or 4111 1111 1111 1111.")))
    d = _docs(spark, sf).select("doc_id", t.alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").alias("n"))


@query("txt11_redaction_nested", f"SELECT conv_id, turn, {_redact_sql('text')} AS text, role FROM conversations")
def redaction_nested(spark, sf):
    rec = F.create_map(F.lit("text"), "text", F.lit("role"), "role")
    d = inputs.table(spark, sf, "conversations").select("conv_id", "turn", F.transform_values(rec, lambda k, v: clean.redacted(v)).alias("m"))
    return d.select("conv_id", "turn", F.col("m")["text"].alias("text"), F.col("m")["role"].alias("role"))


@query("txt12_strip_html", f"""SELECT page_id, md5({s_squeeze("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) AS digest FROM pages""")
def strip_html(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", F.md5(clean.html_text(F.col("html")).cast("binary")).alias("digest"))


_LISTY = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE i % 4 WHEN 1 THEN '- ' || l WHEN 2 THEN (i::VARCHAR) || '. ' || l WHEN 3 THEN '12345. ' || l ELSE '  ' END), chr(10))"
_BULLET_RE = r"^[•\-*○▪▫]"


def _item_sql(e):
    bare = f"(CASE WHEN regexp_matches({e}, '{_BULLET_RE}') THEN {s_strip(f'substr({e}, 2)')} ELSE {e} END)"
    return f"(CASE WHEN regexp_matches({bare}, '{classify.NUMBERED}') THEN {s_strip(f'''regexp_replace({bare}, '^[^.]*[.]', '')''')} ELSE {bare} END)"


def _listy(c):
    return F.array_join(F.transform(F.split(c, "\n"), lambda l, i: F.when(i % 4 == 0, F.concat(F.lit("- "), l)).when(
        i % 4 == 1, F.concat((i + 1).cast("string"), F.lit(". "), l)).when(i % 4 == 2, F.concat(F.lit("12345. "), l)).otherwise(F.lit("  "))), "\n")


@query("txt13_list_items", f"""
SELECT doc_id, len(items) AS n, md5(array_to_string(items, '|')) AS digest FROM (
 SELECT doc_id, CASE WHEN len(x) > 0 THEN x ELSE [t] END AS items FROM (
  SELECT doc_id, t, list_filter(list_transform(list_transform(string_split(t, chr(10)), lambda l: {s_strip('l')}), lambda l: {_item_sql('l')}), lambda i: i <> '') AS x
  FROM (SELECT doc_id, {_LISTY} AS t FROM documents)))""")
def list_items(spark, sf):
    d = _docs(spark, sf).select("doc_id", _listy(F.col("text")).alias("t")).select("doc_id", classify.list_items(F.col("t")).alias("items"))
    return d.select("doc_id", F.size("items").alias("n"), F.md5(F.array_join("items", "|").cast("binary")).alias("digest"))


_NUM = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN doc_id % 2 = 0 OR i % 3 = 0 THEN (i::VARCHAR) || '. ' || l ELSE l END), chr(10))"


@query("txt14_list_style", f"""
SELECT doc_id, CASE WHEN len(list_filter(ls[1:5], lambda l: regexp_matches({s_strip('l')}, '{classify.NUMBERED}'))) > len(ls) / 2 THEN 'ordered' ELSE 'unordered' END AS style
FROM (SELECT doc_id, string_split({_NUM}, chr(10)) AS ls FROM documents)""")
def list_style(spark, sf):
    t = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.when(
        (F.col("doc_id") % 2 == 0) | ((i + 1) % 3 == 0), F.concat((i + 1).cast("string"), F.lit(". "), l)).otherwise(l)), "\n")
    return _docs(spark, sf).select("doc_id", t.alias("t")).select("doc_id", classify.list_style(F.col("t")).alias("style"))


def _level_sql(t, y):
    arms = " ".join(f"WHEN {s_contains_any(f'lower({t})', w)} THEN {lv}" for lv, w in classify.HEADING_WORDS.items())
    return f"(CASE {arms} WHEN {y} < 100 AND length({t}) < 30 THEN 1 WHEN {y} < 100 THEN 2 WHEN length({t}) < 20 THEN 3 WHEN length({t}) < 40 THEN 4 ELSE 5 END)::BIGINT"


_KEYED = "CASE line_no % 9 WHEN 3 THEN 'Section ' || text WHEN 5 THEN 'A Chapter' WHEN 7 THEN substr(text, 1, 15) WHEN 8 THEN substr(text, 1, 35) ELSE text END"


def _keyed():
    m = F.col("line_no") % 9
    return (F.when(m == 3, F.concat(F.lit("Section "), "text")).when(m == 5, "A Chapter").when(m == 7, F.substring("text", 1, 15))
            .when(m == 8, F.substring("text", 1, 35)).otherwise(F.col("text")))


@query("txt15_header_level", with_ll(f"SELECT doc_id, line_no, {_level_sql('t', 'y1')} AS level FROM (SELECT *, {_KEYED} AS t FROM ll)"))
def header_level(spark, sf):
    d = inputs.ll(spark, sf).select("doc_id", "line_no", "y1", _keyed().alias("t"))
    return d.select("doc_id", "line_no", classify.header_level(F.col("t"), F.col("y1")).alias("level"))


_MARKED = "CASE line_no % 8 WHEN 1 THEN '• ' || text WHEN 2 THEN '7. ' || text WHEN 3 THEN upper(substr(text, 1, 60)) WHEN 4 THEN '' WHEN 5 THEN 'x 42 ' || substr(text, 1, 30) WHEN 6 THEN text || chr(10) || '12. y' WHEN 7 THEN text || '|a' ELSE text END"
_LISTRE = rf"({s_starts_any('t', classify.BULLETS)} OR regexp_matches(t, '^([1-9]|1[0-9])[.]') OR regexp_matches(t, '\n[•\-*○▪▫]') OR regexp_matches(t, '\n([1-9]|1[0-9])[.]'))"
_UPPER = r"(regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]'))"


def _marked():
    t, m = F.col("text"), F.col("line_no") % 8
    return (F.when(m == 1, F.concat(F.lit("• "), t)).when(m == 2, F.concat(F.lit("7. "), t)).when(m == 3, F.upper(F.substring(t, 1, 60)))
            .when(m == 4, "").when(m == 5, F.concat(F.lit("x 42 "), F.substring(t, 1, 30))).when(m == 6, F.concat(t, F.lit("\n12. y")))
            .when(m == 7, F.concat(t, F.lit("|a"))).otherwise(t))


@query("txt16_region_class", with_ll(rf"""
SELECT doc_id, line_no, CASE WHEN t = '' THEN 'image' WHEN {_LISTRE} THEN 'list'
 WHEN length(t) < 100 AND ({_UPPER} OR regexp_matches(substr(t, 1, 10), '\p{{Nd}}') OR y1 < 100) THEN 'header' ELSE 'paragraph' END AS class
FROM (SELECT doc_id, line_no, y1, {s_strip(_MARKED)} AS t FROM ll)"""))
def region_class(spark, sf):
    d = inputs.ll(spark, sf).select("doc_id", "line_no", "y1", _marked().alias("t"))
    return d.select("doc_id", "line_no", classify.region_class(F.col("t"), F.col("y1")).alias("class"))


@query("txt17_refined_class", with_ll(f"""
SELECT doc_id, line_no, CASE WHEN c = '' THEN 'image' WHEN {_LISTRE} THEN 'list'
 WHEN y1 / 1000 < 0.2 OR (length(t) < 80 AND ({_UPPER} OR {s_contains_any('lower(t)', ['title', 'chapter', 'section'])} OR (x2 - x1) / 1300 > 0.6)) THEN 'header'
 WHEN (contains(t, chr(9)) OR contains(t, '|') OR (length(t) - length(replace(t, ' ', ''))) > length(t) * 0.3::DOUBLE) AND (line_no % 3) / 10.0 > 0.1 THEN 'table' ELSE 'paragraph' END AS class
FROM (SELECT *, {s_strip('c')} AS t FROM (SELECT *, {_MARKED} AS c FROM ll))"""))
def refined_class(spark, sf):
    d = inputs.ll(spark, sf).withColumn("t", _marked())
    return d.select("doc_id", "line_no", classify.refined_class(
        F.col("t"), F.col("y1") / 1000, (F.col("x2") - F.col("x1")) / 1300, (F.col("line_no") % 3) / 10.0).alias("class"))


_SIZES = ", ".join(map(str, classify.FONT_SIZES))


@query("txt18_font_size", with_lr(f"""
, r AS (SELECT doc_id, ord, greatest(8, least(72, trunc((y2 - y1) * (1 + ord % 9) / greatest(1, len(string_split({s_strip('content')}, chr(10)))) * 0.75::DOUBLE)::BIGINT)) AS raw FROM lr)
SELECT doc_id, ord, arg_min(s, abs(raw - s) * 100 + s)::BIGINT AS font_size FROM r, (SELECT unnest([{_SIZES}]) AS s) GROUP BY doc_id, ord"""))
def font_size(spark, sf):
    h = (F.col("y2") - F.col("y1")) * (F.col("ord") % 9 + 1)
    return inputs.lr(spark, sf).select("doc_id", "ord", classify.font_size(F.col("content"), h).alias("font_size"))


@query("txt19_line_breaks", "SELECT doc_id, md5(replace(text, chr(10), '<br>')) AS digest FROM documents")
def line_breaks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.replace("text", F.lit("\n"), F.lit("<br>")).cast("binary")).alias("digest"))


_NAMED = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' #' || p_partkey WHEN 1 THEN p_partkey || '-' || p_name WHEN 2 THEN substr(p_name, 1, 2) ELSE repeat(p_name || '/', 9) END"


@query("txt21_safe_name", rf"""
SELECT p_partkey, CASE WHEN length(c) < 3 THEN c || '_col' ELSE c END AS safe FROM (
 SELECT p_partkey, substr(CASE WHEN b <> '' AND NOT regexp_matches(b, '^\p{{L}}') THEN 'c_' || b ELSE b END, 1, 63) AS c
 FROM (SELECT p_partkey, regexp_replace({_NAMED}, '[^\p{{L}}\p{{N}}_]', '_', 'g') AS b FROM part))""")
def safe_name(spark, sf):
    n, k, m = F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    raw = (F.when(m == 0, F.concat(n, F.lit(" #"), k)).when(m == 1, F.concat(k, F.lit("-"), n)).when(m == 2, F.substring(n, 1, 2))
           .otherwise(F.repeat(F.concat(n, F.lit("/")), 9)))
    return inputs.table(spark, sf, "part").select("p_partkey", clean.safe_name(raw).alias("safe"))


@query("txt23_answer_confidence", """
SELECT conv_id, turn, CASE WHEN contains(a, '未找到') OR contains(a, '没有') OR contains(a, '不确定') THEN 0.3::DOUBLE WHEN length(a) > 50 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
 CASE WHEN turn % 4 = 3 THEN 0.3::DOUBLE WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS qa_confidence
FROM (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN text || '未找到' WHEN conv_id % 5 = 1 THEN substr(text, 1, 40) ELSE text END AS a FROM conversations)""")
def answer_confidence(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    a = F.when(c % 5 == 0, F.concat("text", F.lit("未找到"))).when(c % 5 == 1, F.substring("text", 1, 40)).otherwise(F.col("text"))
    return inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn", classify.answer_confidence(a).alias("confidence"),
        classify.qa_confidence(t % 4 != 3, t % 4 == 1, F.when(c % 2 == 0, 2).otherwise(0)).alias("qa_confidence"))


# Error texts and types put before each line so that every category occurs.
_FAULTS = ["unsupported file type", "file size over limit", "invalid and empty", "corrupt pdf", "pdf extract encrypted", "ocr convert failed",
           "network unreachable", "out of memory", "fatal crash", "plain trouble", "rate limit reached", "temporary error"]
_KINDS = ["ValueError", "OSError", "OCRFault", "AuthFault", "KeyError"]


def _fault_sql():
    arr = "[" + ", ".join(f"'{f}'" for f in _FAULTS) + "]"
    kinds = "[" + ", ".join(f"'{f}'" for f in _KINDS) + "]"
    return f"SELECT doc_id, line_no, {arr}[(line_no + doc_id) % {len(_FAULTS)} + 1] || ': ' || text AS m, {kinds}[(line_no * 3 + doc_id) % {len(_KINDS)} + 1] AS k FROM ll"


def _faults(spark, sf):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))
    d, n = F.col("doc_id"), F.col("line_no")
    return inputs.ll(spark, sf).select("doc_id", "line_no", F.concat(pick(_FAULTS, n + d), F.lit(": "), "text").alias("m"), pick(_KINDS, n * 3 + d).alias("k"))


def _triage_sql():
    lm, lk = "lower(m)", "lower(k)"
    arms = " ".join(f"WHEN {s_contains_any(lk, t)}{' OR ' + s_contains_any(lm, w) if w else ''} THEN '{n}'" for n, t, w in classify.ERROR_RULES)
    cat = f"SELECT doc_id, line_no, {lm} AS lm, CASE {arms} ELSE 'system_error' END AS category FROM f"
    sev = ("CASE WHEN category = 'system_error' AND " + s_contains_any("lm", ["critical", "fatal", "crash"]) + " THEN 'critical' WHEN category IN ('resource_error', 'authentication_error') THEN 'high' WHEN "
           + s_contains_any("lm", ["corrupt", "failed", "error"]) + " THEN 'high' WHEN category IN ('processing_error', 'network_error') THEN 'medium' ELSE 'low' END")
    why = ("CASE WHEN category = 'validation_error' AND " + s_contains_any("lm", ["file type", "unsupported"]) + " THEN 'file_type' WHEN category = 'validation_error' AND " + s_contains_any("lm", ["size", "limit"])
           + " THEN 'file_size' WHEN category = 'validation_error' AND contains(lm, 'empty') THEN 'file_empty' WHEN category = 'processing_error' AND contains(lm, 'pdf') AND contains(lm, 'encrypted') THEN 'pdf_locked'"
           " WHEN category = 'processing_error' AND contains(lm, 'pdf') AND contains(lm, 'corrupt') THEN 'pdf_corrupt' WHEN category = 'processing_error' AND contains(lm, 'ocr') THEN 'ocr' ELSE category END")
    status = s_map("category", {k: str(v) for k, v in classify.ERROR_STATUS.items()}, "'500'")
    return with_ll(f""", f AS ({_fault_sql()}), c AS ({cat}), r AS (SELECT *, {sev} AS severity, {why} AS reason FROM c)
SELECT doc_id, line_no, category, severity, {status}::BIGINT AS status, {s_map('reason', classify.ERROR_MESSAGES, 'NULL')} AS message,
 {s_map('reason', classify.ERROR_GUIDANCE, 'NULL')} AS guidance, {s_map('reason', classify.ERROR_ACTIONS, 'NULL')} AS action FROM r""")


@query("txt24_error_triage", _triage_sql())
def error_triage(spark, sf):
    d = _faults(spark, sf).withColumn("category", classify.error_category(F.col("k"), F.col("m")))
    d = d.withColumn("reason", classify.error_reason(F.col("category"), F.col("m")))
    return d.select("doc_id", "line_no", "category", classify.error_severity(F.col("category"), F.col("m")).alias("severity"),
                    classify.error_status(F.col("category")).alias("status"), *classify.error_texts(F.col("reason")))


@query("txt25_pseudonyms", "SELECT event_id, substr(md5(user_id::VARCHAR), 1, 8) AS user_hash, substr(md5(event_id::VARCHAR || event_type), 1, 12) AS event_hash FROM events")
def pseudonyms(spark, sf):
    return inputs.table(spark, sf, "events").select(
        "event_id", clean.pseudonym(F.col("user_id").cast("string"), 8).alias("user_hash"),
        clean.pseudonym(F.concat(F.col("event_id").cast("string"), "event_type"), 12).alias("event_hash"))


@query("txt26_backoff_delay", """
SELECT event_id, least(60, CASE event_type WHEN 'view' THEN power(2, event_id % 8) WHEN 'click' THEN event_id % 8 + 1 WHEN 'signup' THEN 1 ELSE 0 END)::DOUBLE AS delay FROM events""")
def backoff_delay(spark, sf):
    e = F.col("event_type")
    strategy = F.when(e == "view", "exponential_backoff").when(e == "click", "linear_backoff").when(e == "signup", "fixed_delay").otherwise("immediate")
    return inputs.table(spark, sf, "events").select("event_id", classify.backoff_delay(F.col("event_id") % 8, strategy).alias("delay"))


@query("txt27_retryable", with_ll(f""", f AS ({_fault_sql()})
SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN (400 + line_no % 105) IN (408, 429, 500, 502, 503, 504) ELSE {s_contains_any('lower(m)', classify.RETRY_WORDS)} END AS retry FROM f"""))
def retryable(spark, sf):
    n = F.col("line_no")
    status = F.when(n % 3 == 0, n % 105 + 400)
    return _faults(spark, sf).select("doc_id", "line_no", classify.retryable(F.col("m"), status).alias("retry"))


@query("txt28_timestamps", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events""")
def timestamps(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return inputs.table(spark, sf, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"))
