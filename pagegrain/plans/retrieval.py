"""Vectors, retrieval and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import vectors
from pagegrain.operators import retrieval
from pagegrain.plans import inputs
from pagegrain.plans.registry import query

# The first vector of every label asks its own collection; the others are the chunks.
_Q = """q AS (SELECT label, arg_min(embedding, vec_id) AS qv, min(vec_id) AS query_id FROM embeddings GROUP BY label),
d AS (SELECT q.query_id, e.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.qv, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance, e.label FROM embeddings e JOIN q USING (label))"""


def _vectors(spark, sf):
    return inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")


def _queries(spark, sf):
    v = inputs.table(spark, sf, "embeddings")
    return v.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("query_vector"))


@query("vec2_cosine", """
SELECT e.vec_id, round(list_sum(list_transform(list_zip(q.qv, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(q.qv, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity
FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label) q USING (label)""")
def cosine(spark, sf):
    j = _vectors(spark, sf).join(_queries(spark, sf), "label")
    return j.select(F.col("chunk_id").alias("vec_id"), F.round(vectors.cosine(F.col("query_vector"), F.col("embedding")), 6).alias("similarity"))


@query("vec3_distance_score", f"WITH {_Q} SELECT query_id, chunk_id, round(distance, 6) AS distance, round(1 - distance, 6) AS score FROM d")
def distance_score(spark, sf):
    j = _vectors(spark, sf).join(_queries(spark, sf), "label")
    dist = vectors.squared_l2(F.col("query_vector"), F.col("embedding"))
    return j.select("query_id", "chunk_id", F.round(dist, 6).alias("distance"), F.round(vectors.score(dist), 6).alias("score"))


@query("top1_nearest_chunks", f"""WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)
SELECT query_id, chunk_id, rank, round(distance, 6) AS distance, round(1 - distance, 6) AS score FROM r WHERE rank <= 30""")
def nearest_chunks(spark, sf):
    s = retrieval.similar(_queries(spark, sf), _vectors(spark, sf), ["label"])
    return s.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("jn15_similarity_join", f"""WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)
SELECT query_id, chunk_id, rank FROM r WHERE rank <= 5""")
def similarity_join(spark, sf):
    return retrieval.similar(_queries(spark, sf), _vectors(spark, sf), ["label"], k=retrieval.DOCUMENT_K).select("query_id", "chunk_id", "rank")


@query("flt7_filtered_search", f"""WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d WHERE label >= 5 AND chunk_id > 20)
SELECT query_id, chunk_id, rank FROM r WHERE rank <= 10""")
def filtered_search(spark, sf):
    s = retrieval.similar(_queries(spark, sf), _vectors(spark, sf), ["label"], k=10, where=(F.col("label") >= 5) & (F.col("chunk_id") > 20))
    return s.select("query_id", "chunk_id", "rank")


_PACK = f"""WITH RECURSIVE {_Q}, r AS (SELECT d.*, text, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d JOIN documents ON doc_id = chunk_id GATE),
h AS (SELECT * FROM r WHERE rank <= 30),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS run FROM h),
k AS (SELECT *, max(CASE WHEN run > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS stop FROM c)"""


def _texts(spark, sf):
    return inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _with_text(spark, sf):
    """Vectors of the chunks that have a text; the text itself is not carried."""
    return _vectors(spark, sf).join(_texts(spark, sf).select("chunk_id"), "chunk_id", "left_semi")


@query("win4_packed_context", _PACK.replace("GATE", "") + """
SELECT query_id, count(*) FILTER (WHERE stop = 0) AS n_used, md5(coalesce(string_agg(CASE WHEN stop = 0 THEN text END, chr(10) || chr(10) ORDER BY rank), '')) AS digest FROM k GROUP BY query_id""")
def packed_context(spark, sf):
    hits = retrieval.similar(_queries(spark, sf), _with_text(spark, sf), ["label"], parts=4)
    p = retrieval.packed_context(hits.join(_texts(spark, sf), "chunk_id"))
    return p.select("query_id", "n_used", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("vec4_built_context", _PACK.replace("GATE", "WHERE label % 2 = 0") + """
, a AS (SELECT query_id, count(*) FILTER (WHERE stop = 0) AS n_used, coalesce(string_agg(CASE WHEN stop = 0 THEN text END, chr(10) || chr(10) ORDER BY rank), '') AS context FROM k GROUP BY query_id)
SELECT q.query_id, coalesce(n_used, 0) AS n_used, md5(coalesce(context, '')) AS digest FROM q LEFT JOIN a ON a.query_id = q.query_id""")
def built_context(spark, sf):
    """Only collections with an even label are indexed; the others answer with nothing."""
    indexed = _vectors(spark, sf).select("label").distinct().withColumn("indexed", F.col("label") % 2 == 0)
    c = retrieval.build_context(_queries(spark, sf), _with_text(spark, sf), indexed, ["label"], texts=_texts(spark, sf))
    return c.select("query_id", "n_used", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("vec1_encoded_documents")
def encoded_documents(spark, sf):
    """Unit vectors of whole documents; the norm is 1 for every text with a word."""
    e = retrieval.encode(inputs.table(spark, sf, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(vectors.norm(F.col("embedding")), 3).alias("norm"))


@query("snk5_index_status", "SELECT doc_id, count(vec_id) AS chunk_count, count(vec_id) > 0 AS indexed FROM documents LEFT JOIN embeddings ON label = doc_id GROUP BY doc_id")
def index_status(spark, sf):
    v = inputs.table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("doc_id"))
    return retrieval.index_status(inputs.table(spark, sf, "documents").select("doc_id"), v, "doc_id")


@query("snk4_replaced_index", """
SELECT chunk_id, label, kind FROM (SELECT vec_id AS chunk_id, label::BIGINT AS label, 'old' AS kind FROM embeddings WHERE label NOT IN (2, 5)
 UNION ALL SELECT vec_id + 1000000, label, 'new' FROM embeddings WHERE label IN (2, 5) AND vec_id % 2 = 0) WHERE label <> 7""")
def replaced_index(spark, sf):
    v = _vectors(spark, sf).select("chunk_id", F.col("label").cast("bigint").alias("label"), F.lit("old").alias("kind"))
    fresh = v.where(F.col("label").isin(2, 5) & (F.col("chunk_id") % 2 == 0)).select((F.col("chunk_id") + 1000000).alias("chunk_id"), "label", F.lit("new").alias("kind"))
    return retrieval.deleted_index(retrieval.replaced_index(v, fresh, "label"), v.where("label = 7"), "label")


def _letters():
    """A stand-in for a model: how often each letter from a to z occurs, at unit length."""
    def model(texts):
        out = []
        for t in texts:
            counts = [t.count(chr(97 + i)) + t.count(chr(65 + i)) for i in range(26)]
            norm = sum(c * c for c in counts) ** 0.5
            out.append([c / norm if norm else 0.0 for c in counts])
        return out
    return model


_ASKED = "question about: "


@query("vec1_batched_encoder", f"""
WITH t AS (SELECT doc_id, side, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM (SELECT doc_id, 'document' AS side, text AS x FROM documents UNION ALL SELECT doc_id, 'query', '{_ASKED}' || text FROM documents)),
c AS (SELECT doc_id, side, list_transform(range(0, 26), lambda i: length(l) - length(replace(l, chr((97 + i)::INTEGER), ''))) AS c FROM t),
v AS (SELECT doc_id, side, c, sqrt(list_sum(list_transform(c, lambda x: x * x))::DOUBLE) AS norm FROM c)
SELECT doc_id, side, len(c)::BIGINT AS dims, array_to_string(list_transform(c, lambda x: printf('%.4f', CASE WHEN norm > 0 THEN x / norm + 0.00000001 ELSE 0 END)), ',') AS vector FROM v""")
def batched_encoder(spark, sf):
    """Documents and questions through an encoder that loads once a worker; questions carry their instruction."""
    d = inputs.table(spark, sf, "documents").select("doc_id", "text")
    encoder = retrieval.batched("letters", _letters)
    side = lambda name, **o: retrieval.encode(d, encoder=encoder, **o).withColumn("side", F.lit(name))
    both = side("document").unionByName(side("query", is_query=True, instruction=_ASKED))
    shown = F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", F.when(x > 0, x + 0.00000001).otherwise(0.0))), ",")
    return both.select("doc_id", "side", F.size("embedding").alias("dims"), shown.alias("vector"))
