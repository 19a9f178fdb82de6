"""Queries over embeddings."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import vectors as O
from tessera.plans.registry import query
from tessera.plans.tables import table, vector

_SIM = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"


@query(
    "q01_vector_topk_low_threshold",
    f"""with s as (select e.vec_id, e.label, {_SIM} as similarity from embeddings e, embeddings q where q.vec_id = 0
        order by similarity desc, vec_id limit 10) select * from s where similarity > 0.05""",
)
def q01(spark, d):
    return O.top_similar(table(spark, d, "embeddings"), vector(spark, d, 0), 10, 0.2)


@query(
    "q02_vector_topk_high_threshold_fallback",
    f"""with s as (select e.vec_id, e.label, {_SIM} as similarity from embeddings e, embeddings q where q.vec_id = 0 and e.vec_id <> 0
        order by similarity desc, vec_id limit 10),
        t as (select *, count(*) filter (similarity >= 0.9) over () as n, row_number() over (order by similarity desc, vec_id) as r from s)
        select vec_id, label, similarity from t where similarity >= 0.9 or (n = 0 and r <= 3)""",
)
def q02(spark, d):
    return O.top_similar(table(spark, d, "embeddings").filter("vec_id <> 0"), vector(spark, d, 0), 10, 0.9)


@query(
    "q03_vector_batch_topk",
    f"""with s as (select q.vec_id as query_id, e.vec_id, {_SIM} as similarity from embeddings e, embeddings q where q.vec_id % 50 = 0 and e.vec_id <> q.vec_id),
        t as (select *, (row_number() over (partition by query_id order by similarity desc, vec_id))::int as rank from s) select * from t where rank <= 5""",
)
def q03(spark, d):
    e = table(spark, d, "embeddings")
    return O.batch_top_similar(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)


_SCALE = "case when list_max(list_transform(embedding, lambda x: abs(x::double))) = 0 then 1.0 else list_max(list_transform(embedding, lambda x: abs(x::double))) / 127.0 end"
_QUANTIZED = f"with s as (select vec_id, embedding, {_SCALE} as scale from embeddings), z as (select *, list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::double / scale + 0.5)::int))) as data from s)"


def _quantized(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", V.int8_scale(F.col("embedding")).alias("scale"))
    return e.withColumn("data", V.quantize_int8(F.col("embedding"), F.col("scale")))


@query("q04_quantize_int8", f"{_QUANTIZED} select vec_id, round(scale, 9) as scale, array_to_string(data, ',') as data from z")
def q04(spark, d):
    return _quantized(spark, d).select("vec_id", F.round("scale", 9).alias("scale"), F.array_join(F.col("data").cast("array<string>"), ",").alias("data"))


@query("q05_dequantize", f"{_QUANTIZED} select vec_id, round(list_sum(list_transform(data, lambda x: x::double * scale)), 6) + 0.0::double as total, case when data[1] = 0 then 0.0::double else round(data[1]::double * scale, 6) end as first from z")
def q05(spark, d):
    back = V.dequantize(F.col("data"), F.col("scale"))
    z = _quantized(spark, d).withColumn("back", back)
    return z.select("vec_id", (F.round(F.aggregate("back", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"), F.when(F.col("data")[0] == 0, F.lit(0.0)).otherwise(F.round(F.col("back")[0], 6)).alias("first"))


@query(
    "q06_quantization_error",
    f"""{_QUANTIZED}, r as (select vec_id, list_transform(list_zip(embedding, data), lambda p: p[1]::double - p[2]::double * scale) as err,
        list_cosine_similarity(embedding::double[], list_transform(data, lambda x: x::double * scale)) as cos from z)
        select vec_id, round(list_avg(list_transform(err, lambda x: abs(x))), 6) as mean_abs, round(list_max(list_transform(err, lambda x: abs(x))), 6) as max_abs,
        round(sqrt(list_avg(list_transform(err, lambda x: x * x))), 6) as rmse, round(cos, 6) as cosine from r""",
)
def q06(spark, d):
    z = _quantized(spark, d).withColumn("back", V.dequantize(F.col("data"), F.col("scale")))
    z = z.withColumn("err", F.zip_with("embedding", "back", lambda x, y: F.abs(x.cast("double") - y)))
    mean = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x)) / F.size(c)
    return z.select("vec_id", F.round(mean("err", lambda x: x), 6).alias("mean_abs"), F.round(F.array_max("err"), 6).alias("max_abs"), F.round(F.sqrt(mean("err", lambda x: x * x)), 6).alias("rmse"), F.round(V.cosine(F.col("embedding"), F.col("back")), 6).alias("cosine"))


_PATH = "case d.lang when 'de' then 'tests/' when 'fr' then 'docs/' when 'es' then 'scripts/' else 'src/' end || d.source || '.ts'"
#: Parts of paths and what they multiply a score by.
PENALTIES = (("tests/", 0.8), ("scripts/", 0.8), ("docs/", 0.7), ("*.md", 0.7), ("*.txt", 0.7), (".env*", 0.3), ("node_modules/", 0.1))
_FACTOR = " * ".join(f"case when contains(p.path, '{k}') then {v} else 1.0 end" for k, v in PENALTIES)


@query(
    "q07_penalised_coarse_retrieval",
    f"""with p as (select e.vec_id, {_PATH} as path, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as sim
        from embeddings e join documents d on e.vec_id = d.doc_id, embeddings q where q.vec_id = 0),
        s as (select vec_id, path, round(sim * {_FACTOR}, 6) as score from p) select * from s where score >= 0.18 order by score desc, vec_id limit 60""",
)
def q07(spark, d):
    """Penalties are literal parts of a path; scores under 0.18 go; the best 60."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_PATH.replace("d.", "")).alias("path"))
    rows = table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))
    factor = F.lit(1.0)
    for part, by in PENALTIES:
        factor = factor * F.when(F.col("path").contains(part), by).otherwise(1.0)
    score = F.round(V.cosine(F.col("embedding"), V.literal(vector(spark, d, 0))) * factor, 6)
    return rows.select("vec_id", "path", score.alias("score")).filter("score >= 0.18").orderBy(F.desc("score"), "vec_id").limit(60)


@query("q13_mmr_rerank")
def q13(spark, d):
    """Candidates: the 60 nearest of each vector whose id 50 divides."""
    e = table(spark, d, "embeddings")
    top = O.batch_top_similar(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 60)
    rows = top.join(e, "vec_id").select("query_id", "vec_id", F.col("label").cast("string").alias("facet"), F.col("similarity").alias("score"), "embedding")
    return O.mmr_rerank(rows)


@query("q34_embedding_byte_size", "select label, count(*) as n, sum(len(embedding) * 4) as float_bytes, sum(len(embedding)) as int8_bytes, round(sum(len(embedding) * 4) / sum(len(embedding)), 6) as ratio from embeddings group by label")
def q34(spark, d):
    e = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).alias("float_bytes"), F.sum(F.size("embedding")).alias("int8_bytes"))
    return e.withColumn("ratio", F.round(F.col("float_bytes") / F.col("int8_bytes"), 6))


@query("q21_model_change_incompatible", "select count(*) filter (where label <> 3 or len(embedding) <> 64) as incompatible, count(*) as total from embeddings")
def q21(spark, d):
    return table(spark, d, "embeddings").agg(F.count_if((F.col("label") != 3) | (F.size("embedding") != 64)).alias("incompatible"), F.count("*").alias("total"))


@query("q22_invalid_dims", "select count(*) filter (where embedding is null or len(embedding) <= 0) as invalid, count(*) filter (where list_bool_or(list_transform(embedding, lambda x: not isfinite(x)))) as not_finite from embeddings")
def q22(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").agg(F.count_if(e.isNull() | (F.size(e) <= 0)).alias("invalid"), F.count_if(F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"))


@query(
    "q200_decoded_chunks",
    f"""{_QUANTIZED}, r as (select vec_id as id, case when vec_id % 2 = 0 then list_transform(data, lambda x: x::double * scale) else list_transform(embedding, lambda x: x::double) end as e from z) select id, round(list_sum(e), 5) + 0.0::double as total, len(e)::int as dims, case when id % 5 = 0 then 0 else 2 end as symbols from r""",
)
def q200(spark, d):
    z = _quantized(spark, d)
    stored = z.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "int8").otherwise("float32").alias("format"), F.when(F.col("vec_id") % 2 == 0, F.col("data").cast("array<float>")).otherwise(F.col("embedding").cast("array<float>")).alias("data"), "scale", F.when(F.col("vec_id") % 5 == 0, "no json").otherwise('["a", "b"]').alias("symbols"))
    out = O.decoded_chunks(stored)
    return out.select("id", (F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5) + F.lit(0.0)).alias("total"), F.size("embedding").alias("dims"), F.size("symbols").alias("symbols"))


@query("q202_quantisation_savings")
def q202(spark, d):
    """JSON of floats is written differently by every engine: rows only."""
    return O.quantisation_savings(table(spark, d, "embeddings"), "label")
