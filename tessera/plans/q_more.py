"""Queries over source files, configurations and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import detectors as D
from tessera.operators import frontend as A
from tessera.plans.registry import query
from tessera.plans.tables import table

@query("q99_page_findings", """select page_id, unnest(list_filter([case when len(regexp_extract_all(html, '<img\\b[^>]*>')) > len(regexp_extract_all(html, '<img\\b[^>]*\\balt=[^>]*>')) then 'A11Y-IMG-ALT' end,
    case when len(regexp_extract_all(html, '<a\\b[^>]*href="https?://[^>]*>')) > len(regexp_extract_all(html, '<a\\b[^>]*href="https?://[^>]*\\brel=[^>]*>')) then 'SEC-001' end,
    case when not contains(lower(html), '<h1') then 'A11Y-H1' end, case when not contains(lower(html), '<main') then 'A11Y-MAIN' end], lambda x: x is not null)) as rule from pages""")
def q99(spark, d):
    return A.page_findings(table(spark, d, "pages"))


@query("q104_unique_names", "with r as (select p_partkey as id, split_part(p_name, ' ', 1) as name, row_number() over (partition by split_part(p_name, ' ', 1) order by p_partkey) as n from part) select id, case when n = 1 then name else name || n end as unique_name from r")
def q104(spark, d):
    return A.unique_names(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")))


@query("q106_integrity_check", "with f as (select vec_id, embedding from embeddings order by vec_id limit 10) select count(*) as checked, count(*) filter (len(embedding) <> 64) as wrong_size, count(*) filter (list_bool_or(list_transform(embedding, lambda x: not isfinite(x)))) as not_finite from f")
def q106(spark, d):
    e = F.col("embedding")
    first = table(spark, d, "embeddings").select("vec_id", "embedding").orderBy("vec_id").limit(10)
    return first.agg(F.count("*").alias("checked"), F.count_if(F.size(e) != 64).alias("wrong_size"), F.count_if(F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"))


_RUNS = "select user_id % 7 as project, case when event_id % 2 = 0 then 'baseline' else 'optimised' end as configuration, value as time, 1 + event_id % 5 as compression, 10 + event_id % 3 as quality, (event_type = 'error')::int as errors from events"


def _runs(spark, d):
    e, c = table(spark, d, "events"), F.col
    kind = F.when(c("event_id") % 2 == 0, "baseline").otherwise("optimised")
    return e.select((c("user_id") % 7).alias("project"), kind.alias("configuration"), c("value").alias("time"), (c("event_id") % 5 + 1).alias("compression"), (c("event_id") % 3 + 10).alias("quality"), (c("event_type") == "error").cast("int").alias("errors"))


_MEAN = lambda c, v: f"avg({v}) filter (configuration = '{c}')"
_CHANGE = lambda v: f"({_MEAN('optimised', v)} - {_MEAN('baseline', v)}) / {_MEAN('baseline', v)}"


@query("q201_compare_configurations", f"with r as ({_RUNS}) select project, round(-({_CHANGE('time')}), 6) as time_reduction, round({_CHANGE('compression')}, 6) as compression_gain, round({_CHANGE('quality')}, 6) as quality_gain from r group by project")
def q201(spark, d):
    return D.compare_configurations(_runs(spark, d), "project")


@query("q107_regression_check", f"with r as ({_RUNS}), m as (select project, {', '.join(f'{_MEAN(c, v)} as {c[0]}_{v}' for c in ('baseline', 'optimised') for v in ('time', 'compression', 'errors'))} from r group by project) select project, array_to_string(list_filter([case when (o_time - b_time) / b_time > 0.02 then 'time' end, case when (b_compression - o_compression) / b_compression > 0.02 then 'compression' end, case when o_errors > b_errors * 1.02::double then 'errors' end], lambda x: x is not null), ',') as issues from m")
def q107(spark, d):
    """One half of the measurements against the other, with a tolerance of two per cent."""
    r = _runs(spark, d)
    mean = lambda c: r.filter(F.col("configuration") == c).groupBy("project").agg(*[F.avg(v).alias(v) for v in ("time", "compression", "errors")])
    return D.regressions(mean("optimised"), mean("baseline"), "project", 0.02)


@query("q109_embedding_time", "select source, count(*) as files, case when avg(n_chars) < 1024 then 1000 when avg(n_chars) <= 10240 then 500 else 200 end as per_minute, ceil(count(*) / (case when avg(n_chars) < 1024 then 1000 when avg(n_chars) <= 10240 then 500 else 200 end) * 60)::bigint as seconds from documents group by source")
def q109(spark, d):
    rate = F.when(F.avg("n_chars") < 1024, 1000).when(F.avg("n_chars") <= 10240, 500).otherwise(200)
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), rate.alias("per_minute"))
    return g.withColumn("seconds", F.ceil(F.col("files") / F.col("per_minute") * 60))


@query("q110_compact_report", "select lang, string_agg(source || '=' || n, ', ' order by source) as line from (select lang, source, count(*) as n from documents group by 1, 2) group by lang")
def q110(spark, d):
    g = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("source", "n")))
    return g.groupBy("lang").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["source"], F.lit("="), p["n"].cast("string"))), ", ").alias("line"))


@query("q111_upload_batches", "with r as (select o_orderkey, ((row_number() over (partition by o_orderpriority order by o_orderkey) - 1) // 500)::int as batch, o_orderpriority as lane from orders) select lane, batch, count(*) as files, min(o_orderkey) as first from r group by lane, batch")
def q111(spark, d):
    """Batches of 500 within each lane."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("lane"), F.floor((F.row_number().over(w) - 1) / 500).cast("int").alias("batch"))
    return r.groupBy("lane", "batch").agg(F.count("*").alias("files"), F.min("o_orderkey").alias("first"))


@query("q112_labels_coverage", "select d.source, count(*) as documents, count(l.doc_id) as labelled, count(*) filter (l.doc_id is null) as unlabelled, round(avg(l.quality), 6) as quality from documents d left join labels l on d.doc_id = l.doc_id group by d.source")
def q112(spark, d):
    l = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")  # noqa: E741
    both = table(spark, d, "documents").select("doc_id", "source").join(l, F.col("doc_id") == F.col("id"), "left")
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.count("id").alias("labelled"), F.count_if(F.col("id").isNull()).alias("unlabelled"), F.round(F.avg("quality"), 6).alias("quality"))
