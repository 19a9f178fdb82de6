"""Queries over events: the batch forms of the streaming operators, and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import detectors as D
from tessera.plans.registry import query
from tessera.plans.tables import table, values
from tessera.streaming import changes as C


def events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("key"), "event_type", F.md5(F.floor("value").cast("string")).alias("hash"), (F.col("event_type") == "error").alias("failed"))


_GAP = 6 * 3600


@query(
    "q80_debounce_sessions",
    f"""with e as (select user_id as key, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '{_GAP}' second then 0 else 1 end as fresh, event_id from events),
        s as (select *, sum(fresh) over (partition by key order by ts, event_id rows unbounded preceding) as n from e)
        select key, min(ts) as first, max(ts) as last, max(ts) + interval '{_GAP}' second as fires, count(*) as events from s group by key, n""",
)
def q80(spark, d):
    return C.debounce(events(spark, d), f"{_GAP} seconds")


@query(
    "q81_change_detection",
    "with e as (select event_id, user_id as key, md5(floor(value)::bigint::varchar) as hash, lag(md5(floor(value)::bigint::varchar)) over (partition by user_id order by ts, event_id) as before from events) select event_id, key, hash from e where hash is distinct from before",
)
def q81(spark, d):
    return C.changed(events(spark, d)).select("event_id", "key", "hash")


@query(
    "q82_circuit_breaker",
    "with e as (select event_id, user_id as key, count(*) over (partition by user_id order by ts range between interval 86400 second preceding and current row) as recent from events where event_type = 'error') select event_id, key, recent, recent >= 3 as open from e",
)
def q82(spark, d):
    return C.circuit_breaker(events(spark, d), 3, 86_400).select("event_id", "key", "recent", "open")


@query("q83_rate_limit_window", "select user_id as key, time_bucket(interval '1 day', ts) as start, count(*) as n, count(*) > 5 as limited from events group by 1, 2")
def q83(spark, d):
    return C.rate_windows(events(spark, d), "1 day", 5)


@query("q84_single_flight_dedup", "with r as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) select event_id, user_id as key, event_type from r where k = 1")
def q84(spark, d):
    """The first of identical requests, by aggregation."""
    e = events(spark, d).groupBy("key", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return e.select(F.col("f.event_id").alias("event_id"), "key", "event_type")


@query(
    "q52_range_join_line_symbol",
    "with f as (select event_id as frame, user_id % 10 as file, (event_id % 100)::bigint as line from events where event_type = 'error'), s as (select (n % 10)::bigint as file, (n // 10 * 20)::bigint as start, (n // 10 * 20 + 14)::bigint as \"end\", 'sym' || n as symbol from range(50) t(n)) select frame, f.file, line, min_by(symbol, start) as symbol from f left join s on f.file = s.file and line between start and \"end\" group by all",
)
def q52(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    frames = e.select(F.col("event_id").alias("frame"), (F.col("user_id") % 10).alias("file"), (F.col("event_id") % 100).alias("line"))
    start = F.floor(F.col("id") / 10) * 20
    symbols = spark.range(50).select((F.col("id") % 10).alias("file"), start.alias("start"), (start + 14).alias("end"), F.concat(F.lit("sym"), F.col("id")).alias("symbol"))
    return D.locate(frames, symbols)


_WEIGHTS = "('error', 50), ('click', 15), ('view', 5), ('purchase', 20), ('signup', 10)"


@query(
    "q69_risk_score",
    f"with f as (select distinct user_id as subject, event_type as rule from events where value > 150), s as (select subject, least(100, sum(weight))::bigint as score from f join (values {_WEIGHTS}) w(rule, weight) on f.rule = w.rule group by subject) select *, case when score >= 70 then 'high' when score >= 40 then 'medium' when score >= 20 then 'low' else 'minimal' end as level from s",
)
def q69(spark, d):
    fired = table(spark, d, "events").filter("value > 150").select(F.col("user_id").alias("subject"), F.col("event_type").alias("rule"))
    return D.risk_score(fired, values(spark, _WEIGHTS, "rule, weight"))


@query("q70_health_score", "select user_id, greatest(0, 100 - 20 * count(*) filter (event_type = 'error') - 5 * count(*) filter (event_type = 'click')) as health from events group by user_id")
def q70(spark, d):
    issues, recommendations = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "click")
    return table(spark, d, "events").groupBy("user_id").agg(D.health_score(issues, recommendations).alias("health"))


@query(
    "q71_telemetry_budget",
    "select event_id, array_to_string(list_filter([case when value * 10 > 500 then 'retrieval' end, case when value > 200 then 'composer' end, case when value / 1000 < 0.1 then 'coverage' end, case when event_id % 10 > 5 then 'anchors' end], lambda x: x is not null), ',') as breaches from events",
)
def q71(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.array_join(D.budget_breaches(v * 10, v, v / 1000, F.col("event_id") % 10), ",").alias("breaches"))


@query("q72_benchmark_stats", "select event_type, min(value) as least, max(value) as most, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as spread, count(*) as n from events group by event_type")
def q72(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"), F.count("*").alias("n"))


@query(
    "q187_project_gap",
    "with e as (select ts, event_id, case when ts - lag(ts) over (order by ts, event_id) < interval '20' minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (order by ts, event_id rows unbounded preceding) as n from e) select 'p' as key, min(ts) as first, max(ts) as last, max(ts) + interval '20' minute as fires, count(*) as events from s group by n",
)
def q187(spark, d):
    """Changes anywhere in a project; a run ends with a pause of 20 minutes."""
    from tessera.streaming.watching import project_changes

    return project_changes(events(spark, d), "p", "20 minutes")


@query("q188_circuit_with_reset")
def q188(spark, d):
    """Opened by the third error in a row, closed after two days."""
    from tessera.streaming.watching import breaker

    return breaker(events(spark, d), 3, 2 * 86_400)


@query(
    "q189_concurrency_halving",
    """with h as (select event_id, user_id as key, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '2' day then 0 else 1 end as fresh from events where event_type = 'error'),
        r as (select *, sum(fresh) over (partition by key order by ts, event_id rows unbounded preceding) as run from h), n as (select *, row_number() over (partition by key, run order by ts, event_id) as hits from r)
        select event_id, key, hits::int as hits, case when hits >= 3 then greatest(1, floor(16 / pow(2::double, hits - 2)))::int else 16 end as concurrency from n""",
)
def q189(spark, d):
    from tessera.streaming.watching import concurrency

    return concurrency(events(spark, d).filter("failed"), 16, 2 * 86_400).select("event_id", "key", "hits", "concurrency")
