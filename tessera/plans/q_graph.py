"""Queries over graphs and rankings. An edge is a lineitem: part -> supplier, or order -> part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans.registry import query
from tessera.plans.tables import table, values


def edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


@query(
    "q48_import_degree_boost",
    """with o as (select l_partkey as node, count(*) as n_out from lineitem group by 1), i as (select l_suppkey as node, count(*) as n_in from lineitem group by 1)
        select coalesce(o.node, i.node) as node, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) + coalesce(n_in, 0) * 1.5::double as degree from o full join i on o.node = i.node""",
)
def q48(spark, d):
    return G.degree_boost(edges(spark, d))


@query("q49_neighbours_topk", "select distinct l_suppkey as node from lineitem where l_partkey in (1, 2, 3) and l_suppkey not in (1, 2, 3) order by 1 limit 12")
def q49(spark, d):
    return G.neighbours(values(spark, "(1L), (2L), (3L)", "node"), edges(spark, d), 12)
