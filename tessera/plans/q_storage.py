"""Queries over chunk and file tables. A lineitem is a chunk of the file l_orderkey, an order is a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import storage as O
from tessera.plans.registry import query
from tessera.plans.tables import table, values

_CHUNKS = "select l_suppkey as project, l_orderkey as file, l_linenumber as chunk_index, l_shipdate as created_at, l_quantity as size, l_returnflag as flag from lineitem"


def chunks(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("chunk_index"),
        F.col("l_shipdate").alias("created_at"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("flag"),
    )


@query("q16_project_stats", f"with c as ({_CHUNKS}) select project, count(*) as total_chunks, count(distinct file) as total_files from c group by project")
def q16(spark, d):
    return O.project_stats(chunks(spark, d))


@query(
    "q17_recent_files",
    f"""with c as ({_CHUNKS}) select o_orderkey as file, max(created_at) as last_update, count(c.file) as chunks, count(distinct chunk_index) as distinct_chunks
        from orders left join c on o_orderkey = c.file group by 1 order by last_update desc nulls last, file limit 50""",
)
def q17(spark, d):
    return O.recent_files(table(spark, d, "orders").select(F.col("o_orderkey").alias("file")), chunks(spark, d), 50)


@query(
    "q18_storage_usage",
    f"with c as ({_CHUNKS}) select project, count(*) as chunks, count(distinct file) as files, sum(size) as used, round(sum(size) * 100 / 15000.0, 6) as percent, greatest(0.0, 15000.0 - sum(size)) as remaining from c group by project",
)
def q18(spark, d):
    return O.storage_usage(chunks(spark, d), 15000.0)


@query(
    "q19_storage_stats",
    f"""with c as ({_CHUNKS}), n as (select project, count(*) as total, count(*) filter (flag = 'R') as int8, count(*) filter (flag <> 'R' or flag is null) as float32 from c group by project)
        select *, int8 * 1536 * 3 as saved_bytes, round(total * 1536 * 4 / (total * 1536 * 4 - int8 * 1536 * 3), 6) as ratio from n""",
)
def q19(spark, d):
    return O.storage_stats(chunks(spark, d), F.col("flag") == "R")


@query("q23_stale_generations", f"with c as ({_CHUNKS}) select file, count(distinct created_at::date) as generations, count(*) as chunks, max(created_at::date)::varchar as newest from c group by file having count(distinct created_at::date) > 1")
def q23(spark, d):
    return O.stale_generations(chunks(spark, d))


@query(
    "q24_stale_cleanup",
    f"""with c as ({_CHUNKS}), g as (select *, dense_rank() over (partition by file order by created_at::date desc) as generation from c),
        n as (select file, count(*) filter (generation > 1) as deleted, count(*) filter (generation = 1) as kept from g group by file) select *, deleted * 2560 as freed from n where deleted > 0""",
)
def q24(spark, d):
    return O.stale_cleanup(chunks(spark, d))


@query(
    "q25_lru_eviction",
    f"""with c as ({_CHUNKS}), s as (select *, sum(size) over (partition by project order by created_at, file, chunk_index rows unbounded preceding) as freed from c)
        select project, file, chunk_index, size, freed from s where freed - size < 500""",
)
def q25(spark, d):
    return O.lru_eviction(chunks(spark, d), 500.0).select("project", "file", "chunk_index", "size", "freed")


@query(
    "q26_quota_admission",
    f"""with c as ({_CHUNKS}), u as (select project, sum(size) as used from c group by project)
        select project, used, greatest(0.0, used + 100 - 15000) as to_free, case when used + 100 <= 15000 then 'admit' when 100 <= 15000 then 'evict' else 'reject' end as verdict from u""",
)
def q26(spark, d):
    return O.quota_admission(chunks(spark, d), 15000.0, 100.0)


@query(
    "q53_stale_vs_disk",
    f"""with c as ({_CHUNKS}), s as (select file, max(created_at) as last_update from c group by file), o as (select o_orderkey as file, o_orderdate as mtime from orders where o_orderkey % 7 <> 0)
        select s.file, last_update, mtime, case when mtime is null then 'missing' else 'stale' end as state from s left join o on s.file = o.file where mtime is null or mtime > last_update""",
)
def q53(spark, d):
    stored = chunks(spark, d).groupBy("file").agg(F.max("created_at").alias("last_update"))
    disk = table(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("file"), F.col("o_orderdate").alias("mtime"))
    return O.stale_against_disk(stored, disk)


@query(
    "q54_manifest_diff",
    """with l as (select o_orderkey as file, md5(o_orderstatus) as hash from orders), r as (select o_orderkey as file, md5(case when o_orderkey % 11 = 0 then 'x' else o_orderstatus end) as hash from orders where o_orderkey % 5 <> 0)
        select l.file, case when r.hash is null then 'missing' else 'hash_mismatch' end as reason from l left join r on l.file = r.file where r.hash is null or r.hash <> l.hash""",
)
def q54(spark, d):
    o = table(spark, d, "orders")
    local = o.select(F.col("o_orderkey").alias("file"), F.md5("o_orderstatus").alias("hash"))
    remote = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("file"), F.md5(F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("hash"))
    return O.manifest_diff(local, remote)


@query("q55_unused_vars", "select distinct p_name || '/' || p_size as name from part where p_partkey % 2 = 0 except select p_name || '/' || p_size from part where p_partkey % 2 = 1")
def q55(spark, d):
    p = table(spark, d, "part").withColumn("name", F.concat_ws("/", "p_name", "p_size"))
    return O.unused(p.filter("p_partkey % 2 = 0").select("name"), p.filter("p_partkey % 2 = 1").select("name"))


@query("q93_latest_wins_upsert", f"with c as ({_CHUNKS}), r as (select *, row_number() over (partition by file, chunk_index order by created_at desc, project) as v from c) select file, chunk_index, project, size from r where v = 1")
def q93(spark, d):
    return O.latest_wins(chunks(spark, d), ["file", "chunk_index"], [F.desc("created_at"), F.col("project")]).select("file", "chunk_index", "project", "size")


_LABEL = "case l_suppkey % 7 when 0 then 'text-embedding-3-small' when 1 then 'openai' when 2 then 'voyage-3' when 3 then 'all-MiniLM-L6-v2' when 4 then 'multilingual-e5-large' when 5 then 'voyageai' end"
_DIMS = "case when l_linenumber = 7 then null when l_suppkey % 3 = 0 then 1536 else 384 end"


def _labelled(spark, d):
    return chunks(spark, d).withColumn("provider", F.expr(_LABEL.replace("l_suppkey", "project"))).withColumn("dims", F.expr(_DIMS.replace("l_suppkey", "project").replace("l_linenumber", "chunk_index")))


_NORM = "case when starts_with(lower(coalesce(p, '')), 'text-embedding-') then 'openai' when starts_with(lower(coalesce(p, '')), 'voyage-') or lower(coalesce(p, '')) = 'voyageai' then 'voyageai' when contains(lower(coalesce(p, '')), 'minilm') or contains(lower(coalesce(p, '')), 'transformers') or contains(lower(coalesce(p, '')), 'e5') then 'local' else p end"


@query("q20_provider_dim_compatibility", f"with c as (select {_LABEL} as p, {_DIMS} as dims from lineitem) select {_NORM} as provider, dims, count(*) as n from c group by all")
def q20(spark, d):
    """Providers are normalised first, then counted once."""
    return O.provider_dimensions(_labelled(spark, d))


@query("q174_generation_lists", f"with c as ({_CHUNKS}), g as (select file, created_at::date as day, string_agg(chunk_index::varchar, ',' order by chunk_index) as chunks from c group by 1, 2) select file, string_agg(day::varchar || ':' || chunks, ';' order by day desc) as generations from g group by file having count(*) > 1")
def q174(spark, d):
    g = O.generation_lists(chunks(spark, d))
    one = lambda x: F.concat(x["day"], F.lit(":"), F.array_join(x["chunks"].cast("array<string>"), ","))
    return g.select("file", F.array_join(F.transform("generations", one), ";").alias("generations"))


@query("q175_dimension_conflicts", f"with c as (select l_suppkey as project, {_DIMS} as dims from lineitem), g as (select dims, project, count(*) as n from c where dims <> 384 group by 1, 2) select dims, sum(n)::bigint as n, string_agg(project::varchar, ',' order by project) as projects, (select count(*) from c where dims is null or dims = 384) as left_over from g group by dims")
def q175(spark, d):
    c = _labelled(spark, d)
    left = O.without_conflicts(c, 384).agg(F.count("*").alias("left_over"))
    return O.dimension_conflicts(c, 384).crossJoin(left)  # one row


_STATS = f"st as (select s_suppkey as project, count(l_orderkey) as total_chunks, max(l_shipdate) as updated_at from supplier left join lineitem on l_suppkey = s_suppkey and l_suppkey % 3 <> 0 group by 1)"


def _stats(spark, d):
    l = table(spark, d, "lineitem").filter("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("project")).agg(F.count("*").alias("total_chunks"), F.max("l_shipdate").alias("updated_at"))  # noqa: E741
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("project")).join(l, "project", "left").fillna(0, ["total_chunks"])


@query("q176_active_projects", f"with {_STATS} select project, total_chunks from st where total_chunks > 0")
def q176(spark, d):
    return O.active_projects(_stats(spark, d)).select("project", "total_chunks")


@query("q177_legacy_statistics", f"with {_STATS}, w as (select project, project + 1 as legacy from st) select w.project, case when a.total_chunks > 0 then a.total_chunks else coalesce(b.total_chunks, 0) end as chunks, case when a.total_chunks > 0 then 'own' when b.total_chunks > 0 then 'legacy' else 'none' end as source from w left join st a on w.project = a.project left join st b on w.legacy = b.project")
def q177(spark, d):
    stats = _stats(spark, d).select("project", F.col("total_chunks").alias("chunks"))
    return O.with_legacy(stats.select("project", (F.col("project") + 1).alias("legacy")), stats)


@query("q178_register_projects", "with n as (select s_suppkey as project, 'new' as path, 9 as added_at from supplier where s_suppkey % 2 = 0 union all select s_suppkey + 100000, 'new', 9 from supplier where s_suppkey % 5 = 0), p as (select s_suppkey as project, s_name as path, s_nationkey as added_at from supplier) select project, path, added_at from p where project not in (select project from n) union all select n.project, n.path, coalesce(p.added_at, n.added_at) from n left join p on n.project = p.project")
def q178(spark, d):
    s = table(spark, d, "supplier")
    p = s.select(F.col("s_suppkey").alias("project"), F.col("s_name").alias("path"), F.col("s_nationkey").alias("added_at"))
    new = lambda rows, key: rows.select(key.alias("project"), F.lit("new").alias("path"), F.lit(9).alias("added_at"))
    changes = new(s.filter("s_suppkey % 2 = 0"), F.col("s_suppkey")).unionByName(new(s.filter("s_suppkey % 5 = 0"), F.col("s_suppkey") + 100_000))
    return O.register(p, changes)


@query("q179_find_project", "select s_suppkey as project, s_name as path from supplier where s_suppkey = 7 union all select s_suppkey, s_name from supplier where s_name = 'Supplier#000000003'")
def q179(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.col("s_name").alias("path"))
    return O.find_project(p, project=7).unionByName(O.find_project(p, path="Supplier#000000003"))


@query(
    "q180_admission_after_eviction",
    f"""with c as ({_CHUNKS}), u as (select project, sum(size) as used from c group by project), p as (select *, greatest(0.0, used + 700 - 15000) as to_free, case when used + 700 <= 15000 then 'admit' else 'evict' end as verdict from u),
        f as (select c.*, sum(size) over (partition by project order by created_at, file, chunk_index rows unbounded preceding) as freed_ from c), g as (select f.project, count(*) as evicted, sum(f.size) as freed from f join p on f.project = p.project where freed_ - size < to_free group by 1),
        o as (select p.*, coalesce(g.evicted, 0) as evicted, coalesce(g.freed, 0) as freed from p left join g on p.project = g.project) select project, case when used - freed + 700 <= 15000 then verdict else 'reject' end as verdict, evicted, freed::double as freed, case when used - freed + 700 <= 15000 then used - freed + 700 else used - freed end as used_after from o""",
)
def q180(spark, d):
    return O.admit(chunks(spark, d), 15000.0, 700.0)


_ORDERS = "select o_orderkey as file, case when o_orderkey % 13 = 0 then null else md5(o_orderstatus) end as hash, o_orderdate as mtime from orders"


@query("q181_changed_against_stored", f"with o as ({_ORDERS}), s as (select file, case when file % 11 = 0 then 'x' else md5(o_orderstatus) end as hash from o join orders on o_orderkey = file where file % 5 <> 0) select o.file from o left join s on o.file = s.file where o.hash is null or o.hash is distinct from s.hash")
def q181(spark, d):
    o = table(spark, d, "orders")
    now = o.select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 13 != 0, F.md5("o_orderstatus")).alias("hash"))
    stored = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.md5("o_orderstatus")).alias("hash"))
    return O.changed_against(now, stored).select("file")


@query("q182_newer_than_stored", "with s as (select l_orderkey as file, max(l_shipdate) as last_update from lineitem group by 1) select o_orderkey as file from orders left join s on o_orderkey = file where last_update is null or o_orderdate > last_update")
def q182(spark, d):
    stored = chunks(spark, d).groupBy("file").agg(F.max("created_at").alias("last_update"))
    return O.newer_than_stored(table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderdate").alias("mtime")), stored).select("file")


@query("q183_replace_files", f"with c as ({_CHUNKS}), n as (select project, file, 1 as chunk_index, size + 1000 as size from c where file % 10 = 3 and chunk_index = 1) select project, file, chunk_index, size from c where file not in (select file from n) union all select * from n")
def q183(spark, d):
    c = chunks(spark, d).select("project", "file", "chunk_index", "size")
    new = c.filter("file % 10 = 3 and chunk_index = 1").withColumn("size", F.col("size") + 1000)
    return O.replace_files(c, new)


@query("q184_upsert", f"with c as ({_CHUNKS}), n as (select file, chunk_index, max(size) + 1000 as size from c where file % 10 = 3 and chunk_index <= 2 group by 1, 2), b as (select file, chunk_index, max(size) as size from c group by 1, 2) select * from b where (file, chunk_index) not in (select (file, chunk_index) from n) union all select * from n")
def q184(spark, d):
    base = chunks(spark, d).groupBy("file", "chunk_index").agg(F.max("size").alias("size"))
    new = base.filter("file % 10 = 3 and chunk_index <= 2").withColumn("size", F.col("size") + 1000)
    return O.upsert(base, new, ["file", "chunk_index"])


@query("q185_changed_files", "select o_orderkey as file from orders where o_orderstatus = 'F' or o_orderkey % 9 = 0")
def q185(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), "o_orderstatus")
    return O.changed_files(o.filter("o_orderstatus = 'F'").select("file"), o.filter("file % 9 = 0").select("file"), o.select("file"), False)


@query("q186_format_and_language", f"with c as ({_CHUNKS}) select flag, count(*) as n from c where flag in ('R', 'A') and size > 10 group by flag")
def q186(spark, d):
    return chunks(spark, d).filter(F.col("flag").isin("R", "A") & (F.col("size") > 10)).groupBy("flag").agg(F.count("*").alias("n"))
