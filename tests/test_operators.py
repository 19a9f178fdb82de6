"""Pinned behaviours on small literal inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import detectors as D
from tessera.operators import documents as O
from tessera.operators import storage, symbols
from tessera.operators import vectors as VO
from tessera.sources import files
from tessera.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("a, b, expected", [([1, 0], [0, 1], 0), ([1, 1], [1, 1], 1), ([0, 0], [1, 1], 0), ([1, 0], [1, 0, 0], 0)])
def test_cosine(spark, a, b, expected):
    assert one(spark, V.cosine(V.literal(a), V.literal(b))) == pytest.approx(expected)


def test_quantise(spark):
    v = V.literal([1, 0, -0.5, 0.8, -0.2])
    assert one(spark, V.quantize_int8(v, V.int8_scale(v))) == [127, 0, -63, 102, -25]
    zero = V.literal([0] * 5)
    assert one(spark, V.int8_scale(zero)) == 1.0


def test_top_similar_regimes(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.1, 0.1]), (3, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<double>")
    assert [r.vec_id for r in VO.top_similar(df, [1.0, 0.0], 5, 0.5).collect()] == [1, 2]
    assert [r.vec_id for r in VO.top_similar(df, [1.0, 0.0], 5, 0.1).collect()] == [1, 2]
    assert VO.top_similar(df, [-1.0, -1.0], 5, 0.9).count() == 3


def test_mmr_keeps_caps(spark):
    rows = [(1, k, "a" if k < 6 else "b", 1.0 - k / 10, [float(k == j) for j in range(8)]) for k in range(8)]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, facet string, score double, embedding array<double>")
    got = VO.mmr_rerank(df, limit=6, cap=2).collect()
    assert len(got) == 4 and sum(r.facet == "a" for r in got) == 2 and got[0].rank == 1


def test_lexical(spark):
    text = "function calculateTotal(items) { return items.reduce((sum, i) => sum + i.price, 0); } // ok.."
    df = spark.createDataFrame([(1, text, "calculateTotal", False), (2, text, "calculateTotal", True), (3, text + "x" * 3000, "calculateTotal", False)], "id long, content string, name string, is_symbol boolean")
    got = O.lexical_search(df, "calculateTotal").collect()
    assert [r.id for r in got] == [2, 1, 3] and got[0].score == pytest.approx(got[1].score + 0.2)
    assert O.lexical_search(df, "a an").count() == 0 and O.lexical_search(df, "nonexistentterm").count() == 0
    assert O.lexical_search(df, "calculateTotal", 1).count() == 1


def test_budgets(spark):
    df = spark.createDataFrame([("g", 1, 0.9, 5), ("g", 2, 0.8, 6), ("g", 3, 0.7, 2)], "g string, id long, score double, tokens long")
    assert [r.id for r in O.budget_prefix(df, "g", 10).collect()] == [1]
    assert sorted(r.id for r in O.budget_greedy(df, "g", 10).collect()) == [1, 3]


def test_text_rules(spark):
    assert [one(spark, T.quota_bytes(F.lit(q))) for q in ("10GB", "500MB", "7", "abc")] == [10737418240, 524288000, 7340032, 10737418240]
    assert [one(spark, T.confidence(F.lit(c).cast("string"))) for c in ("85.2%", "0.5", None)] == [pytest.approx(0.852), 0.5, None]
    assert one(spark, T.complexity(F.lit("if (a && b) { for (;;) {} }"))) == 4
    assert one(spark, T.task_type(F.lit("Fix this bug"))) == "troubleshoot"
    assert one(spark, D.health_score(F.lit(2), F.lit(3))) == 45
    routes = {"app/page.tsx": "/", "app/users/[id]/page.tsx": "/users/:id", "app/blog/[...slug]/page.tsx": "/blog/*slug", "app/files/[[...path]]/page.tsx": "/files/*path?", "app/(marketing)/pricing/page.tsx": "/pricing"}
    for file, route in routes.items():
        assert one(spark, T.route_path(F.lit(file))) == route


def test_storage(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 1, k, day(1), 10.0 * (k + 1)) for k in range(3)] + [(1, 1, 3 + k, day(2), 5.0) for k in range(2)]
    df = spark.createDataFrame(rows, "project long, file long, chunk_index int, created_at timestamp, size double")
    got = storage.stale_cleanup(df).first()
    assert (got.deleted, got.kept, got.freed) == (3, 2, 7680)
    assert [r.chunk_index for r in storage.lru_eviction(df, 25).collect()] == [0, 1]
    base, change = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in storage.upsert(base, change, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_dedup_keeps_exported(spark):
    df = spark.createDataFrame([(1, "h", 1), (2, "h", 0), (3, "z", 0)], "id long, hash string, hidden int")
    got = {r.id: (r.kept, r.duplicate) for r in O.keep_best(df, "hash", [F.col("hidden")]).collect()}
    assert got == {1: (2, True), 2: (2, False), 3: (3, False)}


def test_chunks_cover_all_lines(spark):
    text = "\n".join(f"line {k} " + "x" * 30 for k in range(200))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = O.overlap_chunks(df, 500, 100).filter("doc_id = 1").orderBy("chunk").collect()
    assert got[0].start_line == 1 and got[-1].end_line == 200
    assert all(b.start_line <= a.end_line + 1 for a, b in zip(got, got[1:]))
    assert O.fixed_line_chunks(df.filter("doc_id = 2"), 50).first().kind == "empty_file"


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\n")
    (tmp_path / "b.md").write_text("# hi\n")
    assert {r.language for r in files.scan(spark, str(tmp_path)).collect()} == {"python", "markdown"}
    assert files.manifest(spark, str(tmp_path)).filter("length(sha256) = 64").count() == 2
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path), most=1)
    files.write_markdown(spark.range(2), str(tmp_path / "md"), "t")
    assert spark.read.text(str(tmp_path / "md")).count() == 2


def test_prefers_sources(spark):
    df = spark.createDataFrame([("pkg/src/u.ts",), ("pkg/src/u.js",)], "path string")
    assert symbols.prefer_sources(df).first().path == "pkg/src/u.ts"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), k % 3, str(k // 4)) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, key long, hash string")
    expected = sorted(r.event_id for r in changes.changed(df).collect())
    for part in range(4):
        df.filter(f"event_id >= {part * 10} and event_id < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = changes.changed_stream(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_id for r in spark.table("changed").collect()) == expected


def test_debounce_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), 1) for m in (0, 2, 4, 30, 31)] + [(dt.datetime(2024, 1, 2), 2)]
    df = spark.createDataFrame(rows, "ts timestamp, key long")
    assert sorted(r.events for r in changes.debounce(df, "5 minutes").collect()) == [1, 2, 3]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.debounce(stream, "5 minutes", "1 minute").writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.events for r in spark.table("runs").collect()) == [2, 3]


def test_mmr_takes_every_query(spark):
    from tessera.plans import q_vectors

    d = "/root/testdata/sf0.01"
    ids = {r[0] for r in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert len(ids) > 1 and {r.query_id for r in q_vectors.q13(spark, d).collect()} == ids


def test_batch_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 8)).round(1)
    rows = [(k, base[k % 120].tolist()) for k in range(300)] + [(400, None), (401, [1.0] * 7), (402, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    monkeypatch.setattr(VO, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(VO, "VECTORS_AT_ONCE", 40)
    got = sorted(tuple(r) for r in VO.batch_top_similar(df, q, 4).select("query_id", "rank", "vec_id").collect())
    pairs = df.crossJoin(q).filter("vec_id <> query_id and q is not null").select("query_id", "vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("s")).collect()
    expected = []
    for i in {r.query_id for r in pairs}:
        best = sorted((r for r in pairs if r.query_id == i), key=lambda r: (-(r.s if r.s is not None else -9), r.vec_id))[:4]
        expected += [(i, n + 1, r.vec_id) for n, r in enumerate(best)]
    assert got == sorted(expected)
    assert VO.batch_top_similar(df, q.filter("false"), 4).count() == 0
