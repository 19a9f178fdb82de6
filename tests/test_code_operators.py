"""Compaction, ranking, project, frontend, debugging and source-text operators on small literal inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera import entries
from tessera.operators import compaction, debugging, detectors, documents, frontend, graph, lineage, project, ranking, sources_text, storage, symbols
from tessera.streaming import watching

SYMBOLS = "id long, file string, kind string, name string, signature string, body string, doc string, exported boolean, is_async boolean, parameters int, relations int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.fixture(scope="module")
def code(spark):
    rows = [
        (1, "src/a.ts", "function", "createUser", "function createUser(name)", "return 1", "Creates a user in the database", True, False, 1, 2), (2, "src/a.ts", "variable", "tmp", "const tmp", None, None, False, False, 0, 0),
        (3, "src/b.ts", "class", "UserService", "class UserService", "\n".join(["find(x) {}"] * 12), None, True, False, 0, 4), (4, "src/b.ts", "function", "copyA", "function copyA(x)", "same", None, False, False, 1, 0),
        (5, "src/c.ts", "function", "copyA", "function copyA(x)", "same", None, True, False, 1, 0), (6, "src/c.ts", "function", "other", "function other(x)", "else", None, False, False, 1, 0),
        (7, "tests/a.test.ts", "function", "testIt", "function testIt()", "x", None, False, False, 0, 0),
    ]
    df = spark.createDataFrame(rows, SYMBOLS)
    c = F.col
    lines = F.when(c("body").isNotNull(), F.size(F.split("body", "\n")))
    return df.withColumn("importance", symbols.importance(c("kind"), c("name"), c("exported"), F.length("doc") > 10, c("is_async"), c("parameters"), c("relations"), lines)).withColumn("days", F.lit(3))


def test_local_variables_weigh_less(spark):
    n = lambda name: one(spark, symbols.likely_local(F.lit(name)))
    assert n("result") and n("myData") and n("x1") and n("ab") and not n("app") and not n("url")
    assert one(spark, symbols.importance(F.lit("variable"), F.lit("result"), F.lit(True), F.lit(False), F.lit(False), F.lit(0), F.lit(0), F.lit(5))) == 15


def test_inclusion_and_duplicates(code):
    kept = {r.id: r.k for r in code.select("id", compaction.included(F.col("importance")).alias("k")).collect()}
    assert kept[1] and kept[3] and not kept[2] and not kept[7]
    marks = {r.id: (r.duplicate_of, r["pass"]) for r in compaction.mark_duplicates(compaction.with_hashes(code)).collect()}
    assert marks[4] == (5, "content") and marks[5] == (None, None)
    # A group with a marked member takes no part in the second pass.
    assert marks[6] == (None, None) and marks[1] == (None, None)
    within = {r.id: r.duplicate_of for r in compaction.mark_duplicates(compaction.with_hashes(code), ["file"]).collect()}
    assert within[4] is None and within[6] == 5


@pytest.mark.parametrize("a, b", [("const fooBar = 1", "const VAR = 1"), ("function  f(a,\n b)", "function VAR(VAR, VAR)"), ("class $x9 extends type", "class VAR VAR type"), ("exported async", "VAR async")])
def test_normalised_signature(spark, a, b):
    assert one(spark, compaction.normalised_signature(F.lit(a))) == b


def test_bodies(code):
    body = {r.id: r.b for r in code.select("id", compaction.compact_body().alias("b")).collect()}
    assert body[3] == "Methods: find" and body[2] is None and body[1] == "return 1"


def test_prompt_and_compaction(code):
    scored = compaction.score_symbols(code, "implement", "create user", ["src/a.ts"], ["UserService"])
    got = {r.id: r for r in scored.collect()}
    assert got[1].score > got[6].score and got[1].context >= 25
    assert {r.id for r in compaction.prompt_context(scored, 10_000).collect()} == set(got)
    chosen = compaction.compact(code, "understand", "user", 30).collect()
    assert chosen and sum(r.tokens for r in chosen) <= 30


def test_name_degrees_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"f{rng.randrange(6)}", "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    got = {r.id: r.degree for r in ranking.name_degrees(spark.createDataFrame(rows, "id long, file string, name string")).collect()}
    for i, f, n in rows:
        assert got[i] == sum((g == f or n in m or m in n) and (g, m) != (f, n) for _, g, m in rows)


def test_query_tokens(spark):
    q = "How does the user-session, work? user"
    assert ranking.query_tokens(q) == one(spark, ranking.query_tokens_column(F.lit(q))) == ["user", "session", "work"]


def test_names_held_by_texts(spark):
    rng = random.Random(4)
    texts = [(i, " ".join("".join(rng.choice("abc_") for _ in range(rng.randrange(1, 6))) + rng.choice(["", ".", "()"]) for _ in range(6))) for i in range(40)]
    names = ["a", "ab", "b_c", "abc", "cc", "_"]
    got = {tuple(r) for r in lineage.holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(i, n) for i, t in texts for n in names if n in t}


def test_reachable_goes_to_the_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(25)] + [(25, 3)], "src long, dst long")
    got = {r.node: r.distance for r in graph.reachable(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    assert got == {k: k for k in range(26)}
    assert graph.reachable(spark.createDataFrame([(25,)], "node long"), edges, 2, backwards=True).count() == 3


def test_paths(spark):
    df = spark.createDataFrame([("src/api/a.ts", 10), ("app/x/page.tsx", 10), ("a/.next/b.js", 10), ("x/lib/a.test.ts", 10), ("big.py", 10**8), ("a.exe", 1)], "path string, size long")
    got = {r.path: r for r in df.select("path", project.is_public_surface(F.col("path")).alias("public"), project.is_indexable(F.col("path")).alias("indexable"), project.discovery_verdict(F.col("path"), F.col("size")).alias("v")).collect()}
    assert got["src/api/a.ts"].public and not got["x/lib/a.test.ts"].public and not got["a/.next/b.js"].indexable
    assert [got[p].v for p in ("src/api/a.ts", "a/.next/b.js", "big.py", "a.exe")] == ["supported", "ignored", "size", "extension"]
    assert [one(spark, project.size_text(F.lit(n))) for n in (0, 512, 1024, 1536, 3 * 1024**3)] == ["0 B", "512 B", "1 KB", "1.5 KB", "3 GB"]


@pytest.mark.parametrize("text, kind, lines", [("/* a\n b */\ncode", "comment", 2), ("// a\n// b\n\n// c\ncode", "comment", 4), ("x = 1\n" * 30, "code", 15), ("# a\ncode", "code", 2)])
def test_headers(spark, text, kind, lines):
    h = one(spark, project.file_header(F.lit(text)))
    assert (h.type, h.lines) == (kind, lines)


def test_parser_gate(spark):
    rows = [("a", "ok {}"), ("b", "x\x00y"), ("c", "{" * 200), ("d", " \n"), ("e", "x" * (1024 * 1024 + 1))]
    got = {r.path: r.gate for r in frontend.parser_gate(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a": "ok", "b": "control_characters", "c": "unbalanced", "d": "blank", "e": "too_large"}


def test_frontend(spark):
    text = '"use client"\nimport { x } from "./util"\nexport function Card(props) {\n  const [a] = useState(0)\n  const useBag = create((set) => 1)\n  fetch("/api/items", { method: "post" })\n  return <button onClick={a}><Icon/></button>\n}'
    files = spark.createDataFrame([("app/shop/card.tsx", text), ("app/shop/util.ts", "export const useIt = useBag()")], "path string, text string")
    c = frontend.components(files).collect()
    assert [(r.name, r.kind) for r in c if r.name == "Card"] == [("Card", "client")]
    assert [(r.name, r.path) for r in frontend.store_users(frontend.stores(files), files).collect()] == [("useBag", "app/shop/util.ts")]
    assert [(r.method, r.url, r.line) for r in frontend.endpoint_calls(files).collect()] == [("POST", "/api/items", 6)]
    assert [r.rule for r in frontend.aria_findings(files).collect()] == ["A11Y-ICON-BUTTON-LABEL"]
    routes = spark.createDataFrame([(1, "/shop", "app/shop/page.tsx"), (2, "/", "app/page.tsx")], "ordinal int, route string, file string")
    out = entries.frontend_insights(files, routes)
    assert {r.route for r in out["components"].collect()} == {"/shop"} and out["risk"].first().score == 10
    assert [tuple(r) for r in out["modules"].collect()] == [("app/shop/card.tsx", "app/shop/util.ts")]


def test_debugging(spark):
    log = [(1, k, t) for k, t in enumerate(["TypeError: x", "  at run (src/a.ts:7:3)", "  at src/b.ts:2:1", '  File "c.py", line 9, in go', "plain"])]
    df = spark.createDataFrame(log, "log long, line long, text string")
    got = [(r.file, r.at, r.symbol, r.type) for r in debugging.stack_frames(df).orderBy("line").collect()]
    assert got == [("src/a.ts", 7, "run", "TypeError"), ("src/b.ts", 2, None, "TypeError"), ("c.py", 9, "go", "TypeError")]
    matches = spark.createDataFrame([(1, "src/a.ts", "run", 0.46), (2, "z.ts", "run", None)], "id long, file string, symbol string, similarity double")
    ages = spark.createDataFrame([("src/a.ts", 3)], "file string, days int")
    places = spark.createDataFrame([("src/a.ts", 1, 10, "main")], "file string, start int, end int, symbol string")
    out = entries.debug_context(df, places, matches, ages)
    assert [(r.id, r.score) for r in out["matches"].collect()] == [(1, 5 + 4 + 2 + 5), (2, 1 + 1 + 2 + 0)]
    assert [r.symbol for r in out["located"].collect() if r.file == "src/a.ts"] == ["main"] and out["summary"].first().errors == 3
    advice = one(spark, debugging.suggestions(F.array(F.lit("TypeError")), F.lit(1), F.lit(9), F.lit(0)))
    assert len(advice) == 5 and advice[-1].startswith("Error spans")


def test_declarations_and_chunks(spark):
    ts = "import x\nexport class A {\n  go() {\n    run()\n  }\n}\nexport const f = (a) => {\n  return a\n}\ntype T = {\n  a: 1\n}"
    assert [d[1:] for d in sources_text.declarations(ts, "typescript")] == [("A", 2, 6), ("f", 7, 9), ("T", 10, 12)]
    py = "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n\ndef h():\n    pass\n"
    assert [d[1:] for d in sources_text.declarations(py, "python")] == [("A", 1, 6), ("f", 2, 3), ("g", 5, 6), ("h", 8, 9)]
    big = "export function big() {\n" + "\n".join(f"  call{k}()" + "x" * 30 for k in range(100)) + "\n}"
    files = spark.createDataFrame([("a.ts", "typescript", ts), ("b.ts", "typescript", big), ("c.txt", "text", "just\nlines"), ("d.ts", "typescript", None)], "path string, language string, text string")
    rows = sources_text.structural_chunks(files, 500, 100, 1, 1).collect()
    of = lambda p: [r for r in rows if r.path == p]
    assert [r.symbol for r in of("a.ts")] == ["A", "f", "T"] and [r.chunk for r in of("b.ts")] == list(range(len(of("b.ts"))))
    assert len(of("b.ts")) > 5 and of("b.ts")[-1].end_line == 102 and all(len(r.content) <= 560 for r in of("b.ts"))
    assert len(of("c.txt")) == 1 and not of("d.ts")
    assert entries.chunked(files).count() == 5


def test_parameters_and_json(spark):
    assert one(spark, sources_text.split_parameters(F.lit("a: Map<K, V>, b = f(1, 2), c: (x) => y, { d, e }"))) == ["a: Map<K, V>", "b = f(1, 2)", "c: (x) => y", "{ d, e }"]
    rows = [(1, '{"a": {"b": [1, {"c": 2}]}, "d": null}'), (2, "no"), (3, "[]"), (4, None)]
    got = {r.id: r for r in sources_text.json_structure(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert (got[1].depth, got[1].nodes, got[1].objects, got[1].arrays, got[1].paths) == (5, 7, 3, 1, ["a", "d", "a.b", "a.b[].c"])
    assert got[2].depth is None and got[3].depth == 1 and got[4].depth is None


def test_structural_search(spark):
    files = spark.createDataFrame([(1, "x\nuseQuery(key, fetcher)\n"), (2, "useQuery(a)")], "id long, text string")
    assert [tuple(r) for r in detectors.structural_search(files, "useQuery($A, $B)").collect()] == [(1, 2, "key", "fetcher")]
    with pytest.raises(ValueError):
        detectors.ast_query(detectors.facts(files), [("assign", "x")])


def test_greedy_budget_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"g{rng.randrange(4)}", i, rng.randrange(10) / 10, rng.randrange(1, 60)) for i in range(300)]
    got = {(r.g, r.id): r.used for r in documents.budget_greedy(spark.createDataFrame(rows, "g string, id long, score double, tokens long"), "g", 100).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        used, kept = 0, []
        for _, i, _, n in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if used + n <= 100:
                used, kept = used + n, [*kept, i]
        expected.update({(g, i): used for i in kept})
    assert got == expected


def test_storage_administration(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    chunks = spark.createDataFrame([(1, 1, k, day(1 + k // 2), 10.0) for k in range(6)], "project long, file long, chunk_index int, created_at timestamp, size double")
    r = storage.admit(chunks, 60.0, 25.0).first()
    assert (r.verdict, r.evicted, r.freed, r.used_after) == ("evict", 3, 30.0, 55.0)
    assert storage.admit(chunks, 20.0, 25.0).first().verdict == "reject"
    g = storage.generation_lists(chunks).first().generations
    assert [x.day for x in g] == ["2024-01-03", "2024-01-02", "2024-01-01"] and g[0].chunks == [4, 5]
    disk = spark.createDataFrame([(1, day(9))], "file long, mtime timestamp")
    out = entries.manage(chunks, disk.select("file"), disk, 100.0, 10.0)
    assert out["stale"].first().state == "stale" and out["admission"].first().verdict == "admit"


def test_context_and_hints(code, spark):
    exports = code.filter("exported").select("name", "file")
    files = spark.createDataFrame([("src/auth/login.ts", "typescript", 10, dt.datetime(2024, 1, 1)), ("docs/x.md", "markdown", 10, dt.datetime(2024, 1, 5))], "path string, language string, size long, mtime timestamp")
    out = entries.local_context(code, exports, files, "how does user login work", 200)
    assert out["question"].first().topic == "auth" and [r.path for r in out["files"].collect()] == ["src/auth/login.ts"]
    assert out["candidates"].first().ranking == 1 and out["bundle"].count() > 0
    routes = spark.createDataFrame([("GET", "/api/users", "src/a.ts")], "method string, path string, file string")
    env = spark.createDataFrame([("OPENAI_KEY", "src/a.ts")], "key string, file string")
    imports = spark.createDataFrame([("react",), ("pg",)], "name string")
    items = code.withColumn("degree", F.lit(2.0))
    hints = entries.project_hints(files, exports, routes, env, items, imports, ["user"])
    assert {r.tag for r in hints["architecture"].collect()} == {"react", "postgresql"} and hints["hints"].first().name == "createUser"
    assert {"ENV-001", "NO-TSCONFIG"} <= {r.rule for r in hints["risks"].collect()} and hints["capabilities"].count() > 0
    texts = files.withColumn("text", F.lit("export const a = 1\nif (a) {}"))
    assert entries.file_summary(texts).first().exports == 1
    assert entries.compact(code, "understand", "user")["project"].first().files == 4


def test_bundle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 1)], "src long, dst long")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    imports = spark.createDataFrame([(2, "three/examples"), (3, "d3"), (4, "xlsx")], "node long, name string")
    weights = spark.createDataFrame([("three", 600), ("d3", 250), ("xlsx", 150)], "name string, size long")
    out = entries.bundle(node(1), edges, node(2), imports, weights)
    assert [(r.name, r.client_files, r.total, r.client_total) for r in out["dependencies"].collect()] == [("three", 1, 850, 850), ("d3", 1, 850, 850)]
    assert {r.node: r.saves for r in out["split"].collect()} == {2: 600, 3: 250}


def test_breaker_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k), k % 3, rng.random() < 0.6) for k in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, key long, failed boolean")
    expected = sorted(tuple(r) for r in watching.breaker(df, 3, 3600).collect())
    state, brute = {}, []
    for i, ts, key, failed in rows:
        n, opened = state.get(key, (0, None))
        if opened and ts - opened >= dt.timedelta(hours=1):
            n, opened = 0, None
        if not opened:
            n = n + 1 if failed else 0
            opened = ts if n >= 3 else None
        state[key] = n, opened
        brute.append((key, i, n, opened is not None))
    assert expected == sorted(brute) and any(r[3] for r in brute)
    for part in range(4):
        df.filter(f"event_id >= {part * 30} and event_id < {part * 30 + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = watching.breaker_stream(stream, 3, 3600).writeStream.format("memory").queryName("broken").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert watching.progress(q)["active"]
    q.stop()
    assert sorted(tuple(r) for r in spark.table("broken").collect()) == expected


def test_watching_and_refreshing(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("one")
    (tmp_path / "src" / "deep" / "b.ts").write_text("two")
    seen = watching.watch(spark, str(tmp_path / "src"))
    table = str(tmp_path / "table")
    old = dt.datetime(2020, 1, 1)
    schema = "file string, chunk_index int, created_at timestamp"
    spark.createDataFrame([("x", 0, old)], schema).write.parquet(f"{table}/version-start")
    spark.createDataFrame([(f"{table}/version-start",)], "path string").coalesce(1).write.text(f"{table}/_current")
    chunk = lambda f: f.select("file", F.lit(0).alias("chunk_index"), F.current_timestamp().alias("created_at"))
    refresh = watching.refresher(spark, table, chunk)
    run = lambda batch, n: refresh(batch.select(F.col("key").alias("file"), F.col("ts").alias("mtime")), n)
    q = seen.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert watching.read_current(spark, table).count() == 3
    # What hasn't changed since is skipped: the version stays.
    before = spark.read.text(f"{table}/_current").first()[0]
    refresh(spark.createDataFrame([("x", old)], "file string, mtime timestamp"), 7)
    assert spark.read.text(f"{table}/_current").first()[0] == before


def test_stale_loop(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    stored = spark.createDataFrame([("a", day(1)), ("b", day(9)), ("c", day(1))], "file string, last_update timestamp")
    disk = spark.createDataFrame([("a", day(2)), ("b", day(2))], "file string, mtime timestamp")
    found = []
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = watching.stale_loop(ticks, lambda: stored, lambda: disk, lambda rows: found.append({r.file: r.state for r in rows.collect()}), str(tmp_path / "cp"), "1 second")
    while not found:
        q.awaitTermination(1)
    q.stop()
    assert found[0] == {"a": "stale", "c": "missing"}


def sent_to_python(df):
    """Bytes that the plan of a collected ``df`` has sent to Python."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        own = node.metrics().get("pythonDataSent")
        return (own.get().value() if own.isDefined() else 0) + sum(walk(x) for x in inner)

    return walk(df._jdf.queryExecution().executedPlan())


def test_snippets_of_many_places_send_each_file_once(spark):
    text = "\n".join(f"const v{i} = () => {{\n  go({i})\n}}" for i in range(2000))
    files = spark.createDataFrame([("a", text), ("b", None), ("c", "one\ntwo"), ("c", "three"), ("d", "x")], "path string, text string")
    wanted = [(i, "a", i % 1500 * 4 - 2) for i in range(3000)] + [(3000, "b", 4), (3001, "c", 2), (3002, "c", 9), (3003, "none", 1)]
    df = sources_text.snippets(spark.createDataFrame(wanted, "id long, path string, line int"), files)
    got = sorted(tuple(r) for r in df.collect())
    expected, every = [], files.collect()
    for i, path, line in wanted:
        for p, t in every:
            if p == path:
                lines = (t or "").split("\n")
                at = min(max(0, line - 1), len(lines) - 1)
                a, b = sources_text.snippet(lines, at, at)
                expected.append((i, a + 1, b + 1, "\n".join(lines[a : b + 1])))
    assert got == sorted(expected)
    assert 0 < sent_to_python(df) < 3 * len(text)


def test_users_of_a_common_store_are_spread_over_tasks(spark):
    """One name with three stores and 40 000 users: all pairs, in more than one task."""
    text = F.when(F.col("id") < 3, "const bag = create(() => 1)").when(F.col("id") == 3, "a bag").otherwise("use(bag)")
    files = spark.range(40_004).select(F.concat(F.lit("f"), "id").alias("path"), text.alias("text")).union(spark.createDataFrame([("g", "const sack = create(() => use(bag))")], "path string, text string"))
    users = frontend.store_users(frontend.stores(files), files)
    by_task = users.groupBy(F.spark_partition_id().alias("task"), "name", "store").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths")).collect()
    total = {}
    for r in by_task:
        assert r.n == r.paths
        total[r.name, r.store] = total.get((r.name, r.store), 0) + r.n
    assert total == {("bag", f"f{k}"): 40_001 for k in range(3)}
    tasks = {r.task for r in users.select(F.spark_partition_id().alias("task")).distinct().collect()}
    assert len(tasks) > 1


def test_similar_symbols_pair_by_pair(spark):
    """Each pair comes once for each pair of rows, by its first reason: a repeated row counts again, as in the SQL."""
    rows = [(0, "function", "f", "f(a: Item)", "c1", "s1"), (1, "function", "f", "f(a: Item)", "c1", "s1"), (1, "function", "f", "f(a: Item)", "c1", "s1"), (2, "class", "g", "g(b)", "c2", "s1"), (3, "function", "f", "f(a: Item, b)", "c3", "s3"), (4, "function", "f", "zz", "c4", "s4"), (5, "type", "t", "t", "c1", "s5")]
    df = spark.createDataFrame(rows, "id long, kind string, name string, signature string, content_hash string, signature_hash string")
    got = sorted(tuple(r) for r in compaction.similar_symbols(df.filter("id = 0"), df).collect())
    assert got == [(0, 1, 1.0), (0, 1, 1.0), (0, 2, 0.9), (0, 3, 0.92), (0, 5, 1.0)]


def test_words_of_many_files_are_not_broadcast(spark):
    """Files whose texts are made of a few bytes: Spark takes their words for small, but they are over 5 MB and may not go to the driver."""
    keys = ("spark.sql.maxBroadcastTableSize", "spark.sql.autoBroadcastJoinThreshold")
    words = F.concat(*[F.concat(F.lit(f" w{k}_"), F.col("id") % 7) for k in range(20)])
    files = spark.range(10_000).select(F.concat(F.lit("f"), "id").alias("path"), F.concat(F.when(F.col("id") % 100 == 0, "const bag = create(() => 1)").otherwise("use(bag)"), words).alias("text"))
    for key, most in zip(keys, ("5m", "10m")):
        spark.conf.set(key, most)
    try:
        users = frontend.store_users(frontend.stores(files), files)
        got = users.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("path", "store").alias("pairs")).collect()
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert [tuple(r) for r in got] == [("bag", 9_900 * 100, 9_900 * 100)]
