"""Entry points: what a question, a project, a file or a log asks for, composed of the operators.

Each returns DataFrames by name; nothing is computed before they are used.
Tables: symbols (id, file, kind, name, signature, body, doc, exported,
is_async, parameters, relations, importance, days), files (path, language,
size, mtime, text), exports (name, file), routes (method, path, file), env
(key, file), chunks (project, file, chunk_index, created_at, size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import compaction, debugging, detectors, documents, frontend, graph, project, ranking, sources_text, storage, vectors


def local_context(symbols: DataFrame, exports: DataFrame, files: DataFrame, question: str, budget: int = 2000, vectors_: DataFrame | None = None, query_vector: list[float] | None = None) -> dict[str, DataFrame]:
    """For a question: its topic, plan and kind of task; files it can be about; the candidates, ranked and no more than three of a file; those that fit a budget of tokens; and the nearest chunks."""
    spark = symbols.sparkSession
    q = spark.range(1).select(F.lit(question).alias("q"))
    kinds = q.select(T.first_match(F.col("q"), T.TOPICS, "unknown").alias("topic"), T.attack_plan(F.col("q")).alias("plan"), T.task_type(F.col("q")).alias("task"), F.array_join(documents.facet_tags(F.lower("q")), ",").alias("facets"))
    asked = kinds.first()
    candidates = symbols.withColumn("reasons", F.when(F.col("doc").isNotNull(), F.array("doc")).otherwise(F.array().cast("array<string>"))).withColumn("role", F.lit(""))
    ranked = ranking.rank_candidates(candidates, exports, question, asked["plan"])
    best = ranking.diverse(ranked.select("id", "file", "name", "score"), "file")
    sized = best.join(symbols.withColumn("tokens", compaction.symbol_tokens(compaction.compact_body())).select("id", "tokens"), "id").withColumn("g", F.lit(1))
    out = {"question": kinds, "files": ranking.topic_files(files, asked["topic"]), "candidates": best, "bundle": documents.budget_two_pass(sized, "g", budget).select("id")}
    if vectors_ is not None and query_vector is not None:
        out["nearest"] = vectors.top_similar(vectors_, query_vector)
    return out


def project_hints(files: DataFrame, exports: DataFrame, routes: DataFrame, env: DataFrame, items: DataFrame, imports: DataFrame, terms: list[str]) -> dict[str, DataFrame]:
    """What a project is made of, can do and risks, and where to begin."""
    return {
        "fingerprint": project.fingerprint(files), "folders": project.folder_hints(files), "coverage": project.coverage_insights(files), "composition": project.composition(files, project.is_indexable(F.col("path"))),
        "architecture": project.architecture_tags(imports), "capabilities": project.capabilities(exports, routes, env), "risks": project.repository_risks(files, env, exports), "hints": ranking.ranked_hints(items, terms),
    }


def file_summary(files: DataFrame) -> DataFrame:
    """path, language, header, complexity, rating, declarations, markdown, yaml_keys of each file."""
    points = T.complexity(F.col("text"))
    kinds = detectors.facts(files.select(F.col("path").alias("id"), "text")).groupBy("id").agg(F.count_if(F.col("kind") == "export").alias("exports"), F.count_if(F.col("kind") == "import").alias("imports"))
    rows = files.select("path", "language", project.file_header(F.col("text"))["type"].alias("header"), points.alias("complexity"), T.complexity_rating(points).alias("rating"), T.markdown_facts(F.col("text")).alias("markdown"), F.size(T.yaml_keys(F.col("text"))).alias("yaml_keys"))
    return rows.join(kinds, F.col("path") == F.col("id"), "left").drop("id").fillna(0, ["exports", "imports"])


def frontend_insights(files: DataFrame, routes: DataFrame) -> dict[str, DataFrame]:
    """Components by route, what they store and call, their libraries, findings and the risk they add up to."""
    found = frontend.components(files)
    calls = frontend.endpoint_calls(files).withColumn("file", F.col("path")).withColumn("path", T.endpoint_path(F.col("url")))
    aria = frontend.aria_findings(files)
    leaks = frontend.env_leaks(files)
    fired = aria.select(F.lit("project").alias("subject"), "rule").unionByName(leaks.select(F.lit("project").alias("subject"), F.lit("ENV-002").alias("rule"))).unionByName(
        detectors.endpoint_usage(calls).filter("finding is not null").select(F.lit("project").alias("subject"), F.col("finding").alias("rule"))
    )
    weights = files.sparkSession.createDataFrame([("ENV-002", 25), ("A11Y-ICON-BUTTON-LABEL", 10), ("A11Y-LABEL-FOR", 10), ("A11Y-ROLE-BUTTON", 10), ("STATE-001", 3)], "rule string, weight int")
    return {
        "components": frontend.components_by_route(found, routes), "stores": frontend.stores(files), "store_users": frontend.store_users(frontend.stores(files), files), "calls": calls,
        "duplicates": detectors.duplicate_endpoints(calls), "libraries": frontend.libraries(files), "modules": frontend.module_graph(files), "aria": aria, "leaks": leaks, "risk": detectors.risk_score(fired, weights),
    }


def debug_context(log: DataFrame, symbols: DataFrame, matches: DataFrame, ages: DataFrame) -> dict[str, DataFrame]:
    """Frames of a log, the symbols (file, start, end, symbol) they fall in, ranked matches, a summary."""
    frames = debugging.stack_frames(log)
    errors = frames.filter("type is not null").withColumn("ordinal", F.col("line"))
    scored = debugging.match_scores(matches, errors, ages)
    located = detectors.locate(frames.select(F.col("line").alias("frame"), "file", F.col("at").alias("line")), symbols)
    return {"frames": frames, "located": located, "matches": debugging.ranked_matches(scored), "summary": debugging.debug_summary(frames, scored), "context": debugging.error_context(log)}


def compact(symbols: DataFrame, task: str, question: str, budget: int = 4000) -> dict[str, DataFrame]:
    """What is kept of a project's symbols for a task, and what it is made of."""
    return {"symbols": compaction.compact(symbols, task, question, budget), "files": compaction.file_summaries(symbols), "project": compaction.project_summary(symbols, compaction.symbol_tokens(compaction.compact_body()))}


def manage(chunks: DataFrame, files: DataFrame, disk: DataFrame, quota: float, new_size: float = 0.0) -> dict[str, DataFrame]:
    """The state of a chunk table: statistics, quota, generations, what is stale and what admitting a chunk would take."""
    stored = chunks.groupBy("file").agg(F.max("created_at").alias("last_update"))
    return {
        "stats": storage.project_stats(chunks), "usage": storage.storage_usage(chunks, quota), "recent": storage.recent_files(files, chunks), "generations": storage.generation_lists(chunks),
        "cleanup": storage.stale_cleanup(chunks), "stale": storage.stale_against_disk(stored, disk), "admission": storage.admit(chunks, quota, new_size),
    }


def bundle(page: DataFrame, edges: DataFrame, marked: DataFrame, imports: DataFrame, weights: DataFrame) -> dict[str, DataFrame]:
    """What a page (node) loads: its modules, which of them are client code, heavy dependencies and what could be loaded later."""
    clients = graph.client_modules(marked, edges).withColumn("client", F.lit(True))
    modules = graph.reachable(page, edges).select("node").join(clients, "node", "left").fillna(False, ["client"])
    return {"modules": modules, "dependencies": graph.bundle(modules, imports, weights), "split": graph.split_candidates(modules, imports, weights)}


def chunked(files: DataFrame, size: int = 2000) -> DataFrame:
    """Chunks of files at the borders of declarations, ready to be embedded."""
    return sources_text.embeddable(sources_text.structural_chunks(files, size), size)
