"""The corpus pipeline, stage by stage, against brute force; and on empty tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard_join, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, hash_ string, c0 int, n_removed int, copy_ string, copy int, row_ int, raw_ string, key_ int, text_key int"

CLASH = (7, "c", 8, 9, "r", 10, 11)


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [words(rng, 30) for _ in range(5)]
    footer = words(rng, 8)
    texts = []
    for i in range(300):
        w = words(rng, 40).split()
        if i % 4 == 0:
            for k in range(0, 40, 8):
                w[k] = "zorg" + rng.choice(["a", "li", "ment", "ush", "ed"])
        texts.append(" ".join(w) + ("\n" + footer if i % 3 == 0 else ""))
    texts += [texts[1], texts[1], texts[2] + " tail", items[0], words(rng, 30) + " " + items[1] + " " + words(rng, 30), "", None, "x"]
    rows = [(i, t, "en", f"s{i % 7}", len(t or ""), "h", 1, *CLASH) for i, t in enumerate(texts)] + [(None, "no id here", "en", None, 10, "h", 1, *CLASH)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items, footer


def test_stages(spark, corpus):
    d, items, footer = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    known = lambda df: {(r.doc_id, r.text): r for r in df.collect()}

    clean = stages["toxicity"](spark, docs, d)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert clean.columns == docs.columns
    assert set(known(clean)) == {k for k in known(docs) if not scores[k[0]]}
    assert not any("zorg" in (t or "") for _, t in known(clean))

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    spread = collections.defaultdict(set)
    first = {}
    for r in clean.collect():
        for x in (r.text or "").split("\n"):
            if x:
                spread[x].add(r.source)
                if r.doc_id is not None:
                    first[x] = min(first.get(x, r.doc_id), r.doc_id)
    lines = stages["line dedup"](spark, clean, d)
    assert lines.columns == docs.columns and len(spread[footer]) >= 5
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    for r in clean.collect():
        kept = [x for x in (r.text or "").split("\n") if len(spread.get(x, ())) < 5 or first[x] == r.doc_id]
        text = None if r.text is None else "\n".join(kept)
        assert got[r.doc_id] == (text, len(text or ""))

    lines = spark.createDataFrame(lines.collect(), docs.schema)
    rows = [(r.doc_id, r.text) for r in lines.collect() if r.doc_id is not None]
    sets = {i: set(jaccard_join.shingle_set(t).tolist()) for i, t in rows}
    drop = {b for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    once = stages["n-gram Jaccard join"](spark, lines, d)
    assert once.columns == docs.columns
    assert {r.doc_id for r in once.collect()} == ({i for i, _ in rows} - drop) | {None}
    again = stages["n-gram Jaccard join"](spark, lines.unionByName(lines.limit(5)), d)
    assert again.count() == once.count()

    once = spark.createDataFrame(once.collect(), docs.schema)
    kept = stages["benchmark decontamination"](spark, once, d)
    assert kept.columns == docs.columns
    assert set(known(kept)) == {k for k in known(once) if not any(x in (k[1] or "") for x in items)}

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    packed = stages["best-fit packing"](spark, kept, d)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert corpus_pipeline.run(spark, d).count() == packed.count()


def test_empty_corpus(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
