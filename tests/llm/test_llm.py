"""The training-data operators on odd inputs, and against brute force."""

import collections
import json
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, html_extract, jaccard_join, line_dedup, packing, quality, token_counts, topk_search, toxicity
from tessera.llm.common import fold, shingle_hashes, word_hashes

DOCS = "doc_id long, text string, source string, n_tokens string, score int, hash_ int, key string, line_ int, row_ int"
ODD = ["", None, " ", "\n\n", "a", "one two three four", "Hello, world! " * 3, "ñandú 日本語 😀 word", "<|endoftext|> x <|startoftext|>", "x" * 5000, "word " * 30000, "a  b\t\tc \n d ", "İΣΑΣ ς"]


def frame(spark, texts, start=1):
    rows = [(start + k, t, f"s{k % 3}", "t", 1, 2, "k", 3, 4) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "null id text", None, None, None, None, None, None, None)], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1 top-k search


def brute_topk(rows, k=5):
    v = {i: np.floor(np.array(e, np.float64) * 256) for i, e in rows}
    out = {}
    for q in v:
        if q % 50 == 0:
            out[q] = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:k]
    return out


@pytest.mark.parametrize("shard_rows, block", [(8192, 2048), (300, 3)])
def test_topk_equals_brute_force_with_ties(spark, shard_rows, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 16)).round(2).tolist()
    rows = [(i, base[i % 700]) for i in range(1500)]  # repeated vectors: ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id_", F.lit("clash"))
    v = topk_search.integer_vectors(df)
    got = collections.defaultdict(list)
    for r in topk_search.topk_search(v, v.filter("id_ % 50 = 0"), 1500, 30, 5, shard_rows, block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    expected = brute_topk([(i, np.array(e, np.float32).tolist()) for i, e in rows])
    assert dict(got) == expected


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [float("inf"), 0.0]), (None, [1.0, 1.0]), (4, []), (5, [1e6, -1e6]), (6, [1.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk_search.integer_vectors(df)
    got = [(r.query_id, r.vec_id, r.score) for r in topk_search.topk_search(v, v.filter("id_ % 50 = 0"), 10, 1).orderBy("rank").collect()]
    assert [g[1] for g in got] == [7, 6, 4, 5] and got[0] == (0, 7, 256 * 256 + 512 * 512)
    empty = v.filter("false")
    assert topk_search.topk_search(empty, empty, 0, 0).count() == 0


def test_topk_huge_components(spark):
    assert topk_search._plain_topk(np.array([1, 2]), np.array([[2**61], [2**60]], object), np.array([2**61], object), 9, 5)[0][:2] == (1, 2**63 - 1)
    rows = [(0, [1e17]), *[(i, [1e16 + i * 1e13]) for i in range(1, 40)], *[(100 + i, [-1e16 - i * 1e13]) for i in range(1, 40) if i % 50]]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for shard_rows in (8192, 10):
        got = topk_search.topk_search(v, v.filter("id_ = 0"), len(rows), 1, 5, shard_rows).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, 2**63 - 1) for i in (39, 38, 37, 36, 35)]


def test_topk_prunes_postings():
    rng = np.random.default_rng(2)
    columns = np.floor(rng.normal(size=(32, 4000)) * 256 / (1 + np.arange(32)[:, None]) ** 1.5)
    ids, query, counts, bound = np.arange(4000), np.floor(rng.normal(size=32) * 256 / (1 + np.arange(32)) ** 1.5), {}, {}
    scores = query @ columns
    best = np.lexsort((ids, -scores))[:5]
    got = topk_search.maxscore_topk(ids, columns, columns.min(axis=1), columns.max(axis=1), query, -1, 5, counts=counts)
    assert got[0].tolist() == best.tolist() and got[1].tolist() == scores[best].tolist()
    # A threshold from another shard saves more, and loses only what falls short of it.
    least = float(np.sort(scores)[-2])
    got = topk_search.maxscore_topk(ids, columns, columns.min(axis=1), columns.max(axis=1), query, -1, 5, least, bound)
    assert got[0].tolist() == best[:2].tolist()
    assert counts["pruned"] > counts["read"] and bound["read"] <= counts["read"]


# 2 and 9 classifiers


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = words(rng, 60).split()
        if bad:
            for k in range(0, 60, 10):
                w[k] = "zorg" + rng.choice(["a", "li", "ment", "ush", "ed", "on"])
        text = " ".join(w) if i % 3 else "\n".join([" ".join(w[:30]), " ".join(w[30:])])
        docs.append((i, text if i % 5 != 1 else text.upper() + "!!! " * 20, "en", "s"))
        labels.append((i, int(i % 5 != 1), int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, column, cut", [(toxicity.toxicity_scores, "toxic", 0.5), (quality.quality_scores, "quality", 0.3)])
def test_classifiers_held_out_and_odd_rows(spark, score, column, cut):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(10_000, ""), (10_001, None), (10_002, "x"), (None, "text"), (10_003, "word " * 20000)], "doc_id long, text string")
    every = docs.withColumn("score", F.lit("clash")).unionByName(odd, allowMissingColumns=True)
    noisy = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    rows = {r.doc_id: r for r in score(every, noisy).collect()}
    assert len(rows) == 405
    truth = {r.doc_id: r[column] for r in labels.collect()}
    for i, r in rows.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in truth if rows[i].held_out]
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.95


def test_ridge_equals_a_direct_solution(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(quality.STATISTICS))) * np.arange(1, len(quality.STATISTICS) + 1)
    y = (x[:, 0] + 0.2 * rng.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "stats array<double>, y_ double").repartition(5)
    model = quality.fit_kernel_ridge(rows)
    z = model.features(x)
    penalty = quality.PENALTY * len(x) * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    # The features' products approximate the Gaussian kernel of the standardised statistics.
    s = (x - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-np.square(s[:60, None] - s[None, :60]).sum(axis=2) / (2 * quality.WIDTH**2))
    many = quality.KernelRidge(x.mean(axis=0), x.std(axis=0), features=20_000)
    f = many.features(x[:60])[:, :-1]
    assert np.abs(f @ f.T - kernel).max() < 0.05


def test_isotonic_equals_brute_force():
    from tessera.llm.calibration import Isotonic

    rng = np.random.default_rng(5)
    x, w = np.arange(12) / 12, rng.integers(1, 6, 12).astype(float)
    p = np.array([float(rng.integers(0, n + 1)) for n in w])
    # Min-max formula of isotonic regression.
    mean = lambda i, j: p[i : j + 1].sum() / w[i : j + 1].sum()
    best = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
    curve = Isotonic(x, w, p)
    at = np.searchsorted([*curve.x[1:]], x + 1e-12)  # blocks by their centres
    raw = [(b - 0.5) / (1 - abs(2 * b - 1)) * 2 if b else -1e9 for b in x]
    assert (np.diff(curve(np.array(raw))) >= 0).all() and len(curve.x) == len(set(np.round(best, 12))) and len(at) == 12


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, 20)
    for score in (toxicity.toxicity_scores, quality.quality_scores):
        assert {r.score for r in score(docs, labels.filter("false")).collect()} == {0.5}
        assert score(docs.filter("false"), labels).count() == 0


def test_labels_of_held_out_ids_change_nothing(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()}




def brute_ratios(rows):
    """The two models by their definition: counts, shared shorter orders, and the difference of the logarithms."""
    n_order, discount = toxicity.ORDER, toxicity.DISCOUNT
    n = [collections.Counter(), collections.Counter()]
    for y in (0, 1):
        for text in {t for t, k in rows if k == y}:
            for chunk in set(text.split()):
                for unit in toxicity.units_of(chunk):
                    for k in range(1, len(unit)):
                        n[y][unit[max(0, k - n_order + 1) : k + 1]] += 1
    both = n[0] + n[1]
    levels, above = [], set(both)
    for order in toxicity.SHORTER:
        level = collections.Counter(g[-min(len(g) - 1, order) :] for g in above if len(g) > 1)
        levels.append(level)
        above = set(level)

    def q(level, gram):
        counts, h = levels[level], gram[:-1]
        after = {g: c for g, c in counts.items() if g[:-1] == h}
        end = gram[-min(len(gram) - 1, toxicity.SHORTER[level + 1]) :] if level + 1 < len(levels) and len(gram) > 1 else None
        low = q(level + 1, end) if end else 1 / len(after)
        return (counts[gram] - discount + discount * len(after) * low) / sum(after.values())

    out = {}
    for gram in both:
        h = gram[:-1]
        t = [sum(c for g, c in n[y].items() if g[:-1] == h) for y in (0, 1)]
        if min(t) == 0:
            continue
        goes = discount * sum(g[:-1] == h for g in both) / sum(t)
        low = q(0, gram[-min(len(gram) - 1, toxicity.SHORTER[0]) :])
        p = [(1 - goes) * (max(n[y][gram] - discount, 0) + discount * sum(g[:-1] == h for g in n[y]) * both[gram] / sum(t)) / t[y] + goes * low for y in (0, 1)]
        out[gram] = math.log(p[1] / p[0])
    return out


def toxic_corpus():
    rng = random.Random(12)
    plain = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    rows = []
    for i in range(60):
        w = [rng.choice(plain) for _ in range(12)]
        if i % 3 == 0:
            w[rng.randrange(12)] = "dabbe" + rng.choice(["", "s", "ed", "dabbeda"])
        rows.append((" ".join(w).capitalize() + ".", int(i % 3 == 0)))
    return rows + [(rows[0][0], 1)] * 5 + [("", 1), ("...", 0), ("c" * 150 + "ab", 0)]


def test_toxicity_probabilities_equal_their_definition(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    # The counts see folds 1 to 3, copies once.
    seen = [(t, y) for i, (t, y) in enumerate(rows) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    counted = spark.createDataFrame([(t, float(y)) for t, y in set(seen)], "text string, y_ double")
    got = {r.gram: r.ratio for r in toxicity.gram_ratios(toxicity.unit_counts(counted)).collect()}
    expected = brute_ratios(seen)
    assert set(got) == set(expected) and len(got) > 100
    assert all(got[g] == pytest.approx(expected[g], rel=1e-4, abs=1e-6) for g in got)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    scorer = toxicity.fit_toxicity(docs, labels)
    model = scorer.shared.value
    unit = toxicity.START + "dabbes" + toxicity.END
    grams = [unit[max(0, k - toxicity.ORDER + 1) : k + 1] for k in range(1, len(unit))]
    assert model.log_ratio([unit, toxicity.START + "zzz" + toxicity.END])[0] == pytest.approx(sum(expected.get(g, 0) for g in grams), rel=1e-4)


def test_a_large_model_is_joined(spark):
    rows = toxic_corpus()
    odd = [(1000 + k, t) for k, t in enumerate([*ODD, "dabbes " * 5])] + [(None, "dabbes abc")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + odd, "doc_id long, text string").withColumn("text_key", F.lit("x")).withColumn("raw_", F.lit("y"))
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    a, b = (sorted(((r.doc_id or -1, r.held_out, r.predicted, r.score) for r in toxicity.toxicity_scores(docs, labels, model_rows=n).collect())) for n in (10**6, 0))
    assert len(a) == len(b) == docs.count() and all(x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-9) for x, y in zip(a, b))
    kept = [sorted(map(str, toxicity.drop_toxic(docs, labels, model_rows=n).collect())) for n in (10**6, 0)]
    assert kept[0] == kept[1]


def test_long_words_lose_no_letter():
    rng = random.Random(3)
    for n in (1, 63, 64, 65, 200):
        unit = toxicity.START + "".join(rng.choice("abc") for _ in range(n)) + toxicity.END
        whole = [unit[max(0, k - toxicity.ORDER + 1) : k + 1] for k in range(1, len(unit))]
        parts = [p[max(0, k - toxicity.ORDER + 1) : k + 1] for p, skip in toxicity.parts_of(unit) for k in range(skip, len(p))]
        assert parts == whole
        keys, owner = toxicity.gram_keys([unit, "\x02a"])
        assert len(keys) == len(whole) + 1 and (keys[: len(whole)] == [toxicity.gram_keys([g])[0][-1] for g in whole]).all()


@pytest.mark.parametrize("glue, letters", [("", "一二三四五六七八九十百千万上下左右中大小"), ("/", "abcdefghijk"), ("", "abcdefghijk")])
def test_toxic_behind_the_twelfth_letter(spark, glue, letters):
    rng = random.Random(4)
    bad = "毒蛇" if letters[0] == "一" else "zorgush"
    docs, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)]
        if i % 3 == 0:
            w[6] = bad
        docs.append((i, glue.join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in rows]) > 0.95


# 3 decontamination


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64)
    queries = []
    for p in prints:
        for flips in range(0, 14):
            q = int(p)
            for b in rng.choice(64, flips, replace=False):
                q ^= 1 << int(b)
            queries.append(q)
    queries = np.array(queries, np.uint64)
    q, p, d = decontaminate.HammingIndex(prints).search(queries)
    got = set(zip(q.tolist(), p.tolist(), strict=True))
    expected = {(i, j) for i in range(len(queries)) for j in range(len(prints)) if int(queries[i] ^ prints[j]).bit_count() <= decontaminate.RADIUS}
    assert got == expected


def test_fingerprints_equal_their_definition():
    s = np.random.default_rng(1).integers(0, 2**63, 60, dtype=np.uint64)
    for size in (1, 5, 26):
        got = decontaminate.window_fingerprints(decontaminate.running_sums(s), size)
        for at, f in enumerate(got.tolist()):
            bits = [(s[at : at + size] >> np.uint64(b) & np.uint64(1)).sum() * 2 > size for b in range(64)]
            assert f == sum(1 << b for b in range(64) if bits[b])


def test_near_copies_edited_in_the_middle():
    rng, found, tried = random.Random(7), 0, 0
    for k in range(150):
        n = rng.choice([49, 58, 94])
        item, w = words(rng, n, 5000), []
        w = item.split()
        for at in {49: [24], 58: [29], 94: [31, 62]}[n]:
            w[at] = "replaced"
        searched = decontaminate.Benchmark([(0, item)])
        text = " ".join([words(rng, 40, 5000), *w, words(rng, 40, 5000)])
        if searched.weighted_similarity(0, decontaminate.shingle_hashes(decontaminate.word_hashes(" ".join(w)))) >= 0.8:
            tried += 1
            found += len(searched.search([text]))
    assert tried > 90 and found >= 0.98 * tried


@pytest.mark.parametrize("n, edits", [(60, 1), (100, 2), (200, 4), (400, 8)])
@pytest.mark.parametrize("where", ["anywhere", "ends", "start"])
def test_recall_against_exact_verification(n, edits, where):
    rng, found, tried = random.Random(n), 0, 0
    for _ in range(40):
        item = words(rng, n, 5000)
        w = item.split()
        near = rng.sample(range(n if where == "anywhere" else n // 6), edits)
        for k, at in enumerate(near):
            w[n - 1 - at if where == "ends" and k % 2 else at] = f"changed{rng.randrange(10**6)}"
        searched = decontaminate.Benchmark([(0, item)])
        if searched.weighted_similarity(0, decontaminate.shingle_hashes(decontaminate.word_hashes(" ".join(w)))) >= 0.8:
            tried += 1
            found += len(searched.search([" ".join([words(rng, 100), *w, words(rng, 100)])]))
    assert tried > 10 and found >= 0.95 * tried


def test_long_items_with_new_ends():
    s = np.random.default_rng(1).integers(0, 2**63, 900, dtype=np.uint64)
    got = decontaminate.window_fingerprints(decontaminate.running_sums(s), 597)
    for at in (0, 150, 303):
        bits = [(s[at : at + 597] >> np.uint64(b) & np.uint64(1)).sum() * 2 > 597 for b in range(64)]
        assert len(got) == 304 and got[at] == sum(1 << b for b in range(64) if bits[b])
    rng, found = random.Random(8), 0
    for k in range(20):
        item = words(rng, 704, 5000)
        text = " ".join([words(rng, 75, 5000), *item.split()[35:-35], words(rng, 75, 5000)])
        found += len(decontaminate.Benchmark([(0, item)]).search([text]))
    assert found == 20


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    common = words(rng, 12, 5000)
    items = [(k, f"{common} {words(rng, 20, 5000)}") for k in range(40)]
    texts = []
    for _, item in items:
        w = item.split()
        w[rng.choice([2, 9, 16, -2, -3])] = "changed"
        texts += [" ".join(w), f"{words(rng, 30, 5000)} {' '.join(w)} {words(rng, 30, 5000)}"]
    docs, benchmark = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in decontaminate.contaminated(docs, benchmark).collect()}
    once = found()
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 4)
    assert once and found() == once


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(k, words(rng, rng.randrange(16, 60), 5000)) for k in range(30)] + [(100, ""), (101, None), (102, "too short item"), (None, words(rng, 20, 5000))]
    texts, truth = list(ODD), set()
    for k, item in items[:30]:
        a, b = words(rng, 50, 5000), words(rng, 50, 5000)
        texts.append(f"{a} {item.upper().replace(' ', ', ')}! {b}")
        truth.add((len(texts), k))
        w = item.split()
        w[-1] = "changed"
        texts.append(" ".join([a, *w, b]))
        if len(w) - 5 >= 0.8 * (len(w) - 3):
            truth.add((len(texts), k))
        texts.append(a + " " + b)
        texts.append(" ".join([a, *w[: len(w) // 2], b]))
    docs = frame(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == truth
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({t for t, _ in truth})
    assert decontaminate.contaminated(docs, benchmark.filter("false")).count() == 0
    assert decontaminate.contaminated(docs.filter("false"), benchmark).count() == 0


# 4 and 5 tokens


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    texts = [*ODD, "I'll we're 's", "--------" * 30, "\t \tb  ", "12345 6 7x", "a\x1cb \x1f c"]
    rows = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), path, 10, keep_prefixes=True).collect()}
    for k, t in enumerate(texts):
        r = rows[k + 1]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n(t), len((t or "").encode()), n(t) > 10)
        if len(t or "") < 300:
            assert r.prefix_counts == [n((t or "")[:i]) for i in range(len(t or "") + 1)]
        assert n((t or "")[: r.fit_chars]) <= 10 or r.fit_chars == 0
    assert token_counts.token_counts(frame(spark, []).filter("false"), path).count() == 0


def test_prefix_tables_answer_budgets(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, c = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(5)
    bits = ["I'll", "we're", "'s", " ", "  ", "\n", "\t", " \n ", "the", "Hello", "--", "!!", "1234", "é", "日本語", "😀", "<|endoftext|>", "<|endof", "'", "'r", "\xa0", "a\x1cb", "<"]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert c.prefix_counts(t).tolist() == [n(t[:i]) for i in range(len(t) + 1)], t
        budget = rng.randrange(12)
        assert n(t[: c.fit(t, budget)]) <= budget
    began = time.time()
    count, calls = c._count_pieces, []
    monkeypatch.setattr(c, "_count_pieces", lambda t: calls.append(t) or count(t))
    for t in ("x" * 200_000, "ab" * 100_000, " " * 100_000 + "x", "-" * 200_000):
        k = c.fit(t, 1000)
        assert n(t[:k]) <= 1000 < n(t[: k + 1])
        assert c.prefix_counts(t)[[k, -1]].tolist() == [n(t[:k]), n(t)]
        assert len(calls) <= 2 and calls.clear() is None  # each call counts the whole text once
    assert time.time() - began < 60


def test_packing_is_a_gapless_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = [*ODD, *[words(rng, rng.randrange(1, 300)) for _ in range(150)]]
    rows = packing.pack_documents(frame(spark, texts), path, 512).collect()
    whole, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 512 * r.piece
        whole[r.doc_id].append((r.piece, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(whole[k + 1])) == ids
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    least = -(-sum(r.length for r in rows) // 512)
    assert len(sequences) <= 1.03 * least + 1


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(3).integers(1, 400, 2000)
    bins, offsets = packing.best_fit(lengths, (1000, 4, 250_000), rule=rule)
    for b in np.unique(bins):
        at = bins == b
        assert lengths[at].sum() <= 1000 and at.sum() <= 4 and (lengths[at] ** 2).sum() <= 250_000
        assert sorted(offsets[at]) == sorted(np.cumsum(lengths[at][np.argsort(offsets[at])]) - lengths[at][np.argsort(offsets[at])])
    with pytest.raises(ValueError):
        packing.best_fit(np.array([10]), (10, 1, 50))


# 6 lines


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    lines = [words(rng, 6) for _ in range(60)]
    rows = []
    for i in range(300):
        own = [rng.choice(lines[: 5 + i % 55]) for _ in range(4)] + [words(rng, 5, 10**6), " ", ""]
        rows.append((i, "\n".join(own), f"s{rng.randrange(12)}" if i % 7 else None))
    rows += [(300, None, "s1"), (301, "", "s1"), (None, "  " + lines[0] + " ", "s2"), (302, lines[0] + "\n" + lines[0], "s3"), (303, lines[0] + "\n" + lines[0], "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("hash_", F.lit(1)).withColumn("gone_", F.lit("x")).withColumn("n_removed_x", F.lit(1))
    spread, first = collections.defaultdict(set), {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip():
                spread[x.strip()].add(s or None)
                if i is not None:
                    first[x.strip()] = min(first.get(x.strip(), i), i)
    got = collections.Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(df).collect())
    expected = collections.Counter()
    for i, t, _ in rows:
        kept = [x for x in (t or "").split("\n") if not (len(spread.get(x.strip(), ())) >= 5 and first[x.strip()] != i)]
        expected[i, None if t is None else "\n".join(kept), len((t or "").split("\n")) - len(kept) if t else 0] += 1
    assert got == expected
    assert line_dedup.clean_documents(df).columns == [*df.columns, "n_removed"]
    assert line_dedup.line_dedup(df.filter("false")).count() == 0
    assert "Python" not in line_dedup.line_dedup(df)._jdf.queryExecution().toString()


# 7 chats


def test_chat_format(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", 'hi "you"\n', 9), (1, 2, "assistant", call(("a", "add", {"y": 2, "x": 1}), ("b", "add", {"x": "q"})), 9), (1, 1, "tool", result("a", "3"), 9), (1, 3, "tool", result("b", {"z": 1}), 9),
        (1, 4, "tool", result("zz", "?"), 9), (2, 0, "assistant", call(("a", "nope", {})), 9), (None, None, None, None, 9), (3, 0, "assistant", "{broken", 9), (3, 1, "assistant", call(("c", "add", {"x": 1.5})), 9),
        (4, 0, "assistant", call(("d", "add", {"x": 1})), 1), (4, 1, "tool", result("d", "1"), 1), (4, 1, "tool", result("d", "1"), 1), (5, 0, "user", "", 1), (5, 1, "user", "long " * 50000, 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, json_ int").withColumn("calls_", F.lit("clash"))
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", False)], chat_format.SCHEMA)
    out = chat_format.chat_format(df, schemas)
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1] or 0))
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r for r in got}
    assert [r[1] for r in got if r[0] == 1] == [0, 2, 1, 3, 4]  # each result after its call
    assert by[1, 2][4] == "invalid_arguments" and by[2, 0][4] == "unknown_tool" and by[1, 4][4] == "unlinked"
    assert by[3, 1][4] == "unanswered" and by[4, 0][4] == "ok"
    assert by[1, 2][5] == '{"role":"assistant","tool_calls":[{"arguments":{"x":1,"y":2},"id":"a","name":"add"},{"arguments":{"x":"q"},"id":"b","name":"add"}]}'
    for r in got:
        assert json.dumps(json.loads(r[5]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r[5]
    assert chat_format.chat_format(df.filter("false")).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_chat_format_keeps_content_and_long_turns(spark):
    call = {"tool_calls": [{"id": "b", "name": "f", "arguments": {}}], "content": "Let me look"}
    now = 1_700_000_000_000
    rows = [(1, 0, json.dumps(call | {"tool_calls": [{"id": "a", "name": "f", "arguments": {}}]})), (1, 1, json.dumps(call | {"tool_call_id": "a"})), (1, 2, json.dumps({"tool_call_id": "b", "content": "3"}))]
    rows += [(2, 0, '{"content":"Hi","tool_calls":[]}'), (2, 1, '{"content":"Yes","tool_calls":[],"tool_call_id":"q"}'), *[(3, t, "x") for t in (now + 1, now, 5, 999_999_999_999, 10 * now)]]
    df = spark.createDataFrame([(c, t, "assistant", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.order_key, r.turn, json.loads(r.json)) for r in chat_format.chat_format(df).collect())
    by = {(c, t): j for c, _, t, j in got}
    assert len(got) == len(rows) and [t for c, _, t, _ in got if c == 1] == [0, 1, 2]
    assert by[1, 0]["content"] == by[1, 1]["content"] == "Let me look" and by[1, 1]["tool_call_id"] == "a" and by[1, 1]["tool_calls"][0]["id"] == "b"
    assert by[2, 0] == {"content": "Hi", "role": "assistant"} and by[2, 1] == {"content": "Yes", "role": "assistant", "tool_call_id": "q"}
    assert [t for c, _, t, _ in got if c == 3] == [5, 999_999_999_999, now, now + 1, 10 * now]


def test_chat_links_equal_sql(spark):
    """Calls and results out of order, checked against plain SQL over what the messages were made from."""
    import duckdb

    rng, messages, calls, results = random.Random(21), [], [], []
    schema = [("add", "x", "number", True), ("add", "y", "integer", False), ("find", "q", "string", True)]
    for conv in range(60):
        turns = rng.sample(range(-20, 200), 12)
        for turn in turns[:4]:
            some = []
            for pos in range(rng.randrange(1, 4)):
                name, args = rng.choice([("add", {"x": 1}), ("add", {"x": "a"}), ("add", {"x": 1, "y": 2.5}), ("add", {"y": 1}), ("find", {"q": "z"}), ("find", {"q": "z", "other": 1}), ("nope", {})])
                good = (name, json.dumps(args)) in {("add", '{"x": 1}'), ("find", '{"q": "z"}')}
                some.append({"id": f"c{rng.randrange(8)}", "name": name, "arguments": args})
                calls.append((conv, turn, pos, some[-1]["id"], "unknown_tool" if name == "nope" else "ok" if good else "invalid_arguments"))
            messages.append((conv, turn, "assistant", json.dumps({"tool_calls": some})))
        for turn in turns[4:10]:
            results.append((conv, turn, f"c{rng.randrange(10)}"))
            messages.append((conv, turn, "tool", json.dumps({"tool_call_id": results[-1][2], "content": "r"})))
        messages += [(conv, turn, "user", f"hi {turn}") for turn in turns[10:]]
    rng.shuffle(messages)
    con = duckdb.connect()
    for name, kinds, rows in (("calls", "conv int, turn int, pos int, id varchar, status varchar", calls), ("results", "conv int, turn int, id varchar", results), ("messages", "conv int, turn int, role varchar, text varchar", messages)):
        con.execute(f"create table {name} ({kinds})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    expected = con.execute("""
        with f as (select conv, id, min((turn, pos)) as at from calls group by conv, id),
        c as (select calls.*, case when status <> 'ok' then status when (turn, pos) = f.at and exists (select 1 from results r where r.conv = calls.conv and r.id = calls.id) then 'ok' else 'unanswered' end as told
              from calls join f on calls.conv = f.conv and calls.id = f.id),
        m as (select conv, turn, arg_max(told, case told when 'invalid_arguments' then 3 when 'unknown_tool' then 2 when 'unanswered' then 1 else 0 end) as status, turn as t, -1 as p, turn as own from c group by conv, turn
              union all select r.conv, r.turn, case when f.id is null then 'unlinked' else 'ok' end, coalesce(f.at[1], r.turn), coalesce(f.at[2], -1), r.turn from results r left join f on r.conv = f.conv and r.id = f.id
              union all select conv, turn, 'ok', turn, -1, turn from messages where role = 'user')
        select conv, turn, status from m order by conv, t, p, own
    """).fetchall()
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = chat_format.chat_format(df, spark.createDataFrame(schema, chat_format.SCHEMA)).collect()
    assert [(r.conv_id, r.turn, r.status) for r in sorted(got, key=lambda r: (r.conv_id, r.order_key))] == expected
    assert len({s for _, _, s in expected}) == 5


def test_chat_turns_sort_as_numbers(spark):
    turns = [-(10**12), -5, -4, 0, 3, 999_999_999_999, 10**12, 10**13, None]
    df = spark.createDataFrame([(1, t, "user", "x") for t in turns], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in sorted(chat_format.chat_format(df).collect(), key=lambda r: r.order_key)] == turns


def test_chat_query_checks_calls_by_what_conversations_declare(spark, tmp_path):
    """Every status comes out of the query itself, which has no table of schemas."""
    from tessera.llm.queries import op7_chat_format

    add = {"name": "add", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": ["string", "null"]}, "z": True}, "required": ["x"]}}
    tools = [{"type": "function", "function": add}, {"name": "open", "inputSchema": {"properties": {}, "additionalProperties": True}}, {"name": "now"}, "broken"]
    arguments = [
        ("add", {"x": 1}, "ok"), ("add", '{"x":1,"y":null,"z":[2]}', "ok"), ("add", {"x": "1"}, "invalid_arguments"), ("add", {"x": 1, "y": 2}, "invalid_arguments"), ("add", {}, "invalid_arguments"),
        ("add", {"x": 1, "q": 1}, "invalid_arguments"), ("open", {"q": 1}, "ok"), ("now", {}, "ok"), ("now", {"q": 1}, "invalid_arguments"), ("other", {}, "unknown_tool"),
    ]
    call = lambda i, name, a: json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": a}]})
    # The first declaration of add is replaced by the next one.
    rows = [(1, 0, "system", json.dumps({"tools": [add | {"parameters": {}}]})), (1, 1, "system", json.dumps({"tools": tools}))]
    expected = {(1, 0): "ok", (1, 1): "ok"}
    for n, (name, a, status) in enumerate(arguments):
        rows += [(1, 10 + n, "assistant", call(f"c{n}", name, a)), (1, 100 - n, "tool", json.dumps({"tool_call_id": f"c{n}", "content": "r"}))]
        expected |= {(1, 10 + n): status, (1, 100 - n): "ok"}
    # Nothing declared (a user's text declares nothing): links, names and the form of arguments are still checked.
    rows += [(2, 0, "user", json.dumps({"tools": []})), (2, 1, "assistant", call("a", "f", {"x": 1})), (2, 2, "assistant", call("b", "f", {})), (2, 3, "assistant", call("c", "f", "x")), (2, 4, "assistant", call("d", "f", [1]))]
    rows += [(2, 5, "assistant", call("e", None, {})), *[(2, 10 + n, "tool", json.dumps({"tool_call_id": i, "content": "r"})) for n, i in enumerate("acdez")]]
    expected |= {(2, 0): "ok", (2, 1): "ok", (2, 2): "unanswered", (2, 3): "invalid_arguments", (2, 4): "invalid_arguments", (2, 5): "unknown_tool"} | {(2, 10 + n): "unlinked" if n == 4 else "ok" for n in range(5)}
    # No tools at all are declared.
    rows += [(3, 0, "developer", json.dumps({"tools": []})), (3, 1, "assistant", call("a", "add", {"x": 1}))]
    expected |= {(3, 0): "ok", (3, 1): "unknown_tool"}
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = op7_chat_format(spark, str(tmp_path))
    got = out.collect()
    assert len(got) == len(rows) and {(r.conv_id, r.turn): r.status for r in got} == expected
    assert [r.turn for r in sorted(got, key=lambda r: (r.conv_id, r.order_key)) if r.conv_id == 2] == [0, 1, 10, 2, 3, 11, 4, 12, 5, 13, 14]
    assert json.loads(next(r.json for r in got if (r.conv_id, r.turn) == (1, 1)))["content"] == rows[1][3]
    assert "Python" not in out._jdf.queryExecution().toString()


def test_chat_checks_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 3)
    rows = [(c, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": {"properties": {"x": {"type": "integer"}}}}]})) for c in (1, 2)]
    rows += [(c, 1 + n, "assistant", json.dumps({"tool_calls": [{"id": f"{n}", "name": "f" if n % 3 else "g", "arguments": {"x": n if n % 2 else "?"}}]})) for c in (1, 2) for n in range(50 if c == 1 else 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.status for r in chat_format.chat_format(df).collect()}
    assert got == {(c, t): "ok" if t == 0 else "unknown_tool" if (t - 1) % 3 == 0 else "unanswered" if (t - 1) % 2 else "invalid_arguments" for c, t, _, _ in rows}


# 8 pages


def test_html_extraction(spark):
    article = "<h1>Title &amp; more</h1><p>First  para\n with <b>bold</b> text.</p><p>Of.</p><ul><li>one</li><li>two</li></ul>"
    junk = '<nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy now.</div>'
    pages = [
        (1, "u", f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{junk}<article>{article}</article><div class='comments'><p>nice post</p></div><footer>&copy; x</footer></body></html>"),
        (2, None, None), (3, "u", ""), (None, "u", "<article><p>unclosed <b>x<p>next"), (5, "u", "<article><p>" + "long text. " * 20000 + "</p></article>"), (6, "u", "<a href='x"),
        (1, "u", "<article><!-- c --><p>caf&eacute; &#9731;</p><form><label>mail</label><button>go</button></form></article>"), (7, "u", "<div>" * 3000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [tuple(r) for r in html_extract.extract(df).collect()]
    assert got[0][2] == "Title & more\nFirst para with bold text.\nOf.\none\ntwo"
    assert [g[2] for g in got[1:4]] == ["", "", "unclosed x\nnext"]
    assert got[6][2] == "café ☃" and all(g[3] == len(g[2]) for g in got)
    assert len(got[4][2]) == 20000 * 11 - 1
    assert html_extract.extract(df.filter("false")).count() == 0


def test_marginals_equal_brute_force():
    model = html_extract.trained(html_extract.training_pages(40))
    nodes = html_extract.parse("<body><article><p>some text here.</p><p>x</p></article><nav><a>menu</a></nav></body>")
    n = len(nodes)
    total, on = 0.0, np.zeros(n)
    for state in range(2**n):
        y = [state >> k & 1 for k in range(n)]
        p = 0.5
        for k, node in enumerate(nodes):
            if k:
                p *= model._edge(model._edge_kind(node))[y[node.parent]][y[k]]
            for f in html_extract.features(node):
                p *= model._seen(node.kind == "text", f)[y[k]]
        total += p
        on += p * np.array(y)
    assert np.allclose(model.marginals(nodes), on / total)


def test_html_by_hand():
    model = html_extract.trained()
    layouts = {
        "<body><article><p>Energy <math><mi>E</mi>=m</math> is mass</p></article></body>": "Energy E=m is mass",
        "<article><h2>News</h2><p class='alert-level'>The alert level rose again last week.</p><div class='share-of-market'><p>Our share grew.</p></div></article>": "News\nThe alert level rose again last week.\nOur share grew.",
        "<div id=page><div class='top-menu'><a href=/>Home</a> <a href=/n>News</a></div><div class=content><p>One long sentence of the story.</p><p>Another one follows it here.</p></div><div class=footer><p>&copy; 2024 All rights</p></div></div>": "One long sentence of the story.\nAnother one follows it here.",
        "<main><h1>T</h1><p>Body text with a <a href=x>link</a> inside.</p></main><section id='comments'><div class='comment'><p>First!</p></div></section>": "T\nBody text with a link inside.",
        "<article><p>Before.</p><aside class='related'><ul><li><a href=1>a</a></li><li><a href=2>b</a></li></ul></aside><p>After the box.</p></article>": "Before.\nAfter the box.",
    }
    for page, text in layouts.items():
        assert html_extract.main_text(page, model) == text
    began = time.time()
    for page in ("<div>" * 16_000 + "</b1></section>" * 16_000, "<p>x<blockquote>" * 16_000, "<ul><li>" * 16_000, "<div>" * 8_000 + "<td>" * 8_000):
        html_extract.main_text(page, model)
    assert time.time() - began < 20


def test_html_on_unseen_layouts():
    model = html_extract.trained()
    exact = 0
    pages = html_extract.training_pages(100, seed=99)
    for page in pages:
        truth = [x.text for x in html_extract.parse(page) if x.text is not None and x.mark == "1"]
        plain = page.replace(' data-content="1"', "").replace(' data-content="0"', "")
        exact += html_extract.main_text(plain, model) == "\n".join(truth)
    assert exact >= 85


# 10 Jaccard join


def brute_links(rows, similarity=0.8):
    sets = {i: set(jaccard_join.shingle_set(t).tolist()) for i, t in rows}
    parent, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if len(x & y) >= similarity * len(x | y) - 1e-9:
                links[ids[a]] += 1
                links[ids[b]] += 1
                u, v = sorted((find(ids[a]), find(ids[b])))
                parent[v] = u
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("limit", [256, 8])
def test_jaccard_join_equals_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    rng = random.Random(6)
    rows = []
    common = words(rng, 40, 10**5)
    for g in range(40):
        base = words(rng, 80, 10**5).split()
        for _ in range(1 if g % 2 else (60 if g == 0 else 4)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [common + " " + words(rng, 60, 10**5) for _ in range(40)]  # a shared passage is no near copy
    rows += [rows[0]] * 30 + ["", None, "tiny text", "Tiny, text!", "..."]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit(2)).withColumn("bucket", F.lit(0))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df, limit=limit, deep=limit).collect()}
    assert got.pop(None) == (None, 0)
    expected = brute_links(rows)
    wrong = [i for i in expected if got[i] != expected[i]]
    assert len(wrong) <= 1, [(got[i], expected[i]) for i in wrong]


def test_jaccard_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_join(df).count() == 0


def test_words_and_shingles():
    a = word_hashes("Hello, wörld foo-bar ... x\n\tHELLO; foobar")
    assert a[0] == a[4] and a[2] == a[5] and len(a) == 6
    assert len(word_hashes("... !!")) == len(word_hashes(None)) == 0
    assert len(shingle_hashes(a)) == 2 and len(shingle_hashes(a[:3])) == 1
    assert shingle_hashes(a[1:])[0] == shingle_hashes(a)[1]
