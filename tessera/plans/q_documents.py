"""Queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as O
from tessera.plans.registry import query
from tessera.plans.tables import table, values


def docs(spark, d):
    return table(spark, d, "documents")


def lowered(spark, d):
    """Texts in lower case once, for all that is looked for in them."""
    return docs(spark, d).select("doc_id", "source", "n_chars", F.lower("text").alias("low"))


def _any(column: str, seeds) -> str:
    return "(" + " or ".join(f"contains({column}, '{s.lower()}')" for s in seeds) + ")"


_TAGS = "list_filter([" + ", ".join(f"case when {_any('lower(text)', s)} then '{f}' end" for f, s in O.FACETS.items()) + "], lambda x: x is not null)"
_MATCHES = " + ".join(f"contains(lower(q), '{s.lower()}')::int" for seeds in O.FACETS.values() for s in seeds)
_QUESTIONS = "(1, 'how does login with a JWT token work'), (2, 'fix the broken sql query in the repository model'), (3, 'overview of the architecture'), (4, 'nothing at all'), (5, 'which api route handler logs an error to sentry'), (6, 'database storage index issue'), (7, 'user session password problem')"


@query(
    "q08_facet_detection_query",
    f"""with q as (select id, q, {_TAGS.replace("text", "q")} as facets, {_MATCHES} as matches from (values {_QUESTIONS}) t(id, q))
        select id, array_to_string(facets, ',') as facets, matches, round(least(1.0::double, 0.3::double * len(facets) + 0.1::double * matches), 6) as confidence from q""",
)
def q08(spark, d):
    q = values(spark, _QUESTIONS, "id, q").withColumn("tags", O.facet_tags(F.lower("q"))).withColumn("matches", O.facet_matches(F.col("q")).cast("int"))
    confidence = F.least(F.lit(1.0), F.size("tags") * 0.3 + F.col("matches") * 0.1)
    return q.select("id", F.array_join("tags", ",").alias("facets"), "matches", F.round(confidence, 6).alias("confidence"))


@query("q09_facet_tags_documents", f"select doc_id, array_to_string({_TAGS}, ',') as facets from documents")
def q09(spark, d):
    return lowered(spark, d).select("doc_id", F.array_join(O.facet_tags(F.col("low")), ",").alias("facets"))


@query("q10_per_facet_counts", f"with t as (select doc_id, source, unnest({_TAGS}) as facet from documents) select facet, count(*) as n, count(distinct source) as sources, round(count(distinct source) / count(*), 6) as coverage from t group by facet")
def q10(spark, d):
    t = lowered(spark, d).select("source", F.explode(O.facet_tags(F.col("low"))).alias("facet"))
    t = t.groupBy("facet").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    return t.withColumn("coverage", F.round(F.col("sources") / F.col("n"), 6))


_PHRASE = "and the"
_LEX = """case when contains(lower(text), 'and the') then 1.0 else 0.0 end
    + ((length(lower(text)) - length(replace(lower(text), 'and', ''))) / 3) * 0.3 + case when contains(lower(source), 'and') then 0.5 else 0.0 end + case when lower(source) = 'and' then 1.0 else 0.0 end
    + ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3) * 0.3 + case when contains(lower(source), 'the') then 0.5 else 0.0 end + case when lower(source) = 'the' then 1.0 else 0.0 end"""


@query(
    "q14_lexical_search",
    f"""with s as (select doc_id as id, greatest(0.0, {_LEX} - least(length(text) / 1000, 0.5)) as score, lang = 'en' as is_symbol from documents),
        t as (select id, round(case when is_symbol and score > 0 then score + 0.2 else score end, 6) as score from s) select * from t where score > 0 order by score desc, id limit 12""",
)
def q14(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("name"), (F.col("lang") == "en").alias("is_symbol"))
    return O.lexical_search(rows, _PHRASE, 12)


@query("q15_content_like_search", "select doc_id, source from documents where text ilike '%LICENSED%' order by n_chars desc, doc_id limit 50")
def q15(spark, d):
    return docs(spark, d).filter(F.col("text").ilike("%LICENSED%")).orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "source")


@query("q27_language_histogram", "select lang, count(*) as n from documents group by lang order by n desc, lang limit 5")
def q27(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(5)


@query(
    "q31_word_frequency_topk",
    """with w as (select doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents)
        select word, count(*) as n, count(distinct doc_id) as documents, count(distinct source) as sources from w where length(word) >= 3 group by word order by n desc, word limit 50""",
)
def q31(spark, d):
    return O.word_frequencies(docs(spark, d), 50)


_HASH = "substring(sha256(concat_ws('|', lang, trim(regexp_replace(lower(text), '[\\s]+', ' ', 'g')))), 1, 16)"


def _hashed(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id"), "source", "n_chars", O.content_hash(F.col("lang"), O.normalised(F.col("text"))).alias("hash"))


@query(
    "q35_exact_dedup_keep_best",
    f"""with h as (select doc_id as id, source, {_HASH} as hash from documents), w as (select *, first_value(id) over (partition by hash order by source, id) as kept, count(*) over (partition by hash) as copies from h)
        select id, hash, kept, copies, kept <> id as duplicate from w""",
)
def q35(spark, d):
    return O.keep_best(_hashed(spark, d), "hash", [F.col("source")]).select("id", "hash", "kept", "copies", "duplicate")


_KEPT = ("the", "function", "class", "type", "const")
_SIGNATURE = "lang || '|' || trim(" + "replace(" * len(_KEPT) + "regexp_replace(" + "regexp_replace(" * (len(_KEPT) + 1) + r"text, '\s+', ' ', 'g')" + "".join(rf", '\b{w}\b', '@{k}@', 'g')" for k, w in enumerate(_KEPT)) + ", '[A-Za-z]+', 'V', 'g')" + "".join(f", '@{k}@', '{w}')" for k, w in enumerate(_KEPT)) + ")"


@query("q36_signature_dedup", f"with h as (select doc_id as id, {_SIGNATURE} as sig from documents) select md5(sig) as signature, min(id) as kept, count(*) as copies from h group by sig having count(*) > 1")
def q36(spark, d):
    """Texts alike but for their words, a few of which are kept as they are; the digest, not the text, is grouped by."""
    plain = F.regexp_replace("text", r"\s+", " ")
    for k, w in enumerate(_KEPT):
        plain = F.regexp_replace(plain, rf"\b{w}\b", f"@{k}@")
    plain = F.regexp_replace(plain, "[A-Za-z]+", "V")
    for k, w in enumerate(_KEPT):
        plain = F.replace(plain, F.lit(f"@{k}@"), F.lit(w))
    h = docs(spark, d).select(F.col("doc_id").alias("id"), F.md5(F.concat(F.col("lang"), F.lit("|"), F.trim(plain))).alias("signature"))
    return h.groupBy("signature").agg(F.min("id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1").select("signature", "kept", "copies")


@query(
    "q37_duplicate_references",
    f"""with h as (select doc_id as id, source, {_HASH} as hash from documents), w as (select *, first_value(id) over (partition by hash order by source, id) as kept, count(*) over (partition by hash) as copies from h)
        select hash, kept, array_to_string(list_sort(list(id) filter (id <> kept))[1:10], ',') as also_found_in from w where copies > 1 group by hash, kept""",
)
def q37(spark, d):
    return O.duplicate_references(O.keep_best(_hashed(spark, d), "hash", [F.col("source")]), "hash")


_TOKENS = "select doc_id as id, source, lang, (n_chars % 97) / 97 as score, ceil(n_chars / 4)::bigint as tokens from documents"


def _scored(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id"), "source", ((F.col("n_chars") % 97) / 97).alias("score"), F.ceil(F.col("n_chars") / 4).alias("tokens"))


@query("q42_token_budget_prefix", f"with t as ({_TOKENS}), s as (select id, source, tokens, sum(tokens) over (partition by source order by score desc, id rows unbounded preceding)::bigint as total from t) select * from s where total <= 8000")
def q42(spark, d):
    return O.budget_prefix(_scored(spark, d), "source", 8000).select("id", "source", "tokens", "total")


_GREEDY = """with recursive t as (%s), o as (select *, row_number() over (partition by source order by %s desc, id) as r from t),
    g as (select source, r, id, tokens, case when tokens <= 8000 then tokens else 0 end as used, tokens <= 8000 as kept from o where r = 1
    union all select o.source, o.r, o.id, o.tokens, case when g.used + o.tokens <= 8000 then g.used + o.tokens else g.used end, g.used + o.tokens <= 8000 from g join o on o.source = g.source and o.r = g.r + 1)
    select source, id, max(used) over (partition by source) as used, kept from g"""


@query("q43_token_budget_greedy", f"select source, id, used from ({_GREEDY % (_TOKENS, 'score')}) where kept")
def q43(spark, d):
    return O.budget_greedy(_scored(spark, d), "source", 8000)


@query("q44_two_pass_packing", f"select source, id, used from ({_GREEDY % (_TOKENS, 'case when score >= 0.8 then score + 10 else score end')}) where kept")
def q44(spark, d):
    return O.budget_two_pass(_scored(spark, d), "source", 8000)


@query("q59_token_estimates", r"select doc_id, ceil(length(text) / 4)::bigint as by_length, ceil(len(regexp_extract_all(text, '[A-Za-z0-9]+')) + len(regexp_extract_all(text, '[.,;]')) / 2)::bigint as by_words from documents")
def q59(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return docs(spark, d).select("doc_id", T.tokens_by_length(F.col("text")).alias("by_length"), F.ceil(n("[A-Za-z0-9]+") + n("[.,;]") / 2).alias("by_words"))


@query("q60_excerpt", "select doc_id, case when length(split_part(text, chr(10), 1)) <= 180 then split_part(text, chr(10), 1) else substring(split_part(text, chr(10), 1), 1, 180) || '...' end as excerpt from documents")
def q60(spark, d):
    return docs(spark, d).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(
    "q78_fixed_50_line_chunks",
    """with l as (select doc_id, text, string_split(text, chr(10)) as l from documents), c as (select *, unnest(range(0, greatest(1, ceil(len(l) / 10))::bigint)) as i from l)
        select doc_id, i::int as chunk, (i * 10 + 1)::int as start_line, least(len(l), (i + 1) * 10)::int as end_line, case when trim(text) = '' then 'empty_file' else 'chunk' end as kind,
        length(array_to_string(l[i * 10 + 1 : i * 10 + 10], chr(10)))::int as chars from c""",
)
def q78(spark, d):
    """Chunks of 10 lines: few of these texts have 50."""
    return O.fixed_line_chunks(docs(spark, d), 10)


@query("q79_overlap_chunks")
def q79(spark, d):
    return O.overlap_chunks(docs(spark, d), 2000, 100)


_CHAIN = lambda c, rules, other: "case " + " ".join(f"when regexp_matches(lower({c}), '{p}') then '{n}'" for n, p in rules) + f" else '{other}' end"


@query("q85_topic_detection", f"select id, {_CHAIN('q', T.TOPICS, 'unknown')} as topic from (values {_QUESTIONS}) t(id, q)")
def q85(spark, d):
    return values(spark, _QUESTIONS, "id, q").select("id", T.first_match(F.col("q"), T.TOPICS, "unknown").alias("topic"))


_PLAN = [f"len(list_filter(string_split(lower(q), ' '), lambda w: regexp_matches(w, '{'|'.join(k)}')))" for _, k in T.PLANS]


@query("q86_attack_plan", f"with s as (select id, {', '.join(f'{e} as s{k}' for k, e in enumerate(_PLAN))} from (values {_QUESTIONS}) t(id, q)) select id, case when greatest(s0, s1, s2, s3) = s0 then '{T.PLANS[0][0]}' when greatest(s0, s1, s2, s3) = s1 then '{T.PLANS[1][0]}' when greatest(s0, s1, s2, s3) = s2 then '{T.PLANS[2][0]}' else '{T.PLANS[3][0]}' end as plan from s")
def q86(spark, d):
    return values(spark, _QUESTIONS, "id, q").select("id", T.attack_plan(F.col("q")).alias("plan"))


@query("q87_task_type", f"select id, {_CHAIN('q', [(n, '|'.join(w)) for n, w in T.TASKS], 'understand')} as task from (values {_QUESTIONS}) t(id, q)")
def q87(spark, d):
    return values(spark, _QUESTIONS, "id, q").select("id", T.task_type(F.col("q")).alias("task"))


@query(
    "q73_context_quality_gate",
    """with m as (select conv_id, coalesce(sum(ceil(length(trim(text)) / 4)) filter (role = 'assistant'), 0)::bigint as system, coalesce(sum(ceil(length(trim(text)) / 4)) filter (role <> 'assistant'), 0)::bigint as dynamic, bool_or(contains(text, '% similar') or contains(text, 'confidence') or contains(text, 'embedding')) as shown from conversations group by conv_id)
        select conv_id, system, dynamic, case when shown then case when dynamic < 10 then 'TOO_FEW_TOKENS' else 'ok' end when dynamic < 32 then 'TOO_FEW_TOKENS' when dynamic / (system + dynamic) < 0.15 then 'LOW_DYNAMIC_RATIO' else 'ok' end as verdict from m""",
)
def q73(spark, d):
    """The assistant's part is taken for the instructions."""
    return O.context_verdicts(table(spark, d, "conversations"), "conv_id", "assistant")


@query(
    "q190_symbol_words",
    f"with w as (select doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z_]+')) as word from documents) select word, count(*) as n, count(distinct doc_id) as documents, count(distinct source) as sources from w where length(word) >= 3 and lower(word) not in ({', '.join(repr(x) for x in O.STOP_WORDS)}) and not starts_with(word, '_') and not (length(word) < 4 and upper(word) = word) group by word order by n desc, word limit 30",
)
def q190(spark, d):
    return O.word_frequencies(docs(spark, d), 30, stop=O.STOP_WORDS, pattern="[A-Za-z_]+", lower=False)


@query("q191_first_seen", "with r as (select event_id, user_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id) as k from events) select event_id, user_id, event_type, value from r where k = 1")
def q191(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return O.first_seen(e, ["user_id", "event_type"], "event_id")


_SECTIONS = (("overview", "the"), ("security", "hash"), ("licence", "licensed"), ("table", " | "))


@query(
    "q89_evidence_cards",
    "with c as (" + " union all ".join(f"select '{n}' as section, doc_id, n_chars from documents where contains(lower(text), '{p}')" for n, p in _SECTIONS) + """),
        r as (select *, (row_number() over (partition by section order by n_chars desc, doc_id))::int as rank from c) select section, doc_id, rank from r where rank <= 5""",
)
def q89(spark, d):
    """A text can be in several sections; the five longest of each."""
    from pyspark.sql import Window

    low = F.lower("text")
    tags = F.array_compact(F.array(*[F.when(low.contains(p), n) for n, p in _SECTIONS]))
    rows = docs(spark, d).select("doc_id", "n_chars", F.explode(tags).alias("section"))
    w = Window.partitionBy("section").orderBy(F.desc("n_chars"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("section", "doc_id", "rank")


@query("q90_system_map_groups", f"with t as (select doc_id, n_chars, unnest({_TAGS}) as facet from documents), r as (select *, (row_number() over (partition by facet order by n_chars desc, doc_id))::int as rank from t where facet in ('auth', 'data', 'security')) select facet, doc_id, rank from r where rank <= 6")
def q90(spark, d):
    from pyspark.sql import Window

    rows = lowered(spark, d).select("doc_id", "n_chars", F.explode(O.facet_tags(F.col("low"))).alias("facet")).filter(F.col("facet").isin("auth", "data", "security"))
    w = Window.partitionBy("facet").orderBy(F.desc("n_chars"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 6").select("facet", "doc_id", "rank")
