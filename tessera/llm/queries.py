"""The registered ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk_search import integer_vectors, topk_search

    table = _table(spark, sf_dir, "embeddings")
    rows = integer_vectors(table)
    n = table.count()
    return topk_search(rows, rows.filter("id_ % 50 = 0"), n, -(-n // 50), k=5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), max_tokens=4096, end_id=1, with_ids=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat_format import chat_format

    return chat_format(_table(spark, sf_dir, "conversations"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_maxscore_topk, op2_toxicity, op3_decontaminate, op4_token_counts, op5_best_fit_packing, op6_line_dedup, op7_chat_format, op8_html_extract, op9_quality, op10_jaccard_join]
    import corpus_pipeline

    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


ORACLE: dict[str, str] = {
    "op1_maxscore_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
        ), r as (
            select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
        )
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op6_line_dedup": """
        with l as (
            select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
        ), t as (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as x from l),
        b as (
            select x, min(doc_id) as first from t where x <> ''
            group by x having count(distinct coalesce('s' || source, 'n')) >= 5
        ), k as (
            select t.doc_id, t.line, t.pos, b.x is not null and t.doc_id is distinct from b.first as gone from t left join b on t.x = b.x
        ), c as (
            select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text, count(*) filter (gone) as n_removed from k group by doc_id
        )
        select d.doc_id, case when d.text is null then null else coalesce(c.text, '') end as text, coalesce(c.n_removed, 0) as n_removed
        from documents d left join c on d.doc_id = c.doc_id
    """,
    "op7_chat_format": """
        select conv_id, turn, coalesce(role, 'unknown') as role,
            lpad(turn::varchar, 12, '0') || '/0/' || lpad(turn::varchar, 12, '0') as order_key, 'ok' as status,
            to_json({'content': coalesce(text, ''), 'role': coalesce(role, 'unknown')})::varchar as json
        from conversations
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
