"""A corpus, filtered and packed: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; all but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty result; null
and empty texts are kept by the filters and packed as one piece of the end id;
rows with a null id are kept and scored like others, but stand for no other
row; repeated rows are scored alike, and of those the n-gram Jaccard join keeps
one; columns beyond those of documents, whatever their names, come through all
stages but the last, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialise
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.line_dedup import clean_documents
from tessera.llm.packing import pack_documents
from tessera.llm.toxicity import drop_toxic

#: A stage of letter models, Hamming searches and random paths has no SQL.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is one half or more go; the others stay as they are."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; every row stays. ``n_chars`` follows the text."""
    names = docs.columns
    counted = free_name("n_removed", names)
    cleaned = clean_documents(docs, counted=counted)
    text_length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    return cleaned.select(*[F.when(F.col(counted) == 0, F.col(c)).otherwise(text_length).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id; of rows with one id and text, one (any). Rows without id stay."""
    classes = jaccard_join(docs)
    first = classes.filter("doc_id = class_id").select("doc_id")
    with_id = docs.filter("doc_id is not null").join(first, "doc_id", "left_semi")
    copy = free_name("copy", docs.columns)
    once = with_id.withColumn(copy, F.xxhash64("text")).dropDuplicates(["doc_id", copy]).drop(copy)
    return once.unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; the others stay as they are."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1, with_ids=False)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
