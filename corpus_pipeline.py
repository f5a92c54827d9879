"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) to a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs, in whatever number, with
`text` and `n_chars` as the stage leaves them. Stages work on whatever their predecessor kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import languages, packing, secrets, simhash, substrings
from tallyfold.llm.common import written
from tallyfold.llm.queries import BYTE_TOKENIZER, CAPACITY


def _with_text(docs: DataFrame, text) -> list:
    """The columns of docs out of `carried`, with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new[c].alias(c) if c in new else F.col("carried").getField(c).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: null texts and those without letters, also where no row has a label."""
    return languages.determined(docs, languages.learn(docs.where(~languages.held_out())))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays.

    Rows that repeat an id are one document: the row stays whose text has the smallest SHA-256 (ties: the
    smallest row as JSON), whatever the order of the rows. Rows without an id stay.
    """
    found = written(simhash.near_duplicates(docs)).where("doc_id IS NOT NULL")
    removed = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = docs.join(removed.union(repeated), "doc_id", "left_anti")
    whole = F.struct(*docs.columns)
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.to_json(whole))
    first = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, order).alias("_first"))
    return once.select(docs.columns).union(first.select("_first.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 20 words and more are cut out; documents of which nothing is left go."""
    found = substrings.remove_repeats(docs, carried=docs.columns, keep_untouched=True)
    found = found.where("n_removed = 0 OR n_removed < n_words")
    return found.select(_with_text(docs, F.when(F.col("carried.text").isNotNull(), F.col("kept_text"))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    found = secrets.scan(docs, docs.columns)
    clean = found.select("carried", secrets.redacted("text", "spans").alias("clean"))
    return clean.select(_with_text(docs, F.when(F.col("carried.text").isNotNull(), F.col("clean"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, BYTE_TOKENIZER, CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Neither fingerprints nor tokens can be had in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
