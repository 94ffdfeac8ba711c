"""From documents to token ids: five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return the columns of ``docs``, the last one the encoded texts.
An empty table passes every stage as an empty table. Columns that a stage adds for itself have names
that ``docs`` does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlearn.llm import bpe, langid, mixing, ngramjoin, secrets
from loamlearn.llm.common import Workspace, free_name

#: Near duplicates: words of a shingle and least similarity in percent.
SHINGLE_WORDS, SIMILAR = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, empty and null ones among them, and texts between languages go; repeated rows are judged
    each. Fitted on the labelled texts themselves; without any label nothing can be told and all texts go."""
    model = langid.fit(docs)
    prefix = free_name(docs, "lang")
    out = langid.identify(docs, model, carry=tuple(docs.columns), prefix=prefix)
    return out.filter((F.col(f"{prefix}_pred") != langid.UNKNOWN) & ~F.col(f"{prefix}_ambiguous")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts one row stays: the one of the least id (null ids last), then of the least key.

    A row's key is a 64-bit hash of its id and text, so rows with one id and different texts are told apart and rows
    that agree in both are one, null ids included. Texts without words, null ones too, are linked with nothing: of
    those one row an id and text stays.
    """
    key, kept, first = (free_name(docs, x) for x in ("key", "kept", "first"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    got = ngramjoin.jaccard_join(keyed, id_col=key, words=SHINGLE_WORDS, percent=SIMILAR).select(F.col("doc_id").alias(kept), "component_id").distinct()
    got = got.join(keyed.select(F.col(key).alias(kept), F.struct(F.col("doc_id").isNull(), "doc_id", key).alias(first)).distinct(), kept)
    stays = got.groupBy("component_id").agg(F.min_by(kept, first).alias(kept)).select(kept)
    return keyed.join(stays, F.col(key) == F.col(kept), "left_semi").dropDuplicates([key]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked in every row; widely copied examples and placeholders stay. Null and empty
    texts stay as they are; n_chars is that of the new text, null for a null one."""
    out = secrets.redact_live(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as the mix of sources takes it, in the order of its slots. Texts without words, null ones
    too, have nothing to take and go; a null source is a source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256: a row for each row;
    a null text has no ids, as an empty one."""
    return bpe.encode_documents(spark, docs, keep=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]

#: SQL can't express the trained and the byte-pair stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = ws.save(docs, name)
    return docs
