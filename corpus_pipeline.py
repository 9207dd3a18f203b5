"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept; its result is written as
Parquet and read again. All stages but the last return the columns of ``documents``.

1. Toxicity: documents predicted to be toxic go.
2. Language: documents without letters or without a likely language go.
3. Near duplicates: of every group of texts on the same component the document with the smallest id stays. Documents
   without an id stay; rows that repeat an id stay or go together.
4. Mixing: a document appears as often as the mix takes it, perhaps never. Rows that repeat an id share its copies
   evenly, rounded up.
5. Packing: pieces of documents in sequences; the result of ``run``.

SQL can't express the trained models and the column generation, so there is no SQL for the rows of ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.durable import stored
from tidewell.llm.common import documents, fold
from tidewell.llm.jaccard import near_texts
from tidewell.llm.language import recognised
from tidewell.llm.mixing import mix
from tidewell.llm.packing import pack
from tidewell.llm.pieces import vocabulary
from tidewell.llm.toxicity import clean

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, documents(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recognised(docs, fold("doc_id", 5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_texts(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    copies = copies.where("copies > 0").select("doc_id", F.ceil(F.col("copies") / F.col("rows")).alias("copies"))
    taken = docs.alias("d").join(copies.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")))
    rows = F.array_repeat(F.struct(*(F.col(f"d.`{c}`") for c in docs.columns)), F.col("k.copies").cast("int"))
    return taken.select(F.inline(rows))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
