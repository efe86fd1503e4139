"""From raw documents to packed sequences: every stage works on all that its predecessor kept."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm import jaccard, language, packing, pii, suffixes
from tablescope.llm.common import held_out, numbered, shipped, tokenizer_path, written

#: Language models, hashing and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(kind))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents without a letter go, and those whose language is less certain than not."""
    shipped(spark)
    train = docs.filter(~held_out(F.col("doc_id"), 5, 0)).select("text", "lang", F.col("doc_id").alias("_key"))
    model = language.fit(train, tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    rows, names = numbered(docs)
    known = language.identify(rows.withColumnRenamed(names["text"], "text"), model)
    known = known.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")
    return known.toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, Jaccard 0.8 or more) one row stays.

    It is the row with the least doc_id, null behind all others; among equal ids the one whose text has the least hash, among
    equal texts the one whose columns have. Rows that share a doc_id are judged by their own texts. Rows without words are in no group and stay.
    """
    shipped(spark)
    groups = jaccard.keepers(docs, n=5, threshold=Fraction(8, 10)).filter("set_id IS NOT NULL")
    rows = written(
        groups.groupBy("doc_id", "text_key", "component_id", "keeper").agg(F.count("*").alias("n"))
        .withColumn("keeps", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("keeper"))),
        "groups",
    )
    numbers, names = numbered(docs)
    columns, doc_id = numbers.columns, names["doc_id"]
    keyed = numbers.withColumn("_text_key", jaccard.text_key(F.col(names["text"])))

    def same(other: DataFrame) -> Column:
        return (keyed["_text_key"] == other["text_key"]) & keyed[doc_id].eqNullSafe(other["doc_id"])

    other, several = rows.filter("NOT keeps OR n > 1"), rows.filter("keeps AND n > 1")
    single = keyed.join(other, same(other), "left_anti")
    first = W.partitionBy(doc_id, "_text_key").orderBy(F.xxhash64(*columns))
    copies = keyed.join(several, same(several), "left_semi").withColumn("_row", F.row_number().over(first)).filter("_row = 1")
    return single.select(columns).unionByName(copies.select(columns)).toDF(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out."""
    shipped(spark)
    return _with_length(suffixes.cut_repeats(docs))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind; what discloses it is generalised or removed."""
    shipped(spark)
    return _with_length(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("personal_data", sanitise),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
