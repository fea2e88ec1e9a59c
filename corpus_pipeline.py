"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), reads whole texts, and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each result as Parquet in the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import feistel, langid, minhash, mixing, packing, queries
from folioweave.llm.shared import Stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents without a letter go. The network learns from the labelled rows.

    Where no row is labelled nothing can be predicted: documents with a letter then stay as they are.
    """
    docs = docs.select(*COLUMNS)
    model = langid.learn(docs, order=F.xxhash64("doc_id"))
    if not model[1]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs.withColumn("read", F.col("text")), model, text_col="read").where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity of 0.8 or more) the document of smallest id stays.

    A document is an id and a text: where an id has several texts, all but one of them are compared under numbers of
    their own, so that no text goes without a copy that stays.
    """
    docs = docs.select(*COLUMNS).withColumn("print", F.xxhash64("text"))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("p0"), F.max("print").alias("p1")).where("p0 <> p1")
    docs = docs.join(several.select("doc_id", "p0").hint("merge"), "doc_id", "left")
    other = F.xxhash64("doc_id", "print").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    docs = docs.withColumn("document", F.when(F.col("p0") != F.col("print"), other).otherwise(F.col("doc_id").cast("long")))
    marked = minhash.near_duplicates(docs, id_col="document", k=5, percent=80)
    gone = marked.where(~F.col("kept")).select("document").distinct()
    return docs.join(gone.hint("merge"), "document", "left_anti").select(*COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(docs.select(*COLUMNS), queries.PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by sources, languages and topics at tempered shares."""
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    return mixing.mix(docs, margins, fraction=0.8).where("mix_kept").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", pseudonymise),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

#: No SQL: the stages learn, hash and pack; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage.table(step(spark, docs, sf_dir))
    return docs
