"""A training corpus from documents: language ID, near-duplicate removal, mixing, packing.

Every stage is (name, function of (spark, docs, sf_dir)) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import langid, mixing, ngramjoin, packing
from roadloom.llm.shared import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language is less likely than this is rejected, as is one without letters.
LEAST_SCORE = 0.3
#: Up to so many removed rows are broadcast to the scan that drops them.
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in one of the learned languages; null texts and those without a letter go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    said = langid.predict(docs.select(*COLUMNS), model)
    return said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, one row stays: the smallest by doc_id (null is last), then by hash of id and text.

    Rows are told apart by id and text together, so repeated and null ids are decided
    like others. Rows that agree in both are one document.
    """
    groups = stash(ngramjoin.ngram_join(docs.select("doc_id", "text"), n=5, num=80, den=100, rows=True), "near-duplicates")
    least_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = groups.where(least_id).groupBy("group_id").agg(F.min("row_id").alias("stays"), F.count("*").alias("n")).where("n > 1")
    several = stash(several.select("group_id", "stays"), "near-duplicates-several")
    later = groups.where(least_id).join(several, "group_id").where("row_id <> stays").select("row_id")
    gone = groups.where(~least_id).select("row_id").unionByName(later).distinct()
    few = gone.count() <= BROADCAST_IDS
    rows = docs.select(*COLUMNS).withColumn("row_id", ngramjoin.row_identity())
    kept = rows.join(F.broadcast(gone) if few else gone, "row_id", "left_anti")
    if several.limit(1).count():
        # they may have copies
        stays = several.select(F.col("stays").alias("row_id"))
        once = kept.join(stays, "row_id", "left_semi").groupBy("row_id").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("row_id", "d.*")
        kept = kept.join(stays, "row_id", "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents are left out, taken or repeated, always whole.

    A null source is a source; a document without words, or of a source without any, has
    nothing to give and goes. Null and repeated ids and repeated rows each count. n_chars becomes the text's length.
    """
    drawn = mixing.draw_rows(mixing.mix(docs.select(*COLUMNS), whole=True))
    return drawn.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, bucket, padded_size, batch, batch_docs_max of every row, those with null or repeated ids as well; a null text has size 0."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Language ID learns a model, which SQL cannot; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
