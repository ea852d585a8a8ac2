"""A corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, minhash, mixing, pii, toxicity
from quillstone.llm._scratch import Scratch, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(spark: SparkSession, docs: DataFrame, stage: str) -> tuple[DataFrame, str]:
    """A written copy of the documents whose rows each have a key of their own, and the key's name. Ids may be null or repeated, and
    only a written key is the same however often it is read."""
    key = "row"
    while key in docs.columns:
        key += "_"
    return Scratch(spark, stage).keep(docs.withColumn(key, F.monotonically_increasing_id())), key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.3 or more go. The model learns from at most 3000 labelled documents of each class.

    Null and empty texts get the score of a text without evidence; null ids and repeated rows are each judged by their texts; without
    labels, all stay or go by the share of toxic labels, one half if there are none; an empty table stays empty.
    """
    model = toxicity.fit_toxicity(*toxicity.labelled_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", 3000))
    return docs.filter(toxicity.scorer(docs, model)(F.col("text")) < 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (five-word shingles, similarity 0.8), the first, and every row in none.

    Rows count, not ids: of repeated rows one stays, whether or not their id is null. Null and blank texts are in no group and stay.
    An empty table stays empty.
    """
    keyed, key = _keyed(spark, docs, "stage-rows")
    gone = minhash.near_duplicates(keyed, id_col=key, k=5, threshold=0.8).filter("not kept").select(key)
    return keyed.join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half or more of a benchmark item go.

    Each row is judged by its own text: null and blank texts stay, repeated rows stay or go together, rows that share an id need not.
    An empty table, of documents or of the benchmark, changes nothing.
    """
    keyed, key = _keyed(spark, docs, "stage-rows")
    found = decontaminate.contamination(keyed, _table(spark, sf_dir, "benchmark"), id_col=key).select(key).distinct()
    return keyed.join(found, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows.

    All rows stay, null ids and repeated ones among them; null and empty texts stay as they are, with the n_chars null and 0.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document: (doc_id, size, source_size, target, taken).

    All rows stay. Null and blank texts have size 0 and take 0; null sources form one source; repeated rows each count.
    """
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact_personal_data), ("mixing", mix_sources)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
