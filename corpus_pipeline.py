"""The corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and the next stage reads it.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewops.llm import decontam, jaccard_join, langid, mix, secret_scan
from reviewops.llm.common import table, text_of, written
from reviewops.session import apply_defaults, ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of ambiguous language go."""
    return langid.identified(docs, langid.train(docs.filter(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (five words, similarity 0.8)."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    done = secret_scan.masked(secret_scan.scan(docs))
    changed = F.size("secret_spans") > 0
    return done.withColumn("n_chars", F.when(changed, F.length(text_of("text")).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of the documents that the mix takes."""
    return mix.mixed(docs).filter("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secrets), ("mixing", mixture)]

#: SQL has no language model, edit matching or component search; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
