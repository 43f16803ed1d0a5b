"""From raw documents to token ids: rules, classifier, near duplicates, mixing, encoding.

Each stage reads all that the one before kept, written as Parquet; all but the last return
the columns of ``documents`` as they are, further columns with any names too. A null or empty text fails the
rules and goes; a null language or source is one of its own; a null doc_id is kept, as near duplicates are told by id;
rows that repeat an id and a text are judged alike, and all stay or go; an empty table gives empty results in
every stage; texts of any length are read whole. For the rest see the operators, whose defined results hold here.
Learned parts are fitted on what reaches their stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import bpe, jaccard, mixing, quality_model, quality_rules
from noticeflow.llm.common import fresh, table, written
from noticeflow.llm.queries import THRESHOLD, tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    *counts, kept, failed = fresh(docs.columns, *quality_rules.COUNTS, "kept", "base_failed")
    return quality_rules.apply_rules(docs, out=tuple(counts), kept=kept, failed=failed).where(F.col(kept)).select(*docs.columns)


def quality_model_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stats, score = fresh(docs.columns, "stats", "score")
    # without the texts, which scratch tables would hold once more until the run's end: those are measured again as they are scored
    measured = written(quality_model.statistics(docs.select("doc_id", "text"), out=stats), "stats")
    model = quality_model.fit(measured, table(spark, sf_dir, "labels"), column=stats)
    return quality_model.score(docs, model, text="text", out=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs, percent=75).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, exponent=0.7, epochs=1.0, seed="mix-1", copy=None, order=None).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) of each row."""
    tokenizer = bpe.load(spark, tokenizer_path())
    coded = bpe.recode(docs.select("doc_id", "lang", "source", "text"), tokenizer)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_model", quality_model_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can express neither the estimates of the first stage, nor the classifier, nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
