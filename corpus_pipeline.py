"""The corpus pipeline: language ID, toxicity, near-duplicates, source mix, byte-level BPE.

Each stage gets the documents that the one before kept, and all but the last
return the columns of documents.  ``run`` writes each stage's result as Parquet
to the shared scratch folder and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, neardup, toxicity
from tessella.llm.common import fits, materialize

#: A document stays if one language makes up at least this share of it.
LEAST_SHARE = 0.35
#: A document goes if its toxicity is at least this.
MOST_TOXIC = 0.5


def _keep(docs: DataFrame, judge, condition) -> DataFrame:
    """Rows of ``docs`` that ``judge`` gives results which meet ``condition``; columns of any names pass through."""
    names = docs.columns
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    key, text = (f"_{names.index(c)}" for c in ("doc_id", "text"))
    seen = judge(plain, key=key, text=text, carry=tuple(c for c in plain.columns if c != key))
    return seen.filter(condition).select(*plain.columns).toDF(*names)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; those without a letter, or with no language of weight, go.

    Where no row has a language, nothing is learned and every document goes.
    """
    model = langid.fit(docs)
    good = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)
    return _keep(docs, lambda d, **k: langid.identify(d, model, **k), good)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below MOST_TOXIC, by a model of the labels of these documents.

    Without labels of both kinds among them, nothing is learned and all stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(docs, lambda d, **k: toxicity.score(d, model, spans=False, **k), F.col("score") < MOST_TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; rows with a null id all stay."""
    groups = neardup.group_documents(docs)
    # the ids that go: far fewer than the documents, and written, so that the larger side need not move
    gone = materialize(groups.filter("not kept").select("doc_id").distinct(), "pipeline-gone")
    few = F.broadcast(gone) if fits(gone, neardup.ID_ROWS) else gone
    return docs.join(few, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by the sources' targets; a document taken twice stands twice.

    A null source is a source of its own; null and empty texts have no words and
    go with their source's order; rows with a null id share a place in it.
    """
    return mixing.mix_whole(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's token ids and digests; a null or empty text has no tokens and the digests of no bytes."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language_stage), ("toxicity", toxicity_stage), ("MinHash near-dedup", near_duplicate_stage), ("mixing sources to target weights", mix_stage), ("byte-level BPE encoding and decoding", encode_stage)]

#: The model stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
