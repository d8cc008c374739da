"""Documents to training sequences: each stage's rows are written and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import roomtrail.llm.queries  # noqa: F401
from roomtrail.llm import langid, packing, secretscan, simhash
from roomtrail.llm.common import shared_dir, small_batches, table
from roomtrail.llm.registry import OPERATIONS, operation


def language(spark, docs, sf_dir):
    """Documents whose language is told stay. Those without letters go, and those with scores
    at which the model is wrong about too many of the labelled documents, labelled ones too.
    The model starts from a bounded sample and is then fitted on every labelled text, as are
    the scores it is held to."""
    small_batches(spark)
    start = langid.train(langid.sample(docs, "lang", "text", langid.Training()))
    return langid.sure_language(docs, langid.refine(start, docs, "lang", "text"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-copies stays: that of the smallest id."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def secrets(spark, docs, sf_dir):
    """Secrets are replaced in the text; every document stays."""
    return secretscan.redact(docs, repository="doc_id", owner="source", length_col="n_chars")


def pack(spark, docs, sf_dir):
    """Token ids of all documents, packed into sequences of at most 2048."""
    import public_tokenizers as P

    small_batches(spark)
    parts = packing.pieces(docs, P.path("word_bpe_49k.json"))
    return packing.pack(parts.withColumn("ids_crc32", F.crc32("ids")), docs.count())


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("secret_scan", secrets), ("best_fit_packing", pack)]
# The language model and the shingle fingerprints have no SQL form.
ORACLE_SQL = None


@operation("pipeline", ORACLE_SQL)
def run(spark, sf_dir):
    """All stages over ``documents``; every stage but the last is kept as Parquet."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["OPERATIONS", "ORACLE_SQL", "STAGES", "run"]
