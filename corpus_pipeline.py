"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vespertide.llm.common import materialize, read_table
from vespertide.llm.decontam import drop_contaminated
from vespertide.llm.linededup import drop_repeated_passages
from vespertide.llm.pieces import digest_rows
from vespertide.llm.simhash import keep_one
from vespertide.llm.toxicity import drop_toxic, learn

PIECE_MODEL = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go."""
    return drop_toxic(docs, learn(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text."""
    return drop_repeated_passages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text."""
    return digest_rows(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Learned scores, seeded fingerprints and tokenizer files aren't SQL. Brute-force tests are those of the operators; the test of the stages looks at columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
