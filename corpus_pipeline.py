"""A corpus pipeline of four stages: toxicity, SimHash near-duplicates, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a table that is written and
read again as the next one's docs. The first three return the columns of documents, whatever they are; names that begin with
`__m_` are the stages' own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metrum.llm import packing, secrets, simhash, toxicity
from metrum.llm.queries import tokenizer
from metrum.llm.shared import materialize
from metrum.session import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; the model is trained on labelled documents among docs. Null and empty texts are
    scored like any other text without words; repeated rows have equal scores, so all of them stay or go; rows without an id
    are scored, but never train."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 3 or fewer bits, the one with the smallest id stays: on a tie (rows of one id) the
    smallest fingerprint, then the smallest hashes of the text; null ids come after all others, and of repeated rows one
    stays. Null and empty texts, and all without words, are one group, so one of them stays."""
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the texts; copied examples and all other text stay. No row goes: null and empty
    texts and repeated rows stay as they are, a null source is the owner '', and rows that share an id each get the spans of
    their own text."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of at most 2048 tokens, one row a piece. A null or empty text is its end mark alone;
    repeated rows are packed each; documents of equal length are interchangeable, so any of them may come first."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: A trained score decides the first stage, which SQL cannot express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
