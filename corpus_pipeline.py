"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of
``documents``; the last writes token ids and returns their index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearken.llm.common import stored, table
from hearken.llm.decontaminate import drop_contaminated
from hearken.llm.language import fit_languages, keep_identified
from hearken.llm.mixing import mixed_documents
from hearken.llm.neardup import keep_one_of_each
from hearken.llm.tokenfile import encode_documents, read_tokens, token_index, write_tokens
from hearken.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those without letters or language go."""
    return keep_identified(docs, fit_languages(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 on 5-word shingles)."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' parts that meet the sources' target weights."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC, as an index of the documents read back from it."""
    path = scratch_path(spark, "tokens.orc")
    write_tokens(encode_documents(docs), path)
    return token_index(read_tokens(spark, path))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
#: Language mixtures and tokenizers have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
