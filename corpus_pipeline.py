"""From raw documents to a training mix: five stages, each written and read again.

Stages take (spark, docs, folder) and give documents with the columns of
`documents`; the last gives the mix. `run` applies them to the documents of a
folder. What a stage drops or rewrites is gone for the later ones.

Null texts, which have no words, are dropped by the first stage. Null ids are
kept by the filters that cannot tell such rows apart. An empty table passes
through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonecast.llm import decontam, mixing, pii, rules, setjoin
from zonecast.llm.base import documents
from zonecast.session import checkpointed
from zonecast.sources import tables


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group linked by 0.8 of five-word shingles: the one with the smallest id."""
    return setjoin.first_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean_of(spark, docs, tables.table(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with the number of copies that the mix takes; those it takes none of are left out."""
    mixed = mixing.mix(spark, docs)
    return mixed.where("copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: Entropy balancing cannot be written in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(spark, docs)
    return docs
