"""The corpus pipeline: five stages over ``documents``, each written and read again.

Counted as part of the subpackage ``quillon.llm``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, jaccard, langid, mixing, pii
from quillon.llm.store import deleted, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: words in a shingle and similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
#: Least posterior of the predicted language.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters or without a language that is likelier than all others; no rows give no rows."""
    return langid.identified(docs.select(*COLUMNS), langid.fit(docs), SURE).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of linked documents one, that of the least doc_id; rows without words stay."""
    return jaccard.without_near_duplicates(docs.select(*COLUMNS), SHINGLE, SIMILAR)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item, as it is or with other parameters."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs.select(*COLUMNS), items)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; every document stays."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many it takes (up to three times all) and their source's target."""
    taken = mixing.mixed(docs.select(*COLUMNS)).where("taken > 0")
    return taken.select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("language identification", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("personal data", redact_personal_data),
    ("mixing to target weights", mix_sources),
]
#: Learned models and connected components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before has kept.

    An empty table runs through all stages and gives an empty result. What a stage has
    written is deleted when the next one has read it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if before:
            deleted(spark, before)
        before = f"{folder}/{k}"
    return docs
