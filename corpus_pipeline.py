"""A corpus pipeline over ``documents``: toxicity, exact copies, near copies, personal data, packing.

Every stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of ``documents``:

1. toxicity: rows that the classifier calls toxic go (fitted on ``labels`` and the table's own rows of its training folds);
2. exact copies: of equal texts the longest original, then the smallest doc_id stays;
3. near copies (SimHash first, then all pairs of a similarity of 0.8 or more over five-word shingles): of each group the longest text, then the smallest doc_id stays;
4. personal data: every span found is masked by its kind in brackets, ``n_chars`` follows the new text;
5. packing: pieces of at most 1024 tokens with their sequence and offset.

Defined cases: null text counts as empty and is kept as null; empty tables give no rows; further columns of ``docs``
pass through stages 1 to 4. :func:`run` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.deploy import ship
from webloom.llm import exact_dedup, near_copies, packing, pii, toxicity
from webloom.llm.common import materialize, small_batches


def ready(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return near_copies.drop_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The classifier and the field can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = stage(spark, rows, sf_dir)
        if name != STAGES[-1][0]:
            rows, _ = materialize(rows, f"stage-{name}")
    return rows
