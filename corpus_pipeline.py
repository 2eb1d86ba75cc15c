"""The corpus pipeline: quality rules, near-duplicate removal, redaction of personal data, mixing and packing.

Each stage works on all that its predecessor kept and returns the columns of the documents, the last one the pieces of
the packed sequences. Null and empty texts fail the quality rules. The near-duplicate stage looks at rows: one that has no
doc_id, or shares it with others, goes only if its own text has a near duplicate that stays. A document that the mix takes more than once appears as often, and is packed as often. Empty tables stay empty, and further
columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import minhash, mixing, packing, pii, quality
from quorumlake.llm.common import broadcast_if_small, documents, materialize, packed, unpacked


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.judge(packed(docs, "text", "lang"), carried=("own_row",)).where("kept").select("own_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five-word shingles and a similarity of 0.8, the one with the least doc_id. Rows whose doc_id doesn't name them alone are numbered after all others."""
    rows = packed(docs, "doc_id", "text")
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = broadcast_if_small(counts.where("doc_id is null or n > 1").select(F.col("doc_id").alias("own_shared")))
    same = F.col("doc_id").eqNullSafe(F.col("own_shared"))
    if not shared.isEmpty():
        after = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
        numbered = rows.join(shared, same, "left_semi").withColumn("doc_id", F.lit(after) + F.monotonically_increasing_id())
        rows = rows.join(shared, same, "left_anti").unionByName(materialize(numbered, "numbered"))
    kept = minhash.near_duplicates(rows).where("kept").select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").select("own_row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind in square brackets; n_chars follows the text."""
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return pii.redact(packed(docs, "text")).select(*unpacked(docs.columns, changed))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(packed(docs, "doc_id", "text", "source"))).select("own_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the boosted trees and the tokenizer; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
