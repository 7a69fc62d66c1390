"""From documents to packed sequences: language, toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm import jaccard, langid, packing, suffix, toxicity
from sorbus.llm.common import prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURE = 0.5  # share of the network's probability that a document's language needs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts, texts without a letter, and those of which the network
    gives no language SURE of its pooled probability."""
    out = langid.predict(docs.select(*COLUMNS), langid.learn(table(spark, sf_dir, "documents")))
    return out.where(f"lang_pred != 'und' and lang_score >= {SURE}").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.7").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of repeated rows with that id, the first by text.

    A document without words is in no group and stays; one without an id goes.
    """
    keep = jaccard.jaccard_groups(docs, 5, 80).where("component_id = doc_id").select("doc_id").distinct()
    rest = COLUMNS[1:]
    first = docs.join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r"))
    return first.select("doc_id", *[f"r.{c}" for c in rest])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 100 bytes and more that start earlier are removed; characters cut in two go.

    A null text stays null where nothing is removed from it; an emptied document stays, with an empty text.
    """
    out = suffix.remove_repeats(docs.select(*COLUMNS), as_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.with_digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared checkpoint folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
