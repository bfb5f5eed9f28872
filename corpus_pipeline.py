"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``. What a stage has put in the shared folder is
deleted when the next stage begins, as nothing reads it any more then.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainframe.llm import common, kneser_ney, mixing, packing, simhash, suffix_dedup
from trainframe.llm.tokens import default_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GROUP = "pipeline"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model keeps: none without text or over their language's perplexity."""
    common.release(spark, GROUP)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.judge(docs.select(COLUMNS), labels, group=GROUP).where("kept").select(COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the group's smallest id; rows without an id stand behind those that have one.

    Rows that share an id, or have none, are documents of their own, told apart by ``_row``.
    """
    common.release(spark, GROUP)
    rows = suffix_dedup.ordered(docs.select(COLUMNS), GROUP)
    rows = rows.withColumn("_row", F.when(F.col("doc_id").isNull(), F.col("_row") + F.lit(1 << 61)).otherwise(F.col("_row")))
    found = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), group=GROUP)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return rows.join(keep, "_row").select(COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what starts earlier too; characters that a span cuts go with it, and texts left blank go."""
    common.release(spark, GROUP)

    def remove(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if spans and text is not None:
                    runs = suffix_dedup.merged([(s["first"], s["end"]) for s in spans])
                    ends = zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)], strict=True)
                    text = "".join(text[a:b].decode(errors="ignore") for a, b in ends).encode()
                texts.append(text)
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            chars = pa.array([None if t is None else len(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2), batch.column(3), chars], COLUMNS)

    cut = suffix_dedup.with_spans(docs.select(COLUMNS), group=GROUP).select(*COLUMNS, "_spans")
    types = dict(cut.dtypes)
    out = cut.withColumn("n_chars", F.col("n_chars").cast("long")).mapInArrow(common.trimmed(remove), ", ".join(f"{c} {'long' if c == 'n_chars' else types[c]}" for c in COLUMNS))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none, once or twice."""
    common.release(spark, GROUP)
    mixed = mixing.mix(docs.select(COLUMNS), group=GROUP)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids, a row for each piece with its ids."""
    common.release(spark, GROUP)
    return packing.pack(docs, default_tokenizer(), 2, group=GROUP)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Perplexity, components and tokens are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name.replace(" ", "-"), "pipeline-stages")
    return docs
