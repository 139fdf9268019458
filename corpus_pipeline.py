"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Null and empty texts are scored like others; what stays of them packs as the end id alone. Rows that share a doc_id but
not the text are documents of their own; of rows equal in both one stays from the near-duplicate stage on, and mixing
gives equal rows the most copies that one of them got. A row with a null doc_id is a document of its own, which line
dedup, near duplicates and mixing see under a number above all ids and return with null; that number, and so the draw of the mix,
may differ between runs. Empty tables give no pieces. Further columns of documents, whatever their names, pass
through every stage but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubbub.llm import line_dedup, mixing, packing, quality, setsketch
from hubbub.llm.common import col, free_name, stage, whole_text

#: Documents below this score go.
MIN_SCORE = 0.3

#: Words that a worker remembers for packing: less than packing alone would, as the same workers run all stages.
WORDS = 200_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """docs with a number above all ids for each null doc_id, and the largest id; None if there is no null."""
    if docs.where("doc_id is null").isEmpty():
        return docs, None
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    number = F.lit(most + 1).cast("long") + F.monotonically_increasing_id()
    return stage(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), number)), "numbered"), most


def _unnumbered(rows: DataFrame, most: int | None) -> DataFrame:
    return rows if most is None else rows.withColumn("doc_id", F.when(F.col("doc_id") <= most, F.col("doc_id")))


def _hashed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of the text, which tells rows of one doc_id apart, and that column's name."""
    name = free_name(docs, "text_hash")
    return docs.withColumn(name, F.xxhash64(whole_text(F.col("text")))), name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model, name = quality.fit(docs, labels.where(quality.fold(F.col("doc_id")) != 0)), free_name(docs, "score")
    return quality.score(docs, model, into=name).where(F.col(name) >= MIN_SCORE).select(*map(col, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered, most = _numbered(docs)
    counts = free_name(docs, "lines"), free_name(docs, "dropped")
    kept = line_dedup.apply_bitmaps(numbered, line_dedup.line_bitmaps(numbered, min_points=40, min_docs=5), into=counts)
    return _unnumbered(kept.withColumn("n_chars", F.length("text").cast("long")).select(*map(col, docs.columns)), most)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more."""
    numbered, most = _numbered(docs)
    plan = setsketch.Plan(width=5, percent=80, bands=32, rows=5)
    rows, name = _hashed(numbered)
    first = setsketch.near_duplicates(numbered, plan).where("first").select("doc_id", F.col("text_hash").alias(name)).distinct()
    kept = rows.join(first, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return _unnumbered(kept.select(*map(col, docs.columns)), most)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    numbered, most = _numbered(docs)
    rows, name = _hashed(numbered)
    copies = free_name(rows, "copies")
    taken = mixing.mix(numbered, with_hash=True).groupBy("doc_id", F.col("text_hash").alias(name)).agg(F.max("copies").alias(copies))
    rows = rows.join(taken.where(F.col(copies) > 0), ["doc_id", name]).withColumn(free_name(rows, "copy"), F.explode(F.sequence(F.lit(1), F.col(copies))))
    return _unnumbered(rows.select(*map(col, docs.columns)), most)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), memory=WORDS)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The fitted network and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
