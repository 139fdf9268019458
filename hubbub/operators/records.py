"""What is written down of an analysis, a seed list or a coding round, and comparisons between runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def persist_analysis(candidates: DataFrame, order: list[str], as_of: str, params: dict, path: str) -> None:
    """Append one row: as_of, params and all candidates in order (one a topic), both as JSON."""
    top = candidates.withColumn("place", F.row_number().over(W.orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("place", *candidates.columns)))
    record = top.agg(F.to_json(rows).alias("candidates")).select(F.lit(as_of).alias("as_of"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), "candidates")
    record.write.mode("append").parquet(path)


def read_analysis(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each candidate of each record. schema: of one candidate."""
    rows = spark.read.parquet(path)
    return rows.select("as_of", "params", F.explode(F.from_json("candidates", f"array<struct<{schema}>>")).alias("c")).select("as_of", "params", "c.*")


def _line_sum(rows: DataFrame) -> Column:
    """A digest of the rows whatever their order: the sum of 60 bits of each one's SHA-256."""
    line = F.to_csv(F.struct(*(F.col(c).cast("string") for c in rows.columns)))
    return F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest")


def manifest_checks(rows: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """One row: rows, repeated keys, members of each flag and a digest."""
    counts = [F.count_if(F.col(f)).alias(f) for f in flags]
    return rows.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated"), *counts, _line_sum(rows))


def freeze_manifest(rows: DataFrame, path: str, key: str, flags: list[str]) -> None:
    """Write a list once: an existing path and repeated keys are errors. The checks are written beside it."""
    checks = manifest_checks(rows, key, flags)
    if (repeated := checks.first().repeated) > 0:
        raise ValueError(f"{repeated} rows repeat a {key}")
    rows.write.mode("errorifexists").option("header", True).csv(f"{path}/rows")
    checks.write.mode("errorifexists").json(f"{path}/checks")


def load_manifest(spark: SparkSession, path: str, schema: str, key: str, flags: list[str]) -> DataFrame:
    """The list again; an error if it is not what was frozen."""
    rows = spark.read.schema(schema).option("header", True).csv(f"{path}/rows")
    frozen, now = spark.read.json(f"{path}/checks").first().asDict(), manifest_checks(rows, key, flags).first().asDict()
    if {k: str(v) for k, v in frozen.items()} != {k: str(v) for k, v in now.items()}:
        raise ValueError(f"{path} was changed: {now} instead of {frozen}")
    return rows


def page_size_diff(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Quote and repost keys of two runs with other page sizes, over the seeds that the second run visited."""
    rows = edges.where(F.col("edge_type").isin("quote", "repost") & F.col("run_id").isin(a, b))
    rows = rows.join(edges.where(F.col("run_id") == b).select("seed_id").distinct(), "seed_id", "left_semi")
    rows = rows.groupBy("edge_type", "seed_id", "actor").agg(F.bool_or(F.col("run_id") == a).alias("x"), F.bool_or(F.col("run_id") == b).alias("y"))
    return rows.groupBy("edge_type").agg(
        F.count_if("x").alias("keys_a"), F.count_if("y").alias("keys_b"), F.count_if(F.expr("x and not y")).alias("only_a"), F.count_if(F.expr("y and not x")).alias("only_b")
    )


def corpus_quote_edges(posts: DataFrame, raw: str) -> DataFrame:
    """quoting, quoted: posts of the corpus that embed another one of it, directly or within another record."""
    uri = F.coalesce(F.get_json_object(raw, "$.embed.record.uri"), F.get_json_object(raw, "$.embed.record.record.uri"))
    rows = posts.select(F.col("post_id").alias("quoting"), uri.alias("uri")).where("uri is not null")
    return rows.join(posts.select("uri", F.col("post_id").alias("quoted")), "uri").select("quoting", "quoted")


def topic_coding_eval(gold: DataFrame, labels: DataFrame) -> DataFrame:
    """One row. gold: post_id, code (MISS_ and the topic that rules missed, NEW_ and a topic that does not exist, FP, others).
    labels: post_id, topic, off_topic. Recall on what was missed, restraint on what is new, alarms, and the harmonic mean."""
    rows = gold.join(labels, "post_id")
    code = F.col("code")
    miss, new, fp = code.startswith("MISS_"), code.startswith("NEW_"), code == "FP"
    right, other = F.col("topic") == F.substring(code, 6, 1 << 20), F.col("topic") == "other"
    off = F.coalesce("off_topic", F.lit(False))
    out = rows.agg(
        F.count_if(miss).alias("missed"), F.count_if(miss & right).alias("hit"), F.count_if(miss & other).alias("left_other"), F.count_if(new).alias("new"), F.count_if(new & other).alias("kept"),
        F.count_if(fp).alias("fp"), F.count_if(fp & off).alias("flagged"), F.count_if(~fp).alias("others"), F.count_if(~fp & off).alias("alarms"),
    )
    share = lambda a, b: F.try_divide(a, b)
    recall, restraint = share("hit", "missed"), share("kept", "new")
    names = {"recall": recall, "restraint": restraint, "flag_recall": share("flagged", "fp"), "alarm_rate": share("alarms", "others")}
    mean = F.try_divide(2 * recall * restraint, recall + restraint)
    return out.select("*", *(F.round(v, 6).alias(k) for k, v in names.items()), F.round(mean, 6).alias("harmonic_mean"))


def annotation_units(facts: DataFrame, edges: DataFrame, posts: DataFrame) -> DataFrame:
    """unit (post id), kind, seed_id, text, context (the text answered or quoted) and the seed's stratum, high from the median
    of its interactions on. A post is one unit: as a seed before a reply before a quote, then of the smallest seed.

    facts: seed_id, d1, quotes of observed seeds. edges: edge_no is the id of the post that replies or quotes."""
    size = F.col("d1") + F.col("quotes")
    middle = F.broadcast(facts.agg(F.percentile(size, F.lit(0.5)).alias("middle")))  # one row
    strata = facts.crossJoin(middle).select("seed_id", F.when(size >= F.col("middle"), "high").otherwise("low").alias("stratum"))
    none = F.lit(None).cast("long")
    units = facts.select(F.col("seed_id").alias("unit"), F.lit("seed").alias("kind"), F.lit(0).alias("nth"), "seed_id", none.alias("parent"))
    kind = F.when(F.col("edge_type") == "quote", "quote").when(F.col("depth") == 1, "reply_1").otherwise("reply_2")
    nth = F.when(kind == "reply_1", 1).when(kind == "reply_2", 2).otherwise(3)
    made = edges.where("edge_type in ('reply', 'quote')").select(F.col("edge_no").alias("unit"), kind.alias("kind"), nth.alias("nth"), "seed_id", F.col("target_id").alias("parent"))
    rows = units.unionByName(made.join(facts.select("seed_id"), "seed_id", "left_semi").select(units.columns))
    best = F.min(F.struct("nth", "seed_id", "kind", "parent")).alias("b")
    rows = rows.groupBy("unit").agg(best).select("unit", "b.kind", "b.seed_id", "b.parent").join(strata, "seed_id")
    texts = lambda a, b: posts.select(F.col("post_id").alias(a), F.col("text").alias(b))
    rows = rows.join(texts("unit", "text"), "unit").join(texts("parent", "context"), "parent", "left")
    return rows.select("unit", "kind", "seed_id", "text", "context", "stratum")
