"""Coded conversation units, seed populations and the metric chosen for a vulnerability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values
CONVERSING = ("substantive_reply", "information_seeking", "information_providing", "discussion_or_reaction")
COLLECTIVE = ("organizational_broadcast", "news_media")

_METRIC = "array<struct<cvssData: struct<baseScore: double, baseSeverity: string>, baseSeverity: string>>"
_RECORD = f"metrics struct<cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>, descriptions array<struct<lang: string, value: string>>"


def human_signal(units: DataFrame) -> DataFrame:
    """units with signal (1 conversing, 0 distributing, NULL unclear) and person_signal, which leaves open what
    organisations and media say in a conversation."""
    main = F.when(F.col("role") == "automated_feed", 0).when(F.col("function") == "broadcast_or_repost", 0).when(F.col("function").isin(*CONVERSING), 1)
    rows = units.withColumn("signal", main)
    return rows.withColumn("person_signal", F.when(F.col("role").isin(*COLLECTIVE) & (F.col("signal") == 1), None).otherwise(F.col("signal")))


def signal_summary(signals: DataFrame, by: str) -> DataFrame:
    """Both signals by a column; the unclear share stands beside them and is in neither count."""
    counts = [x for c in ("signal", "person_signal") for x in (
        F.count_if(F.col(c) == 1).alias(f"{c}_1"), F.count_if(F.col(c) == 0).alias(f"{c}_0"), F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"{c}_na_share"),
    )]
    return signals.groupBy(by).agg(F.count(F.lit(1)).alias("units"), *counts)


def best_cvss(records: DataFrame, body: str) -> DataFrame:
    """The newest scoring version of a record's JSON and its first English description. Version 2 has its severity beside
    the data, not in it. NULLs where the body has none or is no JSON."""
    first = lambda c: F.get(F.col(f"r.metrics.{c}"), F.lit(0))
    pick = lambda version, c, severity: F.when(first(c).isNotNull(), F.struct(F.lit(version).alias("version"), first(c)["cvssData"]["baseScore"].alias("score"), severity(first(c)).alias("severity")))
    inside, beside = lambda m: m["cvssData"]["baseSeverity"], lambda m: m["baseSeverity"]
    chosen = F.coalesce(pick("3.1", "cvssMetricV31", inside), pick("3.0", "cvssMetricV30", inside), pick("2.0", "cvssMetricV2", beside))
    english = F.get(F.filter("r.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    rows = records.withColumn("r", F.from_json(body, _RECORD)).withColumn("m", chosen).withColumn("description", english)
    return rows.select(*[c for c in records.columns if c != body], "m.version", "m.score", "m.severity", "description")


def seed_populations(main: DataFrame, legacy: DataFrame, rules: DataFrame, faults: DataFrame, provenance: DataFrame) -> DataFrame:
    """seed_id, in_main, in_legacy, in_rules, derived_chain, provenance_status, annotation_run, prompt_hash, model and
    exclusion_reason of every post that the legacy or the rule version calls relevant, also where the legacy version has no
    label at all.

    main, legacy, rules: post_id, is_relevant; main also derived_chain (array) and `step`, its own version. The run, prompt and
    model are those of the first link of the chain. A post that only the rules found has none. A legacy post that the main
    version lost tells by which faults. faults: post_id, fault. provenance: post_id, label_version, prompt_sha256, model_id,
    recorded_at."""
    flag = lambda d, name: d.select(F.col("post_id").alias("seed_id"), F.col("is_relevant").alias(name))
    rows = flag(legacy, "in_legacy").join(flag(rules, "in_rules"), "seed_id", "full")
    rows = rows.where(F.coalesce("in_legacy", F.lit(False)) | F.coalesce("in_rules", F.lit(False)))
    chained = main.select(F.col("post_id").alias("seed_id"), F.col("is_relevant").alias("in_main"), F.concat("derived_chain", F.array("step")).alias("chain"))
    rows = rows.join(chained, "seed_id", "left").fillna(False, ["in_main", "in_legacy", "in_rules"])
    why = faults.where("fault is not null").select("post_id", "fault").distinct().groupBy(F.col("post_id").alias("seed_id")).agg(F.array_join(F.array_sort(F.collect_list("fault")), "+").alias("why"))
    heads = provenance.select(F.col("post_id").alias("seed_id"), F.col("label_version").alias("head"), "prompt_sha256", "model_id", "recorded_at")
    rows = rows.withColumn("head", F.get("chain", F.lit(0))).join(heads, ["seed_id", "head"], "left").join(why, "seed_id", "left")
    judged = F.col("in_main") | F.col("in_legacy")
    status = F.when(~judged, "deterministic_rules").when(F.size("chain") > 2, "derived_validated").otherwise("direct_then_validated")
    run = F.concat_ws("@", F.when(F.col("recorded_at").isNotNull(), F.col("head")), F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss"))
    lost = F.when(F.col("in_legacy") & ~F.col("in_main"), F.concat(F.lit("failed_check:"), F.coalesce("why", F.lit(""))))
    return rows.select(
        "seed_id", "in_main", "in_legacy", "in_rules", F.array_join("chain", ">").alias("derived_chain"), status.alias("provenance_status"), F.when(judged, run).alias("annotation_run"),
        F.when(judged, F.col("prompt_sha256")).alias("prompt_hash"), F.when(judged, F.col("model_id")).alias("model"), lost.alias("exclusion_reason"),
    )


def population_overlaps(populations: DataFrame) -> DataFrame:
    """How many seeds are in which of the populations."""
    return populations.groupBy("in_main", "in_legacy", "in_rules").agg(F.count(F.lit(1)).alias("seeds"))
