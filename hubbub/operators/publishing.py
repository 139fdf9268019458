"""Results that are published as one version, and label versions derived from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(rows: DataFrame) -> Column:
    """Of rows whatever their order: a sum of 64-bit hashes."""
    return F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in rows.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string")


def publish(panels: dict[str, DataFrame], root: str, version: str) -> None:
    """Write several datasets as one version: all panels first, under the version's own folder, then the manifest that
    makes them the current one. Until that last write, and if any panel fails, readers keep the version before. A version
    that has a manifest is never written again; one that was left half done is."""
    spark = next(iter(panels.values())).sparkSession
    if version in published_versions(spark, root):
        raise ValueError(f"version {version} is published already")
    entries = None
    for name, df in panels.items():
        path = f"{root}/panels/{version}/{name}"
        df.write.mode("overwrite").parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
        entry = back.agg(F.lit(name).alias("panel"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), digest(back).alias("digest"))
        entries = entry if entries is None else entries.unionByName(entry)
    # one file: a manifest is there whole or not at all
    entries.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/version={version}")


def _manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """Manifests whose write was finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/manifests")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [f"{s.getPath()}" for s in fs.listStatus(path) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema("panel string, rows long, columns int, digest string, version string").json(done) if done else None


def published_versions(spark: SparkSession, root: str) -> list[str]:
    rows = _manifests(spark, root)
    return [] if rows is None else sorted(r.version for r in rows.select("version").distinct().collect())


def current_manifest(spark: SparkSession, root: str) -> DataFrame:
    """panel, rows, columns, digest, version of the newest version."""
    versions = published_versions(spark, root)
    if not versions:
        raise ValueError(f"nothing is published at {root}")
    return _manifests(spark, root).where(F.col("version") == versions[-1])


def read_panel(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A panel of the newest version; an error if it is not what was published."""
    entry = current_manifest(spark, root).where(F.col("panel") == name).first()
    if entry is None:
        raise ValueError(f"the current version has no panel {name}")
    rows = spark.read.parquet(f"{root}/panels/{entry.version}/{name}")
    found = rows.agg(F.count(F.lit(1)).alias("rows"), digest(rows).alias("digest")).first()
    if (found.rows, found.digest) != (entry.rows, entry.digest):
        raise ValueError(f"panel {name} of version {entry.version} was changed")
    return rows


LABEL = "post_id long, is_cyber boolean, is_canada boolean, is_relevant boolean, topic_key string, entities array<string>, dropped array<string>, derived_chain array<string>"


def derived_labels(labels: DataFrame, checked: DataFrame, source: str) -> DataFrame:
    """Labels of a version with only the entities that stand: home if any is left, relevant if also on the subject, without
    topic. What was dropped joins what earlier steps dropped, and the source joins the chain of derivation.

    labels: LABEL of one version. checked: post_id, entity, fault (NULL if it stands). A post without entities keeps none."""
    faults = checked.groupBy("post_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("fault").isNull(), F.col("entity")))).alias("good"), F.array_sort(F.collect_set(F.when(F.col("fault").isNotNull(), F.col("entity")))).alias("bad")
    )
    none = F.array().cast("array<string>")
    rows = labels.join(faults, "post_id", "left").withColumn("good", F.coalesce("good", none)).withColumn("bad", F.coalesce("bad", none))
    home = F.size("good") > 0
    return rows.select(
        "post_id", "is_cyber", home.alias("is_canada"), (home & F.coalesce("is_cyber", F.lit(False))).alias("is_relevant"), F.lit(None).cast("string").alias("topic_key"), F.col("good").alias("entities"),
        F.concat(F.coalesce("dropped", none), "bad").alias("dropped"), F.concat(F.coalesce("derived_chain", none), F.array(F.lit(source))).alias("derived_chain"),
    )


def write_version(labels: DataFrame, path: str, version: str) -> None:
    """Put a version's labels in place of what the table has of it; other versions stay as they are."""
    rows = labels.withColumn("label_version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label_version").parquet(path)


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.schema(f"{LABEL}, label_version string").parquet(path).where(F.col("label_version") == version).drop("label_version")


def derivation_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: posts, relevant ones, entities dropped in this step, and posts that lost relevance by it."""
    was = before.select("post_id", (F.coalesce("is_cyber", F.lit(False)) & (F.size(F.coalesce("entities", F.array().cast("array<string>"))) > 0)).alias("was"), F.size(F.coalesce("dropped", F.array().cast("array<string>"))).alias("earlier"))
    rows = after.join(was, "post_id")
    return rows.agg(
        F.count(F.lit(1)).alias("posts"), F.count_if("is_relevant").alias("relevant"), F.coalesce(F.sum(F.size("dropped") - F.col("earlier")), F.lit(0)).alias("dropped"), F.count_if(F.col("was") & ~F.col("is_relevant")).alias("lost")
    )
