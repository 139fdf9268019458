"""Answers of a model about posts: reading, checking against the text, deriving labels. The model itself is not called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ANSWER = "topic string, confidence string, rationale string, off_topic boolean"


def parse_verdict(answers: DataFrame, topics: list[str]) -> DataFrame:
    """answers: post_id, answer. Broken JSON is searched for its fields; a missing or unknown topic is an error, never a guess."""
    read = F.from_json("answer", _ANSWER)
    found = lambda f: F.nullif(F.regexp_extract(F.coalesce("answer", F.lit("")), rf'"{f}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    rows = answers.select("post_id", F.coalesce(read["topic"], found("topic")).alias("topic"), F.coalesce(read["confidence"], found("confidence")).alias("said"), F.coalesce(read["rationale"], F.lit("")).alias("rationale"), F.coalesce(read["off_topic"], F.lit(False)).alias("off_topic"))
    error = F.when(F.col("topic").isNull(), "no_topic").when(~F.col("topic").isin(*topics), "unknown_topic")
    level = F.when(F.col("said").isin("high", "medium", "low"), F.col("said")).otherwise("low")
    return rows.select("post_id", F.when(error.isNull(), F.col("topic")).alias("topic"), level.alias("confidence"), "rationale", "off_topic", error.alias("error"))


def topic_relabel(base: DataFrame, verdicts: DataFrame, version: str) -> DataFrame:
    """Topics from verdicts without error; relevance is inherited, other becomes NULL."""
    sure = F.when(F.col("confidence") == "high", 0.9).when(F.col("confidence") == "medium", 0.6).otherwise(0.3)
    rows = base.drop("topic_key", "label_version").join(verdicts.where("error is null"), "post_id")
    return rows.select("post_id", F.lit(version).alias("label_version"), "is_cyber", "is_canada", "is_relevant", F.nullif("topic", F.lit("other")).alias("topic_key"), sure.alias("confidence"), "off_topic")


def entity_fault(text: Column, entity: Column, kind: Column, suffix: str) -> Column:
    """NULL for an entity that stands; else why it does not."""
    there = F.contains(text, entity) | F.contains(F.lower(text), F.lower(entity))
    return F.when(~F.coalesce(there, F.lit(False)), "not_in_text").when((kind == "domain") & ~F.endswith(F.lower(entity), F.lit(suffix)), "wrong_suffix")


def validate_entities(entities: DataFrame, posts: DataFrame, suffix: str) -> DataFrame:
    return entities.join(posts.select("post_id", "text"), "post_id").withColumn("fault", entity_fault(F.col("text"), F.col("entity"), F.col("kind"), suffix)).drop("text")


def post_entities(entities: DataFrame, posts: DataFrame) -> DataFrame:
    """One row for a post, version and entity, with its offset: as written, else in lower case, else -1."""
    at = F.instr(F.col("text"), F.col("entity"))
    offset = F.when(at > 0, at - 1).otherwise(F.instr(F.lower("text"), F.lower("entity")) - 1)
    return entities.join(posts.select("post_id", "text"), "post_id").groupBy("post_id", "label_version", "entity").agg(F.min("kind").alias("kind"), F.min(offset).alias("offset"), F.min(F.lower("entity")).alias("canonical"))


def tri_state_gate(posts: DataFrame, valid: DataFrame, judged: DataFrame) -> DataFrame:
    """Home if any valid entity; an unjudged post keeps a NULL flag and is not relevant."""
    home = valid.select("post_id").distinct().withColumn("home", F.lit(True))
    rows = posts.select("post_id").join(home, "post_id", "left").join(judged.select("post_id", "is_cyber"), "post_id", "left")
    home = F.coalesce("home", F.lit(False))
    return rows.select("post_id", "is_cyber", home.alias("is_canada"), (home & F.coalesce("is_cyber", F.lit(False))).alias("is_relevant"))


def screen_candidates(posts: DataFrame, labels: DataFrame, min_length: int = 40) -> DataFrame:
    """Posts that a version rejected and that are long enough to look at again."""
    return posts.where(F.length("text") > min_length).join(labels.where("not is_canada").select("post_id"), "post_id", "left_semi").select("post_id", F.length("text").alias("n"))


def entity_trend(valid: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mentions, authors, topics and the five entities most often in the same posts, joined by commas, of each entity."""
    rows = valid.select("post_id", F.lower("entity").alias("entity")).distinct().join(relevant.select("post_id", "author_id", "topic"), "post_id")
    each = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("author_id").alias("authors"), F.array_sort(F.collect_set("topic")).alias("topics"))
    met = rows.groupBy("post_id").agg(F.collect_set("entity").alias("met")).where("size(met) > 1")  # those of one post
    pairs = met.select(F.explode("met").alias("entity"), "met").select("entity", F.explode(F.array_remove("met", F.col("entity"))).alias("other")).groupBy("entity", "other").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("n"), "other"))
    most = pairs.withColumn("place", place).where("place <= 5").groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]), ",").alias("co_entities"))
    return each.join(most, "entity", "left")


def topic_entities(valid: DataFrame, relevant: DataFrame) -> DataFrame:
    rows = valid.select("post_id", "kind", F.lower("entity").alias("entity")).distinct().join(relevant.select("post_id", "topic"), "post_id")
    return rows.groupBy("topic", "kind", "entity").agg(F.count(F.lit(1)).alias("posts"))
