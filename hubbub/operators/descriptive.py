"""Counts that describe a corpus and the aggregates behind its charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.authors import engagement
from hubbub.operators.percentiles import exact_percentiles
from hubbub.operators.trend import days, in_window, instant


def _n():
    return F.count(F.lit(1))


def top(rows: DataFrame, k: int, *order, by: tuple[str, ...] = ()) -> DataFrame:
    """The first k (of each group) in a total order, numbered as place."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def pilot_totals(labelled: DataFrame) -> DataFrame:
    """labelled: posts with the flags of one version; unknown flags count as neither."""
    return labelled.agg(
        _n().alias("posts"), F.count_if("is_relevant").alias("relevant"), F.count_if("is_cyber").alias("cyber"), F.count_if("is_canada").alias("canada"),
        F.countDistinct("author_id").alias("authors"), F.countDistinct(F.when(F.col("is_relevant"), F.col("author_id"))).alias("relevant_authors"),
        F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
    )


def pilot_daily(labelled: DataFrame) -> DataFrame:
    relevant = F.col("is_relevant")
    return labelled.groupBy(F.to_date("published_at").alias("day")).agg(
        _n().alias("posts"), F.count_if(relevant).alias("relevant"), F.countDistinct(F.when(relevant, F.col("author_id"))).alias("relevant_authors"), F.count_if(relevant & F.col("low_info")).alias("relevant_low_info")
    )


def relevant_per_day(daily: DataFrame) -> DataFrame:
    return daily.agg(F.round(F.avg("relevant"), 6).alias("mean"), F.percentile("relevant", 0.5).alias("median"), F.min("relevant").alias("least"), F.max("relevant").alias("most"))


def weekday_profile(daily: DataFrame) -> DataFrame:
    """0 is Monday."""
    return daily.groupBy(F.weekday("day").alias("weekday")).agg(F.round(F.avg("relevant"), 6).alias("mean_relevant"))


def counts_by(posts: DataFrame, *keys) -> DataFrame:
    return posts.groupBy(*keys).agg(_n().alias("posts"), F.countDistinct("author_id").alias("authors"))


def posts_per_author(by_topic: DataFrame) -> DataFrame:
    return by_topic.withColumn("posts_per_author", F.round(F.try_divide("posts", "authors"), 6))


def lag_by_mode(posts: DataFrame, runs: DataFrame) -> DataFrame:
    """mode, mean, median and outer tenths of the hours from publication to collection, and mean likes."""
    rows = posts.join(runs.select("run_id", "mode"), "run_id").withColumn("lag", F.timestamp_diff("SECOND", F.col("published_at"), F.col("collected_at")) / 3600)
    means = rows.groupBy("mode").agg(F.round(F.avg("lag"), 6).alias("mean_lag"), F.round(F.avg("like_count"), 6).alias("mean_likes"))
    ranks = exact_percentiles(rows, ["mode"], "lag", {"p10": 0.1, "median": 0.5, "p90": 0.9}).drop("n")
    return means.join(ranks.select("mode", *(F.round(c, 6).alias(c) for c in ("p10", "median", "p90"))), "mode")


def bad_run_groups(runs: DataFrame) -> DataFrame:
    first_line = F.substring(F.split("detail", "\n")[0], 1, 120)
    rows = runs.where(F.col("status").isin("failed", "partial")).groupBy("mode", "status", first_line.alias("error"))
    rows = rows.agg(_n().alias("runs"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.sum("n_errors").alias("errors"), F.sum("n_fetched").alias("fetched"))
    return top(rows, 1 << 30, F.desc("runs"), "mode", "status", "error")


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("mode", "status").agg(_n().alias("runs"), F.sum("n_errors").alias("errors"))


def source_stats(posts: DataFrame, labels: DataFrame) -> DataFrame:
    rows = posts.join(labels.select("post_id", "is_relevant"), "post_id", "left")
    return rows.groupBy("source_key").agg(_n().alias("posts"), F.count_if("is_relevant").alias("relevant"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


def topic_daily(posts: DataFrame, gate: DataFrame, topics: DataFrame) -> DataFrame:
    """Relevant by one version, topic by another: 'other' for a null topic, '(unlabelled)' where that version has no row."""
    rows = posts.join(gate.where("is_relevant").select("post_id"), "post_id").join(topics.select("post_id", "topic_key", F.lit(True).alias("has")), "post_id", "left")
    topic = F.when(F.col("has").isNull(), "(unlabelled)").otherwise(F.coalesce("topic_key", F.lit("other")))
    return counts_by(rows, F.to_date("published_at").alias("day"), topic.alias("topic"))


def topic_timeseries(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("topic", F.to_date("published_at").alias("day")).agg(_n().alias("posts"), F.countDistinct("author_id").alias("authors"), F.count_if(~F.col("broadcast")).alias("organic_posts"))


def topic_stats(posts: DataFrame) -> DataFrame:
    """Keyed by topic_key itself: a null key is no topic here."""
    rows = posts.where("topic_key is not null")
    out = rows.groupBy("topic_key").agg(
        _n().alias("posts"), F.countDistinct("author_id").alias("authors"), F.count_if("low_info").alias("low_info"), F.sum("like_count").alias("likes"), F.sum("repost_count").alias("reposts"),
        F.countDistinct("lang").alias("langs"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.round(_n() / F.countDistinct("author_id"), 6).alias("posts_per_author"),
    )
    langs = rows.groupBy("topic_key", F.coalesce("lang", F.lit("(unknown)")).alias("lang")).agg(_n().alias("n"))
    langs = top(langs, 5, F.desc("n"), "lang", by=("topic_key",)).groupBy("topic_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "lang"))), lambda x: x["lang"]), ",").alias("top_langs"))
    return out.join(langs, "topic_key")


def compare_periods(posts: DataFrame, as_of: str, w: int) -> DataFrame:
    now, then = in_window(F.col("published_at"), as_of, w), in_window(F.col("published_at"), as_of, w, 1)
    rows = posts.where("topic_key is not null").where(now | then).groupBy("topic_key").agg(
        F.count_if(now).alias("posts"), F.count_if(then).alias("posts_before"), F.countDistinct(F.when(now, F.col("author_id"))).alias("authors"), F.countDistinct(F.when(then, F.col("author_id"))).alias("authors_before")
    )
    growth = F.when(F.col("posts_before") > 0, F.round((F.col("posts") - F.col("posts_before")) / F.col("posts_before"), 6))
    return rows.select("*", growth.alias("growth"), (F.col("authors") - F.col("authors_before")).alias("author_delta"))


def representative_posts(posts: DataFrame, k: int = 5) -> DataFrame:
    """By likes + 2 reposts + replies, a missing count as 0; trimmed for each (topic, day) before the topic's own order."""
    score = F.coalesce("like_count", F.lit(0)) + 2 * F.coalesce("repost_count", F.lit(0)) + F.coalesce("reply_count", F.lit(0))
    rows = posts.where(~F.col("low_info")).select("topic", F.to_date("published_at").alias("day"), "post_id", "author_id", score.alias("engagement"))
    for by in (("topic", "day"), ("topic",)):
        rows = top(rows, k, F.desc("engagement"), "post_id", by=by)
    return rows.drop("day")


def diverse_posts(posts: DataFrame, k: int = 5, authors: int = 3) -> DataFrame:
    """representative_posts with at least `authors` authors where there are as many: an author's first post ranks with
    the leaders until enough authors are in."""
    score = F.coalesce("like_count", F.lit(0)) + 2 * F.coalesce("repost_count", F.lit(0)) + F.coalesce("reply_count", F.lit(0))
    rows = posts.where(~F.col("low_info")).select("topic", "post_id", "author_id", score.alias("engagement"))
    rows = top(rows, k, F.desc("engagement"), "post_id", by=("topic", "author_id")).withColumnRenamed("place", "nth")
    first = top(rows.where("nth = 1"), authors, F.desc("engagement"), "post_id", by=("topic",)).select("topic", "post_id", F.lit(True).alias("first"))
    rows = rows.join(first, ["topic", "post_id"], "left")
    return top(rows, k, F.coalesce("first", F.lit(False)).desc(), F.desc("engagement"), "post_id", by=("topic",)).select("topic", "post_id", "author_id", "engagement", "place")


def labelled_through(posts: DataFrame, labels: DataFrame, coverage: float = 0.9, days: int = 7) -> DataFrame:
    """The last day with enough labels; the days since..until (exclusive) that end with it, and where as many before them start."""
    rows = posts.join(labels.where("is_cyber is not null").select("post_id", F.lit(1).alias("seen")), "post_id", "left")
    daily = rows.groupBy(F.to_date("published_at").alias("day")).agg((F.count("seen") / _n()).alias("share"))
    row = daily.agg(F.max(F.when(F.col("share") >= coverage, F.col("day"))).alias("through"), F.round(F.min("share"), 6).alias("lowest"))
    ago = lambda n: F.date_sub("through", n)
    return row.select("*", ago(-1).alias("until"), ago(days - 1).alias("since"), ago(2 * days - 1).alias("before_since"))


def topic_split(flagged: DataFrame) -> DataFrame:
    organic = ~F.col("broadcast")
    return flagged.groupBy("topic").agg(_n().alias("raw"), F.count_if(organic).alias("organic"), F.countDistinct("author_id").alias("raw_authors"), F.countDistinct(F.when(organic, F.col("author_id"))).alias("organic_authors"))


def trajectory(flagged: DataFrame) -> DataFrame:
    rows = flagged.groupBy("topic", F.to_date("published_at").alias("day")).agg(_n().alias("raw"), F.count_if(~F.col("broadcast")).alias("organic"), F.countDistinct("author_id").alias("authors"))
    return rows.withColumn("share", F.round(F.col("raw") / F.sum("raw").over(W.partitionBy("day")), 6))


def week_heatmap(flagged: DataFrame, least: int = 4) -> DataFrame:
    """Monday weeks without broadcast; the first and last are dropped if there are more than two."""
    rows = flagged.where(~F.col("broadcast")).groupBy(F.to_date(F.date_trunc("week", "published_at")).alias("week"), "topic").agg(_n().alias("n"))
    ends = F.broadcast(rows.agg(F.min("week").alias("a"), F.max("week").alias("b"), F.countDistinct("week").alias("weeks")))
    rows = rows.withColumn("total", F.sum("n").over(W.partitionBy("week"))).crossJoin(ends)
    rows = rows.where((F.col("weeks") <= 2) | ((F.col("week") > F.col("a")) & (F.col("week") < F.col("b")))).where(F.col("total") >= least)
    return rows.select("week", "topic", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def actor_topic_edges(flagged: DataFrame) -> DataFrame:
    rows = flagged.groupBy("author_id", "topic").agg(_n().alias("weight"), F.sum(engagement()).alias("engagement"), F.bool_or("broadcast").alias("broadcast"))
    return rows.withColumn("topics", F.count(F.lit(1)).over(W.partitionBy("author_id")))


def lorenz_gini(counts: DataFrame, by: str) -> DataFrame:
    """counts: `by`, n. Gini of the positive n, from the histogram of values: no row is ranked on its own."""
    bins = counts.where("n > 0").groupBy(by, "n").agg(_n().alias("c"))
    so_far = W.partitionBy(by).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = bins.withColumn("before", F.coalesce(F.sum("c").over(so_far), F.lit(0)))
    # the sum of i * n_i over ranks i = before + 1 .. before + c
    ranked = F.sum(F.col("n") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2))
    rows = rows.groupBy(by).agg(F.sum("c").alias("actors"), F.sum(F.col("n") * F.col("c")).alias("total"), ranked.alias("ranked"))
    return rows.select(by, "actors", "total", F.round(2 * F.col("ranked") / (F.col("actors") * F.col("total")) - (F.col("actors") + 1) / F.col("actors"), 6).alias("gini"))


def gaps(posts: DataFrame, since: str, until: str) -> DataFrame:
    """Days of [since, until) without posts."""
    grid = posts.sparkSession.range(1).select(F.explode(F.sequence(instant(since).cast("date"), F.date_sub(instant(until).cast("date"), 1), F.expr("interval 1 day"))).alias("day"))
    return grid.join(posts.select(F.to_date("published_at").alias("day")).distinct(), "day", "left_anti")


def plan_windows(spans: DataFrame, chunk_days: int) -> DataFrame:
    """spans: since, until. Contiguous pieces of [since, until), the last one short."""
    step = F.make_dt_interval(F.lit(chunk_days))
    rows = spans.where("since < until").select("*", F.explode(F.sequence("since", F.col("until") - F.expr("interval 1 microsecond"), step)).alias("start"))
    return rows.select("since", "until", "start", F.least(F.col("start") + days(chunk_days), "until").alias("stop"))
