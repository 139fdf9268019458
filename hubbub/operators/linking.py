"""Registry events and the posts that name them: names and domains, evaluation sets, hits in a second corpus, who was first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.events import rarest_key
from hubbub.operators.keyfilter import admitted, key_bits

BEFORE, AFTER = 2, 30


def flat(text: Column) -> Column:
    """Words of letters and digits in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def named(text: Column, canonical: Column, is_domain: Column) -> Column:
    """Whether a text names an entity: a name as whole words, a domain with its dots, neither as a part of a longer word."""
    words = F.concat(F.lit(" "), flat(text), F.lit(" "))
    literal = F.regexp_replace(canonical, r"([^a-z0-9_])", r"\\$1")
    pattern = F.concat(F.lit(r"(^|[^a-z0-9_])"), literal, F.lit(r"($|[^a-z0-9_])"))
    return F.when(is_domain, F.regexp_like(F.lower(text), pattern)).otherwise(F.contains(words, F.concat(F.lit(" "), canonical, F.lit(" "))))


def name_matches(posts: DataFrame, entities: DataFrame, days: tuple[int, int] | None = None) -> DataFrame:
    """post_id, event_id, canonical, is_domain, delta (whole days from the event to the post, towards the past), within `days`
    if given.

    posts: post_id, text, published_at. entities: event_id, canonical, is_domain, at. Each entity is known by its rarest word,
    also a domain. A filter of these words is tested on each post before its words are exploded; what passes meets the
    entities by an equal join, with ids and times only. The text is fetched for hits and compared in full."""
    wanted = entities.select("event_id", "canonical", "is_domain", "at").where("canonical is not null and at is not null").distinct()
    keyed = rarest_key(wanted, F.filter(F.split(F.regexp_replace("canonical", r"[^a-z0-9]+", " "), " "), lambda w: w != ""))
    tokens = admitted(F.array_distinct(F.split(flat(F.col("text")), " ")), key_bits(keyed))
    found = posts.select("post_id", "published_at", F.explode(tokens).alias("token")).join(keyed, "token")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    found = found.withColumn("delta", F.floor((micros("published_at") - micros("at")) / 86_400_000_000))
    if days:
        found = found.where(F.col("delta").between(-days[0], days[1]))
    hits = found.select("post_id", "event_id", "canonical", "is_domain", "delta").join(posts.select("post_id", "text"), "post_id")
    return hits.where(named(F.col("text"), F.col("canonical"), F.col("is_domain"))).drop("text").distinct()


def evaluation_sets(matches: DataFrame, events: DataFrame, posts: DataFrame, strata: DataFrame, home: str, most_ids: int = 5) -> DataFrame:
    """post_id, label, stratum, event_id, delta, event_ids, entities of each post that names an entity.

    positive: a home event within the days, with the nearest one (of equal distances the smaller id), and the first
    `most_ids` ids of all home events that it names; out_of_window: home events at other times alone, to be left out;
    negative: foreign events alone. entities: the home names, else the foreign ones. stratum: the author's.

    events: event_id, country. posts: post_id, author_id. strata: author_id, stratum."""
    rows = matches.join(events.select("event_id", "country"), "event_id").withColumn("own", F.col("country") == home)
    near = F.col("own") & F.col("delta").between(-BEFORE, AFTER)
    best = F.min_by(F.when(near, F.struct("event_id", "delta")), F.when(near, F.struct(F.abs("delta"), "event_id"))).alias("best")
    each = rows.groupBy("post_id").agg(F.bool_or("own").alias("own"), F.bool_or(near).alias("near"), best)
    # ids and names are made distinct and cut before they are gathered
    ids = rows.where("own").select("post_id", "event_id").distinct()
    ids = ids.withColumn("nth", F.row_number().over(W.partitionBy("post_id").orderBy("event_id"))).where(F.col("nth") <= most_ids)
    ids = ids.groupBy("post_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("event_ids"))
    names = rows.select("post_id", "own", "canonical").distinct().groupBy("post_id", "own").agg(F.array_join(F.array_sort(F.collect_list("canonical")), ",").alias("entities"))
    label = F.when(F.col("near"), "positive").when(F.col("own"), "out_of_window").otherwise("negative")
    out = each.join(names, ["post_id", "own"]).join(ids, "post_id", "left").join(posts.select("post_id", "author_id"), "post_id").join(strata.select("author_id", "stratum"), "author_id", "left")
    return out.select(
        "post_id", label.alias("label"), F.coalesce("stratum", F.lit("other")).alias("stratum"), F.col("best.event_id").alias("event_id"), F.col("best.delta").alias("delta"),
        F.when(F.col("near"), F.col("event_ids")).alias("event_ids"), "entities",
    )


def second_corpus_hits(events: DataFrame, matches: DataFrame, wide: DataFrame, corpus: DataFrame, cyber: DataFrame, feeds: DataFrame) -> DataFrame:
    """event_id, hits, in_corpus, cyber, cyber_in_corpus and cyber_organic of every event: posts of a wider corpus that name it
    within the days, those of them that the corpus has, and those on the subject, collected, or by no feed.

    wide: post_id, author_id. corpus and cyber: post_id. feeds: author_id."""
    flag = lambda d, key, name: d.select(key).distinct().withColumn(name, F.lit(True))
    rows = matches.select("event_id", "post_id").distinct().join(wide.select("post_id", "author_id"), "post_id")
    rows = rows.join(flag(corpus, "post_id", "have"), "post_id", "left").join(flag(cyber, "post_id", "on"), "post_id", "left")
    rows = rows.join(flag(feeds, "author_id", "feed"), "author_id", "left")
    have, on, organic = F.col("have").isNotNull(), F.col("on").isNotNull(), F.col("feed").isNull()
    counts = {"hits": F.lit(True), "in_corpus": have, "cyber": on, "cyber_in_corpus": on & have, "cyber_organic": on & organic}
    counted = rows.groupBy("event_id").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return events.select("event_id").distinct().join(counted, "event_id", "left").fillna(0)


def stages_of(hits: DataFrame) -> DataFrame:
    """One row: events listed, discussed anywhere, collected, and discussed by an account that is no feed."""
    return hits.agg(
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("cyber") > 0).alias("discussed"), F.count_if(F.col("cyber_in_corpus") > 0).alias("collected"),
        F.count_if(F.col("cyber_organic") > 0).alias("organic"),
    )


def first_posts(matches: DataFrame, events: DataFrame, posts: DataFrame, feeds: DataFrame) -> DataFrame:
    """event_id, posts, first_post, lead_hours, feed_hours, organic_hours, first_by: hours from each event's publication to
    its first post, to the first one by a feed and by another account (NULL without one), and whose came first.

    events: event_id, at. posts: post_id, author_id, published_at. feeds: author_id. Equal times go to the smaller post_id."""
    rows = matches.select("event_id", "post_id").distinct().join(posts.select("post_id", "author_id", "published_at"), "post_id").join(events.select("event_id", "at"), "event_id")
    rows = rows.join(feeds.select("author_id").distinct().withColumn("feed", F.lit(True)), "author_id", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first = lambda c, name: F.min(F.when(c, F.struct("hours", "post_id"))).alias(name)
    rows = rows.withColumn("hours", (micros("published_at") - micros("at")) / 3_600_000_000)
    out = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("posts"), first(F.lit(True), "any"), first(F.col("feed").isNotNull(), "by_feed"), first(F.col("feed").isNull(), "organic"))
    whose = F.when(F.col("any.post_id") == F.col("by_feed.post_id"), "feed").otherwise("organic")
    hours = lambda c, name: F.round(F.col(f"{c}.hours"), 6).alias(name)
    return out.select("event_id", "posts", F.col("any.post_id").alias("first_post"), hours("any", "lead_hours"), hours("by_feed", "feed_hours"), hours("organic", "organic_hours"), whose.alias("first_by"))


def search_registry(events: DataFrame, entities: DataFrame, records: DataFrame, text: str, most_events: int = 15, most_records: int = 10) -> DataFrame:
    """kind, id, place, label of the newest events whose title or entity holds a text in any case, and of the records whose
    id or description does, exploited and severe ones first.

    events: event_id, name, at. entities: event_id, entity. records: cve_id, description, cvss, known_exploited."""
    like = f"%{text.strip()}%"
    hits = entities.where(F.col("entity").ilike(like)).select("event_id").distinct().withColumn("named", F.lit(True))
    found = events.join(hits, "event_id", "left").where(F.col("name").ilike(like) | F.col("named").isNotNull())
    found = found.orderBy(F.desc_nulls_last("at"), "event_id").limit(most_events)
    found = found.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.row_number().over(W.orderBy(F.desc_nulls_last("at"), "event_id")).alias("place"), F.col("name").alias("label"))
    order = (F.desc_nulls_last("known_exploited"), F.desc_nulls_last("cvss"), "cve_id")
    known = records.where(F.col("description").ilike(like) | F.col("cve_id").ilike(like)).orderBy(*order).limit(most_records)
    known = known.select(F.lit("record").alias("kind"), F.col("cve_id").alias("id"), F.row_number().over(W.orderBy(*order)).alias("place"), F.col("description").alias("label"))
    return found.unionByName(known)
