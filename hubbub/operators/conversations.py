"""What happened around seed posts, by population and by group: sums, distinct people in each role, gaps, delays, sensors.

Seeds come as facts (one row a seed: seed_id, author_id, status, observed, conversation, d1, d2, quotes, reposts and group
columns), people as roles (one row for each seed, actor and way of taking part). Only observed seeds tell of interaction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.interaction import concentration
from hubbub.operators.percentiles import exact_percentiles

#: Ways of taking part in a seed's conversation, as bits.
AUTHOR, REPLY, DEEPER, QUOTE, REPOST = 1, 2, 4, 8, 16
STATUSES = ("observed", "unavailable", "failed", "missing")
#: Counts of people: those in any of these roles.
PEOPLE = {
    "seed_authors": AUTHOR, "reposters": REPOST, "participants": REPLY | DEEPER | QUOTE | REPOST, "participants_no_reposts": REPLY | DEEPER | QUOTE,
    "actors": AUTHOR | REPLY | DEEPER | QUOTE | REPOST,
}


def seed_roles(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """seed_id, actor, role (bits or-ed) of everyone in an observed seed: its author, and who replied, quoted or reposted.
    An unknown actor is nobody."""
    seen = facts.where("observed")
    kind, depth = F.col("edge_type"), F.col("depth")
    role = F.when(kind == "quote", QUOTE).when(kind == "repost", REPOST).when((kind == "reply") & (depth == 1), REPLY).when((kind == "reply") & (depth == 2), DEEPER)
    made = edges.join(seen.select("seed_id"), "seed_id", "left_semi").select("seed_id", "actor", role.alias("role"))
    rows = made.unionByName(seen.select("seed_id", F.col("author_id").alias("actor"), F.lit(AUTHOR).alias("role"))).where("actor is not null and role is not null")
    return rows.groupBy("seed_id", "actor").agg(F.bit_or("role").alias("role"))


def seed_participants(roles: DataFrame) -> DataFrame:
    """seed_id and how many people replied (at any depth, and directly), quoted and reposted, and took part at all."""
    has = lambda bits: F.count_if(F.col("role").bitwiseAND(F.lit(bits)) != 0)
    return roles.groupBy("seed_id").agg(
        has(REPLY | DEEPER).alias("repliers"), has(REPLY).alias("direct_repliers"), has(QUOTE).alias("quoters"), has(REPOST).alias("reposters"), has(PEOPLE["participants"]).alias("participants")
    )


def _sums() -> list[Column]:
    seen = F.col("observed")
    return [
        F.count(F.lit(1)).alias("seeds"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count_if("conversation").alias("conversations"),
        *(F.count_if(seen & (F.col(c) > 0)).alias(f"with_{c}") for c in ("d1", "quotes", "reposts")),
        *(F.coalesce(F.sum(F.when(seen, F.col(c))), F.lit(0)).cast("long").alias(name) for c, name in (("d1", "depth1"), ("d2", "depth2"), ("quotes", "quote_edges"), ("reposts", "repost_edges"))),
    ]


def _csr(rows: DataFrame) -> DataFrame:
    return rows.withColumn("csr", F.round(F.try_divide("conversations", "observed"), 6))


def population_summary(facts: DataFrame, roles: DataFrame, populations: dict[str, Column]) -> DataFrame:
    """population, counts of seeds by status, sums over observed ones, conversation share and distinct people, of
    populations that may overlap. Each is a bit: an actor's rows are or-ed to one row that tells for every role in which
    populations it was taken, so people are counted once in each without a set or a second pass."""
    if len(populations) > 62:
        raise ValueError("at most 62 populations")
    member = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.coalesce(flag, F.lit(False)), F.lit(1 << i)).otherwise(0).cast("long") for i, flag in enumerate(populations.values())))
    rows = facts.withColumn("members", member)
    name = F.explode(F.array_compact(F.array(*(F.when(F.col("members").bitwiseAND(F.lit(1 << i)) != 0, F.lit(p)) for i, p in enumerate(populations)))))
    seeds = rows.withColumn("population", name).groupBy("population").agg(*_sums())

    taken = roles.join(rows.select("seed_id", "members"), "seed_id")
    bits = (AUTHOR, REPLY, DEEPER, QUOTE, REPOST)
    each = taken.groupBy("actor").agg(*(F.bit_or(F.when(F.col("role").bitwiseAND(F.lit(b)) != 0, F.col("members")).otherwise(F.lit(0).cast("long"))).alias(f"in_{b}") for b in bits))
    union = lambda mask: reduce(lambda a, b: a.bitwiseOR(b), (F.col(f"in_{b}") for b in bits if b & mask))
    counts = each.agg(*(F.count_if(union(mask).bitwiseAND(F.lit(1 << i)) != 0).alias(f"{n}_{i}") for i in range(len(populations)) for n, mask in PEOPLE.items()))
    one = F.array(*(F.struct(F.lit(p).alias("population"), *(F.col(f"{n}_{i}").alias(n) for n in PEOPLE)) for i, p in enumerate(populations)))
    people = counts.select(F.inline(one))
    return _csr(seeds.join(people, "population"))


def group_summary(facts: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """kind, value and the same counts for every value of every key, and for all seeds (kind `all`), by grouping sets: one
    pass over the seeds and one over the people. A NULL value is a value of its own."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("(none)")).alias(k) for k in keys]
    rows = facts.select("seed_id", "status", "observed", "conversation", "d1", "d2", "quotes", "reposts", *text)
    kind = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys), F.lit("all")).alias("kind")
    value = F.coalesce(*keys, F.lit("")).alias("value")
    seeds = rows.groupingSets([[F.col(k)] for k in keys] + [[]], *map(F.col, keys)).agg(kind, value, *_sums()).drop(*keys)
    taken = roles.join(rows.select("seed_id", *keys), "seed_id")
    each = taken.groupingSets([[F.col(k), F.col("actor")] for k in keys] + [[F.col("actor")]], *map(F.col, keys), F.col("actor")).agg(kind, value, F.bit_or("role").alias("role"))
    people = each.groupBy("kind", "value").agg(*(F.count_if(F.col("role").bitwiseAND(F.lit(mask)) != 0).alias(n) for n, mask in PEOPLE.items()))
    return _csr(seeds.join(people, ["kind", "value"], "left").fillna(0, list(PEOPLE)))


def without_top_authors(facts: DataFrame, roles: DataFrame, ks: tuple[int, ...] = (0, 1, 5, 10)) -> DataFrame:
    """removed, seeds, observed, csr, replies, quotes, participants without the seeds of the k authors with most seeds; ties
    by author."""
    order = (F.desc("n"), F.asc("author_id"))
    top = facts.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(max(ks))
    top = top.select("author_id", F.row_number().over(W.orderBy(*order)).alias("place"))  # max(ks) rows
    rows = facts.join(F.broadcast(top), "author_id", "left")
    out = population_summary(rows, roles, {str(k): F.col("place").isNull() | (F.col("place") > k) for k in ks})
    return out.select(F.col("population").cast("int").alias("removed"), "seeds", "observed", "csr", (F.col("depth1") + F.col("depth2")).alias("replies"), F.col("quote_edges").alias("quotes"), "participants")


def producers(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, and how far seeds, replies, quotes and reposts come from few accounts."""
    kind = F.when(F.col("edge_type") == "reply", "replies").when(F.col("edge_type") == "quote", "quotes").when(F.col("edge_type") == "repost", "reposts")
    made = edges.join(facts.select("seed_id"), "seed_id", "left_semi").select(kind.alias("kind"), "actor")
    rows = made.unionByName(facts.select(F.lit("seed_posts").alias("kind"), F.col("author_id").alias("actor"))).where("kind is not null and actor is not null")
    return concentration(rows.groupBy("kind", "actor").agg(F.count(F.lit(1)).alias("n")), "kind", "n")


def count_gaps(facts: DataFrame, reported: dict[str, str]) -> DataFrame:
    """kind, reported, retrieved, seeds_short: what observed seeds say of themselves against what was retrieved.
    reported: column of the retrieved count -> column of the own one, of which NULL counts as 0."""
    each = F.array(*(F.struct(F.lit(got).alias("kind"), F.coalesce(F.col(own), F.lit(0)).cast("long").alias("own"), F.col(got).cast("long").alias("got")) for got, own in reported.items()))
    rows = facts.where("observed").select(F.inline(each))
    return rows.groupBy("kind").agg(F.sum("own").alias("reported"), F.sum("got").alias("retrieved"), F.count_if(F.col("got") < F.col("own")).alias("seeds_short"))


def early_counts(facts: DataFrame, reported: list[str]) -> DataFrame:
    """early, conversation, seeds: whether any count was above 0 when a seed was collected, against whether it had a conversation."""
    early = reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit(0)) > 0 for c in reported))
    return facts.where("observed").groupBy(early.alias("early"), "conversation").agg(F.count(F.lit(1)).alias("seeds"))


def reply_delays(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number, mean, quartiles, 90th percentile, extremes, replies dated before their seed and the share within a day,
    of the hours from an observed seed to each reply with a known time. Negative hours stay in the distribution."""
    seen = facts.where("observed").select("seed_id", "created_at")
    rows = edges.where("edge_type = 'reply' and event_time is not null").join(seen, "seed_id")
    hours = (F.unix_micros(F.col("event_time").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    rows = rows.select(hours.alias("h"))
    ranks = exact_percentiles(rows, [], "h", {"q1_h": 0.25, "median_h": 0.5, "q3_h": 0.75, "p90_h": 0.9, "least_h": 0.0, "most_h": 1.0}).drop("n")
    sums = rows.agg(F.count("h").alias("n"), F.round(F.avg("h"), 6).alias("mean_h"), F.count_if(F.col("h") < 0).alias("before_seed"), F.round(F.avg((F.col("h") <= 24).cast("int")), 6).alias("within_day"))
    return sums.crossJoin(ranks.select(*(F.round(c, 6).alias(c) for c in ranks.columns)))  # one row each


def distributions(facts: DataFrame, columns: list[str]) -> DataFrame:
    """measure, n, total, mean, quartiles, most and the share of zeros of each count over observed seeds."""
    long = facts.where("observed").select(F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("x")) for c in columns))))
    sums = long.groupBy("measure").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("most"), F.round(F.avg((F.col("x") == 0).cast("int")), 6).alias("zero_share"))
    return sums.join(exact_percentiles(long, ["measure"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n"), "measure")


def sensors(facts: DataFrame, roles: DataFrame, topic: str = "topic_key") -> DataFrame:
    """topic, s_post, s_actor, s_interaction, their ranks (ties by topic) and interactions a post, of observed seeds. Actors are
    seed authors and who replied or quoted; who only reposted has no time and does not count. One row an actor and topic
    is made before they are counted."""
    key = F.coalesce(F.col(topic), F.lit("(none)")).alias("topic")
    seen = facts.where("observed").select("seed_id", key, (F.col("d1") + F.col("d2") + F.col("quotes")).alias("made"))
    posts = seen.groupBy("topic").agg(F.count(F.lit(1)).alias("s_post"), F.sum("made").alias("s_interaction"))
    counted = roles.where(F.col("role").bitwiseAND(F.lit(AUTHOR | REPLY | DEEPER | QUOTE)) != 0).join(seen.select("seed_id", "topic"), "seed_id")
    actors = counted.select("topic", "actor").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("s_actor"))
    rows = posts.join(actors, "topic", "left").fillna(0, ["s_actor"])
    place = lambda c: F.row_number().over(W.orderBy(F.desc(c), "topic")).alias(c.replace("s_", "rank_"))  # noqa: E731  a row a topic
    return rows.select("topic", "s_post", "s_actor", "s_interaction", *map(place, ("s_post", "s_actor", "s_interaction")), F.round(F.col("s_interaction") / F.col("s_post"), 6).alias("per_post"))


def sensor_correlations(rows: DataFrame) -> DataFrame:
    """pair, rho, n: Spearman correlations of the three sensors over topics, NULL where a sensor does not vary."""
    names = ("s_post", "s_actor", "s_interaction")
    mean_rank = lambda c: (F.rank().over(W.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / 2).alias(f"r_{c}")
    ranks = rows.select(*map(mean_rank, names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rho = lambda a, b: F.round(F.try_divide(F.covar_pop(f"r_{a}", f"r_{b}"), F.stddev_pop(f"r_{a}") * F.stddev_pop(f"r_{b}")), 6)
    one = ranks.agg(F.count(F.lit(1)).alias("n"), *(rho(a, b).alias(f"{a}~{b}") for a, b in pairs))
    return one.select("n", F.inline(F.array(*(F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(f"{a}~{b}").alias("rho")) for a, b in pairs))))


def strict_summary(facts: DataFrame, strict: DataFrame, by: str, reported: str = "reply_count") -> DataFrame:
    """by, seeds, observed, conversations, csr, silent, grown, same, fallen: only seeds of which both endpoints succeeded
    in full count as observed; silent ones have no interaction at all; the last three tell how the replies retrieved
    compare with those reported when the seed was collected. strict: seed_id."""
    rows = facts.join(strict.select("seed_id").distinct().withColumn("full", F.lit(True)), "seed_id", "left")
    full, made = F.col("full").isNotNull(), F.col("d1") + F.col("quotes")
    drift = F.col("d1") - F.coalesce(F.col(reported), F.lit(0))
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if(full).alias("observed"), F.count_if(full & (made > 0)).alias("conversations"), F.count_if(full & (made + F.col("d2") + F.col("reposts") == 0)).alias("silent"),
        F.count_if(full & (drift > 0)).alias("grown"), F.count_if(full & (drift == 0)).alias("same"), F.count_if(full & (drift < 0)).alias("fallen"),
    )
    return _csr(out)
