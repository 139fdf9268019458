"""Replies, quotes and reposts around seed posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.numbering import numbered


def edge_key(kind: Column, source: Column, target: Column) -> Column:
    """A missing part prints as None."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws("|", part(kind), part(source), part(target)), 256), 1, 32)


def latest_outcome(outcomes: DataFrame) -> DataFrame:
    """The newest run that did not fail; if all failed, the oldest."""
    failed = F.col("outcome") == "failed"
    order = (failed.asc(), F.when(failed, F.col("run_id")).asc(), F.col("run_id").desc())
    rows = outcomes.withColumn("nth", F.row_number().over(W.partitionBy("seed_id", "endpoint").orderBy(*order)))
    return rows.where("nth = 1").select("seed_id", "endpoint", "run_id", "outcome")


def adopted_edges(edges: DataFrame, latest: DataFrame) -> DataFrame:
    """The edges of the run that each seed's thread was taken from, so that repeated runs do not count twice."""
    run = latest.where("endpoint = 'thread'").select("seed_id", "run_id")
    return edges.join(run, ["seed_id", "run_id"], "left_semi")


def seed_metrics(edges: DataFrame) -> DataFrame:
    kind = F.col("edge_type")
    return edges.groupBy("seed_id").agg(
        F.count_if((kind == "reply") & (F.col("depth") == 1)).alias("d1"), F.count_if((kind == "reply") & (F.col("depth") == 2)).alias("d2"), F.count_if(kind == "quote").alias("quotes"),
        F.count_if(kind == "repost").alias("reposts"), F.countDistinct("actor").alias("actors"),
    )


def seed_status(latest: DataFrame) -> DataFrame:
    """observed needs both endpoints in success or partial."""
    rows = latest.groupBy("seed_id").pivot("endpoint", ["thread", "quotes"]).agg(F.first("outcome"))
    good = lambda c: F.coalesce(F.col(c).isin("success", "partial"), F.lit(False))
    either = lambda v: F.coalesce(F.col("thread") == v, F.lit(False)) | F.coalesce(F.col("quotes") == v, F.lit(False))
    status = F.when(good("thread") & good("quotes"), "observed").when(either("unavailable"), "unavailable").when(either("failed"), "failed").otherwise("missing")
    return rows.select("seed_id", status.alias("status"))


def csr(seeds: DataFrame, status: DataFrame, metrics: DataFrame, by: str) -> DataFrame:
    """Share of observed seeds with a direct reply or a quote; reposts do not count."""
    rows = seeds.join(status, "seed_id", "left").join(metrics, "seed_id", "left")
    seen = F.coalesce(F.col("status") == "observed", F.lit(False))
    talk = seen & (F.coalesce("d1", F.lit(0)) + F.coalesce("quotes", F.lit(0)) > 0)
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("seeds"), F.count_if(seen).alias("observed"), F.count_if(talk).alias("conversations"))
    return out.withColumn("csr", F.round(F.try_divide("conversations", "observed"), 6))


def actor_reply_graph(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """authors: target_id, author. Directed weights and whether the other direction exists."""
    rows = edges.where("edge_type = 'reply'").join(authors, "target_id").groupBy(F.col("actor").alias("src"), F.col("author").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    back = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"))
    return rows.join(back, ["src", "dst"], "left").select("src", "dst", "weight", F.coalesce("back", F.lit(False)).alias("mutual"))


def seed_facts(seeds: DataFrame, status: DataFrame, metrics: DataFrame) -> DataFrame:
    """Seeds with their status and counts; observed and conversation as flags, never NULL."""
    rows = seeds.join(status, "seed_id", "left").join(metrics, "seed_id", "left").fillna(0, ["d1", "d2", "quotes", "reposts", "actors"]).fillna("missing", ["status"])
    seen = F.col("status") == "observed"
    return rows.withColumn("observed", seen).withColumn("conversation", seen & (F.col("d1") + F.col("quotes") > 0))


def _share(hits: str, n: str) -> Column:
    return F.round(F.try_divide(hits, n), 6)


def csr_depth(facts: DataFrame) -> DataFrame:
    rows = facts.where("observed").agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.expr("d1 > 0")).alias("with_d1"), F.count_if(F.expr("d2 > 0")).alias("with_d2"))
    return rows.select("*", _share("with_d1", "observed").alias("share_d1"), _share("with_d2", "observed").alias("share_d2"))


def csr_weighted(facts: DataFrame, stratum: str) -> DataFrame:
    """Share per stratum among observed seeds, weighted by the stratum's share of all seeds."""
    rows = facts.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if("observed").alias("seen"), F.count_if("conversation").alias("talk")).where("seen > 0")
    return rows.agg(F.round(F.try_divide(F.sum(F.col("n") * F.col("talk") / F.col("seen")), F.sum("n")), 6).alias("csr_weighted"))


def concentration(counts: DataFrame, by: str, n: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """HHI and top-k shares of counts (one row an actor). Works on the histogram of the counts, so that a
    group with very many actors is never ordered in one task."""
    histogram = counts.groupBy(by, n).agg(F.count(F.lit(1)).alias("m"))
    ahead = F.coalesce(F.sum("m").over(W.partitionBy(by).orderBy(F.desc(n)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = lambda k: F.sum(F.col(n) * F.least("m", F.greatest(F.lit(k) - F.col("ahead"), F.lit(0))))
    total = F.sum(F.col(n) * F.col("m"))
    return histogram.withColumn("ahead", ahead).groupBy(by).agg(
        F.sum("m").alias("actors"), total.alias("total"), F.round(F.sum(F.col(n) * F.col(n) * F.col("m")) / (total * total), 6).alias("hhi"), *[F.round(top(k) / total, 6).alias(f"top_{k}") for k in ks]
    )


def run_rollup(outcomes: DataFrame) -> DataFrame:
    """Seeds of each run by their worst endpoint: failed > unavailable > partial > ok."""
    worst = F.max(F.when(F.col("outcome") == "failed", 3).when(F.col("outcome") == "unavailable", 2).when(F.col("outcome") == "partial", 1).otherwise(0)).alias("w")
    rows = outcomes.groupBy("run_id", "seed_id").agg(worst).groupBy("run_id")
    return rows.agg(*[F.count_if(F.col("w") == i).alias(name) for i, name in enumerate(("ok", "partial", "unavailable", "failed"))])


def resume_anti(seeds: DataFrame, outcomes: DataFrame, run: int) -> DataFrame:
    """Seeds that the run has not covered with both endpoints."""
    done = outcomes.where((F.col("run_id") == run) & F.col("outcome").isin("success", "partial")).groupBy("seed_id").agg(F.countDistinct("endpoint").alias("n")).where("n = 2")
    return seeds.join(done, "seed_id", "left_anti").select("seed_id")


def repeat_run_diff(edges: DataFrame, a: int, b: int) -> DataFrame:
    """Keys (source, seed, type) found in only one or in both of two runs."""
    rows = edges.where(F.col("run_id").isin(a, b)).groupBy("edge_type", "actor", "seed_id").agg(F.bool_or(F.col("run_id") == a).alias("x"), F.bool_or(F.col("run_id") == b).alias("y"))
    return rows.groupBy("edge_type").agg(F.count_if(F.expr("x and not y")).alias("only_a"), F.count_if(F.expr("y and not x")).alias("only_b"), F.count_if(F.expr("x and y")).alias("both"))


def intensity_ratios(edges: DataFrame, posts: DataFrame) -> DataFrame:
    """Replies and quotes a post, and distinct interacting actors an author, by day."""
    day = lambda d, c: d.withColumn("day", F.to_date(c))
    made = day(edges, "event_time").groupBy("day").agg(F.count_if(F.expr("edge_type = 'reply'")).alias("replies"), F.count_if(F.expr("edge_type = 'quote'")).alias("quotes"), F.countDistinct("actor").alias("actors"))
    rows = day(posts, "published_at").groupBy("day").agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("author_id").alias("authors")).join(made, "day", "left").fillna(0)
    return rows.select("day", _share("replies", "posts").alias("ri"), _share("quotes", "posts").alias("qi"), _share("actors", "authors").alias("uar"))


def conversation_features(edges: DataFrame) -> DataFrame:
    """Size, depth, responders and replies for each replied-to post of a seed."""
    rows = edges.where("edge_type = 'reply'").groupBy("seed_id").agg(F.count(F.lit(1)).alias("size"), F.max("depth").alias("depth"), F.countDistinct("actor").alias("responders"), F.countDistinct("target_id").alias("targets"))
    return rows.withColumn("branching", _share("size", "targets"))


def interaction_by_cve(mentions: DataFrame, edges: DataFrame, records: DataFrame) -> DataFrame:
    """mentions: post_id, author_id, cve_id. Posts, authors and interactions of each CVE beside its known-exploited flag."""
    hits = edges.groupBy(F.col("target_id").alias("post_id")).agg(F.count(F.lit(1)).alias("hits"))
    rows = mentions.join(hits, "post_id", "left").groupBy("cve_id").agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct("author_id").alias("authors"), F.coalesce(F.sum("hits"), F.lit(0)).alias("interactions")
    )
    return rows.join(records.select("cve_id", "known_exploited"), "cve_id", "left").withColumn("known_exploited", F.coalesce("known_exploited", F.lit(False)))


def mention_edges(posts: DataFrame) -> DataFrame:
    """Author to mentioned handle, with posts; a handle counts once a post."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"(?:^|[^\w@])(@[A-Za-z0-9_.-]*[A-Za-z0-9_])"), F.lit(1))
    rows = posts.select("author_id", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("handle"))
    return rows.groupBy("author_id", "handle").agg(F.count(F.lit(1)).alias("posts"))


def derive_run(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges (snapshot_id, edge_type, source, target, actor, depth) with their key, each relation once a snapshot, without
    those of known (snapshot_id, key): deriving again adds nothing."""
    key = edge_key(F.col("edge_type"), F.coalesce("source", "actor"), F.col("target"))
    rows = edges.withColumn("key", key).groupBy("snapshot_id", "key", "edge_type", "source", "target").agg(F.min("actor").alias("actor"), F.min("depth").alias("depth"))
    return rows.join(known.select("snapshot_id", "key"), ["snapshot_id", "key"], "left_anti")


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Of each (run_id, seed_id, endpoint) the outcome of reading its pages (page from 1, ok, error, capped, items array).

    The last page decides, which is the first that failed, if any: all read is success, or partial at a cap; a failed first
    page is unavailable (not_found, blocked) or failed, a later one partial. items are distinct ones where all was read,
    all ones before a failed page, null if the first failed; duplicates came on an earlier page already."""
    keys = ["run_id", "seed_id", "endpoint"]
    row, bad = F.struct("page", "ok", "error", "capped"), F.when(~F.col("ok"), F.col("page"))
    ends = pages.groupBy(*keys).agg(F.coalesce(F.min_by(row, bad), F.max_by(row, "page")).alias("end"))
    read = pages.join(ends, keys).where("ok and (end.ok or page < end.page)").select(*keys, "page", F.explode("items").alias("item"))
    by_item = read.groupBy(*keys, "item", "page").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "item").agg(F.sum("n").alias("n"), F.min_by("n", "page").alias("first"))
    counts = by_item.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seen"), F.sum(F.col("n") - F.col("first")).alias("again"))
    ok, page, zero = F.col("end.ok"), F.col("end.page"), F.lit(0)
    early = F.when(F.col("end.error").isin("not_found", "blocked"), "unavailable").otherwise("failed")
    outcome = F.when(ok & F.col("end.capped"), "partial").when(ok, "success").when(page > 1, "partial").otherwise(early)
    return ends.join(counts, keys, "left").select(
        *keys, page.alias("pages"), outcome.alias("outcome"), F.when(ok, F.coalesce("seen", zero)).when(page > 1, F.coalesce("n", zero)).alias("items"),
        F.when(ok, F.coalesce("again", zero)).alias("duplicates"), F.when(ok, F.col("end.capped")).alias("cap_hit"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("run_id", "endpoint").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "partial", "unavailable", "failed")])


def negative_control(edges: DataFrame) -> DataFrame:
    """edge_no, actor, new_target: the targets of all replies dealt anew among them, so actors, times and target counts stay.
    Both orders are numbered by ranges, and equal numbers meet."""
    rows = edges.where("edge_type = 'reply'").select("edge_no", "actor", "target_id")
    natural = numbered(rows.select("edge_no", "actor"), [F.col("edge_no")], "nth")
    order = [F.md5(F.col("edge_no").cast("string")), F.col("edge_no")]
    dealt = numbered(rows.select("edge_no", F.col("target_id").alias("new_target")), order, "nth").select("nth", "new_target")
    return natural.join(dealt, "nth").select("edge_no", "actor", "new_target")
