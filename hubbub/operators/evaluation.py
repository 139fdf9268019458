"""Samples, scores and agreement of labellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratum() -> Column:
    """Of the two flags; an unknown flag belongs to none of the four."""
    side = lambda c: F.when(F.col(c), c).when(~F.col(c), F.concat(F.lit("not_"), F.lit(c)))
    return F.concat(side("is_cyber"), F.lit("/"), side("is_canada"))


def stratified_sample(labels: DataFrame, n: int, seed: str) -> DataFrame:
    order = F.md5(F.concat(F.col("post_id").cast("string"), F.lit(seed)))
    place = F.row_number().over(W.partitionBy("stratum").orderBy(order, "post_id"))
    rows = labels.withColumn("stratum", stratum()).where("stratum is not null").withColumn("place", place)
    return rows.where(F.col("place") <= n).select("post_id", "stratum", "place")


def stratum_sizes(labels: DataFrame) -> DataFrame:
    return labels.withColumn("stratum", stratum()).where("stratum is not null").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


def wilson_ci(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds within [0, 1]; (0, 0) for nothing."""
    p = hits / F.greatest(n, F.lit(1))
    wide = z * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)) + z * z / (4 * n * n + F.when(n == 0, 1).otherwise(0)))
    scale = 1 + z * z / F.greatest(n, F.lit(1))
    mid = p + z * z / (2 * F.greatest(n, F.lit(1)))
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.round(F.least(F.greatest(x / scale, F.lit(0.0)), F.lit(1.0)), 6))
    return bound(mid - wide), bound(mid + wide)


def gate_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Posts relevant in a and explicitly not in b, by b's flags; and as direction b_only, without flags, the other way round."""

    def only(x, y):
        return x.where("is_relevant").select("post_id").join(y, "post_id").where(~F.col("is_relevant"))

    split = only(a, b).groupBy("is_cyber", "is_canada").agg(F.count(F.lit(1)).alias("posts"))
    back = only(b, a).agg(F.lit(None).cast("boolean").alias("is_cyber"), F.lit(None).cast("boolean").alias("is_canada"), F.count(F.lit(1)).alias("posts"))
    return split.withColumn("direction", F.lit("a_only")).unionByName(back.withColumn("direction", F.lit("b_only")))


def version_transition(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.select("post_id", F.col("is_relevant").alias("x")).join(b.select("post_id", F.col("is_relevant").alias("y"), "derived_chain"), "post_id", "full")
    x, y = F.coalesce("x", F.lit(False)), F.coalesce("y", F.lit(False))
    return rows.groupBy("derived_chain").agg(F.count(F.lit(1)).alias("posts"), F.count_if(y).alias("relevant"), F.count_if(y & ~x).alias("gained"), F.count_if(x & ~y).alias("lost"))


def label_migration(a: DataFrame, b: DataFrame) -> DataFrame:
    """Posts that a calls relevant and b labels too, by both topics; rows with two topics are the flows between them."""
    key = lambda d, c: d.select("post_id", F.coalesce("topic_key", F.lit("other")).alias(c))
    return key(a.where("is_relevant"), "before").join(key(b, "after"), "post_id").groupBy("before", "after").agg(F.count(F.lit(1)).alias("posts"))


def migration_topics(flows: DataFrame) -> DataFrame:
    """label_migration's rows by topic: posts in each version, the change, and what came from or went to others."""
    n, moved = F.col("posts"), F.col("before") != F.col("after")
    left = flows.select(F.col("before").alias("topic"), n.alias("a"), F.lit(0).alias("b"), F.when(moved, n).alias("left"), F.lit(0).alias("gained"))
    came = flows.select(F.col("after").alias("topic"), F.lit(0).alias("a"), n.alias("b"), F.lit(0).alias("left"), F.when(moved, n).alias("gained"))
    rows = left.unionByName(came).groupBy("topic").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("a", "b", "left", "gained")])
    return rows.withColumn("delta", F.col("b") - F.col("a")).withColumn("change", F.round(F.try_divide(F.col("b") - F.col("a"), F.col("a")), 6))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()
    cells = cells.withColumn("all", F.sum("n").over(everything)).withColumn("ra", F.sum("n").over(W.partitionBy(a))).withColumn("rb", F.sum("n").over(W.partitionBy(b)))
    same = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(0.0)
    rows = cells.agg(F.sum(same * F.col("n") / F.col("all")).alias("po"), F.sum(same * F.col("ra") * F.col("rb") / (F.col("all") * F.col("all"))).alias("pe"))
    return rows.select(F.round("po", 6).alias("agreement"), F.round(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 6).alias("kappa"))


def _prf(tp: str, fp: str, fn: str) -> list[Column]:
    p, r = F.try_divide(F.col(tp), F.col(tp) + F.col(fp)), F.try_divide(F.col(tp), F.col(tp) + F.col(fn))
    f1 = F.try_divide(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")]


def gate_eval(truth: DataFrame, labels: DataFrame, flag: str) -> DataFrame:
    """Recall and specificity per stratum and over all (stratum NULL); unjudged rows are in no denominator."""
    rows = truth.select("post_id", "stratum", F.col(flag).alias("t")).join(labels.select("post_id", F.col(flag).alias("p")), "post_id", "left").rollup("stratum")
    sums = {"positives": "t and p is not null", "hits": "t and p", "negatives": "not t and p is not null", "passed": "not t and not p", "unjudged": "p is null"}
    out = rows.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in sums.items()])
    return out.select("*", F.round(F.try_divide("hits", "positives"), 6).alias("recall"), F.round(F.try_divide("passed", "negatives"), 6).alias("specificity"))


def two_sided(z: Column) -> Column:
    """The chance of a normal value at least as far out as |z|, by a rational approximation with an error below 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)  # fixed values of the approximation
    tail = F.lit(terms[-1])
    for k in terms[-2::-1]:
        tail = tail * t + F.lit(k)
    return tail * t * F.exp(-x * x)


def mann_whitney(values: DataFrame, side: str, x: str, by: list[str] | None = None) -> DataFrame:
    """values: two sides (a boolean column) of numbers, within each group of `by`. U of the true side by average ranks, from the
    histogram of the values, so that rows are never ordered; both medians (the upper one of two), the rank-biserial effect 1 - 2U / ab
    and the two-sided p of the normal approximation with corrections for ties and continuity. No row if a side has fewer than
    five; p is 1 if all values are equal."""
    by = by or []
    h = values.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    before = W.partitionBy(*by).orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    whole = W.partitionBy(*by)
    h = h.select("*", *(sums(c).alias(f"before_{c}") for c in "ab"), *(F.sum(c).over(whole).alias(f"n_{c}") for c in "ab"))
    t = F.col("a") + F.col("b")
    h = h.withColumn("rank", F.col("before_a") + F.col("before_b") + (t + 1) / 2)
    middle = lambda c: F.min(F.when(F.col(f"before_{c}") + F.col(c) > F.floor(F.col(f"n_{c}") / 2), F.col(x))).alias(f"median_{c}")
    rows = h.groupBy(*by).agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), middle("a"), middle("b"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum((t * t * t - t).cast("double")).alias("ties")
    )
    n, pairs = F.col("n_a") + F.col("n_b"), F.col("n_a") * F.col("n_b")
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    spread = F.sqrt(pairs / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(spread > 0, F.greatest(F.abs(u - pairs / 2) - 0.5, F.lit(0.0)) / spread).otherwise(0.0)
    rows = rows.where("n_a >= 5 and n_b >= 5")
    return rows.select(*by, "n_a", "n_b", "median_a", "median_b", u.alias("u"), F.round(1 - 2 * u / pairs, 6).alias("effect"), F.round(F.least(two_sided(z), F.lit(1.0)), 6).alias("p"))


def ppi_daily(predicted: DataFrame, labelled: DataFrame, z: float = 1.96) -> DataFrame:
    """predicted: post_id, day, p (0 or 1) of all posts; labelled: post_id, y of a few. The daily rate is the mean prediction
    plus the mean correction of the labelled posts, with its interval. NULL where a day has fewer than two labels."""
    rows = predicted.join(labelled, "post_id", "left").withColumn("d", F.col("y") - F.col("p"))
    rows = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("n_labelled"), F.avg("p").alias("m"), F.avg("d").alias("c"), F.var_samp("p").alias("vp"), F.var_samp("d").alias("vd"))
    rate, half = F.col("m") + F.col("c"), z * F.sqrt(F.col("vp") / F.col("n") + F.try_divide("vd", "n_labelled"))
    enough = lambda c: F.when((F.col("n_labelled") > 1) & (F.col("n") > 1), F.round(c, 6))
    return rows.select("day", "n", "n_labelled", enough(rate).alias("rate"), enough(rate - half).alias("low"), enough(rate + half).alias("high"))


def verify_evidence(cited: DataFrame, served: DataFrame, key: str) -> DataFrame:
    """Cited keys that were never served, with how often each is cited."""
    return cited.join(served, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("times"))


def export_review(rows: DataFrame, path: str) -> None:
    """A tab-separated sheet with one line a post: white space is flattened, flags are y or n."""
    flag = lambda c: F.when(F.col(c), "y").when(~F.col(c), "n").otherwise("").alias(c)
    kinds = dict(rows.dtypes)
    flat = lambda c: F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")).alias(c)
    rows.select(*[flag(c) if kinds[c] == "boolean" else flat(c) for c in rows.columns]).write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def load_review(spark, path: str, flags: list[str]) -> DataFrame:
    """The lines in which every given flag is filled with y or n."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    value = lambda c: F.when(F.lower(F.trim(c)) == "y", True).when(F.lower(F.trim(c)) == "n", False)
    return rows.withColumns({f: value(F.col(f)) for f in flags}).where(" and ".join(f"{f} is not null" for f in flags))
