"""Label versions scored on one reviewed sample, beside each other and weighted back to the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hubbub.operators.evaluation import wilson_ci

#: Flags of a label and what a reviewer says of them; relevance is both.
FLAGS = {"is_cyber": "true_cyber", "is_canada": "true_canada", "is_relevant": "true_cyber and true_canada"}


def score_versions(truth: DataFrame, labels: DataFrame, sizes: DataFrame, flags: dict[str, str] = FLAGS) -> DataFrame:
    """label_version, flag, tp, fp, fn (rows), weighted_tp, weighted_fp, weighted_fn, precision, recall, f1 and Wilson bounds.

    truth: post_id, stratum, true_cyber, true_canada of a stratified sample. labels: post_id, label_version and the flags; an
    unjudged flag counts as not set. sizes: label_version, stratum, n. A row counts for as many as its stratum has in the
    version for each drawn one; the bounds are those of the plain counts. Shares without rows are 0."""
    drawn = truth.groupBy("stratum").agg(F.count(F.lit(1)).alias("drawn"))
    weight = sizes.join(drawn, "stratum").select("label_version", "stratum", (F.col("n") / F.col("drawn")).alias("w"))
    # strata that a version lacks weigh nothing
    rows = truth.join(labels.select("post_id", "label_version", *flags), "post_id").join(F.broadcast(weight), ["label_version", "stratum"], "left").fillna(0.0, ["w"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    each = F.array(*(F.struct(F.lit(f).alias("flag"), yes(F.expr(t)).alias("t"), yes(F.col(f)).alias("p")) for f, t in flags.items()))
    rows = rows.select("label_version", "w", F.inline(each))
    kinds = {"tp": F.col("t") & F.col("p"), "fp": ~F.col("t") & F.col("p"), "fn": F.col("t") & ~F.col("p")}
    out = rows.groupBy("label_version", "flag").agg(
        *(F.count_if(c).alias(k) for k, c in kinds.items()), *(F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(f"weighted_{k}") for k, c in kinds.items())
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    precision, recall = share("weighted_tp", "weighted_fp"), share("weighted_tp", "weighted_fn")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    low, high = {}, {}
    for name, missed in (("precision", "fp"), ("recall", "fn")):
        low[name], high[name] = wilson_ci(F.col("tp"), F.col("tp") + F.col(missed))
    six = lambda c, name: F.round(c, 6).alias(name)
    return out.select(
        "label_version", "flag", *kinds, *(six(f"weighted_{k}", f"weighted_{k}") for k in kinds), six(precision, "precision"), six(recall, "recall"), six(f1, "f1"),
        *(six(bound[name], f"{name}_{end}") for name in ("precision", "recall") for end, bound in (("low", low), ("high", high))),
    )


def versions_side_by_side(scores: DataFrame) -> DataFrame:
    """label_version, precision and recall of each flag and f1 of relevance: one row a version."""
    at = lambda flag, c: F.max(F.when(F.col("flag") == flag, F.col(c))).alias(f"{flag[3:]}_{c}")
    return scores.groupBy("label_version").agg(*(at(f, c) for f in FLAGS for c in ("precision", "recall")), at("is_relevant", "f1"))


def fill_quotas(have: dict[str, int], shares: dict[str, float], n: int, spare: str) -> dict[str, int]:
    """How many of each type: its rounded share of n, but no more than there are; what a type lacks goes to the spare type."""
    quota = {t: round(n * s) for t, s in shares.items()}
    for t in quota:
        if t != spare and (short := quota[t] - have.get(t, 0)) > 0:
            quota[t] -= short
            quota[spare] += short
    return quota


def annotation_sample(units: DataFrame, shares: dict[str, float], n: int, reliability: int, spare: str, seed: str) -> DataFrame:
    """unit_id, unit_type, stratum, place, twice: about n units by type, in each type by turns over the strata.

    units: unit_id, unit_type, stratum, talk. Half of the spare type comes from units with `talk`, as far as there are enough.
    twice marks those that a second person reads too, as many of each type as its share of `reliability`. Within a stratum
    and among the strata the order is by hash of the id and of the name, so a rerun gives the same sample. Ranks above
    what a type takes leave before the shuffle."""
    counted = units.where(F.col("unit_type").isin(*shares)).groupBy("unit_type", "talk").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows a type
    have, talking = {}, 0
    for r in counted:
        have[r["unit_type"]] = have.get(r["unit_type"], 0) + r["n"]
        talking += r["n"] if r["unit_type"] == spare and r["talk"] else 0
    quota = fill_quotas(have, shares, n, spare)
    pools = [(t, F.lit(True), k) for t, k in quota.items() if t != spare]
    half = min(talking, quota[spare] // 2)
    pools += [(spare, F.col("talk"), half), (spare, ~F.col("talk"), quota[spare] - half)]
    key = lambda c, salt: F.md5(F.concat(F.col(c).cast("string"), F.lit(salt)))
    out = None
    for kind, which, k in pools:
        rows = units.where((F.col("unit_type") == kind) & F.coalesce(which, F.lit(False)))
        rank = F.row_number().over(_window("stratum", key("unit_id", seed), F.col("unit_id")))
        rows = rows.select("unit_id", "unit_type", "stratum", rank.alias("turn")).where(F.col("turn") <= k)
        rows = rows.orderBy("turn", key("stratum", seed), "stratum").limit(k)
        out = rows if out is None else out.unionByName(rows)
    # n rows at most from here on
    drawn = F.count(F.lit(1)).over(_window("unit_type"))
    second = F.bround(F.lit(reliability) * drawn / F.count(F.lit(1)).over(_window()))
    place = F.row_number().over(_window("unit_type", key("unit_id", seed + "twice"), F.col("unit_id")))
    return out.select("unit_id", "unit_type", "stratum", "turn", (place <= second).alias("twice"))


def _window(by: str | None = None, *order: Column):
    spec = W.partitionBy(*([by] if by else []))
    return spec.orderBy(*order) if order else spec
