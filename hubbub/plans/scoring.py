"""Scores of label versions and samples to annotate, over the adapted labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubbub.operators import evaluation as e
from hubbub.operators import scoring
from hubbub.plans.catalog import register
from hubbub.plans.quality_checks import version
from hubbub.sources.staging import staged

PER_STRATUM = 25


def truth(t):
    """A sample by the second version's strata; a reviewer agrees with the first version but for every ninth post."""
    drawn = e.stratified_sample(version(t, "v2"), PER_STRATUM, "seed").select("post_id", "stratum")
    first = version(t, "v1").select("post_id", (F.col("is_cyber") != (F.col("post_id") % 9 == 0)).alias("true_cyber"), F.col("is_canada").alias("true_canada"))
    return staged(drawn.join(first, "post_id"), "truth")


def scores(t):
    sizes = t.labels.withColumn("stratum", e.stratum()).where("stratum is not null").groupBy("label_version", "stratum").agg(F.count(F.lit(1)).alias("n"))
    return scoring.score_versions(truth(t), t.labels, sizes)


_STRATUM = """CASE WHEN is_cyber THEN 'is_cyber' WHEN NOT is_cyber THEN 'not_is_cyber' END || '/' || CASE WHEN is_canada THEN 'is_canada' WHEN NOT is_canada THEN 'not_is_canada' END"""
_BOUND = lambda h, n, sign: f"""CASE WHEN {n} = 0 THEN 0.0 ELSE round(least(greatest(({h} / {n} + 1.9208::DOUBLE / {n} {sign} 1.96::DOUBLE * sqrt(({h} / {n}) * (1 - {h} / {n}) / {n} + 0.9604::DOUBLE / ({n} * {n})))
      / (1 + 3.8416::DOUBLE / {n}), 0.0), 1.0), 6) END::DOUBLE"""  # noqa: E731
_SCORES = f"""z AS (SELECT label_version, {_STRATUM} AS stratum, count(*) AS n FROM labels WHERE is_cyber IS NOT NULL GROUP BY ALL),
    dr AS (SELECT post_id, {_STRATUM} AS stratum FROM labels WHERE label_version = 'v2' AND is_cyber IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY {_STRATUM} ORDER BY md5(post_id || 'seed'), post_id) <= {PER_STRATUM}),
    tr AS (SELECT post_id, stratum, is_cyber <> (post_id % 9 = 0) AS tc, is_canada AS tk FROM dr JOIN labels USING (post_id) WHERE label_version = 'v1'),
    w AS (SELECT label_version, stratum, z.n / d.n AS w FROM z JOIN (SELECT stratum, count(*) AS n FROM tr GROUP BY 1) d USING (stratum)),
    x AS (SELECT l.label_version, coalesce(w, 0) AS w, unnest(['is_cyber', 'is_canada', 'is_relevant']) AS flag, unnest([tc, tk, tc AND tk]) AS t,
          unnest([coalesce(l.is_cyber, false), l.is_canada, coalesce(l.is_relevant, false)]) AS p FROM tr JOIN labels l USING (post_id) LEFT JOIN w ON w.label_version = l.label_version AND w.stratum = tr.stratum),
    g AS (SELECT label_version, flag, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, coalesce(sum(w) FILTER (t AND p), 0)::DOUBLE AS wtp,
          coalesce(sum(w) FILTER (NOT t AND p), 0)::DOUBLE AS wfp, coalesce(sum(w) FILTER (t AND NOT p), 0)::DOUBLE AS wfn FROM x GROUP BY 1, 2),
    h AS (SELECT *, coalesce(wtp / nullif(wtp + wfp, 0), 0) AS pr, coalesce(wtp / nullif(wtp + wfn, 0), 0) AS re FROM g),
    sc AS (SELECT label_version, flag, tp, fp, fn, round(wtp, 6) AS weighted_tp, round(wfp, 6) AS weighted_fp, round(wfn, 6) AS weighted_fn, round(pr, 6) AS precision, round(re, 6) AS recall,
           round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, {_BOUND('tp', '(tp + fp)', '-')} AS precision_low, {_BOUND('tp', '(tp + fp)', '+')} AS precision_high,
           {_BOUND('tp', '(tp + fn)', '-')} AS recall_low, {_BOUND('tp', '(tp + fn)', '+')} AS recall_high FROM h)"""
register("score_weighted", scores, f"WITH {_SCORES} SELECT * FROM sc")
_AT = lambda flag, c: f"max({c}) FILTER (flag = '{flag}') AS {flag[3:]}_{c}"
register(
    "compare_scores", lambda t: scoring.versions_side_by_side(scores(t)),
    f"WITH {_SCORES} SELECT label_version, {', '.join(_AT(f, c) for f in scoring.FLAGS for c in ('precision', 'recall'))}, {_AT('is_relevant', 'f1')} FROM sc GROUP BY 1",
)

SHARES = {"seed": 0.4, "reply_1": 0.3, "reply_2": 0.2, "quote": 0.1}
N, TWICE = 120, 40
_TYPE = "CASE WHEN post_id % 100 = 4 THEN 'reply_2' WHEN post_id % 10 = 0 THEN 'quote' WHEN post_id % 10 < 4 THEN 'reply_1' ELSE 'seed' END"


def annotation_sample(t):
    units = version(t, "v2").select(F.col("post_id").alias("unit_id"), F.expr(_TYPE).alias("unit_type"), F.coalesce("topic_key", F.lit("other")).alias("stratum"), (F.col("post_id") % 4 == 0).alias("talk"))
    return scoring.annotation_sample(units, SHARES, N, TWICE, "seed", "q")


_SHORT = lambda kind, share: f"greatest(round_even({N} * {share}, 0) - (SELECT count(*) FROM u WHERE unit_type = '{kind}'), 0)"
register(
    "quota_round_robin", annotation_sample,
    f"""WITH u AS (SELECT post_id AS unit_id, {_TYPE} AS unit_type, coalesce(topic_key, 'other') AS stratum, post_id % 4 = 0 AS talk FROM labels WHERE label_version = 'v2'),
      s AS (SELECT {' + '.join(_SHORT(k, v) for k, v in SHARES.items() if k != 'seed')} AS spare),
      q AS (SELECT 'seed' AS unit_type, CAST(round_even({N} * {SHARES['seed']}, 0) + spare AS BIGINT) AS k FROM s
            {' '.join(f"UNION ALL SELECT '{k}', CAST(round_even({N} * {v}, 0) - {_SHORT(k, v)} AS BIGINT)" for k, v in SHARES.items() if k != 'seed')}),
      y AS (SELECT least((SELECT count(*) FROM u WHERE unit_type = 'seed' AND talk), k // 2) AS half FROM q WHERE unit_type = 'seed'),
      p AS (SELECT u.*, unit_type = 'seed' AND talk AS pool, CASE WHEN unit_type <> 'seed' THEN k WHEN talk THEN half ELSE k - half END AS take FROM u JOIN q USING (unit_type), y),
      r AS (SELECT *, row_number() OVER (PARTITION BY unit_type, pool, stratum ORDER BY md5(unit_id || 'q'), unit_id) AS turn FROM p),
      c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY unit_type, pool ORDER BY turn, md5(stratum || 'q'), stratum) <= take)
      SELECT unit_id, unit_type, stratum, CAST(turn AS INTEGER) AS turn, row_number() OVER (PARTITION BY unit_type ORDER BY md5(unit_id || 'qtwice'), unit_id)
        <= round_even({TWICE} * count(*) OVER (PARTITION BY unit_type) / count(*) OVER (), 0) AS twice FROM c""",
)
