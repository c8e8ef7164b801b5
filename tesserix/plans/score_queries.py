"""Queries on scored views: metrics, policies, errors, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserix.functions import binomial
from tesserix.functions.scalars import clamp, platt, sigmoid, verdict
from tesserix.operators import metrics, policy, resample, tables, vectors
from tesserix.plans.base import ACC, AUC, LARGE, SCORED, query, sql_fpr, sql_hash, sql_ranked, sql_tpr
from tesserix.sources.relations import scored_views, scored_views_large

HIGH, LOW = 0.7, 0.45
RATES = ("fpr", "recall", "false_clear_rate", "coverage", "review_rate")
TABLE = f"count_n::BIGINT AS n, acc, auc, tpr_at_1fpr, tpr_at_5fpr, fpr_at_95tpr FROM (SELECT {{k}}, sum(p + n) AS count_n, {ACC} AS acc, {AUC} AS auc, {sql_tpr(0.01)} AS tpr_at_1fpr, {sql_tpr(0.05)} AS tpr_at_5fpr, {sql_fpr(0.95)} AS fpr_at_95tpr FROM rk GROUP BY {{k}})"


def sql_table(k: str) -> str:
    return f"SELECT {k}, " + TABLE.format(k=k)


def sql_rates(rel: str, key: str, score: str, high: str, low: str) -> str:
    lead = f"{key}, " if key else ""
    return (
        f"SELECT {lead}avg(CASE WHEN y = 0 THEN ({score} >= {high})::INT END) AS fpr, avg(CASE WHEN y = 1 THEN ({score} >= {high})::INT END) AS recall, avg(CASE WHEN y = 1 THEN ({score} <= {low})::INT END) AS false_clear_rate, "
        f"avg(({score} >= {high} OR {score} <= {low})::INT) AS coverage, avg((NOT ({score} >= {high} OR {score} <= {low}))::INT) AS review_rate FROM {rel}" + (f" GROUP BY {key}" if key else "")
    )


@query(f"WITH {SCORED}, {sql_ranked('sv', ['condition'], 'score_a')} {sql_table('condition')}", ("acc", "auc", "tpr_at_1fpr", "tpr_at_5fpr", "fpr_at_95tpr"))
def robustness_table(spark, d):
    """The core analytic query, all conditions in one pass."""
    return metrics.robustness_table(scored_views(spark, d), ["condition"], "score_a")


@query(f"WITH {LARGE}, {sql_ranked('lv', ['condition'], 'score_a')} {sql_table('condition')}", ("acc", "auc", "tpr_at_1fpr", "tpr_at_5fpr", "fpr_at_95tpr"))
def robustness_table_large(spark, d):
    """The same over the larger relation, for timing."""
    return metrics.robustness_table(scored_views_large(spark, d), ["condition"], "score_a")


@query(f"WITH {SCORED}, m AS (SELECT *, 'a' AS model, score_a AS score FROM sv UNION ALL SELECT *, 'b', score_b FROM sv), {sql_ranked('m', ['model', 'condition'], 'score')} SELECT model, condition, {AUC} AS auc FROM rk GROUP BY model, condition", ("auc",))
def auc_by_condition(spark, d):
    """Two matched models on the same rows."""
    both = scored_views(spark, d).select("condition", "y", F.explode(F.create_map(F.lit("a"), F.col("score_a"), F.lit("b"), F.col("score_b"))).alias("model", "score"))
    return metrics.auc(both, ["model", "condition"])


@query(f"WITH {SCORED}, {sql_ranked('sv', ['domain', 'condition'], 'score_b')} SELECT domain, condition, {sql_fpr(0.95)} AS fpr_at_95tpr FROM rk GROUP BY domain, condition", ("fpr_at_95tpr",))
def fpr_at_tpr95(spark, d):
    """A10."""
    return metrics.ranked(scored_views(spark, d), ["domain", "condition"], "score_b").groupBy("domain", "condition").agg(metrics.fpr_at_tpr_expr().alias("fpr_at_95tpr"))


@query(f"WITH {SCORED} {sql_rates('sv', 'condition', 'score_a', HIGH, LOW)}", RATES)
def operating_metrics(spark, d):
    """A4."""
    return metrics.operating_metrics(scored_views(spark, d), ["condition"], "score_a", F.lit(HIGH), F.lit(LOW))


@query(
    f"""WITH {SCORED}, g AS (SELECT domain, grp, min(y) AS y, max((score_a >= {HIGH})::INT) AS fl, max((score_a <= {LOW})::INT) AS cl, max((score_a > {LOW} AND score_a < {HIGH})::INT) AS rv FROM sv GROUP BY domain, grp)
SELECT domain, sum(CASE WHEN y = 0 THEN fl ELSE 0 END)::BIGINT AS real_any_view_errors, sum((y = 0)::INT)::BIGINT AS n_real, avg(CASE WHEN y = 0 THEN fl END) AS real_any_view_fpr, sum(CASE WHEN y = 1 THEN cl ELSE 0 END)::BIGINT AS fake_any_view_clear_errors,
sum((y = 1)::INT)::BIGINT AS n_fake, avg(CASE WHEN y = 1 THEN cl END) AS fake_any_view_false_clear, avg(rv) AS original_any_view_review FROM g GROUP BY domain""",
    ("real_any_view_fpr", "fake_any_view_false_clear", "original_any_view_review"),
)
def any_view_metrics(spark, d):
    """A3."""
    return metrics.any_view_metrics(scored_views(spark, d), ["domain"], "score_a", F.lit(HIGH), F.lit(LOW))


@query(f"WITH {SCORED} SELECT grp, min(y) AS y, CASE WHEN min(y) = 0 THEN max(score_a) ELSE min(score_a) END AS worst FROM sv GROUP BY grp", ("worst",))
def worst_view_extremes(spark, d):
    """A2."""
    return policy.worst_views(scored_views(spark, d), [], "score_a")


def sql_policy(rel: str, keys: list[str], score: str, fpr: str = "0.01", clear: str = "0.05", out: str = "po") -> str:
    """CTEs that end in `out`: select_policy() without the upper bounds."""
    k = "".join(f"{x}, " for x in keys)
    part = ", ".join(keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys) or "true"
    ak = "".join(f"a.{x}, " for x in keys)
    return f"""
{out}_w AS (SELECT {k}grp, min(y) AS y, CASE WHEN min(y) = 0 THEN max({score}) ELSE min({score}) END AS w FROM {rel} GROUP BY {k}grp),
{out}_n AS (SELECT {k}y, count(*) AS n, CASE WHEN y = 0 THEN {fpr} ELSE {clear} END AS t FROM {out}_w GROUP BY {k}y),
{out}_p AS (SELECT {k}y, n, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(t) + (n - i) * ln(1 - t))) OVER (PARTITION BY {k}y ORDER BY i) AS cdf FROM (SELECT *, unnest(range(0, n)) AS i FROM {out}_n)),
{out}_k AS (SELECT {k}y, max(n) AS n, coalesce(max(CASE WHEN cdf <= 0.05 THEN i END), 0) AS k, coalesce(bool_or(cdf <= 0.05), false) AS ok FROM {out}_p GROUP BY {k}y),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {k}y ORDER BY CASE WHEN y = 0 THEN -w ELSE w END) AS rn FROM {out}_w),
{out}_c AS (SELECT {ak}max(CASE WHEN a.y = 0 THEN nextafter(w, 1e308) END) AS h, max(CASE WHEN a.y = 1 THEN nextafter(w, -1e308) END) AS l, max(CASE WHEN a.y = 0 THEN n END) AS n_real, max(CASE WHEN a.y = 1 THEN n END) AS n_fake,
 max(CASE WHEN a.y = 0 THEN k END) AS k_real, max(CASE WHEN a.y = 1 THEN k END) AS k_fake, bool_or(CASE WHEN a.y = 0 THEN ok END) AS fpr_bound_met, bool_or(CASE WHEN a.y = 1 THEN ok END) AS false_clear_bound_met
 FROM {out}_r a JOIN {out}_k b ON {on} AND a.y = b.y WHERE rn = k + 1 {'GROUP BY ' + ', '.join('a.' + x for x in keys) if keys else ''}),
{out}_t AS (SELECT * EXCLUDE (h, l), CASE WHEN l >= h THEN (l + h) / 2 + (l - h) / 4 ELSE h END AS high, CASE WHEN l >= h THEN (l + h) / 2 - (l - h) / 4 ELSE l END AS low FROM {out}_c WHERE h IS NOT NULL AND l IS NOT NULL),
{out}_e AS (SELECT {ak}sum((a.y = 0 AND w >= high)::INT)::BIGINT AS real_errors, sum((a.y = 1 AND w <= low)::INT)::BIGINT AS fake_errors FROM {out}_w a JOIN {out}_t b ON {on} {'GROUP BY ' + ', '.join('a.' + x for x in keys) if keys else ''}),
{out} AS (SELECT {ak}high, low, n_real::BIGINT AS n_real, n_fake::BIGINT AS n_fake, k_real::BIGINT AS k_real, k_fake::BIGINT AS k_fake, fpr_bound_met, false_clear_bound_met, real_errors, fake_errors FROM {out}_t a JOIN {out}_e b ON {on})"""


@query(f"WITH {SCORED}, {sql_policy('sv', [], 'score_a')} SELECT * FROM po", ("high", "low"))
def select_policy(spark, d):
    """D-1 on all originals."""
    return policy.select_policy(scored_views(spark, d), [], "score_a", bounds=False)


@query(f"WITH {SCORED}, {sql_policy('sv', ['condition'], 'score_b')} SELECT * REPLACE (high + 0.00001 AS high, low - 0.00001 AS low), 0.00001::DOUBLE AS margin FROM po", ("high", "low"))
def numerical_guard(spark, d):
    """D-1 per condition with D-2."""
    return policy.numerical_guard(policy.select_policy(scored_views(spark, d), ["condition"], "score_b", bounds=False))


@query(
    f"""WITH {SCORED}, {sql_policy('sv', ['condition'], 'score_a')} SELECT max(high + 0.00001) AS high, min(low - 0.00001) AS low, max(real_errors) AS real_errors, max(fake_errors) AS fake_errors, bool_and(fpr_bound_met) AS fpr_bound_met,
bool_and(false_clear_bound_met) AS false_clear_bound_met, count(*) AS n_conditions FROM po""",
    ("high", "low"),
)
def conditionwise_policy(spark, d):
    """D-3."""
    return policy.conditionwise_policy(scored_views(spark, d), "condition", "score_a", bounds=False)


BISECT = 60


def sql_upper(errors: str, n: str) -> str:
    """Bisection for the rate at which so many errors or fewer have the probability 0.05: a step of halving per row of a recursion."""
    step = "(b.lo + b.hi) / 2"
    return f"(SELECT CASE WHEN {errors} = {n} THEN 1.0 ELSE list_reduce(list_prepend({{'lo': {errors}::DOUBLE / {n}, 'hi': 1.0::DOUBLE}}, list_transform(range({BISECT}), lambda z: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}})), lambda b, z: CASE WHEN list_sum(list_transform(range(0, {errors} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({step}) + ({n} - i) * ln(1 - {step})))) > 0.05 THEN {{'lo': {step}, 'hi': b.hi}} ELSE {{'lo': b.lo, 'hi': {step}}} END).hi END)"


@query(f"WITH {SCORED}, {sql_policy('sv', ['condition'], 'score_a')} SELECT *, {sql_upper('real_errors', 'n_real')} AS fpr_upper, {sql_upper('fake_errors', 'n_fake')} AS false_clear_upper FROM po", ("high", "low", "fpr_upper", "false_clear_upper"))
def policy_with_bounds(spark, d):
    """D-1 with A5: the bounds come from bisection on the exact distribution, tested against published values too."""
    return policy.select_policy(scored_views(spark, d), ["condition"], "score_a")


@query("WITH c AS (SELECT user_id AS grp, count(*) AS n FROM events GROUP BY 1) SELECT grp, n, 1 - pow(0.05, 1.0 / n) AS upper_zero FROM c", ("upper_zero",))
def zero_error_bound(spark, d):
    """A5 for no errors, in closed form."""
    from tesserix.runtime import table

    c = table(spark, d, "events").groupBy(F.col("user_id").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("upper_zero", binomial.upper(F.lit(0), F.col("n")))


TARGETS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2)


@query(
    f"""WITH {SCORED}, tv AS (SELECT sv.*, t.target FROM sv, (SELECT unnest({list(TARGETS)})::DOUBLE AS target) t), {sql_policy('tv', ['target'], 'score_a', fpr='target')},
r AS (SELECT target, high, low, fpr_bound_met, avg(CASE WHEN y = 0 THEN (score_a >= high)::INT END) AS fpr, avg(CASE WHEN y = 1 THEN (score_a >= high)::INT END) AS recall, avg((score_a >= high OR score_a <= low)::INT) AS coverage
FROM tv JOIN po USING (target) GROUP BY ALL) SELECT * FROM r""",
    ("high", "low", "fpr", "recall", "coverage"),
)
def risk_coverage_curve(spark, d):
    """D-4: policies at several targets, and what they cover."""
    sv = scored_views(spark, d).withColumn("target", F.explode(F.array(*[F.lit(t) for t in TARGETS])))
    po = policy.select_policy(sv, ["target"], "score_a", target_fpr="target", bounds=False).select("target", "high", "low", "fpr_bound_met")
    rows = sv.join(F.broadcast(po), "target")  # a row per target
    return metrics.operating_metrics(rows, ["target", "high", "low", "fpr_bound_met"], "score_a", F.col("high"), F.col("low")).select("target", "high", "low", "fpr_bound_met", "fpr", "recall", "coverage")


MARGINS = (0.0, 0.025, 0.05, 0.1, 0.2, 0.3, 0.4, 0.45, 0.49)


@query(f"WITH {SCORED}, mv AS (SELECT sv.*, m.margin FROM sv, (SELECT unnest({list(MARGINS)})::DOUBLE AS margin) m) {sql_rates('mv', 'margin', 'score_a', '0.5 + margin', '0.5 - margin')}", RATES)
def margin_curve(spark, d):
    """D-5."""
    rows = scored_views(spark, d).withColumn("margin", F.explode(F.array(*[F.lit(m) for m in MARGINS])))
    return metrics.operating_metrics(rows, ["margin"], "score_a", 0.5 + F.col("margin"), 0.5 - F.col("margin"))


@query(
    f"""WITH {SCORED}, v AS (SELECT condition, CASE WHEN score_a >= {HIGH} THEN 'flag' WHEN score_a <= {LOW} THEN 'clear' ELSE 'review' END AS verdict, CASE WHEN score_b >= 0.5 THEN 'flag' ELSE 'clear' END AS binary_verdict FROM sv)
SELECT condition, verdict, binary_verdict, count(*) AS n FROM v GROUP BY ALL"""
)
def verdict_counts(spark, d):
    """P10: with a policy and without."""
    v = scored_views(spark, d).select("condition", verdict(F.col("score_a"), F.lit(HIGH), F.lit(LOW)).alias("verdict"), verdict(F.col("score_b"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("binary_verdict"))
    return v.groupBy("condition", "verdict", "binary_verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {SCORED}, {sql_ranked('sv', [], 'score_a', 'ra')}, {sql_ranked('sv', [], 'score_b', 'rb')},
c AS (SELECT count(*) AS n, sum((y = 0)::INT)::BIGINT AS n_real, sum((y = 1)::INT)::BIGINT AS n_fake, sum((y = 0 AND score_a >= 0.5)::INT)::BIGINT AS n_false_positives, sum((y = 1 AND score_a < 0.5)::INT)::BIGINT AS n_false_negatives,
 avg(CASE WHEN y = 0 THEN (score_a >= 0.5)::INT END) AS fpr, avg(CASE WHEN y = 1 THEN (score_a < 0.5)::INT END) AS fnr, avg(CASE WHEN y = 0 THEN score_b - score_a END) AS drift_real, avg(CASE WHEN y = 1 THEN score_b - score_a END) AS drift_fake,
 sum((y = 0 AND score_a < 0.5 AND score_b >= 0.5)::INT)::BIGINT AS n_flips_to_fp, sum((y = 1 AND score_a >= 0.5 AND score_b < 0.5)::INT)::BIGINT AS n_flips_to_fn FROM sv)
SELECT c.*, (SELECT {AUC} FROM ra) AS auc_clean, (SELECT {sql_fpr(0.95)} FROM ra) AS fpr_at_95tpr_clean, (SELECT {AUC} FROM rb) AS auc_degraded, (SELECT {sql_fpr(0.95)} FROM rb) AS fpr_at_95tpr_degraded FROM c""",
    ("fpr", "fnr", "drift_real", "drift_fake", "auc_clean", "fpr_at_95tpr_clean", "auc_degraded", "fpr_at_95tpr_degraded"),
)
def error_summary(spark, d):
    """A13."""
    return metrics.error_summary(scored_views(spark, d), "score_a", "score_b")


def sql_top(kinds: dict[str, tuple[str, str]], k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS kind, {key} AS key, grp, condition, score_a FROM sv WHERE {mask}" for n, (mask, key) in kinds.items())
    return f"""WITH {SCORED}, e AS ({parts}), b AS (SELECT *, row_number() OVER (PARTITION BY kind, grp ORDER BY key, condition, score_a) AS r FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY key, grp) AS rank FROM b WHERE r = 1) SELECT kind, rank::INTEGER AS rank, grp, condition, score_a FROM t WHERE rank <= {k}"""


V3_KINDS = {"false_positive": ("y = 0 AND score_a >= 0.7", "-score_a"), "false_clear": ("y = 1 AND score_a <= 0.45", "score_a"), "false_negative_at_0_5": ("y = 1 AND score_a < 0.5", "score_a")}
V4_KINDS = {"false_positive_at_05": ("y = 0 AND score_a >= 0.5", "-abs(score_a - 0.5)"), "false_negative_at_05": ("y = 1 AND score_a < 0.5", "-abs(score_a - 0.5)"), "policy_false_flag": ("y = 0 AND score_a >= 0.7", "-abs(score_a - 0.5)"), "policy_false_clear": ("y = 1 AND score_a <= 0.45", "-abs(score_a - 0.5)")}


def _kinds(kinds):
    return {n: (F.expr(m), F.expr(k)) for n, (m, k) in kinds.items()}


@query(sql_top(V3_KINDS, 12), ("score_a",))
def top_errors_v3(spark, d):
    """Twelve distinct originals per kind."""
    return tables.top_errors(scored_views(spark, d), _kinds(V3_KINDS), "grp", 12, ["grp", "condition", "score_a"])


@query(sql_top(V4_KINDS, 5), ("score_a",))
def top_errors_v4(spark, d):
    """Five distinct originals per kind, furthest from 0.5."""
    return tables.top_errors(scored_views(spark, d), _kinds(V4_KINDS), "grp", 5, ["grp", "condition", "score_a"])


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) AS view_errors, count(DISTINCT grp) AS distinct_originals FROM sv WHERE {m} HAVING count(*) > 0" for n, (m, _) in V4_KINDS.items()))
def error_counts(spark, d):
    """W4's counts."""
    return tables.error_counts(scored_views(spark, d), {n: F.expr(m) for n, (m, _) in V4_KINDS.items()}, "grp")


@query(
    f"""WITH {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY y, condition ORDER BY CASE WHEN y = 0 THEN -score_a ELSE score_a END, grp) AS rank FROM sv WHERE (y = 0 AND score_a >= 0.5) OR (y = 1 AND score_a < 0.5))
SELECT condition, y, rank::INTEGER AS rank, grp, score_a FROM ranked WHERE rank <= 8""",
    ("score_a",),
)
def top_k_errors(spark, d):
    """False positives from the top, false negatives from the bottom."""
    from tesserix.operators.sampling import first_n

    rows = scored_views(spark, d).filter("(y = 0 AND score_a >= 0.5) OR (y = 1 AND score_a < 0.5)")
    return first_n(rows, ["y", "condition"], [F.when(F.col("y") == 0, -F.col("score_a")).otherwise(F.col("score_a")), "grp"], 8).select("condition", "y", "rank", "grp", "score_a")


@query(
    f"""WITH {SCORED}, c AS (SELECT *, unnest(CASE WHEN sid = 0 THEN ['all', 'synthetic', 'tampered'] WHEN sid = 1 THEN ['all', 'synthetic'] ELSE ['all', 'tampered'] END) AS against FROM sv), {sql_ranked('c', ['condition', 'against'], 'score_a')}
SELECT condition, against, sum(p + n)::BIGINT AS n, {AUC} AS auc, {sql_tpr(0.01)} AS tpr_at_1fpr, {sql_tpr(0.05)} AS tpr_at_5fpr FROM rk GROUP BY condition, against""",
    ("auc", "tpr_at_1fpr", "tpr_at_5fpr"),
)
def per_class_breakdown(spark, d):
    """A24 P5."""
    return metrics.per_class(scored_views(spark, d), ["condition"], "score_a")


@query(
    f"""WITH {SCORED}, m AS (SELECT *, unnest(CASE WHEN sid <> 1 THEN ['all', domain, domain || '_tampered'] ELSE ['all', domain] END) AS member FROM sv), {sql_ranked('m', ['member', 'condition'], 'score_a')}, t AS ({sql_table('member, condition')})
SELECT member, avg(auc) AS mean_auc, min(auc) AS worst_auc, avg(acc) AS mean_acc, avg(tpr_at_1fpr) AS mean_tpr_at_1fpr, count(*) AS n_conditions FROM t GROUP BY member""",
    ("mean_auc", "worst_auc", "mean_acc", "mean_tpr_at_1fpr"),
)
def domain_condition_summary(spark, d):
    """Means over conditions per domain membership."""
    return metrics.condition_summary(metrics.robustness_table(metrics.memberships(scored_views(spark, d)), ["member", "condition"], "score_a"), ["member"])


@query(
    f"""WITH {SCORED}, u AS (SELECT y, 'score_a' AS probe, score_a AS value FROM sv UNION ALL SELECT y, 'score_b', score_b FROM sv UNION ALL SELECT y, 'grp_mod', (grp % 7)::DOUBLE FROM sv), {sql_ranked('u', ['probe'], 'value')},
a AS (SELECT probe, {AUC} AS auc FROM rk GROUP BY probe), m AS (SELECT probe, avg(CASE WHEN y = 0 THEN value END) AS mean_real, avg(CASE WHEN y = 1 THEN value END) AS mean_fake FROM u GROUP BY probe)
SELECT probe, auc, greatest(auc, 1 - auc) AS separability, mean_real, mean_fake FROM a JOIN m USING (probe)""",
    ("auc", "separability", "mean_real", "mean_fake"),
)
def probe_separability(spark, d):
    """A14."""
    return metrics.probe_separability(scored_views(spark, d).withColumn("grp_mod", F.col("grp") % 7), ["score_a", "score_b", "grp_mod"])


@query(f"WITH {SCORED} SELECT condition, avg((score_a - y) * (score_a - y)) AS brier FROM sv GROUP BY condition", ("brier",))
def brier(spark, d):
    """A11."""
    return metrics.brier(scored_views(spark, d), ["condition"], "score_a")


@query(f"WITH {SCORED} SELECT condition, avg(score_a) AS mean_score, sum((score_a > 0.5)::INT)::BIGINT AS n_flagged, count(*) AS n FROM sv WHERE sid = 2 GROUP BY condition", ("mean_score",))
def tampered_scores(spark, d):
    """A25."""
    return scored_views(spark, d).filter("sid = 2").groupBy("condition").agg(F.avg("score_a").alias("mean_score"), F.sum((F.col("score_a") > 0.5).cast("long")).alias("n_flagged"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {SCORED}, r AS (SELECT grp, condition, CASE WHEN grp % 11 = 0 THEN 'NaN'::DOUBLE WHEN grp % 7 = 0 THEN score_a * 3 WHEN grp % 5 = 0 THEN -score_a ELSE score_a END AS raw FROM sv)
SELECT grp, condition, CASE WHEN raw IS NULL OR isnan(raw) OR isinf(raw) THEN 0.5 ELSE greatest(0.0, least(1.0, raw)) END AS pred FROM r""",
    ("pred",),
)
def clamp_predictions(spark, d):
    """K1 K2: predictions as they are written out."""
    raw = F.when(F.col("grp") % 11 == 0, float("nan")).when(F.col("grp") % 7 == 0, F.col("score_a") * 3).when(F.col("grp") % 5 == 0, -F.col("score_a")).otherwise(F.col("score_a"))
    return scored_views(spark, d).select("grp", "condition", clamp(raw).alias("pred"))


@query(f"WITH {SCORED} SELECT condition, count(*) AS n_rows, avg(1 / (1 + exp(-(3 * score_a - 1)))) AS mean_sigmoid, avg(1 / (1 + exp(-2.5 * score_a + 1.25))) AS mean_platt, avg(0.25 * score_a + 0.75 * score_b) AS mean_blend FROM sv GROUP BY condition", ("mean_sigmoid", "mean_platt", "mean_blend"))
def calibrated_scores(spark, d):
    """Sigmoid, Platt map and convex blend of scores."""
    from tesserix.functions.scalars import blend

    a, b = F.col("score_a"), F.col("score_b")
    return scored_views(spark, d).groupBy("condition").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(sigmoid(3 * a - 1)).alias("mean_sigmoid"), F.avg(platt(a, -2.5, 1.25)).alias("mean_platt"), F.avg(blend(b, a, 0.25)).alias("mean_blend"))


REPS = 20


def sql_boot(seed: str, reps: int = REPS) -> str:
    return f"""{SCORED}, o AS (SELECT grp, y, row_number() OVER (PARTITION BY y ORDER BY {sql_hash('slots', 'grp')}) - 1 AS slot, count(*) OVER (PARTITION BY y) AS n FROM (SELECT DISTINCT grp, y FROM sv)),
dr AS (SELECT rep, y, (('0x' || substr(md5('{seed}:' || rep || ':' || y || ':' || slot), 1, 15))::BIGINT % n)::INT AS slot FROM o, (SELECT unnest(range(0, {reps})) AS rep)),
w AS (SELECT rep, o.grp, count(*) AS w FROM dr JOIN o USING (y, slot) GROUP BY rep, o.grp),
b AS (SELECT 'score_a' AS model, rep, condition, y, score_a AS score, w FROM sv JOIN w USING (grp) UNION ALL SELECT 'score_b', rep, condition, y, score_b, w FROM sv JOIN w USING (grp)),
{sql_ranked('b', ['condition', 'model', 'rep'], 'score', weight='w')}, ba AS (SELECT condition, model, rep, {AUC} AS auc FROM rk GROUP BY condition, model, rep)"""


@query(f"WITH {sql_boot('b1')} SELECT condition, model, count(auc) AS reps, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM ba GROUP BY condition, model", ("lo", "hi"), 9)
def bootstrap_auc_ci(spark, d):
    """B1 A8 A26."""
    return resample.auc_interval(scored_views(spark, d), ["condition"], ["score_a", "score_b"], REPS, "b1")


@query(f"WITH {sql_boot('b1', resample.REPS)} SELECT condition, model, count(auc) AS reps, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM ba GROUP BY condition, model", ("lo", "hi"), 9)
def bootstrap_auc_ci_full(spark, d):
    """B1 A8 A26 with all 2,000 repetitions."""
    return resample.auc_interval(scored_views(spark, d), ["condition"], ["score_a", "score_b"], resample.REPS, "b1")


@query(f"WITH {sql_boot('b2')}, dd AS (SELECT condition, rep, max(CASE WHEN model = 'score_b' THEN auc END) - max(CASE WHEN model = 'score_a' THEN auc END) AS delta FROM ba GROUP BY condition, rep) SELECT condition, count(delta) AS reps, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM dd GROUP BY condition", ("lo", "hi"), 9)
def paired_auc_ci(spark, d):
    """Both models on the same draws."""
    return resample.paired_interval(scored_views(spark, d), ["condition"], "score_a", "score_b", REPS, "b2")


@query(f"WITH {sql_boot('b4')}, dd AS (SELECT rep, avg(dl) AS delta FROM (SELECT condition, rep, max(CASE WHEN model = 'score_b' THEN auc END) - max(CASE WHEN model = 'score_a' THEN auc END) AS dl FROM ba GROUP BY condition, rep) GROUP BY rep) SELECT count(delta) AS reps, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM dd", ("lo", "hi"), 9)
def block_bootstrap(spark, d):
    """Originals keep all their conditions."""
    return resample.block_interval(scored_views(spark, d), "condition", "score_a", "score_b", REPS, "b4")


@query(f"WITH {SCORED}, p AS (SELECT grp, count(*) AS n_views, min(domain || ':' || sid) AS stratum FROM sv GROUP BY grp), s AS (SELECT stratum, count(*) AS n_originals FROM p GROUP BY stratum) SELECT grp, stratum, n_views, 1.0 / n_originals / n_views / ((SELECT count(*) FROM s)::DOUBLE / (SELECT sum(n_views) FROM p)) AS weight FROM p JOIN s USING (stratum)", ("weight",))
def original_weights(spark, d):
    """A16."""
    return vectors.original_weights(scored_views(spark, d))


@query(f"WITH {SCORED}, c AS (SELECT y, count(*) AS n FROM sv GROUP BY y) SELECT y, n, (SELECT sum(n) FROM c)::DOUBLE / (2 * n) AS weight FROM c", ("weight",))
def class_weights(spark, d):
    """A17."""
    return vectors.class_weights(scored_views(spark, d))


@query(f"WITH {SCORED} SELECT grp, min(CASE WHEN condition = 'click' THEN score_a END) AS click, min(CASE WHEN condition = 'error' THEN score_a END) AS error, min(CASE WHEN condition = 'purchase' THEN score_a END) AS purchase, min(CASE WHEN condition = 'signup' THEN score_a END) AS signup, min(CASE WHEN condition = 'view' THEN score_a END) AS view FROM sv GROUP BY grp", ("click", "error", "purchase", "signup", "view"))
def condition_pivot(spark, d):
    """One row per original, one column per condition."""
    return scored_views(spark, d).groupBy("grp").pivot("condition", ["click", "error", "purchase", "signup", "view"]).agg(F.min("score_a"))


@query(
    f"""WITH {SCORED}, {sql_ranked('sv', ['condition'], 'score_a', 'ra')}, {sql_ranked('sv', ['condition'], 'score_b', 'rb')}, t AS (SELECT CASE condition WHEN 'view' THEN 'clean' WHEN 'click' THEN 'resize_0.25' ELSE condition END AS condition, 'base' AS model, auc FROM (SELECT condition, {AUC} AS auc FROM ra GROUP BY condition)
UNION ALL SELECT CASE condition WHEN 'view' THEN 'clean' WHEN 'click' THEN 'resize_0.25' ELSE condition END, 'cand', auc FROM (SELECT condition, {AUC} AS auc FROM rb GROUP BY condition)),
g AS (SELECT avg(CASE WHEN model = 'base' THEN auc END) AS mean_base, avg(CASE WHEN model = 'cand' THEN auc END) AS mean_cand, max(CASE WHEN model = 'cand' AND condition = 'resize_0.25' THEN auc END) - max(CASE WHEN model = 'base' AND condition = 'resize_0.25' THEN auc END) AS thumbnail_delta,
max(CASE WHEN model = 'cand' AND condition = 'clean' THEN auc END) - max(CASE WHEN model = 'base' AND condition = 'clean' THEN auc END) AS clean_delta FROM t)
SELECT *, mean_cand >= mean_base AND thumbnail_delta >= -0.005 AND clean_delta >= -0.01 AS eligible FROM g""",
    ("mean_base", "mean_cand", "thumbnail_delta", "clean_delta"),
)
def development_gate(spark, d):
    """D-6, with view as clean and click as the thumbnail condition."""
    named = F.when(F.col("condition") == "view", "clean").when(F.col("condition") == "click", "resize_0.25").otherwise(F.col("condition"))
    both = scored_views(spark, d).select(named.alias("condition"), "y", F.explode(F.create_map(F.lit("base"), F.col("score_a"), F.lit("cand"), F.col("score_b"))).alias("model", "score"))
    return policy.development_gate(metrics.auc(both, ["model", "condition"]))


BLENDS = (("base", 0.0), ("cand", 1.0), ("blend_25", 0.25), ("blend_50", 0.5), ("blend_75", 0.75))


@query(
    f"""WITH {SCORED}, v AS (SELECT CASE condition WHEN 'view' THEN 'clean' WHEN 'click' THEN 'resize_0.25' ELSE condition END AS condition, sid, y, m.model, m.ord, (1 - m.w) * score_a + m.w * score_b AS score FROM sv,
(VALUES {', '.join(f"('{m}', {i}, {w}::DOUBLE)" for i, (m, w) in enumerate(BLENDS))}) AS m(model, ord, w)), {sql_ranked('v', ['model', 'ord', 'condition'], 'score', 'ra')}, t AS (SELECT model, ord, condition, {AUC} AS auc FROM ra GROUP BY ALL),
o AS (SELECT * FROM v WHERE sid <> 2), {sql_ranked('o', ['model'], 'score', 'ro')}, s AS (SELECT model, {AUC} AS auc FROM ro GROUP BY model),
p AS (SELECT model, min(ord)::INT AS ord, avg(auc) AS mean_auc, max(CASE WHEN condition = 'resize_0.25' THEN auc END) AS thumb, max(CASE WHEN condition = 'clean' THEN auc END) AS clean FROM t GROUP BY model), q AS (SELECT p.*, s.auc AS own_auc FROM p JOIN s USING (model)),
g AS (SELECT q.model, q.ord, q.mean_auc, q.thumb - b.thumb AS thumbnail_delta, q.clean - b.clean AS clean_delta, q.own_auc, q.own_auc >= b.own_auc - 0.005 AS own_guard_met,
 q.model = 'base' OR (q.mean_auc >= b.mean_auc AND q.thumb - b.thumb >= -0.005 AND q.clean - b.clean >= -0.01 AND q.own_auc >= b.own_auc - 0.005) AS eligible FROM q, (SELECT * FROM q WHERE model = 'base') b)
SELECT *, model = (SELECT model FROM g WHERE eligible ORDER BY mean_auc DESC, ord LIMIT 1) AS selected FROM g""",
    ("mean_auc", "thumbnail_delta", "clean_delta", "own_auc"),
)
def development_selection(spark, d):
    """D-6 whole: the gates, the guard on the own source's data, and the best of the eligible models."""
    named = F.when(F.col("condition") == "view", "clean").when(F.col("condition") == "click", "resize_0.25").otherwise(F.col("condition"))
    blends = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("ord"), F.lit(w).alias("w")) for i, (m, w) in enumerate(BLENDS)])).alias("m")
    rows = scored_views(spark, d).select(named.alias("condition"), "sid", "y", "score_a", "score_b", blends).select("condition", "sid", "y", "m.model", "m.ord", ((1 - F.col("m.w")) * F.col("score_a") + F.col("m.w") * F.col("score_b")).alias("score"))
    return policy.development_selection(metrics.auc(rows, ["model", "ord", "condition"]), metrics.auc(rows.filter("sid <> 2"), ["model"]))


@query(
    f"""WITH {SCORED}, m AS (SELECT *, unnest(['m25', 'm50', 'm75', 'ref']) AS name, unnest([0.25, 0.5, 0.75, 1.0]) AS alpha FROM sv), s AS (SELECT *, alpha * score_a + (1 - alpha) * score_b AS score FROM m),
e AS (SELECT * FROM s WHERE domain = 'odd'), {sql_ranked('e', ['name'], 'score', 're')}, t AS (SELECT * FROM s WHERE sid <> 1), {sql_ranked('t', ['name'], 'score', 'rt')},
q AS (SELECT a.name, true AS bounds_supported, a.auc AS external_auc, b.auc AS tampered_auc, c.review_rate FROM (SELECT name, {AUC} AS auc FROM re GROUP BY name) a JOIN (SELECT name, {AUC} AS auc FROM rt GROUP BY name) b USING (name)
 JOIN (SELECT name, avg((NOT (score >= {HIGH} OR score <= {LOW}))::INT) AS review_rate FROM s GROUP BY name) c USING (name)),
f AS (SELECT *, external_auc >= (SELECT external_auc FROM q WHERE name = 'ref') - 0.005 AS external_ok, tampered_auc >= (SELECT tampered_auc FROM q WHERE name = 'ref') - 0.005 AS tampered_ok, review_rate < (SELECT review_rate FROM q WHERE name = 'ref') AS lower_review FROM q),
h AS (SELECT *, bounds_supported AND external_ok AND tampered_ok AND lower_review AND name <> 'ref' AS eligible FROM f)
SELECT *, name = coalesce((SELECT name FROM h WHERE eligible ORDER BY review_rate, name LIMIT 1), 'ref') AS selected FROM h""",
    ("external_auc", "tampered_auc", "review_rate"),
)
def release_gate(spark, d):
    """D-7: blends against a reference."""
    heads = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("m25", "m50", "m75", "ref"))), F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0))))).alias("name", "alpha")
    s = scored_views(spark, d).select("*", heads).withColumn("score", F.col("alpha") * F.col("score_a") + (1 - F.col("alpha")) * F.col("score_b"))
    external = metrics.auc(s.filter("domain = 'odd'"), ["name"], name="external_auc")
    tampered = metrics.auc(s.filter("sid <> 1"), ["name"], name="tampered_auc")
    review = metrics.operating_metrics(s, ["name"], "score", F.lit(HIGH), F.lit(LOW)).select("name", "review_rate")
    records = external.join(tampered, "name").join(review, "name").select("name", F.lit(True).alias("bounds_supported"), "external_auc", "tampered_auc", "review_rate")
    return policy.release_gate(records, "ref")


@query(f"WITH {SCORED} SELECT grp, condition, domain, sid, y, score_a, score_b FROM sv", ("score_a", "score_b"))
def scored_view_grid(spark, d):
    """The central relation itself."""
    return scored_views(spark, d)

