"""Queries on forecasts, baskets, customers and recommendations."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..config import Analysis, Report
from ..functions.draws import poisson_steps
from ..operators import baskets as b
from ..operators import customers as c
from ..operators import evidence as e
from ..operators import forecast as f
from ..operators import items as i
from ..operators import recommend as r
from ..plans.monthly import monthly_report
from ..plans.steps import next_steps
from ..sources.readers import weekly_long
from ..sources.stage import fresh_path as scratch
from .months import MOVES, actions_sql, effects, month_items
from .registry import check
from .rows import MERCH, WEEKLY_SQL, WEEKS, weekly_wide
from .sql import BLOCKS
from .tables import FORECAST, REPORT, forecast_grid, grid, kept, mapping, order_items, order_times, regular_times, source_rows, stored, table

DAYS = f.calendar_length(FORECAST)
PLAN = f.Plan.for_days(DAYS)
PARAMS = Analysis(min_confidence=0.1)


def arrays(spark, d):
    return f.arrays_of(forecast_grid(spark, d))


def eligible(spark, d):
    return f.eligibility(arrays(spark, d), DAYS)


def backtest(spark, d):
    def build():
        return f.backtest(arrays(spark, d), eligible(spark, d).filter("tested"), PLAN)

    return stored(spark, ("backtest", d), build)


def policy(spark, d):
    return f.select_policy(backtest(spark, d), PLAN.validation)


TESTED = "(SELECT item_id FROM ({}) WHERE tested)"
ELIGIBLE = """SELECT item_id, early IS NULL AS tested, coalesce(early, late) AS code FROM (SELECT item_id,
  CASE WHEN first > 639 THEN 'item_history_short' WHEN gap_early > 0 THEN 'missing_days' WHEN sell_early < 4 THEN 'early_sales_sparse' END AS early,
  CASE WHEN gap_late > 0 AND first > 822 THEN 'recent_history_short' WHEN gap_late > 0 THEN 'missing_days' WHEN sell_late < 4 THEN 'recent_sales_sparse' END AS late
FROM (SELECT item_id, any_value(first) AS first, count(*) FILTER (WHERE t >= first AND t < 667 AND quantity IS NULL) AS gap_early,
    count(*) FILTER (WHERE t >= 639 AND t < 667 AND quantity <> 0) AS sell_early, count(*) FILTER (WHERE t >= 822 AND quantity IS NULL) AS gap_late,
    count(*) FILTER (WHERE t >= 884 AND quantity <> 0) AS sell_late
  FROM (SELECT *, min(CASE WHEN quantity IS NOT NULL THEN t END) OVER (PARTITION BY item_id) AS first FROM {grid}) GROUP BY item_id))"""


@check("l17_eligibility", ELIGIBLE.replace("{grid}", "fgrid"))
def _(spark, d):
    return eligible(spark, d)


@check("l17_eligibility_with_gap", ELIGIBLE.replace("{grid}", "grid"))
def _(spark, d):
    return f.eligibility(f.arrays_of(grid(spark, d)), DAYS)


_ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in f.SIMPLE)


@check("l14_simple_forecasts", f"SELECT item_id, origin, stratum, actual, {_ROUND} FROM btest")
def _(spark, d):
    return f.simple_forecasts(arrays(spark, d), PLAN.origins)


_KEPT = TESTED.format(ELIGIBLE.replace("{grid}", "fgrid"))
BLOCKS["btested"] = f"SELECT * FROM btest WHERE item_id IN {_KEPT}"


@check("l16_backtest", f"SELECT item_id, origin, stratum, split, actual, {_ROUND} FROM btest WHERE item_id IN {_KEPT}")
def _(spark, d):
    return f.backtest(arrays(spark, d), eligible(spark, d).filter("tested"), PLAN)


@check("d23_errors", """
SELECT method, split, round(avg(off), 6) AS mae, round(sum(off) / nullif(sum(actual), 0), 6) AS wape, round(avg(bias), 6) AS bias, count(*) AS samples
FROM errs GROUP BY ALL
""")
def _(spark, d):
    return f.errors(backtest(spark, d))


@check("l18_select_policy", """
SELECT stratum, baseline, candidate, round(candidate_mae, 6) AS candidate_mae, round(baseline_mae, 6) AS baseline_mae, validation_adopted, selected, policy_adopted FROM policy
""")
def _(spark, d):
    return policy(spark, d)


@check("l18_test_support", """
SELECT p.stratum, round(avg(abs(chosen_value - actual)), 6) AS selected_mae, round(avg(abs(b - actual)), 6) AS baseline_mae,
  avg(abs(chosen_value - actual)) <= avg(abs(b - actual)) AS test_supported
FROM (SELECT *, CASE (SELECT baseline FROM base1) WHEN 'last_week' THEN last_week ELSE four_week_mean END AS b FROM picked WHERE split = 'test') p GROUP BY 1
""")
def _(spark, d):
    return f.test_support(backtest(spark, d), policy(spark, d))


RANGES = """
SELECT stratum, origins, round(radius, 6) AS radius, round(coverage, 6) AS coverage, round(coalesce(held, 0), 6) AS heldout_coverage,
  origins >= 20 AND coverage >= 0.8 AND late <= greatest(1, 1.5 * early) AS range_ok
FROM (SELECT r.*, (SELECT avg(CASE WHEN abs(chosen_value - actual) <= radius THEN 1.0 ELSE 0 END) FROM picked p WHERE split = 'calibration' AND p.stratum = r.stratum) AS coverage,
    (SELECT avg(CASE WHEN abs(chosen_value - actual) <= radius THEN 1.0 ELSE 0 END) FROM picked p WHERE split = 'test' AND p.stratum = r.stratum) AS held
  FROM (SELECT stratum, count(*) AS origins, quantile_cont(m, 0.9) AS radius, avg(m) FILTER (WHERE rl <= 5) AS late, avg(m) FILTER (WHERE re <= 10) AS early
    FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY origin DESC) AS rl, row_number() OVER (PARTITION BY stratum ORDER BY origin) AS re
      FROM (SELECT stratum, origin, median(abs(chosen_value - actual)) AS m FROM picked WHERE split = 'calibration' GROUP BY ALL)) GROUP BY stratum) r)
"""


@check("l19_calibration_ranges", RANGES)
def _(spark, d):
    return f.calibration_ranges(backtest(spark, d), policy(spark, d))


BLOCKS["npast"] = BLOCKS["past"].replace(", origins GROUP BY", ", (SELECT 912 AS origin) GROUP BY")
BLOCKS["nbtest"] = BLOCKS["btest"].replace("FROM past)", "FROM npast)")
_RANGED = "ok AND range_ok AND radius <= greatest(2, q)"
PUBLISH = f"""
SELECT item_id, code, CASE WHEN ok THEN method END AS method, stratum, CASE WHEN ok THEN round(q, 3) END AS quantity, CASE WHEN ok THEN round(mae, 3) END AS validation_mae,
  CASE WHEN ok THEN round(test_mae, 3) END AS test_mae, CASE WHEN {_RANGED} THEN greatest(0, round(q - radius, 3)) END AS lower, CASE WHEN {_RANGED} THEN round(q + radius, 3) END AS upper,
  '2001-07-01' AS start, '2001-07-07' AS "end"
FROM (SELECT *, code IS NULL AS ok FROM (SELECT e.item_id, n.method, n.stratum, n.q, h.mae, x.test_mae, g.radius, g.range_ok,
    CASE WHEN e.code IS NOT NULL THEN e.code WHEN coalesce(h.n, 0) = 0 THEN 'comparison_unavailable' WHEN h.mae > greatest(2, n.four_week_mean * 0.5) THEN 'validation_error' END AS code
  FROM ({ELIGIBLE.replace("{grid}", "fgrid")}) e
  LEFT JOIN (SELECT *, CASE method WHEN 'last_week' THEN last_week WHEN 'four_week_mean' THEN four_week_mean WHEN 'exponential_smoothing' THEN exponential_smoothing ELSE croston_sba END AS q
    FROM (SELECT b.*, coalesce(p.selected, (SELECT selected FROM policy WHERE stratum = 'all')) AS method FROM nbtest b LEFT JOIN policy p ON p.stratum = b.stratum)) n ON n.item_id = e.item_id
  LEFT JOIN (SELECT item_id, method, avg(off) FILTER (WHERE split = 'validation') AS mae, count(*) FILTER (WHERE split = 'validation') AS n FROM errs WHERE split IN ('validation', 'test') GROUP BY ALL) h
    ON h.item_id = e.item_id AND h.method = n.method
  LEFT JOIN (SELECT item_id, avg(abs(chosen_value - actual)) AS test_mae FROM picked WHERE split = 'test' GROUP BY 1) x ON x.item_id = e.item_id
  LEFT JOIN ({RANGES.replace("round(radius, 6)", "radius")}) g ON g.stratum = n.stratum))
"""


@check("l19_publish", PUBLISH)
def _(spark, d):
    return f.publish(backtest(spark, d), policy(spark, d), arrays(spark, d), eligible(spark, d), FORECAST)


@check("w18_trailing_features", """
SELECT item_id, t, round(scale, 6) AS scale, round(m7 / scale, 6) AS mean7, round(m14 / scale, 6) AS mean14, round(s28 / scale, 6) AS std28,
  round(nz / 28.0::DOUBLE, 6) AS nonzero_share, round(mp / scale, 6) AS week_before, round(mx / scale, 6) AS max28,
  round(least(coalesce(t - 1 - last, 28), 90) / 28.0::DOUBLE, 6) AS idle, round((w4 - w1) / (scale * 7), 6) AS week_slope,
  round((isodow(day) - 1) / 6.0::DOUBLE, 6) AS weekday, round(month(day) / 12.0::DOUBLE, 6) AS month, round(coalesce(gap / 28, 1.0), 6) AS median_gap
FROM (SELECT *, greatest(avg(quantity) OVER b28, 0.1) AS scale, count(quantity) OVER b28 AS k, avg(quantity) OVER b7 AS m7, avg(quantity) OVER b14 AS m14,
    stddev_pop(quantity) OVER b28 AS s28, count(*) FILTER (WHERE quantity <> 0) OVER b28 AS nz, max(quantity) OVER b28 AS mx,
    avg(quantity) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND 8 PRECEDING) AS mp,
    max(CASE WHEN quantity > 0 THEN t END) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
    sum(quantity) OVER b7 AS w4, sum(quantity) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN 28 PRECEDING AND 22 PRECEDING) AS w1,
    last_value(mg IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap
  FROM (SELECT g.*, x.mg FROM fgrid g LEFT JOIN (SELECT item_id, t, median(dt) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS mg
      FROM (SELECT item_id, t, CAST(t - lag(t) OVER (PARTITION BY item_id ORDER BY t) AS DOUBLE) AS dt FROM fgrid WHERE quantity > 0)) x ON x.item_id = g.item_id AND x.t = g.t)
  WINDOW b28 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), b7 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    b14 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) WHERE k = 28
""")
def _(spark, d):
    return f.trailing_features(forecast_grid(spark, d)).drop("day", "first", "next_week")


def day_features(spark, d):
    """Features of all item days and of the day after the calendar."""
    return stored(spark, ("day-features", d), lambda: f.trailing_features(f.with_next_day(forecast_grid(spark, d), DAYS)))


def boosted(spark, d):
    """The boosted method at every origin of the check and at the one to publish, grown in the same passes."""
    def build():
        keys = eligible(spark, d).filter("tested")
        found = f.boosted_forecasts(day_features(spark, d), keys, [*PLAN.origins, DAYS])
        return found if found is not None else spark.createDataFrame([], "item_id string, origin int, gradient_boosting double")

    return stored(spark, ("boosted", d), build)


def backtest_of_all(spark, d):
    def build():
        return f.backtest(arrays(spark, d), eligible(spark, d).filter("tested"), PLAN, boosted(spark, d).filter(F.col("origin") < DAYS))

    return stored(spark, ("backtest-of-all", d), build)


def policy_of_all(spark, d):
    return f.select_policy(backtest_of_all(spark, d), PLAN.validation)


@check("l15_gbt_forecast")
def _(spark, d):
    return boosted(spark, d)


@check("l16_backtest_of_all_methods")
def _(spark, d):
    return backtest_of_all(spark, d)


@check("d23_errors_of_all_methods")
def _(spark, d):
    return f.errors(backtest_of_all(spark, d))


@check("l18_policy_of_all_methods")
def _(spark, d):
    return policy_of_all(spark, d)


@check("l18_support_of_all_methods")
def _(spark, d):
    return f.test_support(backtest_of_all(spark, d), policy_of_all(spark, d))


@check("l19_ranges_of_all_methods")
def _(spark, d):
    return f.calibration_ranges(backtest_of_all(spark, d), policy_of_all(spark, d))


@check("l19_publish_of_all_methods")
def _(spark, d):
    latest = boosted(spark, d).filter(F.col("origin") == DAYS)
    return f.publish(backtest_of_all(spark, d), policy_of_all(spark, d), arrays(spark, d), eligible(spark, d), FORECAST, latest)


def v2_boosted(spark, d):
    def build():
        keys = f.v2_eligibility(arrays(spark, d), DAYS)
        found = f.boosted_forecasts(f.v2_features(f.with_next_day(forecast_grid(spark, d), DAYS)), keys, [*f.v2_origins(DAYS), DAYS], names=f.V2_FEATURES)
        return found if found is not None else spark.createDataFrame([], "item_id string, origin int, gradient_boosting double")

    return stored(spark, ("v2-boosted", d), build)


@check("l23_v2_features", """
SELECT item_id, t, first, round(scale, 6) AS scale, next_week, round(m7 / scale, 6) AS mean7, round(m14 / scale, 6) AS mean14, round(s28 / scale, 6) AS std28, round(nz / 28.0::DOUBLE, 6) AS nonzero_share,
  round(w1 / (scale * 7), 6) AS week, round(w2 / (scale * 7), 6) AS week_before, round(mx / scale, 6) AS max28, round(coalesce(t - 1 - last, 28) / 28.0::DOUBLE, 6) AS idle,
  round((isodow(day) - 1) / 6.0::DOUBLE, 6) AS weekday, round(month(day) / 12.0::DOUBLE, 6) AS month
FROM (SELECT *, min(CASE WHEN quantity IS NOT NULL THEN t END) OVER (PARTITION BY item_id) AS first, greatest(avg(quantity) OVER b28, 0.1) AS scale, count(quantity) OVER b28 AS k,
    avg(quantity) OVER b7 AS m7, avg(quantity) OVER b14 AS m14, stddev_pop(quantity) OVER b28 AS s28, count(*) FILTER (WHERE quantity <> 0) OVER b28 AS nz, sum(quantity) OVER b7 AS w1,
    sum(quantity) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND 8 PRECEDING) AS w2, max(quantity) OVER b28 AS mx,
    max(CASE WHEN quantity > 0 THEN t END) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
    CASE WHEN count(quantity) OVER ahead = 7 THEN sum(quantity) OVER ahead END AS next_week
  FROM fgrid WINDOW b28 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), b7 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    b14 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), ahead AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE k = 28
""")
def _(spark, d):
    return f.v2_features(forecast_grid(spark, d))


@check("l23_v2_gbt")
def _(spark, d):
    return v2_boosted(spark, d)


@check("l23_v2_publish")
def _(spark, d):
    own, found = arrays(spark, d), v2_boosted(spark, d)
    rows = f.v2_backtest(own, f.v2_eligibility(own, DAYS), DAYS, found)
    return f.v2_publish(rows, own, FORECAST, found.filter(F.col("origin") == DAYS))


@check("l23_v2_publish_of_simple_methods", """
SELECT * FROM (WITH rows AS (
  SELECT item_id, origin, actual, last_week, four_week_mean, CASE WHEN origin < 891 THEN 'validation' ELSE 'test' END AS split
  FROM btest WHERE origin >= 870 AND item_id IN (SELECT item_id FROM fgrid GROUP BY 1 HAVING count(*) FILTER (WHERE t >= 842 AND t < 870 AND quantity <> 0) >= 8
    AND count(*) FILTER (WHERE t < 842 AND quantity <> 0) >= 8)),
per AS (SELECT item_id, avg(abs(last_week - actual)) AS a, avg(abs(four_week_mean - actual)) AS b FROM rows WHERE split = 'validation' GROUP BY 1),
pick AS (SELECT CASE WHEN avg(abs(last_week - actual)) <= avg(abs(four_week_mean - actual)) THEN 'last_week' ELSE 'four_week_mean' END AS method FROM rows WHERE split = 'validation'),
now AS (SELECT item_id, sum(quantity) FILTER (WHERE t >= 905) AS last_week, sum(quantity) FILTER (WHERE t >= 884) / 4 AS four_week_mean FROM fgrid GROUP BY 1
  HAVING count(*) FILTER (WHERE t >= 884 AND quantity <> 0) >= 8 AND count(*) FILTER (WHERE t < 884 AND quantity <> 0) >= 8 AND 912 - min(t) FILTER (WHERE quantity <> 0) >= 90)
SELECT now.item_id, method, round(CASE method WHEN 'last_week' THEN last_week ELSE four_week_mean END, 3) AS quantity, round(CASE method WHEN 'last_week' THEN a ELSE b END, 3) AS validation_mae,
  '2001-07-01' AS start, '2001-07-07' AS "end"
FROM now JOIN per ON per.item_id = now.item_id, pick WHERE CASE method WHEN 'last_week' THEN a ELSE b END <= greatest(2, four_week_mean * 0.5))
""")
def _(spark, d):
    own = arrays(spark, d)
    return f.v2_publish(f.v2_backtest(own, f.v2_eligibility(own, DAYS), DAYS), own, FORECAST)


@check("l23_v2_backtest", """
SELECT item_id, origin, stratum, actual, last_week, four_week_mean, CASE WHEN origin < 891 THEN 'validation' ELSE 'test' END AS split
FROM btest WHERE origin >= 870 AND item_id IN (SELECT item_id FROM fgrid GROUP BY 1 HAVING count(*) FILTER (WHERE t >= 842 AND t < 870 AND quantity <> 0) >= 8
  AND count(*) FILTER (WHERE t < 842 AND quantity <> 0) >= 8)
""")
def _(spark, d):
    own = arrays(spark, d)
    return f.v2_backtest(own, f.v2_eligibility(own, DAYS), DAYS)


WEEKLY_ROWS = f"""(SELECT item_id, week AS origin, quantity AS actual, lag(quantity) OVER w AS last_week,
  avg(quantity) OVER (PARTITION BY item_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS four_week_mean,
  CASE WHEN week < 44 THEN 'validation' ELSE 'test' END AS split, 'all' AS stratum FROM {WEEKLY_SQL} WINDOW w AS (PARTITION BY item_id ORDER BY week) QUALIFY week >= 36)"""


@check("l24_weekly_backtest", f"SELECT item_id, origin, actual, last_week, round(four_week_mean, 6) AS four_week_mean, split, stratum FROM {WEEKLY_ROWS}")
def _(spark, d):
    return f.weekly_backtest(weekly_long(weekly_wide(spark, d), "item_id", WEEKS))


@check("l24_weekly_method", f"""
SELECT CASE WHEN avg(abs(last_week - actual)) <= avg(abs(four_week_mean - actual)) THEN 'last_week' ELSE 'four_week_mean' END AS method FROM {WEEKLY_ROWS} WHERE split = 'validation'
""")
def _(spark, d):
    return f.best_method(f.errors(f.weekly_backtest(weekly_long(weekly_wide(spark, d), "item_id", WEEKS))))


def weekly_boosted(spark, d):
    return stored(spark, ("weekly-boosted", d), lambda: f.weekly_boosted(weekly_long(weekly_wide(spark, d), "item_id", WEEKS)))


@check("l24_weekly_gbt")
def _(spark, d):
    return f.weekly_backtest(weekly_long(weekly_wide(spark, d), "item_id", WEEKS), boosted=weekly_boosted(spark, d))


@check("l24_weekly_method_of_three")
def _(spark, d):
    rows = f.weekly_backtest(weekly_long(weekly_wide(spark, d), "item_id", WEEKS), boosted=weekly_boosted(spark, d))
    return f.best_method(f.errors(rows))


# --- baskets -------------------------------------------------------------------------------------


def split_pairs(spark, d, part):
    labels = stored(spark, ("split", d), lambda: b.split(order_times(spark, d).select("order_id", "event_time")))
    build = lambda: order_items(spark, d).join(labels.filter(F.col("split") == part).select("order_id"), "order_id")
    return stored(spark, ("split-pairs", d, part), build)


def train_size(spark, d):
    return kept(spark, ("train-size", d), lambda: split_pairs(spark, d, "train").select("order_id").distinct().count())


def itemsets(spark, d):
    return stored(spark, ("itemsets", d), lambda: b.itemsets(split_pairs(spark, d, "train"), train_size(spark, d), PARAMS))


def mined(spark, d):
    """Rules with their Wilson bounds, before validation."""
    rules = b.rules(itemsets(spark, d), train_size(spark, d), PARAMS.min_confidence)
    lower, upper = b.wilson(F.col("n_ab"), F.col("n_a"))
    return rules.withColumns({"leverage": b.leverage(), "confidence_lower": lower, "confidence_upper": upper})


@check("d20_baskets", "SELECT order_id, item_id FROM bpairs")
def _(spark, d):
    return order_items(spark, d)


@check("d20_popularity", "SELECT item_id, count(*) AS orders FROM bpairs GROUP BY 1")
def _(spark, d):
    return b.popularity(order_items(spark, d))


@check("l01_split", "SELECT order_id, CAST(tm AS VARCHAR) AS event_time, split, 'chronological' AS split_mode FROM bsplit")
def _(spark, d):
    return b.split(order_times(spark, d).select("order_id", "event_time"))


@check("l01_random_split", """
SELECT order_id, NULL::VARCHAR AS event_time, CASE WHEN k < c0 THEN 'train' WHEN k < c1 THEN 'validation' ELSE 'test' END AS split, 'random' AS split_mode
FROM (SELECT *, max(k) FILTER (WHERE r = least(n - 1, floor(n * 0.6::DOUBLE))) OVER () AS c0, max(k) FILTER (WHERE r = least(n - 1, floor(n * 0.8::DOUBLE))) OVER () AS c1
  FROM (SELECT order_id, k, dense_rank() OVER (ORDER BY k) - 1 AS r, (SELECT count(DISTINCT substr(md5(order_id || ':42'), 1, 15)) FROM btimes) AS n
    FROM (SELECT order_id, substr(md5(order_id || ':42'), 1, 15) AS k FROM btimes)))
""")
def _(spark, d):
    unknown = order_times(spark, d).select("order_id", F.lit(None).cast("timestamp").alias("event_time"))
    return b.split(unknown)


@check("l02_itemsets", "SELECT array_to_string(items, ',') AS items, n FROM sets")
def _(spark, d):
    return b.itemsets(split_pairs(spark, d, "train"), train_size(spark, d), PARAMS)


_RULE = "antecedents, consequents, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, n_ab, n_a, n_b, CAST(denominator AS BIGINT) AS denominator"


@check("l03_rules", f"SELECT {_RULE} FROM mined")
def _(spark, d):
    return b.rules(itemsets(spark, d), train_size(spark, d), PARAMS.min_confidence).drop("antecedent_items", "consequent_items")


@check("l04_wilson", """
SELECT antecedents, consequents, round(confidence_lower, 6) AS confidence_lower, round(confidence_upper, 6) AS confidence_upper, round(leverage, 6) AS leverage FROM mined
""")
def _(spark, d):
    return mined(spark, d).select("antecedents", "consequents", "confidence_lower", "confidence_upper", "leverage")


VCOUNT = """(SELECT m.*, (SELECT count(*) FROM vb WHERE list_has_all(basket, a)) AS va, (SELECT count(*) FROM vb WHERE list_has_all(basket, b)) AS vb_n,
  (SELECT count(*) FROM vb WHERE list_has_all(basket, list_concat(a, b))) AS vab, (SELECT count(*) FROM vb) AS vn FROM mined m)"""
VB = "vb AS (SELECT order_id, list(item_id) AS basket FROM valid GROUP BY 1)"


@check("j11_containment_counts", """
SELECT * FROM (WITH vb AS (SELECT order_id, list(item_id) AS basket FROM valid GROUP BY 1)
SELECT array_to_string(items, ',') AS items, count(*) AS baskets FROM sets JOIN vb ON list_has_all(basket, items) GROUP BY 1)
""")
def _(spark, d):
    return b.containment_counts(itemsets(spark, d), split_pairs(spark, d, "validation"))


@check("l05_qualify", f"""
SELECT * FROM (WITH {VB} SELECT {_RULE}, va AS validation_n_a, vb_n AS validation_n_b, vab AS validation_n_ab, round(vab * vn / (va * vb_n), 6) AS validation_lift
FROM {VCOUNT} WHERE lift > 1 AND leverage > 0 AND confidence_lower > n_b / denominator AND vab >= 3 AND vab * vn / (va * vb_n) > 1)
""")
def _(spark, d):
    found = b.qualify(b.rules(itemsets(spark, d), train_size(spark, d), PARAMS.min_confidence), split_pairs(spark, d, "validation"))
    return found.select(
        "antecedents", "consequents", "support", "confidence", "lift", "n_ab", "n_a", "n_b", "denominator",
        "validation_n_a", "validation_n_b", "validation_n_ab", "validation_lift",
    )


ORDER = "confidence_lower DESC, leverage DESC, n_ab DESC, lift DESC, antecedents, consequents"


@check("w22_merge_reciprocal", f"""
SELECT antecedents, consequents, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY list_sort(list_concat(a, b)) ORDER BY {ORDER}) AS r FROM mined WHERE lift > 1) WHERE r = 1
""")
def _(spark, d):
    return b.merge_reciprocal(mined(spark, d)).select("antecedents", "consequents", "lift")


@check("w21_cards", f"""
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS place, antecedents, consequents, round(lift, 6) AS lift FROM (WITH RECURSIVE best AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY {ORDER}) AS place FROM (SELECT *, list_sort(list_concat(a, b)) AS items, row_number() OVER (PARTITION BY list_sort(list_concat(a, b)) ORDER BY {ORDER}) AS r FROM mined) WHERE r = 1),
  walk AS (SELECT 0::BIGINT AS place, []::VARCHAR[] AS used, 0 AS shown, FALSE AS taken
    UNION ALL SELECT next, CASE WHEN ok THEN list_concat(used, items) ELSE used END, shown + ok::INT, ok
    FROM (SELECT w.used, w.shown, o.place AS next, o.items, w.shown < 50 AND len(list_filter(o.items, lambda i: len(list_filter(w.used, lambda u: u = i)) >= 5)) = 0 AS ok FROM walk w JOIN best o ON o.place = w.place + 1))
SELECT o.* FROM walk w JOIN best o ON o.place = w.place WHERE taken)
""")
def _(spark, d):
    shown = b.cards(mined(spark, d))
    rows = [(k + 1, x["antecedents"], x["consequents"], float(x["lift"])) for k, x in enumerate(shown)]
    return spark.createDataFrame(rows, "place int, antecedents string, consequents string, lift double")


@check("w23_recommend", """
SELECT * FROM (WITH vb AS (SELECT order_id, list(item_id) AS basket FROM valid GROUP BY 1)
SELECT order_id, item_id, CAST(r AS INTEGER) AS rank FROM (SELECT order_id, item_id, row_number() OVER (PARTITION BY order_id ORDER BY s.cl DESC, s.l DESC, s.n DESC, item_id) AS r
  FROM (SELECT order_id, item_id, max(s) AS s FROM (SELECT order_id, basket, unnest(b) AS item_id, {'cl': confidence_lower, 'l': lift, 'n': n_ab} AS s
    FROM vb JOIN mined ON list_has_all(basket, a)) WHERE NOT list_contains(basket, item_id) GROUP BY ALL)) WHERE r <= 5)
""")
def _(spark, d):
    return b.recommend(split_pairs(spark, d, "validation"), mined(spark, d))


@check("w24_popular", """
SELECT order_id, item_id, CAST(r AS INTEGER) AS rank FROM (SELECT o.order_id, p.item_id, row_number() OVER (PARTITION BY o.order_id ORDER BY p.n DESC, p.item_id) AS r
  FROM (SELECT DISTINCT order_id FROM valid) o CROSS JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) p
  WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.order_id = o.order_id AND v.item_id = p.item_id)) WHERE r <= 5
""")
def _(spark, d):
    popular = b.popularity(split_pairs(spark, d, "train"))
    return b.popular_for(split_pairs(spark, d, "validation"), popular)


def cases(spark, d):
    def build():
        train = split_pairs(spark, d, "train")
        popular = b.popularity(train)
        return b.completion_cases(split_pairs(spark, d, "test"), popular, mined(spark, d), popular, 43)

    return stored(spark, ("cases", d), build)


@check("l06_completion", """
SELECT count(*) AS baskets, round(sum(hit) / (count(*) * 5.0::DOUBLE), 6) AS precision_at_5, round(avg(hit), 6) AS hit_rate_at_5, round(avg((len(recs) > 0)::INT), 6) AS recommendation_coverage,
  round(avg(popular_hit), 6) AS popularity_hit_rate_at_5, round(avg((len(pops) > 0)::INT), 6) AS popularity_coverage, round(avg(list_contains(hybrid, target)::INT), 6) AS hybrid_hit_rate_at_5,
  round(avg(len(recs)), 6) AS mean_list_length, round(avg(len(hybrid)), 6) AS hybrid_mean_list_length, round(avg(hit - popular_hit), 6) AS paired_hit_difference
FROM bcases
""")
def _(spark, d):
    return b.basket_metrics(cases(spark, d))


@check("d24_strata", """
SELECT CASE WHEN target IN (SELECT item_id FROM (SELECT item_id, count(*) AS n FROM train GROUP BY 1) ORDER BY n DESC, item_id
    LIMIT (SELECT greatest(1, CAST(floor(count(DISTINCT item_id) * 0.2::DOUBLE) AS INTEGER)) FROM train)) THEN 'popular' ELSE 'other' END AS stratum,
  count(*) AS cases, round(avg(hit), 6) AS rule_hit_rate, round(avg(popular_hit), 6) AS popular_hit_rate
FROM bcases GROUP BY 1
""")
def _(spark, d):
    return b.strata_metrics(cases(spark, d), b.popular_head(b.popularity(split_pairs(spark, d, "train"))))


@check("d24_popular_head", """
SELECT item_id FROM (SELECT item_id, count(*) AS n FROM train GROUP BY 1) ORDER BY n DESC, item_id
LIMIT (SELECT greatest(1, CAST(floor(count(DISTINCT item_id) * 0.2::DOUBLE) AS INTEGER)) FROM train)
""")
def _(spark, d):
    return b.popular_head(b.popularity(split_pairs(spark, d, "train")))


_STEPS = " + ".join(f"(u >= {s})::INT" for s in poisson_steps())


@check("l07_bootstrap", f"""
SELECT max(blocks) AS blocks, round(CASE WHEN max(blocks) >= 20 THEN quantile_cont(estimate, 0.025) END, 6) AS lower, round(CASE WHEN max(blocks) >= 20 THEN quantile_cont(estimate, 0.975) END, 6) AS upper
FROM (SELECT draw, sum(w * difference) / nullif(sum(w * size), 0)::DOUBLE AS estimate, count(*) AS blocks
  FROM (SELECT draw, difference, size, {_STEPS} AS w
    FROM (SELECT draw, difference, size, CAST('0x' || substr(md5(customer_id || ':' || (draw // 4) || ':1042'), 8 * (draw % 4) + 1, 8) AS BIGINT) AS u
      FROM (SELECT customer_id, sum(hit - popular_hit) AS difference, count(*) AS size FROM bcases c JOIN btimes t ON t.order_id = c.order_id GROUP BY 1), (SELECT CAST(d AS INTEGER) AS draw FROM range(500) r(d))))
  GROUP BY draw)
""")
def _(spark, d):
    owners = order_times(spark, d).select("order_id", "customer_id")
    return b.bootstrap(cases(spark, d).join(owners, "order_id"), "customer_id")


# --- customers -----------------------------------------------------------------------------------

RFM = """(SELECT customer_id, CAST(greatest(0, floor(date_diff('second', max(tm), (SELECT CAST(CAST(max(tm) AS DATE) + 1 AS TIMESTAMP) FROM btimes)) / 86400.0::DOUBLE)) AS BIGINT) AS recency_days,
  count(DISTINCT b.order_id) AS frequency, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS monetary
FROM btimes b JOIN orders ON CAST(o_orderkey AS VARCHAR) = b.order_id GROUP BY customer_id)"""


def features(spark, d):
    return c.rfm_features(order_times(spark, d))


@check("d21_rfm_features", f"SELECT * FROM {RFM}")
def _(spark, d):
    return features(spark, d)


@check("d21_event_features", """
SELECT customer_id, CAST(floor(date_diff('second', date_trunc('second', last), stop) / 86400.0::DOUBLE) AS BIGINT) AS recency_days, n AS frequency FROM (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, max(ts) AS last, count(*) AS n,
    (SELECT CAST(CAST(max(ts) AS DATE) + 1 AS TIMESTAMP) FROM events WHERE event_type = 'purchase') AS stop FROM events WHERE event_type = 'purchase' GROUP BY 1)
""")
def _(spark, d):
    bought = table(spark, d, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("customer_id"), F.col("event_id").cast("string").alias("order_id"),
        F.date_trunc("second", "ts").alias("event_time"), F.col("value").cast("decimal(18,2)").alias("amount"),
    )
    return c.rfm_features(bought, "rf")


@check("l08_robust_scale", f"""
SELECT customer_id, {', '.join(f"round(({x} - q2_{x}) / CASE WHEN q3_{x} = q1_{x} THEN 1 ELSE q3_{x} - q1_{x} END, 6) AS {x}" for x in ('recency_days', 'frequency', 'monetary'))}
FROM (SELECT customer_id, {', '.join(f"ln(1 + {x}::DOUBLE) AS {x}" for x in ('recency_days', 'frequency', 'monetary'))} FROM {RFM}),
  (SELECT {', '.join(f"quantile_cont(ln(1 + {x}::DOUBLE), {q}) AS q{k}_{x}" for x in ('recency_days', 'frequency', 'monetary') for k, q in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM {RFM})
""")
def _(spark, d):
    return c.robust_scale(features(spark, d), ["recency_days", "frequency", "monetary"])


SEGMENTS = """(SELECT f.*, c_nationkey AS cluster FROM {} f JOIN customer ON CAST(c_custkey AS VARCHAR) = f.customer_id)""".format(RFM)


@check("d22_cluster_profile", f"""
SELECT cluster, count(*) AS customers, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share, median(recency_days) AS recency_days_median,
  median(frequency)::DOUBLE AS frequency_median, round(median(monetary), 6) AS monetary_median FROM {SEGMENTS} GROUP BY cluster
""")
def _(spark, d):
    nation = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_nationkey").alias("cluster"))
    return c.cluster_profile(features(spark, d).join(nation, "customer_id"))


def groups(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _GROUPS:
        _GROUPS[key] = c.choose_k(features(spark, d), ["recency_days", "frequency", "monetary"])
    return _GROUPS[key]


_GROUPS: dict = {}


@check("l10_silhouette", """
SELECT * FROM (WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey % 5 AS cl, CAST(c_acctbal AS DOUBLE) / 1000 AS x, CAST(c_nationkey % 7 AS DOUBLE) AS y FROM customer
    ORDER BY substr(md5(c_custkey || ':42'), 1, 15) LIMIT 2000),
  d AS (SELECT a.id, a.cl = b.cl AS own, b.cl, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS t, count(*) AS n FROM s a CROSS JOIN s b GROUP BY ALL),
  p AS (SELECT id, max(t / nullif(n - 1, 0)) FILTER (WHERE own) AS inside, min(t / n) FILTER (WHERE NOT own) AS outside FROM d GROUP BY id)
SELECT 5 AS k, round(avg(coalesce((outside - inside) / nullif(greatest(inside, outside), 0), 0)), 6) AS silhouette FROM p)
""")
def _(spark, d):
    """Customers by the fifth part of nations, on two plain measures."""
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.lit(5).alias("k"), (F.col("c_nationkey") % 5).cast("int").alias("cluster"),
        (F.col("c_acctbal").cast("double") / 1000).alias("x"), (F.col("c_nationkey") % 7).cast("double").alias("y"),
    )
    return c.silhouette(rows, "customer_id", ["x", "y"], 42)


@check("l12_choose_k")
def _(spark, d):
    return groups(spark, d)[0]


@check("l09_assignments")
def _(spark, d):
    candidates, labels = groups(spark, d)
    return labels.join(F.broadcast(c.best_candidate(candidates).select("k")), "k")


@check("l11_ari", """
SELECT * FROM (WITH cells AS (SELECT c_nationkey AS x, c_mktsegment AS y, count(*) AS n FROM customer GROUP BY ALL),
  s AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ab, sum(n)::DOUBLE AS n FROM cells),
  r AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS a FROM (SELECT sum(n)::DOUBLE AS n FROM cells GROUP BY x)),
  q AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS b FROM (SELECT sum(n)::DOUBLE AS n FROM cells GROUP BY y))
SELECT 1 AS grp, round((ab - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s, r, q)
""")
def _(spark, d):
    pairs = table(spark, d, "customer").select(F.lit(1).alias("grp"), F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"))
    return c.ari(pairs, ["grp"])


GAPS = """(SELECT customer_id, count(*) AS purchase_days, median(gap)::DOUBLE AS usual, quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25) AS iqr, max(gap) AS widest,
  max(day) AS last FROM (SELECT customer_id, day, CAST(date_diff('day', lag(day) OVER (PARTITION BY customer_id ORDER BY day), day) AS DOUBLE) AS gap
    FROM (SELECT DISTINCT customer_id, CAST(tm AS DATE) AS day FROM btimes WHERE tm < TIMESTAMP '2001-08-02')) GROUP BY customer_id)"""
FOLLOW = f"""(SELECT customer_id, purchase_days, usual AS usual_gap_days, last AS last_purchase, date_diff('day', last, DATE '2001-08-02') AS days_since_purchase,
  greatest(usual * 1.5, usual + 7) AS threshold_days FROM {GAPS} WHERE purchase_days >= 4 AND usual >= 1 AND iqr <= usual * 0.5 AND widest <= usual * 2
  AND date_diff('day', last, DATE '2001-08-02') > greatest(usual * 1.5, usual + 7) AND date_diff('day', last, DATE '2001-08-02') <= greatest(90, usual * 3))"""
REFERENCE = date(2001, 8, 2)
# the same with every tenth customer buying regularly until they stop
REGULAR = FOLLOW.replace("btimes", "rtimes")


def customers(spark, d):
    return kept(spark, ("regular-customers", d), lambda: regular_times(spark, d).select("customer_id").distinct().count())


def regular_summary(spark, d):
    found = stored(spark, ("followups", d), lambda: c.followups(regular_times(spark, d), REFERENCE))
    return c.followup_summary(found, customers(spark, d))


@check("w16_followups", f"SELECT * REPLACE (CAST(last_purchase AS VARCHAR) AS last_purchase) FROM {FOLLOW}")
def _(spark, d):
    return c.followups(order_times(spark, d), REFERENCE)


@check("w16_followup_summary", f"""
SELECT count(*) AS customers, median(purchase_days)::DOUBLE AS purchase_days_median, median(usual_gap_days) AS usual_gap_median,
  median(days_since_purchase)::DOUBLE AS elapsed_median FROM {REGULAR} HAVING count(*) >= greatest(10, 0.01 * (SELECT count(DISTINCT customer_id) FROM rtimes))
""")
def _(spark, d):
    return regular_summary(spark, d)


@check("l13_item_clusters")
def _(spark, d):
    """Part names as items, on the year before August 2001."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    window = Report(month="2001-07", coverage_start=date(2000, 8, 1), coverage_end=date(2001, 7, 31), complete_coverage=True)
    daily = lines.groupBy(F.to_date("l_shipdate").alias("day"), F.col("p_name").alias("item_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("amount"), F.lit(0).alias("amount_missing")
    )
    names = daily.groupBy("item_id").agg(F.min("day").alias("first_day"))
    profile = i.item_profile(i.item_day_grid(daily, names, window), window)
    change = i.week_change(i.month_series(daily, names, window), window).select("item_id", F.col("early_change").alias("change"))
    amounts = daily.filter(F.date_format("day", "yyyy-MM") == "2001-07").groupBy("item_id").agg(F.sum("amount").alias("amount"))
    found = c.item_clusters(amounts.join(profile, "item_id").join(change, "item_id"), Analysis(k_max=6))
    none = spark.createDataFrame([], c.CANDIDATES).withColumnRenamed("publishable", "numeric_gate").withColumn("publishable", F.lit(False))
    return found[0] if found else none


# --- recommendations -----------------------------------------------------------------------------


@check("k01_period_guard", """
SELECT run_id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey % 3 AS v, o_orderkey % 2 AS rev, CAST(o_orderdate AS DATE) AS latest, o_orderstatus AS st FROM orders)
WHERE v = 1 AND rev = 0 AND st <> 'F' AND latest BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'
""")
def _(spark, d):
    """Every order stands for one stored analysis run."""
    day = F.to_date("o_orderdate")
    runs = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), (F.col("o_orderkey") % 3).alias("version_id"),
        (F.col("o_orderkey") % 2).alias("mapping_revision"), F.lit("drop_exact").alias("duplicates"), F.lit(False).alias("filtered"),
        (F.col("o_orderstatus") != "F").alias("publishable"), F.lit(date(1999, 1, 1)).alias("scope_start"),
        F.lit(None).cast("date").alias("scope_end"), day.alias("latest_day"), F.date_add(day, 1).alias("reference_day"),
    )
    sources = spark.createDataFrame([(1, 0)], "version_id long, mapping_revision long")
    return r.period_guard(runs, REPORT, sources).select("run_id")


ON_ITEMS = f"""(SELECT m.antecedents, m.consequents, count(*) AS found, sum(coalesce(g.amount, 0)) AS group_amount, sum(g.quantity) AS group_quantity
  FROM (SELECT antecedents, consequents, unnest(list_concat(a, b)) AS item_id, len(a) + len(b) AS size FROM mined) m
  JOIN (SELECT * FROM items WHERE {MERCH}) g ON g.item_id = m.item_id GROUP BY m.antecedents, m.consequents HAVING count(*) = max(size))"""


@check("j12_rules_on_items", f"SELECT antecedents, consequents, round(group_amount, 4) AS group_amount, group_quantity FROM {ON_ITEMS}")
def _(spark, d):
    found = r.rules_on_items(mined(spark, d), month_items(spark, d))
    return found.select("antecedents", "consequents", F.round("group_amount", 4).alias("group_amount"), "group_quantity")


def counted(spark, d):
    """Mined rules with validation counts but without the qualification filter."""
    def build():
        return b.qualify(mined(spark, d).drop("leverage", "confidence_lower", "confidence_upper"), split_pairs(spark, d, "validation"))

    return stored(spark, ("counted", d), build)


PAIRINGS = f"""
SELECT * FROM (WITH {VB}, q AS (SELECT * FROM {VCOUNT} WHERE lift > 1 AND leverage > 0 AND confidence_lower > n_b / denominator AND vab >= 3 AND vab * vn / (va * vb_n) > 1),
  s AS (SELECT q.*, g.group_amount / (SELECT sum(coalesce(amount, 0)) FROM items WHERE {MERCH}) AS reach,
    least((confidence_lower - n_b / denominator) / greatest(1 - n_b / denominator, 0.001), (vab / va - vb_n / vn) / greatest(1 - vb_n / vn, 0.001)) AS strength
    FROM q JOIN {ON_ITEMS} g ON g.antecedents = q.antecedents AND g.consequents = q.consequents WHERE n_ab >= 20 AND n_a > n_ab AND vab / va > vb_n / vn)
SELECT antecedents, consequents, array_to_string(items, ',') AS related_items, round(reach, 6) AS reach, round(strength, 6) AS strength, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY items ORDER BY score DESC, antecedents, consequents) AS r FROM (
  SELECT *, reach * strength * least(vab / 20, 1) AS score, list_sort(list_concat(a, b)) AS items FROM s WHERE reach >= 0.002)) WHERE r = 1)
"""


@check("k02_pairings", PAIRINGS)
def _(spark, d):
    return r.pairings(counted(spark, d), month_items(spark, d))


FOLLOWUP = f"""
SELECT 'customer-followup' AS strategy, round(n / total::DOUBLE * 0.25, 6) AS score FROM (SELECT count(*) AS n FROM {REGULAR}), (SELECT count(DISTINCT customer_id) AS total FROM rtimes)
WHERE n >= greatest(10, 0.01 * total)
"""


@check("k03_followup_action", FOLLOWUP)
def _(spark, d):
    return r.followup_action(regular_summary(spark, d), customers(spark, d))


@check("k04_combine", f"""
SELECT CAST(place AS INTEGER) AS place, id, strategy, round(score, 6) AS score FROM (WITH RECURSIVE cand AS MATERIALIZED (
    SELECT 'action:' || item_id AS id, CASE WHEN item_type = 'physical' THEN 'procurement-' ELSE 'sales-' END || signal AS strategy,
      least(impact / (SELECT sum(amount) FROM items), 1) * 0.8 AS score, [item_id] AS items FROM ({actions_sql(MOVES, 1, "monthly", "").replace("round(impact, 6)", "impact")})
    UNION ALL SELECT 'pairing:' || replace(related_items, ',', '|'), 'pairing', exact, string_split(related_items, ',') FROM ({PAIRINGS.replace("round(score, 6) AS score", "score AS exact")})
    UNION ALL SELECT 'customer:followup', strategy, exact, []::VARCHAR[] FROM ({FOLLOWUP.replace("round(n / total::DOUBLE * 0.25, 6) AS score", "n / total::DOUBLE * 0.25 AS exact")})),
  walk AS (SELECT 0 AS place, ''::VARCHAR AS id, []::VARCHAR[] AS done, []::VARCHAR[] AS covered, ''::VARCHAR AS strategy, 0::DOUBLE AS score
    UNION ALL SELECT place + 1, id, list_append(done, strategy), list_concat(covered, items), strategy, score
    FROM (SELECT w.place, w.done, w.covered, c.id, c.strategy, c.score::DOUBLE AS score, c.items,
        row_number() OVER (ORDER BY c.score * (1 - 0.6 * coalesce(len(list_intersect(c.items, w.covered)) / nullif(len(list_distinct(c.items)), 0)::DOUBLE, 0)) DESC, c.id) AS r
      FROM walk w JOIN cand c ON NOT list_contains(w.done, c.strategy) WHERE w.place < 3) WHERE r = 1)
SELECT * FROM walk WHERE place > 0)
""")
def _(spark, d):
    items = month_items(spark, d)
    total = items.agg(F.sum("amount")).first()[0]
    sales = r.action_pool(e.actions(items, effects(spark, d), None, REPORT, n=None), total)
    pairs = r.pairing_pool(r.pairings(counted(spark, d), items))
    follow = r.followup_pool(r.followup_action(regular_summary(spark, d), customers(spark, d)))
    return r.combine(sales.unionByName(pairs).unionByName(follow))


@check("k05_stock_reference", f"""
SELECT item_id, start, "end", quantity, ceil(greatest(0, q + 5 - available - 2) / 2.5) * 2.5 AS suggested_quantity
FROM (SELECT f.*, CAST(f.quantity AS DECIMAL(18,6)) AS q, CAST(length(f.item_id) AS INTEGER) * 3 AS available FROM ({PUBLISH}) f LEFT JOIN items i ON i.item_id = f.item_id
  WHERE f.quantity IS NOT NULL AND coalesce(i.item_type, 'unknown') NOT IN ('fee_service', 'accounting'))
""")
def _(spark, d):
    """The published forecast; stock figures follow from the item's id."""
    own = arrays(spark, d)
    forecast = f.publish(backtest(spark, d), policy(spark, d), own, eligible(spark, d), FORECAST)
    stock = own.select(
        "item_id", F.lit(date(2001, 7, 1)).alias("snapshot_date"), F.lit(5.0).alias("reserve"), (F.length("item_id") * 3.0).alias("available"),
        F.lit(2.0).alias("incoming"), F.lit(date(2001, 7, 3)).alias("arrival_date"), F.lit(2.5).alias("pack_size"),
        F.lit(True).alias("confirmed"), F.lit(True).alias("physical_confirmed"),
    )
    return r.stock_reference(forecast.select("item_id", "quantity", "start", "end"), stock, month_items(spark, d))


@check("j13_with_stock", "SELECT o_orderkey AS item_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.to_date("o_orderdate").alias("start"), F.lit(1.0).alias("quantity"))
    stock = orders.select("item_id", F.date_add("start", (F.col("item_id") % 2).cast("int")).alias("snapshot_date"))
    return r.with_stock(orders, stock).select("item_id", "start")




def own_steps(spark, d):
    """The whole way of the shared report: month, admitted orders, both analyses, their runs, next steps."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STEPS:
        rows = source_rows(spark, d)
        parts = [(rows.filter(F.col("version_id") == v), mapping()) for v in ("v1", "v2")]
        month = monthly_report(parts, FORECAST, trees=0, stored=rows)
        _STEPS[key] = next_steps(month, [mapping(), mapping()], FORECAST, scratch(spark, "runs"), datetime(2001, 7, 1), Analysis(min_confidence=0.1, k_max=4, n_init=3))
    return _STEPS[key]


_STEPS: dict = {}


@check("k01_runs_of_the_report")
def _(spark, d):
    """The runs that the plan entered in its ledger and that the guard lets join the report."""
    return own_steps(spark, d)["runs"].drop("run_id", "version_id", "mapping_revision")


@check("k04_steps_of_the_report")
def _(spark, d):
    return own_steps(spark, d)["steps"]


@check("j09_admitted_rows", """
SELECT version_id, source_row_id, CASE WHEN reason = 'order_conflict' THEN 'unknown' ELSE record_status END AS record_status FROM lab
WHERE reason NOT IN ('outside_scope', 'replaced_range', 'duplicate_removed')
""")
def _(spark, d):
    return own_steps(spark, d)["admitted"].select("version_id", "source_row_id", "record_status")
