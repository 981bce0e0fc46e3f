"""Queries on the monthly report: totals, item evidence, focus and order concentration."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import anomaly as a
from ..operators import evidence as e
from ..operators import items as i
from ..operators import normalize as n
from ..operators import sales as s
from .registry import check
from .rows import MERCH
from .tables import REPORT, UNKNOWN, anomaly_days, facts, grid, labelled, mapping, stored, table

LINE = mapping()


def month_items(spark, d):
    def build():
        rows = included(spark, d)
        return i.item_month(s.daily_fact(rows, LINE), s.item_names(rows), n.item_types(rows, REPORT), LINE, REPORT, comparable=True)

    return stored(spark, ("items", d), build)


def included(spark, d):
    """The included rows with what days, names and kinds of items read; labelled once for the three."""
    columns = ("day", "item_id", "quantity", "line_amount", "currency", "issues", "reason", "item_name", "category", "item_type", *s.ROW_ORDER)
    return stored(spark, ("included", d), lambda: facts(spark, d)[0].filter("reason = 'included'").select(*columns))


def effects(spark, d):
    return stored(spark, ("effects", d), lambda: i.price_volume(facts(spark, d)[1], REPORT))


def series(spark, d):
    _, daily, names = facts(spark, d)
    return i.month_series(daily, names, REPORT, UNKNOWN)


def flagged(spark, d):
    items = month_items(spark, d)
    return i.flags(items, i.week_change(series(spark, d), REPORT), i.abc(items), anomaly_days(spark, d))


def days_evidence(spark, d):
    return e.with_anomalies(series(spark, d), anomaly_days(spark, d))


def signals(spark, d):
    shown = days_evidence(spark, d)
    return e.trend4(shown, REPORT), e.spike(shown, month_items(spark, d), REPORT)


@check("d10_daily_fact", """
SELECT CAST(day AS VARCHAR) AS day, item_id, CAST(quantity AS DOUBLE) AS quantity, CAST(amount AS DOUBLE) AS amount, amount_missing FROM daily
""")
def _(spark, d):
    return facts(spark, d)[1]


@check("d11_item_names", "SELECT item_id, name, category, CAST(first_day AS VARCHAR) AS first_day FROM names")
def _(spark, d):
    return facts(spark, d)[2]


def totals_sql(lab: str, amount: str) -> str:
    return f"""
SELECT m.month, coalesce(CAST(sum(quantity) FILTER (WHERE inc) AS DOUBLE), 0) AS quantity, {amount} AS amount,
  count(*) FILTER (WHERE inc AND MODE_LINE AND NOT coalesce(line_amount >= 0 AND currency IS NOT NULL, FALSE)) AS amount_missing_rows,
  CASE WHEN count(*) FILTER (WHERE broken) = 0 AND count(DISTINCT (version_id, order_id)) FILTER (WHERE inc) > 0
       THEN count(DISTINCT (version_id, order_id)) FILTER (WHERE inc) END AS orders,
  CASE WHEN count(*) FILTER (WHERE reason = 'returned' AND NOT (MODE_LINE AND line_amount IS NOT NULL AND currency IS NOT NULL)) = 0
       THEN CAST(sum(abs(line_amount)) FILTER (WHERE reason = 'returned' AND currency IS NOT NULL) AS DOUBLE) END AS refund_amount
FROM (VALUES ('2001-06'), ('2001-05')) m(month) LEFT JOIN (SELECT *, strftime(day, '%Y-%m') AS mm, reason = 'included' AS inc,
  reason IN ('invalid_quantity', 'missing_item', 'order_conflict', 'unknown_status') AS broken FROM {lab}) ON mm = m.month GROUP BY m.month
"""


@check("d12_month_totals", totals_sql("lab", """CASE WHEN count(*) FILTER (WHERE inc AND NOT coalesce(line_amount >= 0 AND currency IS NOT NULL, FALSE)) = 0
  THEN CAST(sum(line_amount) FILTER (WHERE inc) AS DOUBLE) END""").replace("MODE_LINE", "TRUE"))
def _(spark, d):
    return s.month_totals(labelled(spark, d), LINE, REPORT)


@check("d12_order_totals", totals_sql("lab_total", "CAST(NULL AS DOUBLE)").replace("MODE_LINE", "FALSE"))
def _(spark, d):
    return s.month_totals(labelled(spark, d, "order_amount"), mapping("order_amount"), REPORT)


@check("d13_summary", """
SELECT '2001-06' AS month, max(q) FILTER (WHERE m = '2001-06') AS quantity, max(a) FILTER (WHERE m = '2001-06') AS amount,
  max(o) FILTER (WHERE m = '2001-06') AS orders, max(q) FILTER (WHERE m = '2001-05') AS previous_quantity,
  max(a) FILTER (WHERE m = '2001-05') AS previous_amount, TRUE AS complete_month,
  round(max(a / o) FILTER (WHERE m = '2001-06'), 6) AS average_order
FROM (SELECT strftime(day, '%Y-%m') AS m, CAST(sum(quantity) FILTER (WHERE reason = 'included') AS DOUBLE) AS q,
  CASE WHEN count(*) FILTER (WHERE reason = 'included' AND NOT coalesce(line_amount >= 0 AND currency IS NOT NULL, FALSE)) = 0
       THEN CAST(sum(line_amount) FILTER (WHERE reason = 'included') AS DOUBLE) END AS a,
  CASE WHEN count(*) FILTER (WHERE reason IN ('invalid_quantity', 'missing_item', 'order_conflict', 'unknown_status')) = 0
       THEN count(DISTINCT (version_id, order_id)) FILTER (WHERE reason = 'included') END AS o FROM lab GROUP BY 1)
""")
def _(spark, d):
    found = s.summary(s.month_totals(labelled(spark, d), LINE, REPORT), REPORT, comparable=True)
    return found.drop("refund_amount", "previous_orders")


@check("w03_gap_days", """
SELECT CAST(day AS VARCHAR) AS day FROM (SELECT day, count(*) OVER (PARTITION BY run) AS n FROM (
  SELECT day, day - to_days(CAST(row_number() OVER (ORDER BY day) AS INTEGER)) AS run
  FROM (SELECT CAST(DATE '1999-01-01' + to_days(CAST(i AS INTEGER)) AS DATE) AS day FROM range(0, 912) r(i)) WHERE day NOT IN (SELECT day FROM daily))) WHERE n >= 3
""")
def _(spark, d):
    return s.gap_days(facts(spark, d)[1], REPORT)


@check("j06_item_day_grid", "SELECT item_id, t, CAST(day AS VARCHAR) AS day, quantity, recorded FROM grid")
def _(spark, d):
    _, daily, names = facts(spark, d)
    return i.item_day_grid(daily, names, REPORT, UNKNOWN)


def chart_sql(start: str, days: int) -> str:
    return f"""
SELECT CAST(c.day AS VARCHAR) AS day, coalesce(CAST(sum(quantity) AS DOUBLE), 0) AS quantity, coalesce(CAST(sum(amount) AS DOUBLE), 0) AS amount
FROM (SELECT CAST(DATE '{start}' + to_days(CAST(i AS INTEGER)) AS DATE) AS day FROM range(0, {days}) r(i)) c LEFT JOIN daily d ON d.day = c.day GROUP BY 1"""


@check("d15_store_chart", chart_sql("2001-06-01", 30))
def _(spark, d):
    return s.store_chart(facts(spark, d)[1], REPORT, UNKNOWN)


@check("d15_previous_chart", chart_sql("2001-05-01", 31))
def _(spark, d):
    return s.store_chart(facts(spark, d)[1], REPORT, UNKNOWN, previous=True)


@check("d16_item_month", """
SELECT item_id, name, category, item_type, type_source, quantity, amount, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day FROM items
""")
def _(spark, d):
    rows, daily, names = facts(spark, d)
    types = n.item_types(rows.filter("reason = 'included'"), REPORT)
    return i.item_month(daily, names, types, LINE, REPORT, comparable=True)


@check("d17_composition", "SELECT item_type, CAST(sum(CAST(coalesce(amount, 0) AS DECIMAL(28,2))) AS DOUBLE) AS amount FROM items GROUP BY 1")
def _(spark, d):
    return i.composition(month_items(spark, d))


@check("d18_price_volume", "SELECT * FROM effects")
def _(spark, d):
    return i.price_volume(facts(spark, d)[1], REPORT).drop("previous_price", "current_price")


@check("j07_two_months", "SELECT item_id, period, previous_quantity, current_quantity, quantity_change FROM effects")
def _(spark, d):
    return effects(spark, d).select("item_id", "period", "previous_quantity", "current_quantity", "quantity_change")


@check("d19_item_profile", """
SELECT item_id, sum(days)::BIGINT AS observed_days, round(sum(selling)::DOUBLE / sum(days), 6) AS nonzero_day_share,
  count(*) FILTER (WHERE days = 7) AS complete_weeks, round(CASE WHEN count(*) FILTER (WHERE days = 7) >= 8 AND avg(q) FILTER (WHERE days = 7) > 0
    THEN stddev_pop(q) FILTER (WHERE days = 7) / avg(q) FILTER (WHERE days = 7) END, 6) AS weekly_cv,
  CASE WHEN count(*) FILTER (WHERE days = 7) >= 8 AND avg(q) FILTER (WHERE days = 7) > 0 THEN
    CASE WHEN stddev_pop(q) FILTER (WHERE days = 7) / avg(q) FILTER (WHERE days = 7) <= 0.5 THEN 'steady'
         WHEN stddev_pop(q) FILTER (WHERE days = 7) / avg(q) FILTER (WHERE days = 7) <= 1 THEN 'varying' ELSE 'erratic' END END AS weekly_band,
  sum(selling)::DOUBLE / sum(days) < 0.5 AS intermittent
FROM (SELECT item_id, date_trunc('week', day) AS week, count(*) AS days, sum(quantity) AS q, count(*) FILTER (WHERE quantity <> 0) AS selling
      FROM grid WHERE quantity IS NOT NULL GROUP BY ALL) GROUP BY item_id
""")
def _(spark, d):
    return i.item_profile(grid(spark, d), REPORT, UNKNOWN)


@check("w04_week_change", "SELECT item_id, status, current_quantity, previous_quantity, round(early_change, 6) AS early_change, early_units FROM weekly_change")
def _(spark, d):
    return i.week_change(series(spark, d), REPORT)


@check("w05_month_change", """
SELECT item_id, CASE WHEN period <> 'only_current' AND previous_quantity > 0 THEN 'available' ELSE 'no_baseline' END AS status,
  current_quantity, CASE WHEN period <> 'only_current' THEN previous_quantity END AS previous_quantity FROM effects
""")
def _(spark, d):
    return i.month_change(effects(spark, d), REPORT, comparable=True)


FLAGS = "SELECT item_id, name, quantity, amount, status, round(change, 6) AS change, anomaly_days, contribution_band, array_to_string(flags, ',') AS flags FROM flagged"


@check("w06_flags", FLAGS)
def _(spark, d):
    return flagged(spark, d)


@check("w06_attention", FLAGS + " WHERE len(flags) > 0")
def _(spark, d):
    return i.attention(flagged(spark, d))


@check("w07_abc", "SELECT item_id, round(amount_share, 6) AS amount_share, amount_rank, round(cumulative_share, 6) AS cumulative_share, contribution_band FROM bands")
def _(spark, d):
    return i.abc(month_items(spark, d))


@check("w08_by_impact", """
SELECT item_id, round(CASE WHEN v <> 0 THEN v ELSE size END, 6) AS impact FROM (SELECT item_id, size,
  CASE WHEN off IS NOT NULL THEN greatest(base, off * price) ELSE base END AS v FROM (SELECT f.item_id,
    CASE WHEN coalesce(f.amount, 0) <> 0 THEN f.amount ELSE f.quantity END AS size,
    CASE WHEN coalesce(x.amount_change, 0) <> 0 THEN abs(x.amount_change) ELSE (CASE WHEN coalesce(f.amount, 0) <> 0 THEN f.amount ELSE f.quantity END)
      * least(abs(coalesce(f.change, 0)), 2) END AS base,
    CASE WHEN f.amount IS NOT NULL AND f.quantity <> 0 THEN f.amount / f.quantity ELSE 1 END AS price, o.off
  FROM flagged f LEFT JOIN effects x ON x.item_id = f.item_id
  LEFT JOIN (SELECT item_id, sum(abs(actual - reference)) AS off FROM anoms GROUP BY 1) o ON o.item_id = f.item_id))
""")
def _(spark, d):
    return i.by_impact(month_items(spark, d), effects(spark, d), flagged(spark, d), anomaly_days(spark, d))


@check("b13_merchandise", f"SELECT item_id FROM items WHERE {MERCH} AND upper(trim(item_id)) NOT IN ('POSTAGE', 'BANK CHARGES', 'AMAZONFEE', 'AMAZON FEE', 'MANUAL')")
def _(spark, d):
    return month_items(spark, d).filter(n.is_merchandise()).select("item_id")


@check("b15_find_items", FLAGS + " WHERE list_contains(flags, 'anomaly') AND lower(name || ' ' || item_id) LIKE '%brand#1%' ORDER BY amount DESC")
def _(spark, d):
    return i.find_items(flagged(spark, d), flag="anomaly", text="BRAND#1", sort="amount")


@check("u06_top_recent", """
SELECT item_id, CAST(sum(quantity) AS DOUBLE) AS recent_quantity FROM daily WHERE day BETWEEN DATE '2001-06-03' AND DATE '2001-06-30'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def _(spark, d):
    return i.top_recent(facts(spark, d)[1], REPORT.month_end, 28, 10)


@check("u07_drivers", "SELECT * FROM effects WHERE amount_change IS NOT NULL ORDER BY abs(amount_change) DESC, item_id LIMIT 5")
def _(spark, d):
    shown = effects(spark, d).drop("previous_price", "current_price")
    return i.overview(flagged(spark, d), shown, month_items(spark, d))[2]


@check("u07_compact", "SELECT item_id, name, quantity, amount, round(change, 6) AS change, array_to_string(flags, ',') AS flags FROM flagged")
def _(spark, d):
    return i.overview(flagged(spark, d), effects(spark, d), month_items(spark, d))[1]


@check("w09_trend4", "SELECT * FROM trends")
def _(spark, d):
    return e.trend4(days_evidence(spark, d), REPORT)


@check("w10_spike", "SELECT item_id, signal, CAST(date AS VARCHAR) AS date, baseline, actual, round(quantity_impact, 6) AS quantity_impact FROM spikes")
def _(spark, d):
    return e.spike(days_evidence(spark, d), month_items(spark, d), REPORT)


MOVES = """(SELECT item_id, CASE WHEN current_quantity > previous_quantity THEN 'growth' ELSE 'decline' END AS signal, previous_quantity, current_quantity,
  abs(current_quantity - previous_quantity) AS quantity_impact FROM effects WHERE period = 'common' AND previous_quantity > 0 AND current_quantity > 0
  AND abs(current_quantity - previous_quantity) >= 3 AND abs((current_quantity - previous_quantity) / previous_quantity) >= 0.25)"""


@check("w11_monthly_move", f"SELECT * FROM {MOVES}")
def _(spark, d):
    return e.monthly_move(effects(spark, d))


def actions_sql(evidence: str, divisor: int, kind: str, tail: str) -> str:
    return f"""
SELECT item_id, name, item_type, signal, scale, round(impact, 6) AS impact, round(floor / {divisor}, 6) AS minimum_impact,
  round(sales_share, 6) AS sales_share, '{kind}' AS comparison
FROM (SELECT s.*, v.signal, v.quantity_impact * CASE WHEN monetary AND both_q > 0 THEN both_a / both_q ELSE 1 END AS impact
  FROM (SELECT *, CASE WHEN monetary THEN by_amount ELSE by_quantity END AS scale,
      greatest((CASE WHEN monetary THEN ta ELSE tq END) * 0.002, (CASE WHEN monetary THEN la ELSE lq END) * 0.05) AS floor,
      CASE WHEN monetary THEN coalesce(amount, 0) / sa ELSE quantity / sq END AS sales_share
    FROM (SELECT *, bool_and(amount IS NOT NULL) OVER () AND sum(coalesce(amount, 0)) OVER () > 0 AS monetary, sum(by_amount) OVER () AS ta,
        max(by_amount) OVER () AS la, sum(by_quantity) OVER () AS tq, max(by_quantity) OVER () AS lq,
        sum(coalesce(amount, 0)) OVER () AS sa, sum(quantity) OVER () AS sq
      FROM (SELECT i.*, greatest(coalesce(i.amount, 0), coalesce(x.previous_amount, 0)) AS by_amount,
          greatest(i.quantity, coalesce(x.previous_quantity, 0)) AS by_quantity, i.quantity + coalesce(x.previous_quantity, 0) AS both_q,
          coalesce(i.amount, 0) + coalesce(x.previous_amount, 0) AS both_a
        FROM items i LEFT JOIN effects x ON x.item_id = i.item_id WHERE {MERCH.replace('quantity', 'i.quantity')}))) s
  JOIN {evidence} v ON v.item_id = s.item_id)
WHERE scale >= floor / {divisor} AND impact >= floor / {divisor} ORDER BY impact DESC, scale DESC, item_id {tail}"""


SIGNALS = """(SELECT item_id, signal, quantity_impact FROM trends UNION ALL
  SELECT item_id, signal, quantity_impact FROM spikes WHERE item_id NOT IN (SELECT item_id FROM trends))"""


@check("w12_actions", actions_sql(SIGNALS, 4, "daily", "LIMIT 3"))
def _(spark, d):
    trends, spikes = signals(spark, d)
    return e.actions(month_items(spark, d), effects(spark, d), e.daily_signals(trends, spikes), REPORT)


def planted_evidence(spark, d):
    """June's real sales of every item upon a steady level of ten times their mean; some rise, some fall, some have one day far above, their anomaly."""
    june = grid(spark, d).filter(F.col("day") >= F.lit(REPORT.month_start)).select("item_id", F.col("day").alias("date"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))
    level = june.groupBy("item_id").agg((F.floor(F.avg("quantity")) + 1).alias("level"))
    number = F.regexp_extract("item_id", "[0-9]+", 0).cast("int") % 4
    dom = F.dayofmonth("date")
    week = F.greatest(F.lit(0), F.floor((dom - 3) / 7))
    extra = F.when(number == 1, 8 * week).when(number == 2, 8 * (3 - week)).when((number == 3) & (dom == 20), 140).otherwise(0)
    sold = june.join(level, "item_id").withColumn("quantity", (F.col("quantity") + F.col("level") * (10 + extra)).cast("double"))
    odd = sold.filter((number == 3) & (dom == 20)).select("item_id", "date", F.col("quantity").alias("actual"), (11 * F.col("level")).cast("double").alias("reference"))
    shown = sold.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("date", "quantity"))).alias("daily"))
    return e.with_anomalies(shown, odd), sold.groupBy("item_id").agg(F.sum("quantity").alias("quantity"))


@check("w09_trend4_planted", "SELECT * FROM ptrends")
def _(spark, d):
    return e.trend4(planted_evidence(spark, d)[0], REPORT)


@check("w10_spike_planted", "SELECT item_id, signal, CAST(date AS VARCHAR) AS date, baseline, actual, round(quantity_impact, 6) AS quantity_impact FROM pspikes")
def _(spark, d):
    return e.spike(*planted_evidence(spark, d), REPORT)


@check("w12_actions_planted", actions_sql(SIGNALS.replace("trends", "ptrends").replace("spikes", "pspikes"), 4, "daily", "LIMIT 3"))
def _(spark, d):
    shown, month = planted_evidence(spark, d)
    return e.actions(month_items(spark, d), effects(spark, d), e.daily_signals(e.trend4(shown, REPORT), e.spike(shown, month, REPORT)), REPORT)


@check("w12_monthly_actions", actions_sql(MOVES, 1, "monthly", ""))
def _(spark, d):
    return e.actions(month_items(spark, d), effects(spark, d), None, REPORT, n=None)


LEADERS = f"""(SELECT item_id, name, quantity, amount, metric, value, total, CASE WHEN value > 0 THEN rank END AS rank,
  greatest(total * 0.002, largest * 0.05) AS floor, value >= greatest(total * 0.002, largest * 0.05) AND value > 0 AS leads
FROM (SELECT *, rank() OVER (ORDER BY value DESC) AS rank, sum(value) OVER () AS total, max(value) OVER () AS largest
  FROM (SELECT *, CASE WHEN monetary THEN 'amount' ELSE 'quantity' END AS metric, CASE WHEN monetary THEN coalesce(amount, 0) ELSE quantity END AS value
    FROM (SELECT *, bool_and(amount IS NOT NULL) OVER () AND sum(amount) OVER () > 0 AS monetary FROM items WHERE {MERCH}))))"""


@check("w13_leaders", f"SELECT item_id, name, quantity, amount, metric, round(value, 6) AS value, round(total, 2) AS total, rank, round(floor, 4) AS floor, leads FROM {LEADERS}")
def _(spark, d):
    ranked = e.leaders(month_items(spark, d), series(spark, d), LINE.quantity_unit)
    return ranked.withColumns({"total": F.round("total", 2), "floor": F.round("floor", 4)})


CANDIDATES = f"""(SELECT item_id, 'leader' AS category, value * 0.15 AS score FROM {LEADERS} WHERE leads
  UNION ALL SELECT p.item_id, t.signal, t.quantity_impact * p.price * 4 FROM priced p JOIN trends t ON t.item_id = p.item_id WHERE t.quantity_impact * p.price * 4 >= p.floor
  UNION ALL SELECT p.item_id, 'anomaly', o.delta * p.price FROM priced p JOIN (SELECT item_id, max(abs(actual - reference)) AS delta FROM anoms GROUP BY 1) o
    ON o.item_id = p.item_id WHERE o.delta >= 3 AND o.delta * p.price >= p.floor / 4)"""
PRICED = f"""priced AS (SELECT l.item_id, l.floor, CASE WHEN metric <> 'amount' THEN 1 WHEN x.previous_amount IS NOT NULL AND x.previous_quantity > 0
    THEN (l.amount + x.previous_amount) / (l.quantity + x.previous_quantity) WHEN l.quantity > 0 THEN l.amount / l.quantity ELSE 0 END AS price
  FROM {LEADERS} l LEFT JOIN effects x ON x.item_id = l.item_id)"""


def candidates(spark, d):
    ranked = e.leaders(month_items(spark, d), series(spark, d), LINE.quantity_unit)
    return e.focus_candidates(ranked, effects(spark, d), e.trend4(days_evidence(spark, d), REPORT), None, anomaly_days(spark, d))


@check("w14_focus_candidates", f"SELECT item_id, category, round(score, 4) AS score FROM (WITH {PRICED} SELECT * FROM {CANDIDATES})")
def _(spark, d):
    return candidates(spark, d).withColumn("score", F.round("score", 4))


def focus_sql(candidates_sql: str) -> str:
    """Greedy choice of five: the leader of the highest score, then by score, 55 % less for every earlier choice of the category."""
    return f"""
SELECT CAST(place AS INTEGER) AS place, item_id, category, round(score, 4) AS score FROM (WITH RECURSIVE cand AS MATERIALIZED ({candidates_sql}),
  walk AS (SELECT 0 AS place, []::VARCHAR[] AS used, []::VARCHAR[] AS kinds, ''::VARCHAR AS item_id, ''::VARCHAR AS category, 0::DOUBLE AS score
    UNION ALL SELECT place + 1, list_append(used, c.item_id), list_append(kinds, c.category), c.item_id, c.category, c.score
    FROM (SELECT w.place, w.used, w.kinds, k.item_id, k.category, k.score::DOUBLE AS score, row_number() OVER (ORDER BY w.place = 0 AND k.category = 'leader' DESC,
        k.score * pow(0.45::DOUBLE, len(list_filter(w.kinds, lambda x: x = k.category))) DESC, k.item_id, k.category) AS r
      FROM walk w JOIN cand k ON NOT list_contains(w.used, k.item_id) WHERE w.place < 5) c WHERE r = 1)
SELECT * FROM walk WHERE place > 0)"""


@check("w15_focus", focus_sql(f"SELECT * FROM (WITH {PRICED} SELECT * FROM {CANDIDATES})"))
def _(spark, d):
    return e.focus(candidates(spark, d)).withColumn("score", F.round("score", 4))


RUNS = """(SELECT item_id, min(date) AS start, max(date) AS "end", count(*) AS days, sum(actual) AS actual, sum(reference) AS reference,
  sum(difference) AS difference, max(strength) AS strength FROM (SELECT *, date - to_days(CAST(row_number() OVER (PARTITION BY item_id ORDER BY date) AS INTEGER)) AS run
  FROM anoms) GROUP BY item_id, run)"""


@check("w19_events", f"""
SELECT item_id, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", days, actual, round(reference, 6) AS reference,
  round(difference, 6) AS difference, round(strength, 6) AS strength FROM {RUNS}
""")
def _(spark, d):
    return e.events_of(anomaly_days(spark, d))


@check("w20_event_value", f"""
SELECT r.item_id, CAST(start AS VARCHAR) AS start, round(difference, 6) AS difference, round(difference * CAST(sum(amount) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE), 6) AS amount_impact_reference
FROM {RUNS.replace('sum(actual) AS actual, sum(reference) AS reference,', '')} r JOIN (SELECT item_id, day, quantity, amount FROM daily WHERE amount_missing = 0 AND quantity > 0) p
  ON p.item_id = r.item_id AND p.day < r.start GROUP BY r.item_id, r.start, r.difference
""")
def _(spark, d):
    return e.event_value(e.events_of(anomaly_days(spark, d)), facts(spark, d)[1])


@check("d25_order_concentration", """
SELECT * FROM (WITH per AS (SELECT a.item_id, a.date, a.actual, l.version_id, l.order_id, CAST(sum(l.quantity) AS DOUBLE) AS q, count(*) AS rows
    FROM anoms a JOIN lab l ON l.item_id = a.item_id AND l.day = a.date AND l.reason = 'included' GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, date ORDER BY q DESC, version_id DESC, order_id DESC) AS r FROM per),
  event AS (SELECT item_id, date, actual, count(*) AS orders, sum(rows)::BIGINT AS rows, sum(q) AS total, max(q) FILTER (WHERE r = 1) AS top,
    max(q) FILTER (WHERE r = 2) AS second FROM ranked GROUP BY ALL)
SELECT item_id, CAST(date AS VARCHAR) AS date, actual, orders, rows, top, CASE WHEN top / actual < 0.8 THEN second END AS second FROM event
WHERE abs(total - actual) < 0.000001 AND CASE WHEN top / actual >= 0.8 THEN top >= 3 ELSE coalesce(second, 0) >= 3 AND (top + coalesce(second, 0)) / actual >= 0.8 END)
""")
def _(spark, d):
    return e.order_concentration(labelled(spark, d), anomaly_days(spark, d), LINE)


@check("k06_rank_facts", f"SELECT item_id, quantity FROM items WHERE {MERCH} ORDER BY quantity DESC, item_id LIMIT 3")
def _(spark, d):
    return e.rank_facts(month_items(spark, d), "quantity").select("item_id", "quantity")


@check("k06_falls", f"""
SELECT f.item_id, round(change, 6) AS change FROM flagged f JOIN (SELECT * FROM types) t ON t.item_id = f.item_id
WHERE {MERCH} AND change < 0 ORDER BY abs(change) DESC, f.item_id LIMIT 3
""")
def _(spark, d):
    kinds = month_items(spark, d).select("item_id", "item_type", "type_source")
    return e.rank_facts(flagged(spark, d).join(kinds, "item_id"), "change", falling=True).select("item_id", "change")


# --- anomaly days --------------------------------------------------------------------------------


@check("w17_weekday_ref", "SELECT item_id, t, round(reference, 6) AS reference, round(mad, 6) AS mad FROM wref")
def _(spark, d):
    return a.weekday_ref(grid(spark, d), REPORT).select("item_id", "t", "reference", "mad")


@check("l20_measured_days", """
SELECT item_id, t, round(difference, 6) AS difference, round(threshold, 6) AS threshold, probe_ok, legacy_ok, round(v0, 6) AS v0, round(v1, 6) AS v1,
  round(v2, 6) AS v2, round(l0, 6) AS l0, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM measured
""")
def _(spark, d):
    return a.measured_days(grid(spark, d), REPORT).select(
        "item_id", "t", "difference", "threshold", "probe_ok", "legacy_ok", "v0", "v1", "v2", "l0", "l1", "l2"
    )


@check("l20_rule_anomalies", """
SELECT item_id, CAST(date AS VARCHAR) AS date, actual, reference, difference, round(strength, 6) AS strength, extreme FROM anoms
""")
def _(spark, d):
    return a.rule_anomalies(a.measured_days(grid(spark, d), REPORT), REPORT)


@check("l20_anomalies")
def _(spark, d):
    return a.anomalies(a.measured_days(grid(spark, d), REPORT), REPORT)


@check("l21_isolation_scores")
def _(spark, d):
    measured = a.measured_days(grid(spark, d), REPORT)
    forest = a.iso_fit(a.training_days(measured, REPORT), a.VECTOR, ["item_id", "t"])
    return a.iso_score(forest, a.probe_days(measured, REPORT), a.VECTOR).select("item_id", "day", "score")


@check("l22_anomaly_status", """
SELECT i.item_id, CASE WHEN p.n IS NULL THEN 'insufficient' WHEN o.n > 0 THEN 'detected' ELSE 'clear' END AS status,
  coalesce(p.n, 0) AS tested_days, coalesce(o.n, 0) AS anomaly_days
FROM items i LEFT JOIN (SELECT item_id, count(*) AS n FROM measured WHERE probe_ok AND day >= DATE '2001-06-01' GROUP BY 1) p ON p.item_id = i.item_id
LEFT JOIN (SELECT item_id, count(*) AS n FROM anoms GROUP BY 1) o ON o.item_id = i.item_id
""")
def _(spark, d):
    measured = a.measured_days(grid(spark, d), REPORT)
    return a.anomaly_status(month_items(spark, d), a.probe_days(measured, REPORT), anomaly_days(spark, d))


@check("l23_v2_anomaly_rule", """
SELECT item_id, CAST(day AS VARCHAR) AS date, quantity AS actual, round(ref, 3) AS reference, round(quantity - ref, 3) AS difference,
  abs(quantity - ref) > greatest(3.0, 3 * list_aggregate(list_transform(past, lambda x: abs(x - ref)), 'median')) AS simple_rule,
  abs(round(quantity - ref, 3)) > greatest(3.0, 0.7 * greatest(mean, 1.0)) AS substantial
FROM (SELECT *, list_aggregate(past, 'median') AS ref FROM (SELECT *, list(quantity) FILTER (WHERE quantity IS NOT NULL) OVER b AS past, avg(quantity) OVER b AS mean,
    count(*) FILTER (WHERE t < 882 AND quantity <> 0) OVER (PARTITION BY item_id) AS hist
  FROM grid WINDOW b AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))) WHERE hist >= 8 AND t >= 882 AND quantity IS NOT NULL
""")
def _(spark, d):
    return a.v2_rule(grid(spark, d), REPORT)


