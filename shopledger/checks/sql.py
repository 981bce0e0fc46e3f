"""SQL building blocks of the expected results, written for DuckDB on the same tables."""

from __future__ import annotations

import re

BLOCKS: dict[str, str] = {}

BLOCKS["lines"] = """
SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)), copy) AS source_row_id,
  CAST(l_orderkey AS VARCHAR) AS order_id,
  CASE WHEN l_orderkey % 113 = 0 AND l_linenumber = 2 THEN NULL
       WHEN l_orderkey % 7 = 0 THEN ' ' || p_brand || ' ' ELSE p_brand END AS item_id,
  'Item ' || p_brand AS item_name,
  CASE WHEN l_orderkey % 103 = 0 THEN NULL WHEN l_orderkey % 101 = 0 AND l_linenumber = 1 THEN 'other'
       ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN l_orderkey % 109 = 0 THEN 'not a time' ELSE strftime(o_orderdate
       + to_days(CAST(CASE WHEN l_orderkey % 107 = 0 AND l_linenumber = 1 THEN 7 ELSE 0 END AS INTEGER))
       + to_hours(CAST(l_orderkey % 24 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS event_time,
  CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN NULL
       WHEN l_orderkey % 89 = 0 AND l_linenumber = 2 THEN '-1'
       WHEN l_orderkey % 211 = 0 AND l_linenumber = 3 THEN 'abc'
       WHEN l_orderkey % 199 = 0 AND l_linenumber = 1 THEN '0'
       ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS quantity,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price,
  CASE WHEN l_orderkey % 151 = 0 AND l_linenumber = 1 THEN NULL
       WHEN l_orderkey % 157 = 0 AND l_linenumber = 2 THEN '12,5'
       ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS line_amount,
  CASE WHEN l_orderkey % 167 = 0 AND l_linenumber = 1 THEN '1.5' WHEN l_orderkey % 173 = 0 THEN NULL
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS order_amount,
  CASE WHEN l_orderkey % 127 = 0 AND l_linenumber = 1 THEN NULL
       WHEN l_orderkey % 131 = 0 AND l_linenumber = 1 THEN 'US'
       WHEN l_orderkey % 5 = 0 THEN ' usd' ELSE 'USD' END AS currency,
  CASE WHEN l_orderkey % 139 = 0 THEN 'X' WHEN l_orderkey % 149 = 0 THEN 'C' ELSE l_returnflag END AS record_status,
  n_name AS country, p_type AS category,
  CASE p_brand WHEN 'Brand#3' THEN '实物' WHEN 'Brand#5' THEN 'fee_service'
       WHEN 'Brand#7' THEN CASE WHEN l_orderkey % 2 = 0 THEN 'physical' ELSE 'accounting' END
       WHEN 'Brand#11' THEN ' physical ' END AS item_type,
  CAST(o_orderdate AS DATE) AS order_day
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey,
UNNEST(CASE WHEN l_orderkey % 163 = 0 AND l_linenumber <= 2 THEN [0, 1] ELSE [0] END) AS copies(copy)
"""

BLOCKS["src"] = """
SELECT *, 'v1' AS version_id, 1 AS source_no FROM lines WHERE order_day < DATE '2001-03-01'
UNION ALL SELECT *, 'v2', 2 FROM lines WHERE order_day >= DATE '2001-01-01'
"""


def _normal(source: str, keep: str, line: str, price: str, total: str) -> str:
    """Typed rows. ``line``, ``price``, ``total`` are the mapped amount columns or NULL."""
    return f"""
SELECT {keep} source_row_id, order_id, nullif(trim(item_id), '') AS item_id, item_name, customer_id,
  event_time AS time_text,
  CASE WHEN wall IS NULL THEN NULL
       WHEN CAST(wall AS TIME) >= TIME '01:00:00' AND CAST(wall AS TIME) < TIME '02:00:00'
            AND day_of_wall IN (spring, autumn) THEN NULL
       WHEN wall >= spring + INTERVAL 1 HOUR AND wall < autumn + INTERVAL 1 HOUR THEN wall - INTERVAL 1 HOUR
       ELSE wall END AS event_time,
  TRY_CAST(quantity AS DECIMAL(18,2)) AS quantity,
  TRY_CAST({price} AS DECIMAL(18,2)) AS unit_price,
  TRY_CAST({line} AS DECIMAL(18,2)) AS line_amount,
  TRY_CAST({total} AS DECIMAL(18,2)) AS order_amount,
  quantity AS quantity_text, {line} AS line_text, {total} AS total_text, {price} AS price_text,
  CASE WHEN regexp_full_match(upper(trim(currency)), '[A-Z]{{3}}') THEN upper(trim(currency)) END AS currency,
  CASE record_status WHEN 'N' THEN 'forward' WHEN 'A' THEN 'forward' WHEN 'R' THEN 'return'
       WHEN 'C' THEN 'cancelled' ELSE 'unknown' END AS record_status,
  country, category, item_type,
  (quantity IS NOT NULL AND TRY_CAST(quantity AS DECIMAL(18,2)) IS NULL) AS bad_quantity,
  ({line} IS NOT NULL AND TRY_CAST({line} AS DECIMAL(18,2)) IS NULL) AS bad_line
FROM (SELECT *, TRY_CAST(event_time AS TIMESTAMP) AS wall,
        date_trunc('day', TRY_CAST(event_time AS TIMESTAMP)) AS day_of_wall,
        make_date(year(TRY_CAST(event_time AS TIMESTAMP)), 3, 31)
          - to_days(CAST(dayofweek(make_date(year(TRY_CAST(event_time AS TIMESTAMP)), 3, 31)) AS INTEGER)) AS spring,
        CASE WHEN year(TRY_CAST(event_time AS TIMESTAMP)) = 1995 THEN DATE '1995-10-22'
          ELSE make_date(year(TRY_CAST(event_time AS TIMESTAMP)), 10, 31)
          - to_days(CAST(dayofweek(make_date(year(TRY_CAST(event_time AS TIMESTAMP)), 10, 31)) AS INTEGER)) END AS autumn
      FROM {source})
"""


for _name, _source, _keep in (("norm", "lines", ""), ("snorm", "src", "version_id, source_no,")):
    for _tag, _line, _price, _total in (
        ("", "line_amount", "NULL", "NULL"),
        ("_total", "NULL", "NULL", "order_amount"),
        ("_price", "NULL", "unit_price", "NULL"),
        ("_both", "line_amount", "unit_price", "NULL"),
    ):
        BLOCKS[_name + _tag + "0"] = _normal(_source, _keep, _line, _price, _total)
        BLOCKS[_name + _tag] = f"""
SELECT *, CAST(CASE WHEN event_time >= make_date(year(event_time), 3, 31)
            - to_days(CAST(dayofweek(make_date(year(event_time), 3, 31)) AS INTEGER)) + INTERVAL 1 HOUR
        AND event_time < CASE WHEN year(event_time) = 1995 THEN DATE '1995-10-22' ELSE make_date(year(event_time), 10, 31)
            - to_days(CAST(dayofweek(make_date(year(event_time), 10, 31)) AS INTEGER)) END + INTERVAL 1 HOUR
        THEN event_time + INTERVAL 1 HOUR ELSE event_time END AS DATE) AS day
FROM {_name + _tag}0
"""


def _labelled(rows: str, merge: str = "replace", dup: str = "drop") -> str:
    """One reason per row of the shared report (month 2001-06, coverage 1999-01-01 to 2001-06-30)."""
    replaced = "day BETWEEN l.start AND l.stop" if merge == "replace" else "FALSE"
    return f"""
SELECT m.*, n.copy_no > 1 AS duplicate_candidate,
  CASE WHEN n.copy_no > 1 AND '{dup}' = 'drop' THEN 'duplicate_removed'
       WHEN c.order_id IS NOT NULL THEN 'order_conflict'
       WHEN {replaced} THEN 'replaced_range'
       WHEN day > DATE '2001-06-30' OR day < DATE '1999-01-01' THEN 'outside_scope'
       WHEN item_id IS NULL THEN 'missing_item' WHEN day IS NULL THEN 'invalid_time'
       WHEN record_status = 'cancelled' THEN 'cancelled' WHEN record_status = 'return' THEN 'returned'
       WHEN record_status <> 'forward' THEN 'unknown_status'
       WHEN quantity IS NULL OR quantity <= 0 THEN 'invalid_quantity' ELSE 'included' END AS reason
FROM {rows} m
JOIN (SELECT version_id AS nv, source_row_id AS nr, row_number() OVER (PARTITION BY order_id, item_id, item_name,
        customer_id, event_time, CASE WHEN quantity IS NULL THEN NULL ELSE quantity_text END, price_text,
        CASE WHEN line_amount IS NULL THEN NULL ELSE line_text END, total_text, currency, record_status,
        country, category, item_type, day ORDER BY source_no, source_row_id) AS copy_no FROM {rows}) n
  ON n.nv = m.version_id AND n.nr = m.source_row_id
LEFT JOIN (SELECT version_id AS cv, order_id FROM {rows} WHERE day <= DATE '2001-06-30' AND order_id IS NOT NULL
           GROUP BY ALL HAVING count(DISTINCT event_time) > 1 OR count(DISTINCT customer_id) > 1
             OR count(DISTINCT currency) > 1) c ON c.cv = m.version_id AND c.order_id = m.order_id
LEFT JOIN (SELECT 'v1' AS lv, min(day) AS start, max(day) AS stop FROM {rows} WHERE version_id = 'v2') l
  ON l.lv = m.version_id
"""


BLOCKS["lab"] = _labelled("snorm")
BLOCKS["lab_total"] = _labelled("snorm_total")
BLOCKS["lab_price"] = _labelled("snorm_price")
BLOCKS["lab_keep"] = _labelled("snorm", "append", "keep")

BLOCKS["daily"] = """
SELECT day, item_id, sum(quantity) AS quantity,
  coalesce(sum(CASE WHEN line_amount >= 0 AND currency IS NOT NULL THEN line_amount END), 0) AS amount,
  count(*) FILTER (WHERE NOT coalesce(line_amount >= 0 AND currency IS NOT NULL, FALSE)) AS amount_missing
FROM lab WHERE reason = 'included' GROUP BY ALL
"""
BLOCKS["names"] = """
SELECT item_id, arg_min(coalesce(nullif(item_name, ''), item_id), (source_no, source_row_id)) AS name,
  arg_min_null(category, (source_no, source_row_id)) AS category, min(day) AS first_day
FROM lab WHERE reason = 'included' GROUP BY item_id
"""
BLOCKS["types"] = """
SELECT item_id, CASE WHEN item_id = 'Brand#9' THEN 'accounting' WHEN kinds = 1 THEN kind ELSE 'unknown' END AS item_type,
  CASE WHEN item_id = 'Brand#9' THEN 'user_mapping' WHEN kinds = 1 THEN 'mapped_source_field'
       WHEN kinds > 1 THEN 'conflicting_types' ELSE 'not_provided' END AS type_source
FROM (SELECT item_id, count(DISTINCT kind) AS kinds, min(kind) AS kind FROM (
  SELECT item_id, CASE trim(item_type) WHEN '实物' THEN 'physical' WHEN 'physical' THEN 'physical'
    WHEN 'accounting' THEN 'accounting' WHEN 'fee_service' THEN 'fee_service' END AS kind
  FROM lab WHERE reason = 'included') GROUP BY item_id)
"""
BLOCKS["items"] = """
SELECT d.item_id, any_value(name) AS name, any_value(category) AS category, any_value(item_type) AS item_type,
  any_value(type_source) AS type_source,
  CAST(coalesce(sum(quantity) FILTER (WHERE day >= DATE '2001-06-01'), 0) AS DOUBLE) AS quantity,
  CASE WHEN coalesce(sum(amount_missing) FILTER (WHERE day >= DATE '2001-06-01'), 0) = 0
       THEN CAST(coalesce(sum(amount) FILTER (WHERE day >= DATE '2001-06-01'), 0) AS DOUBLE) END AS amount,
  any_value(first_day) AS first_day, max(day) AS last_day
FROM daily d JOIN names USING (item_id) JOIN types USING (item_id)
GROUP BY d.item_id HAVING max(day) >= DATE '2001-05-01'
"""
BLOCKS["grid"] = """
SELECT n.item_id, CAST(c.t AS INTEGER) AS t, c.day,
  CASE WHEN c.day >= n.first_day AND c.day <> DATE '2001-03-15' THEN CAST(coalesce(d.quantity, 0) AS DOUBLE) END AS quantity,
  d.quantity IS NOT NULL AS recorded
FROM names n CROSS JOIN (SELECT i AS t, CAST(DATE '1999-01-01' + to_days(CAST(i AS INTEGER)) AS DATE) AS day
                         FROM range(0, 912) r(i)) c
LEFT JOIN daily d ON d.item_id = n.item_id AND d.day = c.day
"""
BLOCKS["effects"] = """
SELECT item_id, CASE WHEN n1 > 0 AND n0 > 0 THEN 'common' WHEN n1 > 0 THEN 'only_current' ELSE 'only_previous' END AS period,
  CAST(q0 AS DOUBLE) AS previous_quantity, CAST(q1 AS DOUBLE) AS current_quantity, CAST(q1 - q0 AS DOUBLE) AS quantity_change,
  CASE WHEN ok THEN CAST(a0 AS DOUBLE) END AS previous_amount, CASE WHEN ok THEN CAST(a1 AS DOUBLE) END AS current_amount,
  CASE WHEN ok THEN CAST(a1 - a0 AS DOUBLE) END AS amount_change,
  CASE WHEN ok AND q0 > 0 AND q1 > 0 THEN cents / 100.0::DOUBLE END AS quantity_effect,
  CASE WHEN ok AND q0 > 0 AND q1 > 0 THEN (CAST((a1 - a0) * 100 AS BIGINT) - cents) / 100.0::DOUBLE END AS price_effect
FROM (SELECT *, CAST(sign(top) AS BIGINT) * (abs(top) // bottom
        + CASE WHEN 2 * (abs(top) % bottom) > bottom
               OR (2 * (abs(top) % bottom) = bottom AND (abs(top) // bottom) % 2 = 1) THEN 1 ELSE 0 END) AS cents
      FROM (SELECT *, CAST(q1 - q0 AS HUGEINT) * (CAST(a0 * 100 AS HUGEINT) * CAST(q1 AS HUGEINT)
              + CAST(a1 * 100 AS HUGEINT) * CAST(q0 AS HUGEINT)) AS top,
              nullif(2 * CAST(q0 AS HUGEINT) * CAST(q1 AS HUGEINT), 0) AS bottom
            FROM (SELECT item_id, count(*) FILTER (WHERE day >= DATE '2001-06-01') AS n1,
                    count(*) FILTER (WHERE day < DATE '2001-06-01') AS n0,
                    coalesce(sum(quantity) FILTER (WHERE day < DATE '2001-06-01'), 0) AS q0,
                    coalesce(sum(quantity) FILTER (WHERE day >= DATE '2001-06-01'), 0) AS q1,
                    coalesce(sum(amount) FILTER (WHERE day < DATE '2001-06-01'), 0) AS a0,
                    coalesce(sum(amount) FILTER (WHERE day >= DATE '2001-06-01'), 0) AS a1,
                    sum(amount_missing) = 0 AS ok
                  FROM daily WHERE day BETWEEN DATE '2001-05-01' AND DATE '2001-06-30' GROUP BY item_id)))
"""
BLOCKS["wref"] = """
SELECT * EXCLUDE (seen), CASE WHEN len(seen) >= 6 THEN list_aggregate(seen, 'median') END AS reference,
  CASE WHEN len(seen) >= 6 THEN list_aggregate(list_transform(seen, lambda x: abs(x - list_aggregate(seen, 'median'))), 'median') END AS mad
FROM (SELECT *, list(quantity) FILTER (WHERE quantity IS NOT NULL) OVER (PARTITION BY item_id, dayofweek(day) ORDER BY t
        RANGE BETWEEN 84 PRECEDING AND 1 PRECEDING) AS seen FROM grid)
"""
BLOCKS["measured"] = """
SELECT item_id, t, day, quantity AS actual, reference, mad, quantity - reference AS difference,
  greatest(3.0, 0.7 * greatest(reference, mean28, 1.0), 4.4478 * mad) AS threshold,
  coalesce(k28 = 28 AND n28 = 28 AND quantity IS NOT NULL AND reference IS NOT NULL AND sold_before >= 8, FALSE) AS probe_ok,
  coalesce(k28 = n28 AND quantity IS NOT NULL AND sold_history >= 8, FALSE) AS legacy_ok,
  abs(quantity - list_aggregate(past28, 'median')) > greatest(3.0, 0.7 * greatest(mean28, 1.0)) AS legacy_substantial,
  (quantity - reference) / greatest(reference, mean28, 1.0) AS v0,
  abs(quantity - reference) / greatest(1.0, mad * 1.4826) AS v1, std28 / greatest(reference, mean28, 1.0) AS v2,
  quantity / greatest(mean28, 1.0) AS l0, mean7 / greatest(mean28, 1.0) AS l1, std28 / greatest(mean28, 1.0) AS l2
FROM (SELECT *, count(*) OVER b28 AS n28, count(quantity) OVER b28 AS k28, avg(quantity) OVER b28 AS mean28,
        stddev_pop(quantity) OVER b28 AS std28, avg(quantity) OVER b7 AS mean7,
        list(quantity) FILTER (WHERE quantity IS NOT NULL) OVER b28 AS past28,
        count(*) FILTER (WHERE quantity > 0) OVER (PARTITION BY item_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sold_before,
        count(*) FILTER (WHERE quantity > 0 AND day < DATE '2001-06-01') OVER (PARTITION BY item_id) AS sold_history
      FROM wref WINDOW b28 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
        b7 AS (PARTITION BY item_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
"""
BLOCKS["anoms"] = """
SELECT item_id, day AS date, actual, round(reference, 3) AS reference, round(difference, 3) AS difference,
  abs(round(difference, 3)) / threshold AS strength, abs(round(difference, 3)) > greatest(10.0, 3 * threshold) AS extreme
FROM measured WHERE probe_ok AND day >= DATE '2001-06-01' AND abs(difference) > threshold
"""
BLOCKS["series"] = """
SELECT item_id, list(quantity ORDER BY day) AS q, count(*) FILTER (WHERE quantity > 0) AS active FROM grid
WHERE day >= DATE '2001-06-01' GROUP BY item_id
"""
BLOCKS["weeks4"] = """
SELECT item_id, any_value(g.sel) AS sel, bool_or(quantity IS NULL) AS gap,
  sum(quantity) FILTER (WHERE w = 0) AS w1, sum(quantity) FILTER (WHERE w = 1) AS w2, sum(quantity) FILTER (WHERE w = 2) AS w3,
  sum(quantity) FILTER (WHERE w = 3) AS w4, max(quantity) FILTER (WHERE w = 3) AS peak,
  avg(quantity) FILTER (WHERE w = 0 AND NOT odd) * 7 AS a1, avg(quantity) FILTER (WHERE w = 1 AND NOT odd) * 7 AS a2,
  avg(quantity) FILTER (WHERE w = 2 AND NOT odd) * 7 AS a3, avg(quantity) FILTER (WHERE w = 3 AND NOT odd) * 7 AS a4,
  least(count(*) FILTER (WHERE w = 0 AND NOT odd), count(*) FILTER (WHERE w = 1 AND NOT odd),
        count(*) FILTER (WHERE w = 2 AND NOT odd), count(*) FILTER (WHERE w = 3 AND NOT odd)) AS least_normal
FROM (SELECT g.item_id, g.quantity, date_diff('day', DATE '2001-06-03', g.day) // 7 AS w, a.date IS NOT NULL AS odd,
        count(*) FILTER (WHERE g.quantity > 0) OVER (PARTITION BY g.item_id) AS sel
      FROM grid g LEFT JOIN anoms a ON a.item_id = g.item_id AND a.date = g.day WHERE g.day >= DATE '2001-06-03') g GROUP BY item_id
"""
BLOCKS["trends"] = """
SELECT item_id, CASE WHEN w4 > w1 THEN 'growth' ELSE 'decline' END AS signal, w1 AS week1, w2 AS week2, w3 AS week3, w4 AS week4,
  abs(w4 - w1) AS quantity_impact
FROM weeks4 WHERE NOT gap AND sel >= 14 AND least(w1, w2, w3, w4) > 0 AND abs(w4 - w1) >= 3 AND abs(w4 / w1 - 1) >= 0.25 AND least_normal >= 5
  AND ((w1 < w2 AND w2 < w3 AND w3 < w4 AND a1 < a2 AND a2 < a3 AND a3 < a4 AND peak <= w4 / 2)
    OR (w1 > w2 AND w2 > w3 AND w3 > w4 AND a1 > a2 AND a2 > a3 AND a3 > a4))
"""
BLOCKS["spikes"] = """
SELECT item_id, 'spike' AS signal, date, baseline, actual, actual - greatest(baseline, reference) AS quantity_impact
FROM (SELECT p.item_id, p.date, p.actual, p.reference, i.quantity AS month, list_aggregate(h, 'median') AS baseline,
        list_avg(h) AS mean, list_aggregate(h, 'stddev_pop') AS std, len(h) AS n, len(list_filter(h, lambda x: x > 0)) AS selling
      FROM (SELECT x.*, (SELECT list(g.quantity ORDER BY g.day DESC)[1:21] FROM grid g WHERE g.item_id = x.item_id AND g.day >= DATE '2001-06-01'
              AND g.day < x.date AND g.quantity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM anoms o WHERE o.item_id = g.item_id AND o.date = g.day)) AS h
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY actual - reference DESC, date) AS r, count(*) OVER (PARTITION BY item_id) AS c
                  FROM anoms WHERE actual > reference AND reference >= 0) x WHERE r = 1 AND c <= 2) p
      JOIN items i ON i.item_id = p.item_id)
WHERE n >= 14 AND selling >= n / 2 AND baseline > 0 AND mean > 0 AND std / mean <= 0.75 AND actual >= 3 * greatest(baseline, reference)
  AND actual - greatest(baseline, reference) >= greatest(3, month * 0.2)
"""
# June's real sales of every item upon a steady level, with rising, falling and spiking items among them.
_NUMBER = "CAST(replace(g.item_id, 'Brand#', '') AS INTEGER)"
BLOCKS["plevel"] = "SELECT item_id, floor(avg(coalesce(quantity, 0))) + 1 AS level FROM grid WHERE day >= DATE '2001-06-01' GROUP BY item_id"
BLOCKS["pgrid"] = f"""
SELECT g.item_id, g.day, coalesce(quantity, 0) + level * (10 + CASE {_NUMBER} % 4 WHEN 1 THEN 8 * greatest(0, (day(g.day) - 3) // 7) WHEN 2 THEN 8 * (3 - greatest(0, (day(g.day) - 3) // 7))
  WHEN 3 THEN CASE WHEN day(g.day) = 20 THEN 140 ELSE 0 END ELSE 0 END) AS quantity
FROM grid g JOIN plevel p ON p.item_id = g.item_id WHERE g.day >= DATE '2001-06-01'
"""
BLOCKS["panoms"] = f"SELECT g.item_id, g.day AS date, g.quantity AS actual, 11 * level AS reference FROM pgrid g JOIN plevel p ON p.item_id = g.item_id WHERE {_NUMBER} % 4 = 3 AND g.day = DATE '2001-06-20'"
BLOCKS["pitems"] = "SELECT item_id, sum(quantity) AS quantity FROM pgrid GROUP BY item_id"


def _planted(block: str) -> str:
    return re.sub(r"\b(grid|anoms|items|weeks4|trends|spikes)\b", r"p\1", block)


for _name in ("weeks4", "trends", "spikes"):
    BLOCKS["p" + _name] = _planted(BLOCKS[_name])
BLOCKS["bands"] = """
SELECT item_id, amount / total AS amount_share, CAST(before_n + 1 AS BIGINT) AS amount_rank, (before + own) / total AS cumulative_share,
  CASE WHEN n < 5 THEN NULL WHEN before < total * 0.8 THEN 'A' WHEN before < total * 0.95 THEN 'B' ELSE 'C' END AS contribution_band
FROM (SELECT i.item_id, i.amount, coalesce((SELECT sum(CAST(b.amount AS DECIMAL(28,2))) FROM items b WHERE b.amount > i.amount), 0) AS before,
        (SELECT sum(CAST(b.amount AS DECIMAL(28,2))) FROM items b WHERE b.amount = i.amount) AS own,
        (SELECT count(*) FROM items b WHERE b.amount > i.amount) AS before_n,
        (SELECT sum(CAST(b.amount AS DECIMAL(28,2))) FROM items b) AS total, (SELECT count(*) FROM items) AS n,
        (SELECT count(*) FROM items WHERE amount IS NULL) AS gaps FROM items i)
WHERE gaps = 0 AND total > 0
"""
BLOCKS["weekly_change"] = """
SELECT item_id, CASE WHEN gap THEN 'missing_records' WHEN before > 0 THEN 'available' ELSE 'no_baseline' END AS status,
  CASE WHEN NOT gap THEN now END AS current_quantity, CASE WHEN NOT gap THEN before END AS previous_quantity,
  CASE WHEN NOT gap AND before > 0 THEN (now - before) / before END AS early_change, CASE WHEN NOT gap THEN abs(now - before) END AS early_units
FROM (SELECT item_id, bool_or(quantity IS NULL) AS gap, sum(quantity) FILTER (WHERE day >= DATE '2001-06-24') AS now,
        sum(quantity) FILTER (WHERE day < DATE '2001-06-24') AS before FROM grid WHERE day >= DATE '2001-06-17' GROUP BY item_id)
"""
BLOCKS["flagged"] = """
SELECT *, list_filter([CASE WHEN quiet AND contribution_band = 'A' AND amount > 0 THEN 'contribution' END,
    CASE WHEN moved AND change > 0 THEN 'growth' END, CASE WHEN moved AND change < 0 THEN 'decline' END,
    CASE WHEN anomaly_days > 0 THEN 'anomaly' END], lambda x: x IS NOT NULL) AS flags
FROM (SELECT i.item_id, i.name, i.category, i.quantity, i.amount, w.status, b.contribution_band, coalesce(a.n, 0) AS anomaly_days,
        CASE WHEN w.status = 'available' THEN (w.current_quantity - w.previous_quantity) / w.previous_quantity END AS change,
        coalesce(w.status = 'available' AND abs((w.current_quantity - w.previous_quantity) / w.previous_quantity) >= 0.25
                 AND abs(w.current_quantity - w.previous_quantity) >= 3, FALSE) AS moved,
        NOT coalesce(abs(early_change) >= 0.25 AND early_units >= 3, FALSE) AND a.n IS NULL AS quiet
      FROM items i LEFT JOIN weekly_change w ON w.item_id = i.item_id LEFT JOIN bands b ON b.item_id = i.item_id
      LEFT JOIN (SELECT item_id, count(*) AS n FROM anoms GROUP BY 1) a ON a.item_id = i.item_id)
"""
BLOCKS["fgrid"] = BLOCKS["grid"].replace(" AND c.day <> DATE '2001-03-15'", "")
BLOCKS["origins"] = "SELECT CAST(667 + 7 * i AS INTEGER) AS origin FROM range(0, 35) r(i)"
BLOCKS["past"] = """
SELECT * FROM (SELECT item_id, origin, any_value(first) AS first,
  count(*) FILTER (WHERE t >= first AND t < origin + 7 AND quantity IS NULL) AS gaps,
  list(quantity ORDER BY t) FILTER (WHERE t < origin AND quantity IS NOT NULL) AS past,
  list([quantity, pos + 1, pos] ORDER BY t) FILTER (WHERE t < origin AND quantity > 0) AS sold,
  coalesce(sum(quantity) FILTER (WHERE t >= origin AND t < origin + 7), 0) AS actual,
  coalesce(sum(quantity) FILTER (WHERE t >= origin - 7 AND t < origin), 0) AS last_week,
  coalesce(sum(quantity) FILTER (WHERE t >= origin - 28 AND t < origin), 0) / 4 AS four_week_mean,
  count(*) FILTER (WHERE t >= origin - 28 AND t < origin AND quantity <> 0) AS selling
  FROM (SELECT *, min(CASE WHEN quantity IS NOT NULL THEN t END) OVER (PARTITION BY item_id) AS first,
          CAST(count(quantity) OVER (PARTITION BY item_id ORDER BY t) - 1 AS DOUBLE) AS pos FROM fgrid), origins GROUP BY item_id, origin)
WHERE gaps = 0 AND origin >= first + 28
"""
BLOCKS["btest"] = """
SELECT item_id, origin, (CASE WHEN selling < 14 THEN 'intermittent' ELSE 'regular' END)
    || (CASE WHEN four_week_mean / 7 < 5 THEN '_small' ELSE '_large' END) AS stratum, actual, last_week, four_week_mean,
  greatest(0.0, 7 * list_reduce(past, lambda a, x: a + 0.2 * (x - a))) AS exponential_smoothing,
  CASE WHEN len(sold) > 0 THEN greatest(0.0, 0.95 * est[1] / est[2] * 7) ELSE 0.0 END AS croston_sba,
  CASE WHEN origin < 751 THEN 'validation' WHEN origin < 891 THEN 'calibration' ELSE 'test' END AS split
FROM (SELECT *, list_reduce(sold, lambda a, x: [a[1] + 0.1 * (x[1] - a[1]), a[2] + 0.1 * (x[3] - a[3] - a[2]), x[3]]) AS est FROM past)
"""
BLOCKS["errs"] = """
SELECT item_id, origin, split, stratum, actual, unnest(['last_week', 'four_week_mean', 'exponential_smoothing', 'croston_sba']) AS method,
  unnest([1, 2, 3, 4]) AS place, abs(unnest([last_week, four_week_mean, exponential_smoothing, croston_sba]) - actual) AS off,
  unnest([last_week, four_week_mean, exponential_smoothing, croston_sba]) - actual AS bias FROM btested
"""
BLOCKS["sums"] = """
SELECT stratum, method, place, sum(off) AS off, count(*) AS n, count(DISTINCT origin) AS origins FROM errs WHERE split = 'validation' GROUP BY ALL
UNION ALL SELECT 'all', method, place, sum(off), count(*), count(DISTINCT origin) FROM errs WHERE split = 'validation' GROUP BY ALL
"""
BLOCKS["base1"] = "SELECT method AS baseline, off / n AS all_mae FROM sums WHERE stratum = 'all' AND place <= 2 ORDER BY off / n, place LIMIT 1"
BLOCKS["cand"] = """
SELECT stratum, method AS candidate, mae AS candidate_mae, n, origins FROM (SELECT *, off / n AS mae,
  row_number() OVER (PARTITION BY stratum ORDER BY off / n, place) AS r FROM sums WHERE stratum LIKE 'intermittent%' OR stratum = 'all' OR place < 4) WHERE r = 1
"""
BLOCKS["chosen"] = """
SELECT c.*, b.baseline, b.all_mae, s.off / s.n AS baseline_mae,
  s.off > 0 AND c.candidate_mae <= 0.95 * s.off / s.n AND (c.stratum <> 'all' OR NOT EXISTS (
    SELECT 1 FROM sums x JOIN sums y ON y.stratum = x.stratum WHERE x.stratum <> 'all' AND x.n >= 30 AND x.method = c.candidate
      AND y.method = b.baseline AND x.off / x.n > 1.05 * y.off / y.n)) AS passed
FROM cand c, base1 b JOIN sums s ON s.method = b.baseline WHERE s.stratum = c.stratum
"""
BLOCKS["policy"] = """
SELECT stratum, baseline, candidate, candidate_mae, baseline_mae, passed AS validation_adopted,
  CASE WHEN adopted AND passed THEN candidate ELSE baseline END AS selected, adopted AS policy_adopted
FROM (SELECT *, bool_or(passed AND candidate <> baseline) OVER () AND (SELECT sum(s.off) / sum(s.n) FROM chosen k JOIN sums s ON s.stratum = k.stratum
    AND s.method = CASE WHEN NOT (k.n >= 30 AND k.origins >= 6) THEN (SELECT CASE WHEN passed THEN candidate ELSE baseline END FROM chosen WHERE stratum = 'all')
      WHEN k.passed THEN k.candidate ELSE k.baseline END WHERE k.stratum <> 'all') <= 0.95 * all_mae AS adopted
  FROM chosen WHERE stratum = 'all' OR (n >= 30 AND origins >= 6))
"""
BLOCKS["picked"] = """
SELECT b.*, coalesce(p.selected, (SELECT selected FROM policy WHERE stratum = 'all')) AS selected_method,
  CASE coalesce(p.selected, (SELECT selected FROM policy WHERE stratum = 'all')) WHEN 'last_week' THEN last_week WHEN 'four_week_mean' THEN four_week_mean
    WHEN 'exponential_smoothing' THEN exponential_smoothing ELSE croston_sba END AS chosen_value
FROM btested b LEFT JOIN policy p ON p.stratum = b.stratum
"""
BLOCKS["bpairs"] = """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS order_id, p_brand AS item_id FROM lineitem JOIN part ON l_partkey = p_partkey
"""
BLOCKS["btimes"] = """
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS tm, CAST(o_custkey AS VARCHAR) AS customer_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey
"""
BLOCKS["rtimes"] = """
SELECT 'r' || c_custkey || '-' || k AS order_id, CAST(DATE '2001-03-20' AS TIMESTAMP) + to_days(CAST(20 * k AS INTEGER)) AS tm, CAST(-c_custkey AS VARCHAR) AS customer_id
FROM customer, UNNEST([0, 1, 2, 3, 4]) AS visits(k) WHERE c_custkey % 10 = 0
UNION ALL SELECT * FROM btimes
"""
BLOCKS["bcuts"] = """
SELECT max(tm) FILTER (WHERE r = least(n - 1, floor(n * 0.6::DOUBLE))) AS c0, max(tm) FILTER (WHERE r = least(n - 1, floor(n * 0.8::DOUBLE))) AS c1
FROM (SELECT tm, row_number() OVER (ORDER BY tm) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT tm FROM btimes))
"""
BLOCKS["bsplit"] = """
SELECT order_id, tm, CASE WHEN tm < c0 THEN 'train' WHEN tm < c1 THEN 'validation' ELSE 'test' END AS split FROM btimes, bcuts
"""
BLOCKS["train"] = "SELECT p.* FROM bpairs p JOIN bsplit s ON s.order_id = p.order_id WHERE split = 'train'"
BLOCKS["valid"] = "SELECT p.* FROM bpairs p JOIN bsplit s ON s.order_id = p.order_id WHERE split = 'validation'"
BLOCKS["bneed"] = "SELECT count(DISTINCT order_id) AS total, ceil(greatest(0.005 * count(DISTINCT order_id), 20)) AS need FROM train"
BLOCKS["sets"] = """
SELECT [item_id] AS items, count(*) AS n FROM train GROUP BY item_id HAVING count(*) >= (SELECT need FROM bneed)
UNION ALL SELECT [a.item_id, b.item_id], count(*) FROM train a JOIN train b ON b.order_id = a.order_id AND a.item_id < b.item_id
  GROUP BY a.item_id, b.item_id HAVING count(*) >= (SELECT need FROM bneed)
UNION ALL SELECT [a.item_id, b.item_id, c.item_id], count(*) FROM train a JOIN train b ON b.order_id = a.order_id AND a.item_id < b.item_id
  JOIN train c ON c.order_id = a.order_id AND b.item_id < c.item_id GROUP BY a.item_id, b.item_id, c.item_id HAVING count(*) >= (SELECT need FROM bneed)
"""
BLOCKS["mined"] = """
SELECT array_to_string(a, ' | ') AS antecedents, array_to_string(b, ' | ') AS consequents, a, b, n_ab, x.n AS n_a, y.n AS n_b, total AS denominator,
  n_ab / total AS support, n_ab / x.n AS confidence, n_ab * total / (x.n * y.n) AS lift,
  n_ab / total - x.n * y.n / (total * total) AS leverage,
  greatest(0, (n_ab / x.n + zz / (2 * x.n)) / (1 + zz / x.n) - z * sqrt(n_ab / x.n * (1 - n_ab / x.n) / x.n + zz / (4 * x.n * x.n)) / (1 + zz / x.n)) AS confidence_lower,
  least(1, (n_ab / x.n + zz / (2 * x.n)) / (1 + zz / x.n) + z * sqrt(n_ab / x.n * (1 - n_ab / x.n) / x.n + zz / (4 * x.n * x.n)) / (1 + zz / x.n)) AS confidence_upper
FROM (SELECT a, list_sort(list_filter(items, lambda i: NOT list_contains(a, i))) AS b, n AS n_ab
      FROM (SELECT items, n, unnest(CASE len(items) WHEN 2 THEN [[items[1]], [items[2]]] WHEN 3 THEN [[items[1]], [items[2]], [items[3]],
        [items[1], items[2]], [items[1], items[3]], [items[2], items[3]]] ELSE [] END) AS a FROM sets)) s
JOIN (SELECT items AS i1, n FROM sets) x ON x.i1 = s.a JOIN (SELECT items AS i2, n FROM sets) y ON y.i2 = s.b,
  (SELECT CAST(total AS DOUBLE) AS total, 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS zz FROM bneed)
WHERE n_ab / x.n >= 0.1
"""
BLOCKS["bheld"] = """
SELECT order_id, item_id AS target FROM (SELECT p.order_id, item_id, count(*) OVER (PARTITION BY p.order_id) AS size,
  row_number() OVER (PARTITION BY p.order_id ORDER BY substr(md5(p.order_id || ':' || item_id || ':43'), 1, 15), item_id) AS r
  FROM bpairs p JOIN bsplit s ON s.order_id = p.order_id WHERE split = 'test') WHERE r = 1 AND size >= 2
"""
BLOCKS["bseen"] = "SELECT p.* FROM bpairs p JOIN bheld h ON h.order_id = p.order_id WHERE p.item_id <> h.target"
BLOCKS["reclists"] = """
SELECT order_id, list(item_id ORDER BY r) AS recs FROM (SELECT order_id, item_id, row_number() OVER (PARTITION BY order_id ORDER BY s.cl DESC, s.l DESC, s.n DESC, item_id) AS r
  FROM (SELECT order_id, item_id, max(s) AS s FROM (SELECT order_id, basket, unnest(b) AS item_id, {'cl': confidence_lower, 'l': lift, 'n': n_ab} AS s
    FROM (SELECT order_id, list(item_id) AS basket FROM bseen WHERE item_id IN (SELECT item_id FROM train) GROUP BY 1) JOIN mined ON list_has_all(basket, a))
    WHERE NOT list_contains(basket, item_id) GROUP BY ALL)) WHERE r <= 5 GROUP BY 1
"""
BLOCKS["poplists"] = """
SELECT order_id, list(item_id ORDER BY r) AS pops FROM (SELECT o.order_id, p.item_id, row_number() OVER (PARTITION BY o.order_id ORDER BY p.n DESC, p.item_id) AS r
  FROM (SELECT DISTINCT order_id FROM bseen) o CROSS JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) p
  WHERE NOT EXISTS (SELECT 1 FROM bseen v WHERE v.order_id = o.order_id AND v.item_id = p.item_id)) WHERE r <= 5 GROUP BY 1
"""
BLOCKS["bcases"] = """
SELECT *, list_contains(recs, target)::INT AS hit, list_contains(pops, target)::INT AS popular_hit,
  list_concat(recs, list_filter(pops, lambda x: NOT list_contains(recs, x)))[1:5] AS hybrid
FROM (SELECT h.order_id, target, coalesce(recs, []::VARCHAR[]) AS recs, coalesce(pops, []::VARCHAR[]) AS pops
  FROM bheld h LEFT JOIN reclists r ON r.order_id = h.order_id LEFT JOIN poplists p ON p.order_id = h.order_id)
"""


def query(text: str) -> str:
    """Prefix a SELECT with the blocks it names, in dependency order."""
    wanted: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", body)):
            if name in BLOCKS and name not in wanted and name not in open_:
                open_.append(name)
                visit(BLOCKS[name])
                wanted.append(name)
                open_.remove(name)

    open_: list[str] = []
    visit(text)
    if not wanted:
        return text.strip()
    parts = ",\n".join(f"{name} AS MATERIALIZED ({BLOCKS[name].strip()})" for name in wanted)
    return f"WITH {parts}\n{text.strip()}"
