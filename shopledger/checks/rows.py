"""Queries on sources, rows and orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..config import Report
from ..functions.money import money
from ..functions.times import parse_time
from ..operators import normalize as n
from ..operators import orders as o
from ..operators import sales as s
from ..sources import readers, writers
from ..sources.stage import fresh_path as scratch
from .registry import check
from .tables import POLICY, REPORT, SCOPE, ZONE, canonical, facts, fresh_labels, labelled, mapping, paired, raw_lines, raw_view, source_rows, table

LINE, TOTAL, PRICE, BOTH = (mapping(m) for m in ("line_amount", "order_amount", "quantity_unit_price", "both"))


def rows(spark, d, mode="line_amount"):
    return n.normalize(canonical(spark, d, mode), mapping(mode))


def resolved(spark, d, mode="line_amount", scope=SCOPE):
    """Stored normalised rows with duplicate marks, and the orders resolved from them."""
    base = paired(spark, d, mode)
    return base, o.resolve_orders(base, mapping(mode), POLICY, scope)


COPIES = """(SELECT source_row_id AS copy_id, row_number() OVER (PARTITION BY order_id, item_id, item_name, customer_id, event_time,
  quantity, unit_price, line_amount, order_amount, currency, record_status, country, category, item_type
  ORDER BY source_row_id) AS copy_no FROM lines)"""


# --- sources -------------------------------------------------------------------------------------

CUSTOMER_TEXT = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"""


def customer_text(spark, d):
    people = table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return people.select([F.col(c).cast("string").alias(c) for c in people.columns])


@check("a01_read_csv", CUSTOMER_TEXT)
def _(spark, d):
    source, path = customer_text(spark, d), scratch(spark, "csv")
    source.write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, source.columns, sep=";")


BLANK_ROWS = """
SELECT count(*) FILTER (WHERE b) AS blank_rows, count(*) AS rows
FROM (SELECT NOT (coalesce(length(trim(CASE WHEN l_orderkey % 50 = 0 THEN '  ' ELSE l_returnflag END)) > 0, FALSE)
  OR coalesce(length(trim(CASE WHEN l_orderkey % 25 = 0 THEN NULL ELSE l_linestatus END)) > 0, FALSE)) AS b FROM lineitem)
"""


@check("a03_observed_blank_rows", BLANK_ROWS)
def _(spark, d):
    """Counted by the pass that writes the rows."""
    seen = Observation("blanks")
    readers.blanks_to_null(blanked(spark, d), ("row_id",), seen).write.format("noop").mode("overwrite").save()
    return readers.counts_seen(spark, seen)


@check("a03_blank_rows", BLANK_ROWS)
def _(spark, d):
    return readers.blank_row_count(blanked(spark, d), keep=("row_id",))


def blanked(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id",
        "CASE WHEN l_orderkey % 50 = 0 THEN '  ' ELSE l_returnflag END AS flag",
        "CASE WHEN l_orderkey % 25 = 0 THEN NULL ELSE l_linestatus END AS line",
    )


@check("a03_blanks_to_null", """
SELECT row_id, flag, line FROM (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CASE WHEN l_orderkey % 50 <> 0 THEN l_returnflag END AS flag, CASE WHEN l_orderkey % 25 <> 0 THEN l_linestatus END AS line
  FROM lineitem) WHERE flag IS NOT NULL OR line IS NOT NULL
""")
def _(spark, d):
    return readers.blanks_to_null(blanked(spark, d), keep=("row_id",))


@check("a04_union_parts", """
SELECT order_id, source_row_id, item_id FROM lines WHERE order_day < DATE '1998-01-01'
UNION ALL SELECT order_id, source_row_id, item_id FROM lines WHERE order_day >= DATE '1998-01-01'
""")
def _(spark, d):
    lines = raw_lines(spark, d)
    shown = ["order_id", "source_row_id", "item_id"]
    early = lines.filter(F.col("order_day") < F.lit(date(1998, 1, 1))).select(*shown)
    return readers.union_parts(early, lines.filter(F.col("order_day") >= F.lit(date(1998, 1, 1))).select(*shown))


@check("a05_explode_baskets", """
SELECT basket_id || ':' || pos AS source_row_id, basket_id, item AS item_id FROM (
  SELECT basket_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (
    SELECT CAST(l_orderkey AS VARCHAR) AS basket_id, list_sort(list_distinct(list(p_brand))) AS items
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))
""")
def _(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = lines.groupBy(F.col("l_orderkey").cast("string").alias("row")).agg(
        F.array_join(F.array_sort(F.collect_set("p_brand")), " | ").alias("goods")
    )
    return readers.explode_baskets(lists, "row", "goods", "|")


@check("a06_row_id", """
SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_row_id, count(*) AS rows
FROM lineitem GROUP BY ALL
""")
def _(spark, d):
    keyed = readers.with_row_id(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    )
    return keyed.groupBy("source_row_id").agg(F.count(F.lit(1)).alias("rows"))


_PROFILED = ["item_id", "customer_id", "event_time", "quantity", "currency", "record_status", "item_type"]


@check("a07_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values,
  (SELECT string_agg({c}, ' | ' ORDER BY {c}) FROM (SELECT DISTINCT {c} FROM lines WHERE {c} IS NOT NULL
   ORDER BY {c} LIMIT 3)) AS examples FROM lines""" for c in _PROFILED))
def _(spark, d):
    return readers.profile(raw_view(spark, d).select(*_PROFILED))


@check("a07_table_profile", """
SELECT count(*) AS rows, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day,
  (SELECT count(DISTINCT order_id) FROM lines) AS orders, (SELECT count(DISTINCT customer_id) FROM lines) AS customers,
  (SELECT count(*) FROM lines WHERE record_status = 'C') AS cancelled_rows,
  count(*) FILTER (WHERE quantity <= 0) AS nonpositive_quantity, count(*) FILTER (WHERE unit_price <= 0) AS nonpositive_price
FROM norm_price
""")
def _(spark, d):
    return readers.table_profile(canonical(spark, d, "quantity_unit_price"), PRICE)


@check("a08_canonicalize", """
SELECT source_row_id, order_id, item_id, item_name, customer_id, event_time, quantity, CAST(NULL AS VARCHAR) AS unit_price,
  line_amount, CAST(NULL AS VARCHAR) AS order_amount, 'EUR' AS currency, record_status, country, category, item_type FROM lines
""")
def _(spark, d):
    return readers.canonicalize(raw_view(spark, d), mapping(currency_constant="EUR"))


@check("a09_time_conformance", """
SELECT count(time_text) AS given, count(*) FILTER (WHERE time_text IS NOT NULL AND event_time IS NULL) AS not_conforming FROM norm
""")
def _(spark, d):
    return readers.time_conformance(canonical(spark, d), LINE)


@check("a09_observed_counts", f"""
SELECT (SELECT count(*) FROM lines) AS rows, count(time_text) AS given, count(*) FILTER (WHERE time_text IS NOT NULL AND event_time IS NULL) AS not_conforming,
  (SELECT count(*) FROM {COPIES} WHERE copy_no > 1) AS duplicate_candidates FROM norm
""")
def _(spark, d):
    """Counted by the pass that writes the paired rows."""
    seen = Observation("counts")
    pairs = o.pair_raw(canonical(spark, d), raw_view(spark, d))
    readers.with_counts(pairs, LINE, seen).write.format("noop").mode("overwrite").save()
    return readers.counts_seen(spark, seen)


@check("a10_source_calendar", """
SELECT CAST(min(day) AS VARCHAR) AS start, CAST(max(day) AS VARCHAR) AS "end",
  string_agg(DISTINCT strftime(day, '%Y-%m'), ',' ORDER BY strftime(day, '%Y-%m')) AS months,
  CASE WHEN last_day(max(day)) <> max(day) AND strftime(min(day), '%Y-%m') <> strftime(max(day), '%Y-%m')
       THEN strftime(date_trunc('month', max(day)) - INTERVAL 1 MONTH, '%Y-%m') ELSE strftime(max(day), '%Y-%m') END AS suggested_month
FROM norm
""")
def _(spark, d):
    return readers.source_calendar(canonical(spark, d), LINE)


@check("a06_content_id", """
SELECT sha256(concat_ws(chr(1), coalesce(item_id, chr(2)), coalesce(quantity, chr(2)), coalesce(currency, chr(2)))) || ':' || (row_number() OVER (PARTITION BY item_id, quantity, currency) - 1) AS source_row_id FROM lines
""")
def _(spark, d):
    return readers.with_content_id(raw_view(spark, d).select("item_id", "quantity", "currency")).select("source_row_id")


@check("a11_fingerprint")
def _(spark, d):
    return readers.fingerprint(source_rows(spark, d).drop("issues", "source_no"))


_TEXTS = ("source_row_id", "order_id", "item_id", "item_name", "customer_id", "event_time", "quantity", "unit_price", "line_amount", "order_amount",
          "currency", "record_status", "country", "category", "item_type")


@check("a11_text_fingerprint", f"""
SELECT version_id, count(*) AS rows, bit_xor(h) AS hash_xor, CAST(sum(h % 2147483647) AS BIGINT) AS hash_sum
FROM (SELECT version_id, CAST('0x' || substr(sha256(concat_ws(chr(1), {", ".join(f"coalesce({c}, chr(2))" for c in _TEXTS)})), 1, 15) AS BIGINT) AS h FROM src) GROUP BY 1
""")
def _(spark, d):
    """The raw text of both sources."""
    lines = raw_lines(spark, d)
    early = lines.filter(F.col("order_day") < F.lit(date(2001, 3, 1))).withColumn("version_id", F.lit("v1"))
    late = lines.filter(F.col("order_day") >= F.lit(date(2001, 1, 1))).withColumn("version_id", F.lit("v2"))
    return readers.fingerprint(early.unionByName(late).select("version_id", *_TEXTS))


@check("a11_repeated_sources", """
SELECT 'first' AS first_source, 'second' AS last_source, CAST(2 AS BIGINT) AS copies, count(*) AS rows FROM orders
""")
def _(spark, d):
    orders = table(spark, d, "orders")
    both = orders.withColumn("version_id", F.lit("first")).unionByName(orders.withColumn("version_id", F.lit("second")))
    other = table(spark, d, "orders").withColumns({"version_id": F.lit("third"), "o_totalprice": F.col("o_totalprice") + 1})
    return readers.repeated_sources(readers.fingerprint(both.unionByName(other)))


@check("a12_parquet", "SELECT CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, d):
    path = scratch(spark, "parquet")
    shown = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    writers.write_parquet(shown, path)
    return spark.read.schema(shown.schema).parquet(path)


@check("a13_formula_guard", """
SELECT source_row_id, CASE WHEN q LIKE '-%' OR q LIKE '=%' THEN '''' || q ELSE q END AS quantity,
  CASE WHEN i LIKE '=%' THEN '''' || i ELSE i END AS item_name
FROM (SELECT source_row_id, quantity AS q, CASE WHEN category = 'PROMO' THEN '=' || item_name ELSE item_name END AS i FROM lines)
""")
def _(spark, d):
    shown = raw_view(spark, d).select(
        "source_row_id", "quantity",
        F.when(F.col("category") == "PROMO", F.concat(F.lit("="), "item_name")).otherwise(F.col("item_name")).alias("item_name"),
    )
    path = scratch(spark, "safe-csv")
    writers.write_csv_safe(shown, path, ["quantity", "item_name"])
    return readers.read_csv(spark, path, shown.columns)


@check("a14_json", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def _(spark, d):
    path = scratch(spark, "json")
    shown = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    writers.write_json(shown, path)
    return spark.read.schema(shown.schema).json(path)


@check("a15_preview", "SELECT source_row_id, order_id, item_id FROM lines ORDER BY source_row_id LIMIT 50 OFFSET 200")
def _(spark, d):
    return readers.preview(raw_view(spark, d).select("source_row_id", "order_id", "item_id"), ["source_row_id"], 200, 50)


@check("a16_keyed_read", "SELECT source_row_id, quantity, order_id FROM lines WHERE record_status = 'C'")
def _(spark, d):
    lines = raw_view(spark, d)
    wanted = lines.filter("record_status = 'C'")
    return readers.keyed_read(lines, wanted, ["source_row_id", "quantity", "order_id"])


WEEKS = [f"W{i}" for i in range(52)]


def weekly_wide(spark, d):
    """Quantities of the 52 weeks from 2000-01-03 on, one column per week."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    week = F.floor(F.datediff("l_shipdate", F.lit(date(2000, 1, 3))) / 7).cast("int")
    inside = lines.withColumn("week", week).filter(F.col("week").between(0, 51))
    return inside.groupBy(F.col("p_name").alias("item_id")).agg(
        *[F.coalesce(F.sum(F.when(F.col("week") == i, F.col("l_quantity"))), F.lit(0.0)).alias(w) for i, w in enumerate(WEEKS)]
    )


WEEKLY_SQL = """
(SELECT i.item_id, CAST(w.week AS INTEGER) AS week, coalesce(q.q, 0) AS quantity
FROM (SELECT DISTINCT p_name AS item_id FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_shipdate >= TIMESTAMP '2000-01-03' AND l_shipdate < TIMESTAMP '2001-01-01') i
CROSS JOIN range(0, 52) w(week)
LEFT JOIN (SELECT p_name AS item_id, date_diff('day', DATE '2000-01-03', CAST(l_shipdate AS DATE)) // 7 AS week, sum(l_quantity) AS q
           FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE l_shipdate >= TIMESTAMP '2000-01-03' AND l_shipdate < TIMESTAMP '2001-01-01' GROUP BY ALL) q
  ON q.item_id = i.item_id AND q.week = w.week)
"""


@check("a17_weekly_long", f"SELECT * FROM {WEEKLY_SQL}")
def _(spark, d):
    return readers.weekly_long(weekly_wide(spark, d), "item_id", WEEKS)


# --- rows ----------------------------------------------------------------------------------------


@check("b01_trim_ids", """
SELECT source_row_id, nullif(trim(order_id), '') AS order_id, nullif(trim(item_id), '') AS item_id,
  nullif(trim(customer_id), '') AS customer_id FROM lines
""")
def _(spark, d):
    return n.trim_ids(canonical(spark, d)).select("source_row_id", "order_id", "item_id", "customer_id")


@check("b02_money", """
SELECT source_row_id, CAST(TRY_CAST(quantity AS DECIMAL(18,2)) AS DOUBLE) AS quantity,
  CAST(TRY_CAST(line_amount AS DECIMAL(18,2)) AS DOUBLE) AS line_amount FROM lines
""")
def _(spark, d):
    return raw_view(spark, d).select(
        "source_row_id", money(F.col("quantity")).alias("quantity"), money(F.col("line_amount")).alias("line_amount")
    )


@check("b03_parse_time", "SELECT source_row_id, CAST(event_time AS VARCHAR) AS event_time FROM norm")
def _(spark, d):
    moment = parse_time(F.col("event_time"), "%Y-%m-%d %H:%M:%S", ZONE)
    return raw_view(spark, d).select("source_row_id", moment.alias("event_time"))


@check("b03_iso_offset", """
SELECT event_id, CAST(date_trunc('second', ts) - INTERVAL 330 MINUTE AS VARCHAR) AS instant FROM events
""")
def _(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    return table(spark, d, "events").select("event_id", parse_time(text, "iso8601", ZONE).alias("instant"))


@check("b04_local_day", "SELECT source_row_id, CAST(day AS VARCHAR) AS day FROM norm")
def _(spark, d):
    return rows(spark, d).select("source_row_id", "day")


@check("b05_status", "SELECT record_status, count(*) AS rows FROM norm GROUP BY ALL")
def _(spark, d):
    return rows(spark, d).groupBy("record_status").agg(F.count(F.lit(1)).alias("rows"))


@check("b05_cancel_prefix", """
SELECT CASE WHEN upper(CASE WHEN record_status = 'C' THEN 'c' || order_id ELSE order_id END) LIKE 'C%' THEN 'cancelled'
  ELSE 'forward' END AS status, count(*) AS rows FROM lines GROUP BY ALL
""")
def _(spark, d):
    marked = F.when(F.col("record_status") == "C", F.concat(F.lit("c"), "order_id")).otherwise(F.col("order_id"))
    prefixed = raw_view(spark, d).withColumn("order_id", marked)
    return prefixed.groupBy(n.status(mapping(status_rule="uci_cancel_prefix")).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


@check("b06_currency", "SELECT source_row_id, currency FROM norm")
def _(spark, d):
    return raw_view(spark, d).select("source_row_id", n.currency(F.col("currency")).alias("currency"))


@check("b07_line_amount", """
SELECT source_row_id, CAST(quantity * unit_price AS DOUBLE) AS line_amount, CAST(line_amount AS DOUBLE) AS declared,
  coalesce(quantity * unit_price IS NOT NULL AND (line_amount <> quantity * unit_price OR bad_line), FALSE) AS conflict
FROM norm_both
""")
def _(spark, d):
    return rows(spark, d, "both").select(
        "source_row_id", "line_amount", F.col("source_line_amount").alias("declared"),
        F.array_contains("issues", "amount_source_conflict").alias("conflict"),
    )


@check("b08_issues", """
SELECT source_row_id, concat_ws(',', CASE WHEN order_id IS NULL THEN 'missing_order' END,
  CASE WHEN item_id IS NULL THEN 'missing_item' END, CASE WHEN customer_id IS NULL THEN 'missing_customer' END,
  CASE WHEN event_time IS NULL THEN 'invalid_time' END, CASE WHEN record_status = 'cancelled' THEN 'cancelled'
    WHEN record_status = 'return' THEN 'returned' WHEN record_status = 'unknown' THEN 'unknown_status' END,
  CASE WHEN bad_quantity THEN 'invalid_quantity' END, CASE WHEN bad_line THEN 'invalid_line_amount' END,
  CASE WHEN quantity IS NULL AND NOT bad_quantity THEN 'invalid_quantity' END,
  CASE WHEN quantity <= 0 THEN 'nonpositive_quantity' END, CASE WHEN currency IS NULL THEN 'unknown_currency' END) AS issues
FROM norm
""")
def _(spark, d):
    return rows(spark, d).select("source_row_id", "issues")


@check("b09_sales_reason", """
SELECT source_row_id, CASE WHEN item_id IS NULL THEN 'missing_item' WHEN day IS NULL THEN 'invalid_time'
  WHEN record_status = 'cancelled' THEN 'cancelled' WHEN record_status = 'return' THEN 'returned'
  WHEN record_status <> 'forward' THEN 'unknown_status' WHEN quantity IS NULL OR quantity <= 0 THEN 'invalid_quantity'
  ELSE 'included' END AS reason FROM norm
""")
def _(spark, d):
    return rows(spark, d).select("source_row_id", n.sales_reason(LINE).alias("reason"))


IN_SCOPE = "coalesce(day >= DATE '1996-01-01' AND day <= DATE '2001-06-30' AND currency = 'USD', FALSE)"


@check("b10_in_scope", f"SELECT source_row_id, {IN_SCOPE} AS inside FROM norm")
def _(spark, d):
    return rows(spark, d).select("source_row_id", n.in_scope(SCOPE).alias("inside"))


ROW_REASON = f"""CASE WHEN order_id IS NULL THEN 'missing_order' WHEN conflict THEN 'order_conflict'
  WHEN record_status = 'cancelled' THEN 'cancelled' WHEN record_status = 'return' THEN 'returned'
  WHEN record_status = 'unknown' THEN 'unknown_status' WHEN quantity IS NULL THEN 'invalid_quantity'
  WHEN quantity <= 0 THEN 'nonpositive_quantity' WHEN copy_no > 1 THEN 'duplicate_removed'
  WHEN {IN_SCOPE} THEN 'included' ELSE 'filtered_out' END"""



def order_sql(base: str) -> str:
    """Rows of one normalised block with their copy number, order conflict and primary reason."""
    return f"""(SELECT *, {ROW_REASON} AS primary_reason FROM (SELECT r.*, copy_no, coalesce(bad, FALSE) AS conflict
  FROM {base} r JOIN {COPIES} c ON c.copy_id = r.source_row_id
  LEFT JOIN (SELECT order_id AS bad_order, count(DISTINCT customer_id) > 1 OR count(DISTINCT event_time) > 1
    OR count(DISTINCT currency) > 1 AS bad FROM {base} GROUP BY 1) x ON bad_order = order_id))"""


@check("b11_primary_reason", f"SELECT source_row_id, primary_reason FROM {order_sql('norm')}")
def _(spark, d):
    base, orders = resolved(spark, d)
    return o.row_audit(base, orders, POLICY, SCOPE).select("source_row_id", "primary_reason")


@check("b12_item_types", "SELECT item_id, item_type, type_source FROM types")
def _(spark, d):
    return n.item_types(labelled(spark, d).filter("reason = 'included'"), REPORT)


MERCH = """coalesce(item_type, 'unknown') NOT IN ('fee_service', 'accounting') AND coalesce(type_source, '') <> 'conflicting_types'
  AND upper(trim(coalesce(name, ''))) NOT IN ('MANUAL', 'POSTAGE', 'DOTCOM POSTAGE', 'BANK CHARGES', 'DISCOUNT', 'MAILOUT', 'AMAZON FEE', 'AMAZONFEE')
  AND coalesce(quantity >= 0, FALSE)"""


@check("b14_scoped_amount", """
SELECT o.order_id, CAST(CASE WHEN kept = n THEN total WHEN kept_gap = 0 THEN kept_sum END AS DOUBLE) AS amount
FROM (SELECT order_id, count(*) AS n, min(order_amount) AS total FROM norm_total GROUP BY 1) o
LEFT JOIN (SELECT order_id, count(*) AS kept, count(*) - count(line_amount) AS kept_gap, sum(line_amount) AS kept_sum
           FROM norm WHERE record_status = 'forward' GROUP BY 1) k ON k.order_id = o.order_id
""")
def _(spark, d):
    totals = rows(spark, d, "order_amount").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("source_rows"), F.min("order_amount").cast("decimal(38,12)").alias("total")
    )
    kept = rows(spark, d).filter("record_status = 'forward'").select("order_id", F.col("line_amount").alias("amount"))
    return o.scoped_amount(totals, kept)


# --- joins and orders ----------------------------------------------------------------------------


@check("w01_raw_duplicates", f"SELECT copy_id AS source_row_id, copy_no > 1 AS duplicate_candidate FROM {COPIES}")
def _(spark, d):
    return o.raw_duplicates(raw_view(spark, d)).select("source_row_id", "duplicate_candidate")


@check("j01_pair_raw", f"SELECT source_row_id, item_id, copy_no > 1 AS duplicate_candidate FROM lines JOIN {COPIES} ON copy_id = source_row_id")
def _(spark, d):
    return o.pair_raw(canonical(spark, d), raw_view(spark, d)).select("source_row_id", "item_id", "duplicate_candidate")


@check("d01_order_amounts", """
SELECT order_id, source_rows, CASE WHEN issues = '' THEN CAST(total AS DOUBLE) END AS amount_candidate,
  CASE WHEN nc <= 1 THEN currency END AS currency, issues
FROM (SELECT *, concat_ws(',', CASE WHEN nc > 1 THEN 'mixed_currency' END, CASE WHEN ncust > 1 THEN 'conflicting_customer' END,
    CASE WHEN nt > 1 THEN 'conflicting_time' END, CASE WHEN gap > 0 THEN 'incomplete_line_amount' END,
    CASE WHEN nc = 0 THEN 'unknown_currency' END) AS issues
  FROM (SELECT order_id, count(*) AS source_rows, count(DISTINCT nullif(currency, '')) AS nc, min(nullif(currency, '')) AS currency,
      count(DISTINCT nullif(customer_id, '')) AS ncust, count(DISTINCT nullif(event_time, '')) AS nt,
      count(*) - count(TRY_CAST(line_amount AS DECIMAL(18,2))) AS gap, sum(TRY_CAST(line_amount AS DECIMAL(18,2))) AS total
    FROM lines GROUP BY order_id))
""")
def _(spark, d):
    return o.order_amounts(canonical(spark, d), "line_amount")


@check("d01_order_totals", """
SELECT order_id, source_rows, CASE WHEN issues = '' THEN CAST(total AS DOUBLE) END AS amount_candidate,
  CASE WHEN nc <= 1 THEN currency END AS currency, issues
FROM (SELECT *, concat_ws(',', CASE WHEN nc > 1 THEN 'mixed_currency' END, CASE WHEN ncust > 1 THEN 'conflicting_customer' END,
    CASE WHEN nt > 1 THEN 'conflicting_time' END, CASE WHEN ntotal > 1 THEN 'conflicting_order_amount' END,
    CASE WHEN ntotal = 0 THEN 'missing_order_amount' END, CASE WHEN nc = 0 THEN 'unknown_currency' END) AS issues
  FROM (SELECT order_id, count(*) AS source_rows, count(DISTINCT nullif(currency, '')) AS nc, min(nullif(currency, '')) AS currency,
      count(DISTINCT nullif(customer_id, '')) AS ncust, count(DISTINCT nullif(event_time, '')) AS nt,
      count(DISTINCT TRY_CAST(order_amount AS DECIMAL(18,2))) AS ntotal, min(TRY_CAST(order_amount AS DECIMAL(18,2))) AS total
    FROM lines GROUP BY order_id))
""")
def _(spark, d):
    return o.order_amounts(canonical(spark, d, "order_amount"), "order_amount")


def state_sql(base: str, value: str, total: str = "order_amount") -> str:
    good = f"coalesce({value} > 0, FALSE)"
    return f"""(SELECT order_id, count(*) AS source_rows, count(*) FILTER (WHERE copy_no = 1) AS effective_source_rows,
  min(customer_id) AS customer_id, min(event_time) AS event_time, min(currency) AS currency, bool_or(conflict) AS conflict,
  bool_or(customer_id IS NULL) AS customer_missing, bool_or(event_time IS NULL) AS time_invalid,
  bool_or(currency IS NULL) AS currency_missing,
  bool_or(item_id IS NULL OR quantity IS NULL OR record_status = 'unknown') AS basket_incomplete,
  min({total}) FILTER (WHERE copy_no = 1) AS total,
  count(DISTINCT {total}) FILTER (WHERE copy_no = 1) > 1 AS total_conflict,
  coalesce(bool_and({good}) FILTER (WHERE copy_no = 1), TRUE) AS lines_complete,
  coalesce(sum({value}) FILTER (WHERE copy_no = 1 AND {good}), 0) AS line_sum,
  count(*) FILTER (WHERE primary_reason = 'included') AS selected_rows,
  count(*) FILTER (WHERE primary_reason IN ('included', 'filtered_out')) AS before_scope,
  coalesce(sum({value}) FILTER (WHERE primary_reason = 'included' AND {good}), 0) AS selected_line_sum,
  coalesce(bool_and({good}) FILTER (WHERE primary_reason = 'included'), TRUE) AS selected_lines_complete,
  coalesce(bool_or(item_id IS NOT NULL) FILTER (WHERE primary_reason = 'included'), FALSE) AS has_items
FROM {order_sql(base)} GROUP BY order_id)"""


@check("d02_order_state", f"""
SELECT order_id, source_rows, effective_source_rows, customer_id, CAST(event_time AS VARCHAR) AS event_time, currency, conflict,
  customer_missing, time_invalid, currency_missing, basket_incomplete, lines_complete, CAST(line_sum AS DOUBLE) AS line_sum
FROM {state_sql('norm', 'line_amount')}
""")
def _(spark, d):
    state = o.order_state(paired(spark, d), LINE, POLICY, SCOPE)
    return state.select(
        "order_id", "source_rows", "effective_source_rows", "customer_id", "event_time", "currency", "conflict",
        "customer_missing", "time_invalid", "currency_missing", "basket_incomplete", "lines_complete", "line_sum",
    )


@check("d03_selected_lines", f"""
SELECT order_id, before_scope, selected_rows, CAST(selected_line_sum AS DOUBLE) AS selected_line_sum, selected_lines_complete, has_items
FROM {state_sql('norm', 'line_amount')}
""")
def _(spark, d):
    state = o.order_state(paired(spark, d), LINE, POLICY, SCOPE)
    return state.select("order_id", "before_scope", "selected_rows", "selected_line_sum", "selected_lines_complete", "has_items")


def final_with(base: str, value: str, mode: str, total: str = "order_amount") -> str:
    """Finalised orders for line_amount or order_amount mode."""
    if mode == "order_amount":
        reason = """CASE WHEN currency_missing THEN 'unknown_currency' WHEN total_conflict THEN 'conflicting_order_amount'
      WHEN total IS NULL OR total <= 0 THEN 'invalid_amount'
      WHEN selected_rows < effective_source_rows AND NOT selected_lines_complete THEN 'partial_order_amount' ELSE 'included' END"""
        source = "CASE WHEN selected_rows < effective_source_rows THEN 'selected_lines' ELSE 'order_amount_once' END"
        amount = "CASE WHEN selected_rows < effective_source_rows THEN selected_line_sum ELSE total END"
    else:
        reason = """CASE WHEN currency_missing THEN 'unknown_currency' WHEN NOT selected_lines_complete THEN 'invalid_amount'
      ELSE 'included' END"""
        source, amount = f"'{mode}'", "selected_line_sum"
    body = f"""SELECT *, CASE WHEN reason = 'included' AND (total_conflict OR coalesce(lines_complete AND line_sum <> total, FALSE))
      THEN 'amount_source_conflict' ELSE reason END AS amount_reason,
    CASE WHEN reason = 'included' THEN {source} ELSE 'none' END AS amount_source,
    CASE WHEN customer_missing THEN 'missing_customer' WHEN time_invalid THEN 'invalid_time' ELSE 'included' END AS rf_reason
  FROM (SELECT *, {reason} AS reason FROM {state_sql(base, value, total)} WHERE selected_rows > 0)"""
    return f"""(SELECT b.*, CASE WHEN rf_reason <> 'included' THEN rf_reason WHEN bad_customer IS NOT NULL
      THEN 'incomplete_customer_amount' ELSE amount_reason END AS rfm_reason,
      CASE WHEN amount_reason = 'included' THEN {amount} END AS amount
    FROM ({body}) b LEFT JOIN (SELECT DISTINCT customer_id AS bad_customer FROM ({body})
      WHERE rf_reason = 'included' AND amount_reason <> 'included') ON bad_customer = customer_id)"""


FIN = final_with("norm", "line_amount", "line_amount")
FIN_TOTAL = final_with("norm_total", "CAST(NULL AS DECIMAL(18,2))", "order_amount")


@check("d04_finalize_orders", f"SELECT order_id, amount_source, amount_reason, rf_reason, rfm_reason, CAST(amount AS DOUBLE) AS amount FROM {FIN}")
def _(spark, d):
    _, orders = resolved(spark, d)
    return o.selected(orders).select("order_id", "amount_source", "amount_reason", "rf_reason", "rfm_reason", "amount")


@check("d04_order_totals_once", f"SELECT order_id, amount_source, amount_reason, CAST(amount AS DOUBLE) AS amount FROM {FIN_TOTAL}")
def _(spark, d):
    _, orders = resolved(spark, d, "order_amount")
    return o.selected(orders).select("order_id", "amount_source", "amount_reason", "amount")


@check("j10_complete_customers", f"SELECT order_id, customer_id, rfm_reason FROM {FIN} WHERE rfm_reason = 'incomplete_customer_amount'")
def _(spark, d):
    _, orders = resolved(spark, d)
    return orders.filter("rfm_reason = 'incomplete_customer_amount'").select("order_id", "customer_id", "rfm_reason")


@check("d05_customer_metrics", f"""
SELECT customer_id, count(*) AS orders, CAST(max(event_time) AS VARCHAR) AS last_time, coalesce(CAST(sum(amount) AS DOUBLE), 0) AS amount
FROM {FIN} WHERE rf_reason = 'included' GROUP BY customer_id
""")
def _(spark, d):
    _, orders = resolved(spark, d)
    return o.customer_metrics(o.selected(orders).filter("rf_reason = 'included'"))


AUDIT = f"""(SELECT r.*, f.rf_reason AS o_rf, f.rfm_reason AS o_rfm, f.amount_reason AS o_amount, f.basket_incomplete AS o_basket
  FROM {order_sql('norm')} r LEFT JOIN {FIN} f ON f.order_id = r.order_id)"""


@check("j02_row_audit", f"""
SELECT source_row_id, order_id, item_id, primary_reason,
  CASE WHEN primary_reason = 'included' THEN o_rf ELSE primary_reason END AS rf_reason,
  CASE WHEN primary_reason = 'included' THEN o_rfm ELSE primary_reason END AS rfm_reason,
  CASE WHEN primary_reason = 'included' THEN o_amount ELSE primary_reason END AS amount_reason,
  CASE WHEN primary_reason <> 'included' THEN primary_reason WHEN o_basket THEN 'incomplete_basket' ELSE 'included' END AS association_reason
FROM {AUDIT}
""")
def _(spark, d):
    base, orders = resolved(spark, d)
    return o.row_audit(base, orders, POLICY, SCOPE).drop("issues")


@check("d06_reason_counts", f"""
SELECT view, reason, count(*) AS rows FROM (SELECT unnest(['common', 'rf', 'rfm', 'amount', 'association']) AS view,
  unnest([primary_reason, CASE WHEN primary_reason = 'included' THEN o_rf ELSE primary_reason END,
    CASE WHEN primary_reason = 'included' THEN o_rfm ELSE primary_reason END,
    CASE WHEN primary_reason = 'included' THEN o_amount ELSE primary_reason END,
    CASE WHEN primary_reason <> 'included' THEN primary_reason WHEN o_basket THEN 'incomplete_basket' ELSE 'included' END]) AS reason
  FROM {AUDIT}) GROUP BY ALL
""")
def _(spark, d):
    base, orders = resolved(spark, d)
    return o.reason_counts(o.row_audit(base, orders, POLICY, SCOPE))


@check("d07_issue_counts", """
SELECT issue, sum(n)::BIGINT AS rows FROM (
  SELECT 'missing_item' AS issue, count(*) FILTER (WHERE item_id IS NULL) AS n FROM norm
  UNION ALL SELECT 'missing_customer', count(*) FILTER (WHERE customer_id IS NULL) FROM norm
  UNION ALL SELECT 'invalid_time', count(*) FILTER (WHERE event_time IS NULL) FROM norm
  UNION ALL SELECT 'cancelled', count(*) FILTER (WHERE record_status = 'cancelled') FROM norm
  UNION ALL SELECT 'returned', count(*) FILTER (WHERE record_status = 'return') FROM norm
  UNION ALL SELECT 'unknown_status', count(*) FILTER (WHERE record_status = 'unknown') FROM norm
  UNION ALL SELECT 'invalid_quantity', count(*) FILTER (WHERE quantity IS NULL) FROM norm
  UNION ALL SELECT 'invalid_line_amount', count(*) FILTER (WHERE bad_line) FROM norm
  UNION ALL SELECT 'nonpositive_quantity', count(*) FILTER (WHERE quantity <= 0) FROM norm
  UNION ALL SELECT 'unknown_currency', count(*) FILTER (WHERE currency IS NULL) FROM norm) WHERE n > 0 GROUP BY issue
""")
def _(spark, d):
    return n.issue_counts(rows(spark, d))


@check("d07_missing_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) - count({c}) AS missing FROM norm" for c in ("item_id", "customer_id", "event_time", "quantity", "line_amount", "currency", "item_type")))
def _(spark, d):
    return n.missing_counts(rows(spark, d), ("item_id", "customer_id", "event_time", "quantity", "line_amount", "currency", "item_type"))


BASKET = f"""(SELECT DISTINCT r.order_id, r.item_id, f.event_time, f.time_invalid, f.customer_id FROM {order_sql('norm')} r
  JOIN {FIN} f ON f.order_id = r.order_id WHERE r.primary_reason = 'included' AND r.item_id IS NOT NULL
  AND NOT f.basket_incomplete AND f.has_items)"""


@check("d08_capabilities", f"""
SELECT count(*) AS selected_orders, count(*) FILTER (WHERE rf_reason = 'included') AS rf_orders,
  count(DISTINCT customer_id) FILTER (WHERE rf_reason = 'included') AS rf_customers,
  count(*) FILTER (WHERE rfm_reason = 'included') AS rfm_orders,
  count(DISTINCT customer_id) FILTER (WHERE rfm_reason = 'included') AS rfm_customers,
  count(amount) AS amount_orders, count(*) FILTER (WHERE basket_incomplete) AS incomplete_baskets,
  (SELECT count(DISTINCT order_id) FROM {BASKET}) AS complete_baskets,
  (SELECT count(DISTINCT item_id) FROM {BASKET}) AS unique_items,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {BASKET} GROUP BY order_id)) AS max_basket_size,
  round(date_diff('second', min(event_time) FILTER (WHERE rf_reason = 'included'),
        max(event_time) FILTER (WHERE rf_reason = 'included')) / 86400.0::DOUBLE, 3) AS rf_span_days,
  concat_ws(',', CASE WHEN count(DISTINCT customer_id) FILTER (WHERE rf_reason = 'included') < 50 THEN 'few_customers' END) AS rf_codes,
  concat_ws(',', CASE WHEN count(DISTINCT customer_id) FILTER (WHERE rfm_reason = 'included') < 50 THEN 'few_customers' END,
    CASE WHEN bool_or(rfm_reason = 'incomplete_customer_amount') THEN 'incomplete_customers' END,
    CASE WHEN bool_or(amount_reason = 'amount_source_conflict') THEN 'amount_source_conflict' END) AS rfm_codes,
  concat_ws(',', CASE WHEN (SELECT count(DISTINCT order_id) FROM {BASKET}) < 200 THEN 'few_baskets' END) AS association_codes
FROM {FIN}
""")
def _(spark, d):
    base, orders = resolved(spark, d)
    found = o.capabilities(o.selected(orders), o.basket_items(base, orders, POLICY, SCOPE), LINE, POLICY)
    return found.select(
        "selected_orders", "rf_orders", "rf_customers", "rfm_orders", "rfm_customers", "amount_orders", "incomplete_baskets",
        "complete_baskets", "unique_items", "max_basket_size", "rf_span_days", "rf_codes", "rfm_codes", "association_codes",
    )


for _view in ("rf", "rfm", "amount"):
    def _build(spark, d, view=_view):
        _, orders = resolved(spark, d)
        return o.order_views(orders)[f"{view}_orders"]

    check(f"d09_{_view}_orders", f"""
    SELECT order_id, customer_id, CAST(event_time AS VARCHAR) AS event_time, currency, CAST(amount AS DOUBLE) AS amount, amount_source,
      source_rows, effective_source_rows, selected_rows, selected_rows < effective_source_rows AS partial_order
    FROM {FIN} WHERE {_view}_reason = 'included'
    """)(_build)


@check("d09_basket_items", f"""
SELECT order_id, item_id, CASE WHEN NOT time_invalid THEN CAST(event_time AS VARCHAR) END AS event_time, customer_id FROM {BASKET}
""")
def _(spark, d):
    base, orders = resolved(spark, d)
    return o.basket_items(base, orders, POLICY, SCOPE)


# --- merging sources -----------------------------------------------------------------------------


@check("w02_duplicates", """
SELECT version_id, source_row_id, duplicate_candidate FROM lab
""")
def _(spark, d):
    return s.duplicates(source_rows(spark, d)).select("version_id", "source_row_id", "duplicate_candidate")


@check("j03_order_conflicts", """
SELECT version_id, order_id, count(*) AS order_rows, TRUE AS conflict FROM snorm WHERE day <= DATE '2001-06-30'
GROUP BY ALL HAVING count(DISTINCT event_time) > 1 OR count(DISTINCT customer_id) > 1 OR count(DISTINCT currency) > 1
""")
def _(spark, d):
    return s.order_conflicts(source_rows(spark, d), LINE, REPORT)


@check("j04_tag_replaced", """
SELECT version_id, source_row_id, coalesce(version_id = 'v1' AND day BETWEEN (SELECT min(day) FROM snorm WHERE version_id = 'v2')
  AND (SELECT max(day) FROM snorm WHERE version_id = 'v2'), FALSE) AS replaced FROM snorm
""")
def _(spark, d):
    base = source_rows(spark, d)
    return s.tag_replaced(base, s.source_ranges(base)).select("version_id", "source_row_id", "replaced")


@check("j05_overlaps", """
SELECT a.v AS earlier, b.v AS later, CAST(greatest(a.x, b.x) AS VARCHAR) AS first_day, CAST(least(a.y, b.y) AS VARCHAR) AS last_day
FROM (SELECT version_id AS v, source_no AS i, min(day) AS x, max(day) AS y FROM snorm GROUP BY ALL) a
JOIN (SELECT version_id AS v, source_no AS i, min(day) AS x, max(day) AS y FROM snorm GROUP BY ALL) b
  ON b.i > a.i AND a.x <= b.y AND a.y >= b.x
""")
def _(spark, d):
    return s.overlaps(s.source_ranges(source_rows(spark, d)))


@check("u01_append", "SELECT version_id, count(*) AS rows, CAST(min(day) AS VARCHAR) AS first_day FROM snorm GROUP BY ALL")
def _(spark, d):
    return source_rows(spark, d).groupBy("version_id").agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"))


@check("u02_replace_overlap", "SELECT version_id, source_row_id, item_id, CAST(day AS VARCHAR) AS date, reason FROM lab")
def _(spark, d):
    return s.sales_audit(fresh_labels(spark, d))


@check("d14_reason_histogram", "SELECT reason, count(*) AS rows FROM lab GROUP BY ALL")
def _(spark, d):
    return s.reason_histogram(fresh_labels(spark, d))


@check("d14_quality_block", """
SELECT count(*) AS input_rows, count(*) FILTER (WHERE reason = 'included') AS included_rows,
  count(*) FILTER (WHERE reason <> 'included') AS excluded_rows, count(*) FILTER (WHERE duplicate_candidate) AS duplicate_candidates
FROM lab_keep
""")
def _(spark, d):
    kept = Report(**{**REPORT.__dict__, "merge_mode": "append", "duplicates": "keep"})
    return s.quality_block(fresh_labels(spark, d, report=kept))


@check("u03_currencies", """
SELECT DISTINCT currency FROM lab WHERE currency IS NOT NULL AND ((reason = 'included' AND line_amount >= 0)
  OR (reason = 'returned' AND day IS NOT NULL AND line_amount IS NOT NULL))
""")
def _(spark, d):
    return s.currencies(labelled(spark, d), LINE)


@check("u04_calendar_conflicts", """
SELECT '2001-03-15' AS day, TRUE AS also_missing,
  coalesce((SELECT max(quantity) > 0 FROM daily WHERE day = DATE '2001-03-15'), FALSE) AS sold
UNION ALL SELECT '2001-05-01', FALSE, TRUE WHERE (SELECT max(quantity) > 0 FROM daily WHERE day = DATE '2001-05-01')
""")
def _(spark, d):
    closed = Report(**{**REPORT.__dict__, "closed_dates": (date(2001, 3, 15), date(2001, 5, 1))})
    return s.calendar_conflicts(facts(spark, d)[1], closed)


@check("u05_months", "SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM daily")
def _(spark, d):
    return s.months(facts(spark, d)[1])


@check("j09_admit", """
SELECT l.version_id, l.source_row_id, CASE WHEN reason = 'order_conflict' THEN 'unknown' ELSE l.record_status END AS record_status
FROM lab l WHERE reason NOT IN ('outside_scope', 'replaced_range', 'duplicate_removed')
""")
def _(spark, d):
    base = source_rows(spark, d)
    audit = s.sales_audit(s.label(base, LINE, REPORT))
    return o.admit(base, audit).select("version_id", "source_row_id", "record_status")


@check("j08_drill", """
SELECT l.version_id, l.source_row_id, CAST(l.quantity AS DOUBLE) AS quantity, CAST(l.line_amount AS DOUBLE) AS line_amount,
  CAST(NULL AS DOUBLE) AS unit_price, CAST(event_time AS VARCHAR) AS event_time, reason
FROM lab l WHERE item_id = 'Brand#25' AND day = DATE '2001-06-09' ORDER BY version_id, source_row_id LIMIT 100
""")
def _(spark, d):
    base = source_rows(spark, d)
    audit = s.sales_audit(s.label(base, LINE, REPORT))
    return s.drill(audit, base, "Brand#25", date(2001, 6, 9))

