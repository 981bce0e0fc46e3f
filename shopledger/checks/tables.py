"""The shared test tables seen as a retail source: one raw view with planted faults, and settings.

Every fault is a fixed function of the row's keys, so the same view can be stated in SQL.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIELDS, Mapping, Policy, Report, Scope
from ..operators.anomaly import measured_days, rule_anomalies
from ..operators.baskets import baskets
from ..operators.items import item_day_grid
from ..operators.normalize import normalize
from ..operators.orders import pair_printed, with_print
from ..operators.sales import daily_fact, item_names, label
from ..sources.readers import canonicalize
from ..sources.stage import staged

STATUS = {"N": "forward", "A": "forward", "R": "return", "C": "cancelled"}
ZONE = "Europe/London"


def columns(*names: str) -> dict[str, str | None]:
    always = ("order_id", "item_id", "item_name", "customer_id", "event_time", "quantity", "currency",
              "record_status", "country", "category", "item_type")
    return {f: f if f in always or f in names else None for f in FIELDS}


def mapping(mode: str = "line_amount", **changes) -> Mapping:
    """One amount column mapped at a time, as the table's own amounts never agree."""
    amount = {"line_amount": ("line_amount",), "order_amount": ("order_amount",),
              "quantity_unit_price": ("unit_price",), "both": ("line_amount", "unit_price")}[mode]
    settings = dict(
        columns=columns(*amount), amount_mode="quantity_unit_price" if mode == "both" else mode, quantity_unit="piece",
        timezone=ZONE, status_rule="status_column", status_values=STATUS, time_format="%Y-%m-%d %H:%M:%S",
    )
    return Mapping(**{**settings, **changes})


REPORT = Report(
    month="2001-06",
    merge_mode="replace_overlap",
    duplicates="drop_exact",
    coverage_start=date(1999, 1, 1),
    coverage_end=date(2001, 6, 30),
    complete_coverage=True,
    missing_dates=(date(2001, 3, 15),),
    item_types={"Brand#9": "accounting"},
)
FORECAST = Report(**{**REPORT.__dict__, "missing_dates": ()})
POLICY = Policy(duplicates="drop_exact")
SCOPE = Scope(date_start=date(1996, 1, 1), date_end=date(2001, 6, 30), currency="USD")
UNKNOWN = REPORT.missing_dates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as text columns with faults, plus second copies of some lines."""
    # tables are spread by key at every size. Parts and customers, far fewer than the rows they meet, are hashed partition by partition, as
    # a sort of all lines by part would spill; then lines meet their order by a sort-merge join, so that the rows of an order end up side by side
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    placed = orders.join(people.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        lines.join(parts.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
        .join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("_copy", F.explode(F.when(
            (F.col("l_orderkey") % 163 == 0) & (F.col("l_linenumber") <= 2), F.array(F.lit(0), F.lit(1))
        ).otherwise(F.array(F.lit(0)))))
    )
    wall = "o_orderdate + make_interval(0, 0, 0, {day}, CAST(l_orderkey % 24 AS INT), 0, 0)"
    late = "CASE WHEN l_orderkey % 107 = 0 AND l_linenumber = 1 THEN 7 ELSE 0 END"
    return joined.selectExpr(
        "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)), _copy) AS source_row_id",
        "CAST(l_orderkey AS STRING) AS order_id",
        "CASE WHEN l_orderkey % 113 = 0 AND l_linenumber = 2 THEN NULL"
        " WHEN l_orderkey % 7 = 0 THEN concat(' ', p_brand, ' ') ELSE p_brand END AS item_id",
        "concat('Item ', p_brand) AS item_name",
        "CASE WHEN l_orderkey % 103 = 0 THEN NULL WHEN l_orderkey % 101 = 0 AND l_linenumber = 1"
        " THEN 'other' ELSE CAST(o_custkey AS STRING) END AS customer_id",
        f"CASE WHEN l_orderkey % 109 = 0 THEN 'not a time' ELSE date_format({wall.format(day=late)},"
        " 'yyyy-MM-dd HH:mm:ss') END AS event_time",
        "CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN NULL"
        " WHEN l_orderkey % 89 = 0 AND l_linenumber = 2 THEN '-1'"
        " WHEN l_orderkey % 211 = 0 AND l_linenumber = 3 THEN 'abc'"
        " WHEN l_orderkey % 199 = 0 AND l_linenumber = 1 THEN '0'"
        " ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING) END AS quantity",
        "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) AS unit_price",
        "CASE WHEN l_orderkey % 151 = 0 AND l_linenumber = 1 THEN NULL"
        " WHEN l_orderkey % 157 = 0 AND l_linenumber = 2 THEN '12,5'"
        " ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS line_amount",
        "CASE WHEN l_orderkey % 167 = 0 AND l_linenumber = 1 THEN '1.5' WHEN l_orderkey % 173 = 0 THEN NULL"
        " ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS order_amount",
        "CASE WHEN l_orderkey % 127 = 0 AND l_linenumber = 1 THEN NULL"
        " WHEN l_orderkey % 131 = 0 AND l_linenumber = 1 THEN 'US' WHEN l_orderkey % 5 = 0 THEN ' usd'"
        " ELSE 'USD' END AS currency",
        "CASE WHEN l_orderkey % 139 = 0 THEN 'X' WHEN l_orderkey % 149 = 0 THEN 'C' ELSE l_returnflag END AS record_status",
        "n_name AS country",
        "p_type AS category",
        "CASE p_brand WHEN 'Brand#3' THEN '实物' WHEN 'Brand#5' THEN 'fee_service'"
        " WHEN 'Brand#7' THEN CASE WHEN l_orderkey % 2 = 0 THEN 'physical' ELSE 'accounting' END"
        " WHEN 'Brand#11' THEN ' physical ' ELSE NULL END AS item_type",
        "CAST(o_orderdate AS DATE) AS order_day",
    )


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_lines(spark, sf_dir).drop("order_day")


def canonical(spark: SparkSession, sf_dir: str, mode: str = "line_amount") -> DataFrame:
    return canonicalize(raw_view(spark, sf_dir), mapping(mode))


_STORED: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, key: tuple, build) -> DataFrame:
    """What several queries read is built once per session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def stored(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Tables that several queries read are derived and written once per session."""
    return kept(spark, key, lambda: staged(build(), str(key[0])))


def paired(spark: SparkSession, sf_dir: str, mode: str = "line_amount") -> DataFrame:
    """Normalised rows of the whole table with their raw duplicate marks."""
    def build():
        raw = with_print(raw_view(spark, sf_dir))
        return normalize(canonicalize(raw, mapping(mode), keep=("_print",)), mapping(mode))

    return kept(spark, ("paired", sf_dir, mode), lambda: pair_printed(stored(spark, ("rows", sf_dir, mode), build)))


def source_rows(spark: SparkSession, sf_dir: str, mode: str = "line_amount") -> DataFrame:
    """Two overlapping sources: v1 up to February 2001, v2 from January 2001 on."""
    def build():
        lines = raw_lines(spark, sf_dir)
        one, two = (F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for v, n in (("v1", 1), ("v2", 2)))
        day, start, end = F.col("order_day"), F.lit(date(2001, 1, 1)), F.lit(date(2001, 3, 1))
        # a day of neither source (unknown) has no array and so no row
        version = F.explode(F.when(day < start, F.array(one)).when(day < end, F.array(one, two)).when(day >= end, F.array(two)))
        raw = lines.withColumn("_s", version).withColumns({"version_id": F.col("_s.v"), "source_no": F.col("_s.n")})
        setting = mapping(mode)
        return normalize(canonicalize(raw, setting, keep=("version_id", "source_no")), setting)

    return stored(spark, ("sources", sf_dir, mode), build)


def fresh_labels(spark: SparkSession, sf_dir: str, mode: str = "line_amount", report: Report = REPORT) -> DataFrame:
    """Rows of both sources, labelled in this query."""
    return label(source_rows(spark, sf_dir, mode), mapping(mode), report)


def labelled(spark: SparkSession, sf_dir: str, mode: str = "line_amount") -> DataFrame:
    """The labelled rows of the shared report; the rows are stored, their labels are cheap."""
    return kept(spark, ("labels", sf_dir, mode), lambda: fresh_labels(spark, sf_dir, mode))


def facts(spark: SparkSession, sf_dir: str, mode: str = "line_amount") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled rows, daily fact and item names of the shared report."""
    rows = labelled(spark, sf_dir, mode)
    return rows, daily_fact(rows, mapping(mode)), item_names(rows)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense item days of the shared report's calendar."""
    def build():
        _, daily, names = facts(spark, sf_dir)
        return item_day_grid(daily, names, REPORT, UNKNOWN)

    return stored(spark, ("grid", sf_dir), build)


def anomaly_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the month that break the simple rule; stands for the anomaly list where no model may enter."""
    return stored(spark, ("anomalies", sf_dir), lambda: rule_anomalies(measured_days(grid(spark, sf_dir), REPORT), REPORT))


def forecast_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        _, daily, names = facts(spark, sf_dir)
        return item_day_grid(daily, names, FORECAST)

    return stored(spark, ("forecast-grid", sf_dir), build)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct brands per order, from the whole line table."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return stored(spark, ("pairs", sf_dir), lambda: baskets(
        lines.select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("p_brand").alias("item_id"))
    ))


def regular_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order times, and beside them one buyer for every tenth customer who buys five times, twenty days apart, and then stops."""
    buyers = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    planted = buyers.select(
        F.concat(F.lit("r"), "c_custkey", F.lit("-"), "k").alias("order_id"), (-F.col("c_custkey")).cast("string").alias("customer_id"),
        F.date_add(F.lit(date(2001, 3, 20)), F.col("k") * 20).cast("timestamp").alias("event_time"),
    )
    return order_times(spark, sf_dir).select("order_id", "customer_id", "event_time").unionByName(planted)


def order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, time and customer of every order that has lines."""
    def build():
        lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
        return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_semi").select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderdate").alias("event_time"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        )

    return stored(spark, ("order-times", sf_dir), build)
