"""Monthly sales: merging sources, one reason per row, the daily fact, totals and store charts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LINE_MODES, Mapping, Report
from ..functions.money import PRODUCT
from ..functions.spread import any_of, attach, mark_repeats, repeated, sieve, sifted
from ..functions.times import month_of
from ..sources.stage import staged
from .normalize import sales_reason

ONE_BY_ONE = 16  # later ranges that are looked at one by one at most
ROW_ORDER = ("source_no", "source_row_id")  # first copy and first name follow this order
# What makes two normalised rows copies of each other.
CONTENT = [
    "order_id", "item_id", "item_name", "customer_id", "event_time", "quantity_text", "unit_price_text",
    "line_amount_text", "line_amount", "order_amount_text", "currency", "record_status", "country",
    "category", "item_type", "day",
]
# What rows that may be copies are found by: copies agree on it, and few others do. The rest follows from it, or is looked at once rows meet.
COPIED = [
    "order_id", "item_id", "customer_id", "event_time", "quantity_text", "unit_price_text", "line_amount_text", "order_amount_text",
    "record_status", "day",
]
# Reasons that leave an order's month incomplete.
BREAKS_ORDER = ("invalid_quantity", "missing_item", "order_conflict", "unknown_status")


def append(sources: Sequence[tuple[DataFrame, Mapping]]) -> DataFrame:
    """Union of normalised sources that agree on shape, unit, amount mode and zone."""
    if len({m.record_kind for _, m in sources}) != 1:
        raise ValueError("mixed_shapes")
    if len({(m.quantity_unit, m.amount_mode, m.timezone) for _, m in sources}) != 1:
        raise ValueError("mixed_semantics")
    return reduce(DataFrame.unionByName, [rows for rows, _ in sources])


def source_ranges(rows: DataFrame) -> DataFrame:
    """First and last day of each source, over all its rows (one row per source)."""
    return rows.filter(F.col("day").isNotNull()).groupBy("version_id", "source_no").agg(
        F.min("day").alias("start"), F.max("day").alias("end")
    )


def overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of sources whose date ranges meet; the table has one row per source."""
    later = ranges.select([F.col(c).alias("later_" + c) for c in ranges.columns])
    meets = (
        (F.col("later_source_no") > F.col("source_no"))
        & (F.col("start") <= F.col("later_end"))
        & (F.col("end") >= F.col("later_start"))
    )
    return ranges.join(later, meets).select(
        F.col("version_id").alias("earlier"),
        F.col("later_version_id").alias("later"),
        F.greatest("start", "later_start").alias("first_day"),
        F.least("end", "later_end").alias("last_day"),
    )


def check_append(ranges: DataFrame) -> None:
    if not overlaps(ranges).isEmpty():
        raise ValueError("overlapping_sources")


def tag_replaced(rows: DataFrame, ranges: DataFrame, sources: int | None = None) -> DataFrame:
    """Mark rows whose day lies in the range of a later source, even on days that source lacks.

    ``sources`` is the number of ``ranges`` if it is known: a few ranges are looked at one by one, as a lambda takes the whole step out of generated code.
    """
    later = overlaps_after(ranges)
    joined = rows.join(F.broadcast(later), "version_id", "left")  # one row per source
    inside = lambda r: (r["start"] <= F.col("day")) & (F.col("day") <= r["end"])
    if sources is not None and sources <= ONE_BY_ONE:
        covered = any_of(F.coalesce(inside(F.get("_later", F.lit(k))), F.lit(False)) for k in range(sources - 1))
    else:
        covered = F.exists("_later", inside)
    return joined.withColumn("replaced", F.coalesce(covered, F.lit(False))).drop("_later")


def overlaps_after(ranges: DataFrame) -> DataFrame:
    """Per source the ranges of all later sources (one short array per source)."""
    mine = ranges.select("version_id", F.col("source_no").alias("_no"))
    others = ranges.select(F.col("source_no").alias("_other"), F.struct("start", "end").alias("_range"))
    return mine.join(others, F.col("_other") > F.col("_no")).groupBy("version_id").agg(
        F.collect_list("_range").alias("_later")
    )


def order_conflicts(rows: DataFrame, mapping: Mapping, report: Report) -> DataFrame:
    """Orders of one source that disagree on time, customer or currency up to the month's end."""
    fields = ("event_time", "customer_id", "currency")
    if mapping.record_kind != "transactions":
        rows = rows.filter(F.lit(False))
    upto = rows.filter(F.col("order_id").isNotNull() & (F.col("day") <= F.lit(report.month_end)))
    state = upto.groupBy("version_id", "order_id").agg(
        F.count(F.lit(1)).alias("order_rows"),
        any_of(F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in fields).alias("conflict"),
    )
    return state.filter("conflict")


def duplicates(rows: DataFrame) -> DataFrame:
    """Later copies of a normalised row across all sources; number text counts, so 1.0 is not 1."""
    return mark_repeats(rows, CONTENT, list(ROW_ORDER), "duplicate_candidate")


def label(rows: DataFrame, mapping: Mapping, report: Report, ranges: DataFrame | None = None) -> DataFrame:
    """Give every row its one reason. Later rules override earlier ones.

    ``ranges`` (see source_ranges) are given where ``rows`` are only some of the sources' rows. ``rows`` are read several times, so they
    should be stored. Rows that may have a copy or may belong to a conflicting order are few: they alone are moved, marked and stored, the
    others are labelled where they are read.
    """
    order = ["version_id", "order_id"]
    conflicts = staged(order_conflicts(rows, mapping, report).select(*order, "conflict"), "order-conflicts")
    copies, clashes = staged(repeated(rows, COPIED), "copies-sieve"), staged(sieve(conflicts, order), "clash-sieve")
    parted = sifted(sifted(rows, copies, COPIED, "_copied"), clashes, order, "_clashes")
    odd = F.col("_copied") | F.col("_clashes")
    few = staged(parted.filter(odd).drop("_copied", "_clashes"), "odd-rows")
    marked = staged(attach(duplicates(few), conflicts, order), "marked-rows").unionByName(
        parted.filter(~odd).drop("_copied", "_clashes").withColumns({"duplicate_candidate": F.lit(False), "conflict": F.lit(None).cast("boolean")})
    )
    if report.merge_mode == "replace_overlap":
        # a row per source, read with every use of the labels
        ranges = staged(source_ranges(rows) if ranges is None else ranges, "ranges")
        marked = tag_replaced(marked, ranges, ranges.count())
    else:
        marked = marked.withColumn("replaced", F.lit(False))
    day = F.col("day")
    outside = day > F.lit(report.month_end)
    if report.coverage_end:
        outside = outside | (day > F.lit(report.coverage_end))
    if report.coverage_start:
        outside = outside | (day < F.lit(report.coverage_start))
    drop = F.lit(report.duplicates == "drop_exact")
    reason = (
        F.when(F.col("duplicate_candidate") & drop, "duplicate_removed")
        .when(F.coalesce(F.col("conflict"), F.lit(False)), "order_conflict")
        .when(F.col("replaced"), "replaced_range")
        .when(outside, "outside_scope")
        .otherwise(sales_reason(mapping))
    )
    return marked.withColumn("reason", reason).drop("conflict", "replaced")


def sales_audit(labelled: DataFrame) -> DataFrame:
    return labelled.select("version_id", "source_row_id", "item_id", F.col("day").alias("date"), "reason")


def reason_histogram(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def quality_block(labelled: DataFrame) -> DataFrame:
    """Input rows = included + excluded; duplicate candidates count even when they are kept."""
    included = F.col("reason") == "included"
    return labelled.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(included).alias("included_rows"),
        F.count_if(~included).alias("excluded_rows"),
        F.count_if("duplicate_candidate").alias("duplicate_candidates"),
    )


def usable_amount(mapping: Mapping) -> Column:
    """True when a line's amount may be added up."""
    return (
        F.col("line_amount").isNotNull()
        & (F.col("line_amount") >= 0)
        & F.col("currency").isNotNull()
        & ~F.array_contains("issues", "amount_source_conflict")
    )


def daily_fact(labelled: DataFrame, mapping: Mapping) -> DataFrame:
    """Quantity, amount and rows without a usable amount per day and item."""
    by_line = F.lit(mapping.amount_mode in LINE_MODES)
    good = usable_amount(mapping)
    zero = F.lit(0).cast(PRODUCT)
    return labelled.filter("reason = 'included'").groupBy("day", "item_id").agg(
        F.sum("quantity").alias("quantity"),
        F.coalesce(F.sum(F.when(by_line & good, F.col("line_amount"))), zero).cast(PRODUCT).alias("amount"),
        F.count_if(by_line & ~good).alias("amount_missing"),
    )


def item_names(labelled: DataFrame) -> DataFrame:
    """First name and category by source and row order, and the first day an item was sold."""
    order = F.struct(*ROW_ORDER)
    return labelled.filter("reason = 'included'").groupBy("item_id").agg(
        F.min_by(F.coalesce(F.nullif("item_name", F.lit("")), "item_id"), order).alias("name"),
        F.min_by("category", order).alias("category"),
        F.min("day").alias("first_day"),
    )


def months(daily: DataFrame) -> DataFrame:
    return daily.select(month_of(F.col("day")).alias("month")).distinct()


def currencies(labelled: DataFrame, mapping: Mapping) -> DataFrame:
    """Currencies of the amounts that enter the report, refunds included."""
    by_line = mapping.amount_mode in LINE_MODES
    included = F.col("reason") == "included"
    if by_line:
        refund = (F.col("reason") == "returned") & F.col("day").isNotNull() & F.col("line_amount").isNotNull()
        used = (included & usable_amount(mapping)) | refund
    else:
        used = included & F.col("order_id").isNotNull() & F.lit(mapping.amount_mode == "order_amount")
    return labelled.filter(used & F.col("currency").isNotNull()).select("currency").distinct()


def check_currency(labelled: DataFrame, mapping: Mapping) -> None:
    if currencies(labelled, mapping).limit(2).count() > 1:
        raise ValueError("mixed_currency")


def calendar_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def gap_days(daily: DataFrame, report: Report) -> DataFrame:
    """Runs of three or more days without any record in the store and no closure: unknown, not zero."""
    spark = daily.sparkSession
    start, end = report.coverage_start, min(report.coverage_end, report.month_end)
    observed = daily.select("day").distinct()
    absent = calendar_days(spark, start, end).join(observed, "day", "left_anti")
    if report.closed_dates:
        absent = absent.filter(~F.col("day").isin(*report.closed_dates))
    # The calendar has at most three years of days, so one task may order it.
    numbered = absent.withColumn("_run", F.date_sub("day", F.row_number().over(Window.orderBy("day")).cast("int")))
    long = numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_run")))
    return long.filter("_n >= 3").select("day")


def calendar_conflicts(daily: DataFrame, report: Report) -> DataFrame:
    """Closed days that were also stated missing, or on which something was sold."""
    spark = daily.sparkSession
    stated = [(d, d in report.missing_dates) for d in report.closed_dates]
    closed = spark.createDataFrame(stated, "day date, also_missing boolean")
    sold = daily.join(F.broadcast(closed.select("day")), "day", "left_semi").groupBy("day").agg(
        F.max("quantity").alias("top")
    )
    joined = closed.join(sold, "day", "left").withColumn("sold", F.coalesce(F.col("top") > 0, F.lit(False)))
    return joined.filter("also_missing or sold").select("day", "also_missing", "sold")


def month_totals(labelled: DataFrame, mapping: Mapping, report: Report) -> DataFrame:
    """Quantity, amount, orders and refunds of the month and the one before (two rows).

    Amount is null when any line is missing, orders are null when an order key is missing or broken.
    """
    spark = labelled.sparkSession
    wanted = [report.month, report.previous_end.strftime("%Y-%m")]
    by_line = mapping.amount_mode in LINE_MODES
    ordered = mapping.record_kind == "transactions" and mapping.order_boundary != "unavailable"
    in_months = labelled.withColumn("month", month_of(F.col("day"))).filter(F.col("month").isin(*wanted))
    included, returned = F.col("reason") == "included", F.col("reason") == "returned"
    good = usable_amount(mapping)
    refundable = F.lit(by_line) & F.col("line_amount").isNotNull() & F.col("currency").isNotNull()
    lines = in_months.groupBy("month").agg(
        F.sum(F.when(included, F.col("quantity"))).alias("quantity"),
        F.count_if(included).alias("rows"),
        F.count_if(included & F.lit(by_line) & ~good).alias("amount_missing_rows"),
        F.sum(F.when(included & good & F.lit(by_line), F.col("line_amount"))).alias("line_sum"),
        F.count_if(F.lit(ordered) & included & F.col("order_id").isNull()).alias("no_order"),
        F.count_if(F.col("reason").isin(*BREAKS_ORDER)).alias("broken"),
        F.sum(F.when(returned & refundable, F.abs("line_amount"))).alias("refund"),
        F.count_if(returned & ~refundable).alias("refund_missing"),
    )
    total = F.when(F.col("order_amount") >= 0, F.col("order_amount"))
    per_order = in_months.filter(included & F.lit(ordered) & F.col("order_id").isNotNull()).groupBy(
        "version_id", "order_id"
    ).agg(
        F.min("month").alias("month"),
        F.min(total).alias("low"),
        F.max(total).alias("high"),
        F.bool_or(total.isNull()).alias("gap"),
        F.min_by("currency", F.struct(*ROW_ORDER)).alias("currency"),
    )
    one = (F.col("low") == F.col("high")) & ~F.col("gap") & F.col("currency").isNotNull()
    orders = per_order.groupBy("month").agg(
        F.count(F.lit(1)).alias("orders"),
        F.bool_and(F.coalesce(one, F.lit(False))).alias("totals_known"),
        F.sum(F.when(F.col("low") == F.col("high"), F.col("low"))).alias("order_sum"),
    )
    frame = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in wanted])).alias("month"))
    joined = frame.join(lines, "month", "left").join(orders, "month", "left")  # at most two rows each
    clean = (F.coalesce("no_order", F.lit(0)) == 0) & (F.coalesce("broken", F.lit(0)) == 0)
    if mapping.amount_mode == "order_amount":
        amount = F.when(clean & F.col("totals_known"), F.col("order_sum"))
    else:
        known = F.lit(by_line) & (F.col("rows") > 0) & (F.col("amount_missing_rows") == 0)
        amount = F.when(known, F.col("line_sum"))
    return joined.select(
        "month",
        F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)).alias("quantity"),
        amount.cast("double").alias("amount"),
        F.coalesce("amount_missing_rows", F.lit(0)).alias("amount_missing_rows"),
        F.when(clean, F.col("orders")).alias("orders"),
        F.when(F.coalesce("refund_missing", F.lit(0)) == 0, F.col("refund").cast("double")).alias("refund_amount"),
    )


def summary(totals: DataFrame, report: Report, comparable: bool) -> DataFrame:
    """The month's figures next to the previous month's, with the average order (one row)."""
    now = F.col("month") == report.month
    pick = lambda c, when: F.max(F.when(when, F.col(c)))
    one = totals.agg(
        *[pick(c, now).alias(c) for c in ("quantity", "amount", "orders", "refund_amount")],
        *[pick(c, ~now & F.lit(comparable)).alias("previous_" + c) for c in ("quantity", "amount", "orders")],
    )
    return one.select(
        F.lit(report.month).alias("month"),
        "*",
        F.when(F.col("orders") > 0, F.col("amount") / F.col("orders")).alias("average_order"),
        F.lit(report.complete_month).alias("complete_month"),
    )


def store_chart(
    daily: DataFrame, report: Report, unknown: Sequence[date] = (), amount_known: bool = True, previous: bool = False
) -> DataFrame:
    """Store quantity and amount per day; an empty day is zero only in a confirmed complete month."""
    start, end = (report.previous_start, report.previous_end) if previous else (report.month_start, report.month_end)
    by_day = daily.filter(F.col("day").between(F.lit(start), F.lit(end))).groupBy("day").agg(
        F.sum("quantity").alias("q"), F.sum("amount").alias("a")
    )
    days = calendar_days(daily.sparkSession, start, end).join(by_day, "day", "left")
    gap = F.col("day").isin(*unknown) if unknown else F.lit(False)
    zero = F.when(F.lit(report.complete_month or previous) & ~gap, F.lit(0.0))
    value = lambda c: F.when(~gap, F.coalesce(F.col(c).cast("double"), zero))
    return days.select(
        "day", value("q").alias("quantity"), F.when(F.lit(amount_known), value("a")).alias("amount")
    )


def drill(audit: DataFrame, canonical: DataFrame, item_id: str, day: date, limit: int = 100) -> DataFrame:
    """The source rows behind one item and day with their reasons (at most ``limit``, by row id)."""
    wanted = audit.filter((F.col("item_id") == item_id) & (F.col("date") == F.lit(day)))
    rows = canonical.select("version_id", "source_row_id", "quantity", "line_amount", "unit_price", "event_time")
    chosen = wanted.select("version_id", "source_row_id", "reason").orderBy("version_id", "source_row_id").limit(limit)
    return rows.join(F.broadcast(chosen), ["version_id", "source_row_id"])
