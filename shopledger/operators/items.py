"""Item evidence of one month: dense daily values, comparisons, effects, bands and flags.

An item's month (at most 31 days) travels as an array on the item row, so comparisons and trend tests
are expressions on one row and need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..config import LINE_MODES, Mapping, Report
from ..functions.spread import attach, totals_above

MIN_CHANGE, MIN_UNITS = 0.25, 3


def known_start(report: Report, first_day: str = "first_day") -> Column:
    """First day on which an item's absence counts as zero."""
    if not report.item_start_dates:
        return F.col(first_day)
    pairs = [x for k, v in report.item_start_dates.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("item_id")), F.col(first_day))


def is_unknown(day: Column, unknown: Sequence[date]) -> Column:
    return day.isin(*unknown) if unknown else F.lit(False)


def item_day_grid(
    daily: DataFrame, names: DataFrame, report: Report, unknown: Sequence[date] = (), start=None, end=None
) -> DataFrame:
    """One row per item and calendar day; zero only after the item's start and on known days.

    Each item carries its sold days as a map (one entry per calendar day at most) and unfolds the
    calendar itself: no join of items with the calendar, and the result is already laid out by item.
    """
    first, last = report.calendar_range
    first, last = start or first, end or last
    inside = daily.filter(F.col("day").between(F.lit(first), F.lit(last)))
    sold = inside.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("day", F.col("quantity").cast("double")))).alias("_sold")
    )
    items = names.select("item_id", known_start(report).alias("_start"))
    days = F.sequence(F.lit(first), F.lit(last))
    grid = items.join(sold, "item_id", "left").select("item_id", "_start", "_sold", F.posexplode(days).alias("t", "day"))
    sold_now = F.when(F.col("_sold").isNotNull(), F.try_element_at("_sold", F.col("day")))
    known = (F.col("day") >= F.col("_start")) & ~is_unknown(F.col("day"), unknown)
    return grid.select(
        "item_id",
        "t",
        "day",
        F.when(known, F.coalesce(sold_now, F.lit(0.0))).alias("quantity"),
        sold_now.isNotNull().alias("recorded"),
    )


def month_series(daily: DataFrame, names: DataFrame, report: Report, unknown: Sequence[date] = ()) -> DataFrame:
    """Per item the month's days as an array of (date, quantity, recorded); unknown stays null."""
    first, last = report.month_start, report.month_end
    sold = daily.filter(F.col("day").between(F.lit(first), F.lit(last))).groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("day", F.col("quantity").cast("double")))).alias("_sold")
    )
    items = names.select("item_id", known_start(report).alias("_start")).join(sold, "item_id", "left")

    def entry(day):
        value = F.when(F.col("_sold").isNotNull(), F.try_element_at("_sold", day))
        gap = is_unknown(day, unknown)
        zero = F.when(F.lit(report.complete_month) & ~gap & (day >= F.col("_start")), F.lit(0.0))
        return F.struct(
            day.alias("date"),
            F.when(~gap, F.coalesce(value, zero)).alias("quantity"),
            value.isNotNull().alias("recorded"),
        )

    return items.select("item_id", F.transform(F.sequence(F.lit(first), F.lit(last)), entry).alias("daily"))


def item_month(daily: DataFrame, names: DataFrame, types: DataFrame, mapping: Mapping, report: Report, comparable: bool) -> DataFrame:
    """Items sold in the month, or in the month before when the two compare."""
    now = F.col("day").between(F.lit(report.month_start), F.lit(report.month_end))
    before = F.col("day").between(F.lit(report.previous_start), F.lit(report.previous_end))
    sums = daily.groupBy("item_id").agg(
        F.count_if(now).alias("_now"),
        F.count_if(before).alias("_before"),
        F.coalesce(F.sum(F.when(now, F.col("quantity"))), F.lit(0)).cast("double").alias("quantity"),
        F.coalesce(F.sum(F.when(now, F.col("amount"))), F.lit(0)).cast("double").alias("_amount"),
        F.coalesce(F.sum(F.when(now, F.col("amount_missing"))), F.lit(0)).alias("_missing"),
        F.max("day").alias("last_day"),
    )
    kept = (F.col("_now") > 0) | (F.lit(comparable) & (F.col("_before") > 0))
    amount = F.when(F.lit(mapping.amount_mode in LINE_MODES) & (F.col("_missing") == 0), F.col("_amount"))
    return (
        sums.filter(kept)
        .join(names, "item_id")
        .join(types, "item_id", "left")
        .select("item_id", "name", "category", "item_type", "type_source", "quantity", amount.alias("amount"), "first_day", "last_day")
    )


def composition(items: DataFrame) -> DataFrame:
    """Month amount by kind of item."""
    return items.groupBy("item_type").agg(F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"))


def half_even_cents(numerator: Column, denominator: Column) -> Column:
    """numerator/denominator in whole cents, ties to even, decided on the exact remainder."""
    size = F.abs(numerator) * 100
    whole = F.floor(size / denominator).cast(DecimalType(22, 0))
    twice = (size - whole * denominator) * 2
    up = (twice > denominator) | ((twice == denominator) & (whole % 2 == 1))
    return F.signum(numerator).cast("int") * (whole + F.when(up, 1).otherwise(0))


def price_volume(daily: DataFrame, report: Report) -> DataFrame:
    """Two months side by side per item, with the amount change split into quantity and price.

    Quantity effect is Δq·(p0+p1)/2 in half-even cents; the price effect takes the rounding residue. Sums of up to four
    decimals are split exactly; longer or larger ones, whose products no decimal type holds, in double precision.
    """
    now = F.col("day").between(F.lit(report.month_start), F.lit(report.month_end))
    old = F.col("day").between(F.lit(report.previous_start), F.lit(report.previous_end))
    two = daily.filter(now | old)
    both = two.groupBy("item_id").agg(
        F.count_if(now).alias("_now"),
        F.count_if(old).alias("_old"),
        *[F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).alias(f"_{c[0]}{i}") for i, w in ((0, old), (1, now)) for c in ("quantity", "amount")],
        (F.sum("amount_missing") == 0).alias("_ok"),
    )
    q0, q1, a0, a1 = (F.col(c) for c in ("_q0", "_q1", "_a0", "_a1"))
    split = F.col("_ok") & (q0 > 0) & (q1 > 0)
    e0, e1, b0, b1 = (c.try_cast(DecimalType(p, 4)) for c, p in ((q0, 14), (q1, 14), (a0, 20), (a1, 20)))
    fits = F.coalesce((e0 == q0) & (e1 == q1) & (b0 == a0) & (b1 == a1), F.lit(False))
    d0, d1, c0, c1 = (c.cast("double") for c in (q0, q1, a0, a1))
    exact = half_even_cents((e1 - e0) * (b0 * e1 + b1 * e0), 2 * e0 * e1).cast("double")
    quantity_cents = F.when(fits, exact).otherwise(F.bround((d1 - d0) * (c0 / d0 + c1 / d1) * 50, 0))
    total_cents = F.when(fits, half_even_cents(b1 - b0, F.lit(1).cast(DecimalType(1, 0))).cast("double")).otherwise(F.bround((c1 - c0) * 100, 0))
    ok = lambda c: F.when(F.col("_ok"), c.cast("double"))
    part = lambda c: F.when(split, c.cast("double"))
    return both.select(
        "item_id",
        F.when((F.col("_now") > 0) & (F.col("_old") > 0), "common")
        .when(F.col("_now") > 0, "only_current")
        .otherwise("only_previous")
        .alias("period"),
        q0.cast("double").alias("previous_quantity"),
        q1.cast("double").alias("current_quantity"),
        (q1 - q0).cast("double").alias("quantity_change"),
        ok(a0).alias("previous_amount"),
        ok(a1).alias("current_amount"),
        ok(a1 - a0).alias("amount_change"),
        (part(quantity_cents) / 100).alias("quantity_effect"),
        (part(total_cents - quantity_cents) / 100).alias("price_effect"),
        (part(a0) / q0.cast("double")).alias("previous_price"),
        (part(a1) / q1.cast("double")).alias("current_price"),
    )


def item_profile(grid: DataFrame, report: Report, unknown: Sequence[date] = ()) -> DataFrame:
    """Share of selling days and spread of full calendar weeks, over the item's known open days."""
    closed = F.col("day").isin(*report.closed_dates) if report.closed_dates else F.lit(False)
    valid = grid.filter(F.col("quantity").isNotNull() & ~closed)
    weeks = valid.groupBy("item_id", F.date_trunc("week", "day").alias("week")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("quantity").alias("q"), F.count_if(F.col("quantity") != 0).alias("selling")
    )
    full = F.when(F.col("days") == 7, F.col("q"))
    per = weeks.groupBy("item_id").agg(
        F.sum("days").alias("observed_days"),
        (F.sum("selling") / F.sum("days")).alias("nonzero_day_share"),
        F.count(full).alias("complete_weeks"),
        F.avg(full).alias("_mean"),
        F.stddev_pop(full).alias("_std"),
    )
    enough = (F.col("complete_weeks") >= 8) & (F.col("_mean") > 0)
    cv = F.when(enough, F.col("_std") / F.col("_mean"))
    band = F.when(cv <= 0.5, "steady").when(cv <= 1, "varying").when(cv > 1, "erratic")
    return per.select(
        "item_id",
        "observed_days",
        "nonzero_day_share",
        "complete_weeks",
        cv.alias("weekly_cv"),
        band.alias("weekly_band"),
        (F.col("nonzero_day_share") < 0.5).alias("intermittent"),
    )


def abc(items: DataFrame) -> DataFrame:
    """Contribution bands: equal amounts share a band, decided by what lies before the tie group."""
    exact = items.select("item_id", F.col("amount").cast(DecimalType(28, 6)).alias("_v"))
    ranks = totals_above(
        exact, "_v", {"_n": F.count(F.lit(1)), "_sum": F.sum("_v"), "_gap": F.count_if(F.col("_v").isNull())}
    )
    total = F.col("_sum_total")
    banded = ranks.filter((F.col("_gap_total") == 0) & (total > 0)).select(
        "_v",
        (F.col("_v").cast("double") / total.cast("double")).alias("amount_share"),
        (F.col("_n_before") + 1).alias("amount_rank"),
        ((F.col("_sum_before") + F.col("_sum")).cast("double") / total.cast("double")).alias("cumulative_share"),
        F.when(F.col("_n_total") < 5, None)
        .when(F.col("_sum_before") < total * F.lit("0.80").cast(DecimalType(3, 2)), "A")
        .when(F.col("_sum_before") < total * F.lit("0.95").cast(DecimalType(3, 2)), "B")
        .otherwise("C")
        .alias("contribution_band"),
    )
    return attach(exact, banded, ["_v"]).drop("_v")


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def week_change(series: DataFrame, report: Report) -> DataFrame:
    """Last seven days against the seven before; closed or unknown days block the comparison."""
    last = F.slice("daily", -7, 7)
    prior = F.slice("daily", -14, 7)
    window = F.slice("daily", -14, 14)
    quantity = lambda part: total_of(F.transform(part, lambda d: d["quantity"]))
    unknown = F.exists(window, lambda d: d["quantity"].isNull())
    end = report.month_end
    shut = any(end - timedelta(days=13) <= d <= end for d in report.closed_dates)
    now, before = quantity(last), quantity(prior)
    blocked = F.lit(not report.complete_month) | unknown
    status = (
        F.when(F.lit(shut), "closed").when(blocked, "missing_records").when(before > 0, "available").otherwise("no_baseline")
    )
    shown = F.lit(not shut) & ~blocked
    return series.select(
        "item_id",
        status.alias("status"),
        F.when(shown, now).alias("current_quantity"),
        F.when(shown, before).alias("previous_quantity"),
        F.when(~blocked & (before > 0), (now - before) / before).alias("early_change"),
        F.when(~blocked, F.abs(now - before)).alias("early_units"),
    )


def month_change(effects: DataFrame, report: Report, comparable: bool) -> DataFrame:
    """Monthly comparison for summaries without daily values."""
    prior = F.when(F.col("period") != "only_current", F.col("previous_quantity"))
    covered = report.complete and report.coverage_start <= report.previous_start and report.complete_month
    status = (
        F.when(F.lit(not covered or not comparable), "missing_records")
        .when(prior > 0, "available")
        .otherwise("no_baseline")
    )
    return effects.select("item_id", status.alias("status"), "current_quantity", prior.alias("previous_quantity"))


def flags(items: DataFrame, comparison: DataFrame, bands: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Growth, decline, anomaly and contribution flags of each item.

    The contribution flag belongs to items that had no movement or anomaly of their own *before*
    closures were masked, as the early figures of the weekly comparison tell.
    """
    found = anomalies.groupBy("item_id").agg(F.count(F.lit(1)).alias("anomaly_days"))
    joined = items.join(comparison, "item_id", "left").join(bands, "item_id", "left").join(found, "item_id", "left")
    now, before = F.col("current_quantity"), F.col("previous_quantity")
    change = F.when(F.col("status") == "available", (now - before) / before)
    moved = F.coalesce((F.abs(change) >= MIN_CHANGE) & (F.abs(now - before) >= MIN_UNITS), F.lit(False))
    has_early = "early_change" in comparison.columns
    early = (F.abs("early_change") >= MIN_CHANGE) & (F.col("early_units") >= MIN_UNITS) if has_early else moved
    quiet = ~F.coalesce(early, F.lit(False)) & F.col("anomaly_days").isNull()
    leading = (F.col("contribution_band") == "A") & (F.col("amount") > 0)
    found_flags = F.array_compact(F.array(
        F.when(quiet & leading, "contribution"),
        F.when(moved & (change > 0), "growth"),
        F.when(moved & (change < 0), "decline"),
        F.when(F.col("anomaly_days") > 0, "anomaly"),
    ))
    return joined.select(
        "item_id", "name", "quantity", "amount", "status", change.alias("change"),
        F.coalesce("anomaly_days", F.lit(0)).alias("anomaly_days"), "contribution_band", found_flags.alias("flags"),
    )


def attention(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.size("flags") > 0)


def by_impact(items: DataFrame, effects: DataFrame, flagged: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Sort key of the item list: amount moved, else size times change, else anomaly worth, else size."""
    worth = anomalies.groupBy("item_id").agg(F.sum(F.abs(F.col("actual") - F.col("reference"))).alias("_off"))
    joined = (
        items.select("item_id", "quantity", "amount")
        .join(effects.select("item_id", "amount_change"), "item_id", "left")
        .join(flagged.select("item_id", "change"), "item_id", "left")
        .join(worth, "item_id", "left")
    )
    size = F.when(F.coalesce("amount", F.lit(0.0)) != 0, F.col("amount")).otherwise(F.col("quantity"))
    moved = F.abs(F.coalesce("amount_change", F.lit(0.0)))
    value = F.when(moved != 0, moved).otherwise(size * F.least(F.abs(F.coalesce("change", F.lit(0.0))), F.lit(2.0)))
    price = F.when(F.col("amount").isNotNull() & (F.col("quantity") != 0), F.col("amount") / F.col("quantity")).otherwise(1.0)
    value = F.when(F.col("_off").isNotNull(), F.greatest(value, F.col("_off") * price)).otherwise(value)
    return joined.select("item_id", F.when(value != 0, value).otherwise(size).alias("impact")).orderBy(
        F.col("impact").desc(), "item_id"
    )


def find_items(flagged: DataFrame, flag=None, category=None, text=None, attention_only=False, sort="quantity") -> DataFrame:
    """Filter and sort the item table; unknown numbers sort as -1."""
    found = flagged
    if attention_only:
        found = found.filter(F.size("flags") > 0)
    if flag:
        found = found.filter(F.array_contains("flags", flag))
    if category:
        found = found.filter(F.col("category") == category)
    if text:
        found = found.filter(F.lower(F.concat_ws(" ", "name", "item_id")).contains(text.lower()))
    return found.orderBy(F.coalesce(F.col(sort), F.lit(-1.0)).desc(), "item_id")


def top_k(df: DataFrame, score: str, k: int, key: str = "item_id") -> DataFrame:
    return df.orderBy(F.col(score).desc(), key).limit(k)


def top_recent(daily: DataFrame, end: date, days: int, k: int) -> DataFrame:
    """The k items that sold most in the last days before ``end`` (inclusive)."""
    recent = daily.filter(F.col("day").between(F.lit(end - timedelta(days=days - 1)), F.lit(end)))
    sums = recent.groupBy("item_id").agg(F.sum("quantity").cast("double").alias("recent_quantity"))
    return top_k(sums, "recent_quantity", k)


def overview(flagged: DataFrame, effects: DataFrame, highlights: DataFrame, drivers: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projected views: highlighted items, compact list, largest amount drivers."""
    marked = flagged.join(F.broadcast(highlights.select("item_id")), "item_id", "left_semi")
    compact = flagged.select("item_id", "name", "quantity", "amount", "change", "flags")
    largest = effects.filter(F.col("amount_change").isNotNull()).orderBy(F.abs("amount_change").desc(), "item_id")
    return marked, compact, largest.limit(drivers)
