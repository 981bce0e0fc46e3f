"""One month's sales report from merged sources, as a set of lazily built tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LINE_MODES, Mapping, Report
from ..operators import anomaly, customers, evidence, forecast, items, normalize, sales
from ..sources.stage import staged


def monthly_report(sources: Sequence[tuple[DataFrame, Mapping]], report: Report, trees: int = 80, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Totals, charts, item evidence, focus, actions, groups of items, forecast and row audit of ``report.month``.

    Summaries have no days: they compare whole months. A month that is not complete is counted and ranked only.

    ``sources`` are normalised rows with version_id and source_no. Labelled rows and the dense grid are
    written once, as several later tables read them. So are the rows, which the labels read several times, unless ``stored`` is a stored table of them all.
    ``trees`` is the size of each boosted model (one per origin of the check and one for publication); 0 leaves that method out.
    """
    appended = sales.append(sources)
    rows = staged(appended, "source-rows") if stored is None else stored.select(*appended.columns)
    mapping = sources[-1][1]
    if report.merge_mode == "append":
        sales.check_append(sales.source_ranges(rows))
    labelled = staged(sales.label(rows, mapping, report), "labelled")
    sales.check_currency(labelled, mapping)
    daily = staged(sales.daily_fact(labelled, mapping), "daily")
    monthly = mapping.record_kind == "monthly_summary"
    if not sales.calendar_conflicts(daily, report).isEmpty():
        raise ValueError("closed_date_conflict")
    gaps = [] if monthly or not report.complete else [r.day for r in sales.gap_days(daily, report).collect()]
    unknown = sorted({*report.missing_dates, *gaps})
    comparable = report.comparative(gaps)
    by_line = mapping.amount_mode in LINE_MODES
    names = staged(sales.item_names(labelled), "names")
    types = normalize.item_types(labelled.filter("reason = 'included'"), report, all(m.status_rule == "uci_cancel_prefix" for _, m in sources))
    month_items = staged(items.item_month(daily, names, types, mapping, report, comparable), "items")
    effects = staged(items.price_volume(daily, report), "effects")
    totals = sales.month_totals(labelled, mapping, report)
    out = {
        # a table of all sources without their labels, unless these replaced a column of theirs
        "rows": labelled.select(*rows.columns) if {"duplicate_candidate", "reason"}.isdisjoint(rows.columns) else rows,
        "labelled": labelled,
        "audit": sales.sales_audit(labelled),
        "quality": sales.quality_block(labelled),
        "reasons": sales.reason_histogram(labelled),
        "totals": totals,
        "summary": sales.summary(totals, report, comparable),
        "items": month_items,
        "composition": items.composition(month_items),
        "bands": items.abc(month_items),
        "effects": effects.filter("false") if not (comparable and by_line) else effects,
    }
    shown = out["effects"]
    none = evidence_schema(labelled)
    if monthly:
        change = items.month_change(effects, report, comparable)
        ranked = evidence.leaders(month_items, None, mapping.quantity_unit)
        moved = evidence.month_signals(change)
        return out | {
            "flags": items.flags(month_items, change, out["bands"], none),
            "focus": evidence.focus(evidence.focus_candidates(ranked, shown, None, moved, none)),
            "actions": evidence.actions(month_items, shown, None, report),
        }
    out["chart"] = sales.store_chart(daily, report, unknown)
    series = staged(items.month_series(daily, names, report, unknown), "month-series")
    ranked = evidence.leaders(month_items, series, mapping.quantity_unit)
    if not report.complete_month:
        # no day without a record is known to be empty, so nothing is compared, judged or forecast; what was sold still ranks
        arrays = month_items.select("item_id")
        return out | {
            "flags": items.flags(month_items, items.week_change(series, report), out["bands"], none),
            "anomaly_status": anomaly.anomaly_status(month_items, none.select("item_id"), none),
            "focus": evidence.focus(evidence.focus_candidates(ranked, shown, None, None, none)),
            "actions": evidence.actions(month_items, shown, evidence.daily_signals(evidence.no_signals(arrays), evidence.no_signals(arrays)), report),
            "eligibility": forecast.eligibility(arrays, 0, forecast.report_blocker(report, mapping.record_kind)),
        }
    grid = staged(items.item_day_grid(daily, names, report, unknown), "grid")
    measured = anomaly.measured_days(grid, report)
    found = staged(anomaly.anomalies(measured, report) if not report.check_only else none, "anomalies")
    with_days = evidence.with_anomalies(series, found)
    trends, spikes = evidence.trend4(with_days, report), evidence.spike(with_days, month_items, report)
    weekly = items.week_change(series, report)
    flagged = items.flags(month_items, weekly, out["bands"], found)
    profile = staged(items.item_profile(grid, report, unknown), "profile")
    focus = evidence.focus(evidence.focus_candidates(ranked, shown, trends, None, found))
    arrays, n = forecast.arrays_of(grid), forecast.calendar_length(report)
    eligible = forecast.eligibility(arrays, n, forecast.report_blocker(report, mapping.record_kind))
    out |= {
        "profile": profile,
        "anomalies": found,
        "anomaly_status": anomaly.anomaly_status(month_items, anomaly.probe_days(measured, report), found),
        "events": evidence.event_value(evidence.events_of(found), daily),
        "flags": flagged,
        "focus": focus,
        "concentration": evidence.order_concentration(labelled, found, mapping),
        "actions": evidence.actions(month_items, shown, evidence.daily_signals(trends, spikes), report),
        "eligibility": eligible,
    }
    out |= dict(zip(("highlights", "overview", "drivers"), items.overview(flagged, shown, focus), strict=True))
    if not report.check_only:
        measures = month_items.select("item_id", "amount").join(profile, "item_id").join(weekly.select("item_id", F.col("early_change").alias("change")), "item_id")
        clusters = customers.item_clusters(measures)
        if clusters is not None:
            out |= {"clusters": clusters[0], "cluster_items": clusters[1]}
    if n >= 90 and not report.check_only:
        plan = forecast.Plan.for_days(n)
        tested, boosted, latest = eligible.filter("tested"), None, None
        if trees:
            features = staged(forecast.trailing_features(forecast.with_next_day(grid, n)), "features")
            boosted = forecast.boosted_forecasts(features, tested, plan.origins, trees)
            latest = forecast.gbt_forecast(features, tested, n, trees) if boosted is not None else None
        rows_checked = staged(forecast.backtest(arrays, tested, plan, boosted), "backtest")
        splits = {r["split"] for r in rows_checked.select("split").distinct().collect()}  # at most three
        if {"validation", "test"} <= splits:
            policy = forecast.select_policy(rows_checked, plan.validation)
            out |= {
                "backtest": rows_checked,
                "errors": forecast.errors(rows_checked),
                "policy": policy,
                "forecast": forecast.publish(rows_checked, policy, arrays, eligible, report, latest),
            }
    return out


def evidence_schema(df: DataFrame) -> DataFrame:
    """An empty anomaly table."""
    columns = "item_id string, date date, actual double, reference double, difference double, strength double"
    return df.sparkSession.createDataFrame([], columns)
