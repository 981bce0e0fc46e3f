"""Order-level resolution for the quality views.

One aggregation by order computes the flags over *all* rows and the sums over the selected rows: a
row's own reason does not depend on its order except for the order conflict, and a conflict excludes
every row of the order. The rows are joined back once, for the audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LINE_MODES, Mapping, Policy, Scope
from ..functions.money import PRODUCT, money, multiply
from ..functions.spread import any_of, attach, mark_repeats, repeated, row_text, sifted
from ..sources.stage import staged
from .normalize import primary_reason, tags

CONFLICT_FIELDS = ("customer_id", "event_time", "currency")
VIEWS = ("common", "rf", "rfm", "amount", "association")


def _differs(name: str) -> Column:
    return F.coalesce(F.min(name) != F.max(name), F.lit(False))


def raw_duplicates(raw: DataFrame, row_id: str = "source_row_id", order=("source_row_id",)) -> DataFrame:
    """Second and later copies of an identical raw row, whatever its id."""
    return mark_repeats(raw, [c for c in raw.columns if c != row_id], list(order), "duplicate_candidate")


def with_print(raw: DataFrame, row_id: str = "source_row_id") -> DataFrame:
    """Raw rows with a print of their content: copies have the same ``_print``, whatever their id."""
    return raw.withColumn("_print", F.unhex(F.md5(row_text([c for c in raw.columns if c != row_id]))))


def pair_printed(rows: DataFrame) -> DataFrame:
    """Rows that carry the print of their raw row (see with_print), with its duplicate mark; as if joined to the marks on the row id.

    Only rows that may share a print or an id are moved and stored; the others have no copy and are marked where they are read.
    """
    copies, same = (staged(repeated(rows, [c]), "sieve") for c in ("_print", "source_row_id"))
    parted = sifted(sifted(rows, copies, ["_print"], "_copied"), same, ["source_row_id"], "_again")
    odd = F.col("_copied") | F.col("_again")
    few = staged(parted.filter(odd).drop("_copied", "_again"), "odd-rows")
    marks = raw_duplicates(few.select("source_row_id", "_print")).select("source_row_id", "duplicate_candidate")
    alone = parted.filter(~odd & F.col("source_row_id").isNotNull()).drop("_copied", "_again")
    paired = staged(few.join(marks, "source_row_id"), "paired-rows")
    return paired.unionByName(alone.withColumn("duplicate_candidate", F.lit(False))).drop("_print")


def pair_raw(canonical: DataFrame, raw: DataFrame) -> DataFrame:
    """Canonical rows with their raw row's duplicate mark, one to one on the row id; a row that only one side has is an error."""
    marks = raw_duplicates(raw).select("source_row_id", "duplicate_candidate")
    both = canonical.withColumn("_canonical", F.lit(True)).join(marks, "source_row_id", "full")
    differ = F.raise_error(F.lit("raw and canonical rows differ")).cast("boolean")
    return both.withColumn("duplicate_candidate", F.when(F.col("_canonical"), F.coalesce("duplicate_candidate", differ)).otherwise(differ)).drop("_canonical")


def order_amounts(canonical: DataFrame, mode: str) -> DataFrame:
    """Amount candidate per order straight from canonical text, null when anything is in doubt."""
    rows = canonical.filter(F.coalesce("order_id", F.lit("")) != "")
    total = money(F.col("order_amount"))
    if mode == "quantity_unit_price":
        line = multiply(money(F.col("quantity")), money(F.col("unit_price")))
    else:
        line = money(F.col("line_amount")).cast(PRODUCT)
    rows = rows.withColumns({"_total": total, "_line": line})
    known = {c: F.nullif(F.col(c), F.lit("")) for c in CONFLICT_FIELDS}
    agg = rows.withColumns(known).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("source_rows"),
        *[_differs(c).alias(f"_mixed_{c}") for c in CONFLICT_FIELDS],
        F.min("currency").alias("_currency"),
        F.min("_total").alias("_low"),
        F.max("_total").alias("_high"),
        F.bool_or(F.col("order_amount").isNotNull() & F.col("_total").isNull()).alias("_bad_total"),
        F.bool_and(F.col("_line").isNotNull()).alias("_complete"),
        F.sum("_line").alias("_sum"),
    )
    checks = [
        (F.col("_mixed_currency"), "mixed_currency"),
        (F.col("_mixed_customer_id"), "conflicting_customer"),
        (F.col("_mixed_event_time"), "conflicting_time"),
    ]
    if mode == "order_amount":
        checks += [
            (F.col("_bad_total"), "invalid_order_amount"),
            (F.col("_low") != F.col("_high"), "conflicting_order_amount"),
            (F.col("_low").isNull(), "missing_order_amount"),
        ]
        amount = F.col("_low").cast(PRODUCT)
    elif mode in LINE_MODES:
        checks.append((~F.col("_complete"), "incomplete_line_amount"))
        amount = F.col("_sum").cast(PRODUCT)
    else:
        amount = F.lit(None).cast(PRODUCT)
    if mode != "none":
        checks.append((F.col("_currency").isNull(), "unknown_currency"))
    issues = tags(*checks)
    return agg.select(
        "order_id",
        "source_rows",
        F.when(F.size(issues) == 0, amount).alias("amount_candidate"),
        F.when(~F.col("_mixed_currency"), F.col("_currency")).alias("currency"),
        F.array_join(issues, ",").alias("issues"),
    )


def line_value(mode: str) -> tuple[Column, Column]:
    """Amount of a line and whether its declared and derived amounts disagree."""
    direct = F.col("line_amount").cast(PRODUCT)
    derived = multiply(F.col("quantity"), F.col("unit_price"))
    value = derived if mode == "quantity_unit_price" else direct
    if mode == "order_amount":
        value = F.coalesce(value, derived)
    return value, F.coalesce(direct != derived, F.lit(False))


def order_state(rows: DataFrame, mapping: Mapping, policy: Policy, scope: Scope = Scope()) -> DataFrame:
    """Flags over all rows of an order, sums over its effective and its selected rows."""
    value, conflict = line_value(mapping.amount_mode)
    removed = F.col("duplicate_candidate") & F.lit(policy.duplicates == "drop_exact")
    has = lambda tag: F.array_contains("issues", tag)
    prepared = rows.filter(F.col("order_id").isNotNull()).withColumns({
        "_value": value,
        "_kept": ~removed,
        "_differs": conflict | has("amount_source_conflict"),
        "_good": F.coalesce(value > 0, F.lit(False)),
        "_unscoped": primary_reason(policy, Scope(), F.lit(False)) == "included",
        "_selected": primary_reason(policy, scope, F.lit(False)) == "included",
        "_broken": any_of(has(t) for t in ("missing_item", "invalid_quantity", "unknown_status")),
        "_bad_total": has("invalid_order_amount"),
    })
    kept = lambda c: F.when(F.col("_kept"), c)
    chosen = lambda c: F.when(F.col("_selected"), c)
    agg = prepared.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if("_kept").alias("effective_source_rows"),
        *[F.min(c).alias(c) for c in CONFLICT_FIELDS],
        any_of(_differs(c) for c in CONFLICT_FIELDS).alias("conflict"),
        F.bool_or(F.col("customer_id").isNull()).alias("customer_missing"),
        F.bool_or(F.col("event_time").isNull()).alias("time_invalid"),
        F.bool_or(F.col("currency").isNull()).alias("currency_missing"),
        F.bool_or("_broken").alias("basket_incomplete"),
        F.min(kept(F.col("order_amount"))).alias("total"),
        F.coalesce(
            F.min(kept(F.col("order_amount"))) != F.max(kept(F.col("order_amount"))), F.lit(False)
        ).alias("total_conflict"),
        F.bool_or(F.col("_kept") & F.col("_bad_total")).alias("total_invalid"),
        F.bool_or(F.col("_kept") & F.col("_differs")).alias("lines_differ"),
        F.coalesce(F.bool_and(kept(F.col("_good"))), F.lit(True)).alias("lines_complete"),
        F.coalesce(F.sum(kept(F.when(F.col("_good"), F.col("_value")))), F.lit(0)).alias("line_sum"),
        F.count_if("_unscoped").alias("_before"),
        F.count_if("_selected").alias("_chosen"),
        F.coalesce(F.bool_and(chosen(F.col("_good"))), F.lit(True)).alias("_chosen_complete"),
        F.coalesce(F.sum(chosen(F.when(F.col("_good"), F.col("_value")))), F.lit(0)).alias("_chosen_sum"),
        F.coalesce(F.bool_or(F.col("_selected") & F.col("item_id").isNotNull()), F.lit(False)).alias("_items"),
    )
    clear = ~F.col("conflict")
    return agg.select(
        *[c for c in agg.columns if not c.startswith("_")],
        F.when(clear, F.col("_before")).otherwise(0).alias("before_scope"),
        F.when(clear, F.col("_chosen")).otherwise(0).alias("selected_rows"),
        F.when(clear, F.col("_chosen_sum")).otherwise(F.lit(0)).cast(PRODUCT).alias("selected_line_sum"),
        F.when(clear, F.col("_chosen_complete")).otherwise(F.lit(True)).alias("selected_lines_complete"),
        (clear & F.col("_items")).alias("has_items"),
    )


def finalize_orders(state: DataFrame, mapping: Mapping, policy: Policy) -> DataFrame:
    """Decide each order's amount, where it comes from and why it is missing.

    Orders without a selected row stay in the table (the audit needs their flags); see ``selected``.
    """
    mode = mapping.amount_mode
    total, partial = F.col("total"), F.col("selected_rows") < F.col("effective_source_rows")
    complete = F.col("selected_lines_complete")
    if mode == "none":
        reason = F.lit("amount_unavailable")
    else:
        reason = F.when(F.col("currency_missing"), "unknown_currency")
        if mode == "order_amount":
            unusable = total.isNull() | F.col("total_invalid") | F.coalesce(total <= 0, F.lit(False))
            reason = (
                reason.when(F.col("total_conflict"), "conflicting_order_amount")
                .when(unusable, "invalid_amount")
                .when(partial & ~complete, "partial_order_amount")
            )
        else:
            reason = reason.when(~complete, "invalid_amount")
        reason = reason.otherwise("included")
    if mode == "order_amount":
        source = F.when(partial, "selected_lines").otherwise("order_amount_once")
        amount = F.when(partial, F.col("selected_line_sum")).otherwise(total.cast(PRODUCT))
    else:
        source, amount = F.lit(mode), F.col("selected_line_sum")
    off = F.coalesce(F.col("lines_complete") & (F.col("line_sum") != total), F.lit(False))
    disputed = F.col("lines_differ") | F.col("total_conflict") | F.col("total_invalid") | off
    judged = state.withColumns({"_reason": reason, "_disputed": disputed})
    checked = F.col("_reason")
    if not policy.accept_selected_amount_source:
        checked = F.when((checked == "included") & F.col("_disputed"), "amount_source_conflict").otherwise(checked)
    rf = (
        F.when(F.col("customer_missing"), "missing_customer")
        .when(F.col("time_invalid"), "invalid_time")
        .otherwise("included")
    )
    resolved = judged.withColumns({
        "amount_source": F.when(F.col("_reason") == "included", source).otherwise("none"),
        "amount_reason": checked,
        "rf_reason": rf,
    })
    return resolved.withColumns({
        "amount": F.when(F.col("amount_reason") == "included", amount),
        "rfm_reason": F.when(F.col("rf_reason") != "included", F.col("rf_reason")).otherwise(F.col("amount_reason")),
        "partial_order": partial,
    }).drop("_reason", "_disputed")


def incomplete_customers(orders: DataFrame) -> DataFrame:
    """Customers with at least one order whose amount is not usable."""
    per = orders.filter("rf_reason = 'included' and selected_rows > 0").groupBy("customer_id").agg(
        F.bool_or(F.col("amount_reason") != "included").alias("bad")
    )
    return per.filter("bad").select("customer_id")


def complete_customers(orders: DataFrame) -> DataFrame:
    """Orders with the RFM reason corrected for customers whose amounts are incomplete."""
    bad = incomplete_customers(orders).withColumn("_incomplete", F.lit(True))
    joined = attach(orders, bad, ["customer_id"])
    hit = F.col("_incomplete") & (F.col("rf_reason") == "included") & (F.col("selected_rows") > 0)
    return joined.withColumn(
        "rfm_reason", F.when(hit, "incomplete_customer_amount").otherwise(F.col("rfm_reason"))
    ).drop("_incomplete")


def resolve_orders(rows: DataFrame, mapping: Mapping, policy: Policy, scope: Scope = Scope()) -> DataFrame:
    orders = staged(finalize_orders(order_state(rows, mapping, policy, scope), mapping, policy), "order-states")  # read twice
    return complete_customers(orders)


def selected(orders: DataFrame) -> DataFrame:
    """The orders that keep at least one row."""
    return orders.filter("selected_rows > 0")


def scoped_amount(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Full order total only if all its lines are kept, else the sum of kept lines if none is missing."""
    kept = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("kept"), F.bool_or(F.col("amount").isNull()).alias("gap"), F.sum("amount").alias("sum")
    )
    partial = F.when(~F.col("gap"), F.col("sum"))
    return orders.join(kept, "order_id", "left").select(
        "order_id", F.when(F.col("kept") == F.col("source_rows"), F.col("total")).otherwise(partial).alias("amount")
    )


def customer_metrics(orders: DataFrame) -> DataFrame:
    """Orders, last time and exact amount per customer."""
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.max("event_time").alias("last_time"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(PRODUCT).alias("amount"),
    )


def row_audit(rows: DataFrame, orders: DataFrame, policy: Policy, scope: Scope = Scope()) -> DataFrame:
    """Every source row with its reason in each of the five views."""
    facts = orders.select("order_id", "conflict", "basket_incomplete", "rf_reason", "rfm_reason", "amount_reason")
    joined = attach(rows, facts, ["order_id"])
    primary = primary_reason(policy, scope, F.col("conflict"))
    joined = joined.withColumn("primary_reason", primary)
    kept = F.col("primary_reason") == "included"
    view = lambda c: F.when(kept, c).otherwise(F.col("primary_reason"))
    basket = F.when(F.col("basket_incomplete"), "incomplete_basket").otherwise("included")
    issues = F.array_distinct(F.concat(
        "issues",
        tags((F.col("duplicate_candidate"), "duplicate_candidate"), (F.coalesce("conflict", F.lit(False)), "order_conflict")),
    ))
    return joined.select(
        "source_row_id",
        "order_id",
        "item_id",
        "primary_reason",
        view(F.col("rf_reason")).alias("rf_reason"),
        view(F.col("rfm_reason")).alias("rfm_reason"),
        view(F.col("amount_reason")).alias("amount_reason"),
        view(basket).alias("association_reason"),
        issues.alias("issues"),
    )


def reason_counts(audit: DataFrame) -> DataFrame:
    """Rows per view and reason; each view's counts sum to the number of source rows."""
    named = audit.select(F.col("primary_reason").alias("common"), *[
        F.col(f"{v}_reason").alias(v) for v in VIEWS[1:]
    ])
    return named.unpivot([], list(VIEWS), "view", "reason").groupBy("view", "reason").agg(F.count(F.lit(1)).alias("rows"))


def order_views(orders: DataFrame) -> dict[str, DataFrame]:
    """RF, RFM and amount views: one row per order with a usable reason."""
    columns = [
        "order_id", "customer_id", "event_time", "currency", "amount", "amount_source",
        "source_rows", "effective_source_rows", "selected_rows", "partial_order",
    ]
    return {
        f"{view}_orders": selected(orders).filter(F.col(f"{view}_reason") == "included").select(*columns)
        for view in ("rf", "rfm", "amount")
    }


def basket_items(rows: DataFrame, orders: DataFrame, policy: Policy, scope: Scope = Scope()) -> DataFrame:
    """Distinct items of every selected order whose basket is known to be complete."""
    chosen = rows.filter(
        (primary_reason(policy, scope, F.lit(False)) == "included") & F.col("item_id").isNotNull()
    ).select("order_id", "item_id").distinct()
    whole = selected(orders).filter(~F.col("basket_incomplete") & F.col("has_items")).select(
        "order_id", "customer_id", F.when(~F.col("time_invalid"), F.col("event_time")).alias("event_time")
    )
    joined = attach(chosen, whole.withColumn("_whole", F.lit(True)), ["order_id"])
    return joined.filter("_whole").select("order_id", "item_id", "event_time", "customer_id")


def capabilities(
    orders: DataFrame, baskets: DataFrame, mapping: Mapping, policy: Policy, caps: dict[str, int] | None = None
) -> DataFrame:
    """One row of summary figures and the RF, RFM and basket gates with their reason codes.

    ``caps`` (baskets, items, basket size) are optional: Spark spills instead of refusing.
    """
    rf = _customer_summary(orders, "rf")
    rfm = _customer_summary(orders, "rfm")
    money_known = F.col("amount").isNotNull()
    base = orders.agg(
        F.count(F.lit(1)).alias("selected_orders"),
        F.count_if(money_known).alias("amount_orders"),
        F.coalesce(F.min(F.when(money_known, F.col("currency"))) != F.max(F.when(money_known, F.col("currency"))), F.lit(False)).alias("mixed_currency"),
        F.count_if("basket_incomplete").alias("incomplete_baskets"),
        F.bool_or(F.col("amount_reason") == "amount_source_conflict").alias("disputed"),
        F.bool_or(F.col("rfm_reason") == "incomplete_customer_amount").alias("incomplete_customers"),
    )
    sizes = baskets.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    basket = sizes.agg(
        F.count(F.lit(1)).alias("complete_baskets"),
        F.count_if(F.col("n") == 1).alias("singleton_baskets"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_basket_size"),
    )
    items = baskets.select("item_id").distinct().agg(F.count(F.lit(1)).alias("unique_items"))
    one = base.withColumn("_k", F.lit(1))
    for part in (rf, rfm, basket, items):  # one-row summaries
        one = one.join(F.broadcast(part.withColumn("_k", F.lit(1))), "_k")
    boundary = F.lit(mapping.order_boundary == "unavailable" or not mapping.mapped("order_id"))
    common = [
        (boundary, "order_boundary"),
        (F.lit(not mapping.mapped("customer_id")), "customer_unmapped"),
        (F.lit(not mapping.mapped("event_time")), "time_unmapped"),
    ]
    gates = lambda view: [
        *common,
        (F.col(f"{view}_customers") < 50, "few_customers"),
        (F.col(f"{view}_span_days") < 7, "short_span"),
        (F.col(f"{view}_profiles") < 2, "no_variation"),
    ]
    rf_codes = tags(*gates("rf"))
    rfm_codes = tags(
        *gates("rfm"),
        (F.lit(mapping.amount_mode == "none"), "no_amount"),
        (F.col("mixed_currency"), "mixed_currency"),
        (F.col("incomplete_customers") & F.lit(policy.monetary_subset != "complete_customers"), "incomplete_customers"),
        (F.col("disputed"), "amount_source_conflict"),
    )
    limits = caps or {}
    over = any_of([
        F.col(column) > F.lit(limits[name])
        for name, column in (("baskets", "complete_baskets"), ("items", "unique_items"), ("basket_size", "max_basket_size"))
        if name in limits
    ])
    basket_codes = tags(
        (boundary, "order_boundary"),
        (F.lit(not mapping.mapped("item_id")), "item_unmapped"),
        (F.col("complete_baskets") < 200, "few_baskets"),
        (F.col("unique_items") < 2, "few_items"),
        (over, "resource_limited"),
    )
    result = one.withColumns({
        "rf_codes": F.array_join(rf_codes, ","),
        "rfm_codes": F.array_join(rfm_codes, ","),
        "association_codes": F.array_join(basket_codes, ","),
    })
    return result.drop("_k")


def _customer_summary(orders: DataFrame, view: str) -> DataFrame:
    """Orders, customers, distinct profiles and time span of one view (one row)."""
    chosen = orders.filter(F.col(f"{view}_reason") == "included")
    customers = customer_metrics(chosen)
    keys = ["orders", "last_time"] + (["amount"] if view == "rfm" else [])
    profiles = customers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = profiles.agg(
        F.coalesce(F.sum(F.col("n") * F.col("orders")), F.lit(0)).alias(f"{view}_orders"),
        F.coalesce(F.sum("n"), F.lit(0)).alias(f"{view}_customers"),
        F.count(F.lit(1)).alias(f"{view}_profiles"),
    ).withColumn("_k", F.lit(1))
    times = chosen.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    seconds = F.unix_timestamp("b") - F.unix_timestamp("a")
    span = times.select(
        F.round(F.coalesce(seconds / 86400, F.lit(0.0)), 3).alias(f"{view}_span_days"), F.lit(1).alias("_k")
    )
    return totals.join(F.broadcast(span), "_k").drop("_k")


def with_capability_states(summary: DataFrame, source_orders: DataFrame) -> DataFrame:
    """available / limited / unavailable / resource_limited per capability, given all source orders."""
    counted = source_orders.agg(F.count(F.lit(1)).alias("source_orders"), F.lit(1).alias("_k"))
    both = summary.withColumn("_k", F.lit(1)).join(F.broadcast(counted), "_k").drop("_k")

    def state(codes, included):
        return (
            F.when(F.col(codes).contains("resource_limited"), "resource_limited")
            .when(F.col(codes) != "", "unavailable")
            .when(F.col(included) < F.col("source_orders"), "limited")
            .otherwise("available")
        )

    return both.withColumns({
        "rf_state": state("rf_codes", "rf_orders"),
        "rfm_state": state("rfm_codes", "rfm_orders"),
        "association_state": state("association_codes", "complete_baskets"),
    })


# Reasons that keep a row out of the analyses that follow a sales report.
LEFT_OUT = ("outside_scope", "replaced_range", "duplicate_removed")


def admit(canonical: DataFrame, audit: DataFrame) -> DataFrame:
    """Rows a sales report admits to follow-up analyses; members of a conflicting order are unknown."""
    kept = audit.filter(~F.col("reason").isin(*LEFT_OUT)).select(
        "version_id", "source_row_id", (F.col("reason") == "order_conflict").alias("_conflict")
    )
    joined = canonical.join(kept, ["version_id", "source_row_id"])
    return joined.withColumn(
        "record_status", F.when(F.col("_conflict"), "unknown").otherwise(F.col("record_status"))
    ).drop("_conflict")


def admit_labelled(canonical: DataFrame, labelled: DataFrame) -> DataFrame:
    """As ``admit`` with the audit of ``labelled``, which are the canonical rows with their reason.

    Only rows that may share their id are moved and meet the audit; the others carry the reason of their id and stay where they are.
    """
    key, names = ["version_id", "source_row_id"], canonical.columns
    parted = sifted(labelled.select(*names, "reason"), staged(repeated(canonical, key), "sieve"), key, "_again")
    few = staged(parted.filter("_again").drop("_again"), "odd-rows")
    alone = parted.filter(~F.col("_again") & F.col("version_id").isNotNull() & F.col("source_row_id").isNotNull() & ~F.col("reason").isin(*LEFT_OUT))
    status = F.when(F.col("reason") == "order_conflict", "unknown").otherwise(F.col("record_status"))
    return admit(few.select(*names), few.select(*key, "reason")).select(*names).unionByName(alone.withColumn("record_status", status).select(*names))
