"""Quality views of one source, and the customer and basket analyses that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Analysis, Mapping, Policy, Scope
from ..operators import baskets, customers, normalize, orders
from ..sources.readers import canonicalize, counts_seen, with_counts
from ..sources.stage import staged


def quality_views(raw: DataFrame, mapping: Mapping, policy: Policy = Policy(), scope: Scope = Scope()) -> dict[str, DataFrame]:
    """Row audit, reason counts, order views, basket items and capability gates.

    ``source_counts`` (rows, given and misfitting times, raw duplicates) come from the pass that writes the normalised rows.
    """
    seen = Observation("source-counts")
    paired = with_counts(orders.pair_raw(canonicalize(raw, mapping), raw), mapping, seen)
    rows = staged(normalize.normalize(paired, mapping, policy), "normalised")
    resolved = staged(orders.resolve_orders(rows, mapping, policy, scope), "orders")
    audit = staged(orders.row_audit(rows, resolved, policy, scope), "audit")
    items = staged(orders.basket_items(rows, resolved, policy, scope), "baskets")
    summary = orders.capabilities(orders.selected(resolved), items, mapping, policy)
    return {
        "audit": audit,
        "source_counts": counts_seen(raw.sparkSession, seen),
        "reason_counts": orders.reason_counts(audit),
        "issue_counts": normalize.issue_counts(rows),
        "basket_items": items,
        "capabilities": orders.with_capability_states(summary, resolved),
        **orders.order_views(resolved),
    }


def association(items: DataFrame, params: Analysis = Analysis()) -> dict[str, DataFrame | list]:
    """Rules mined on the training split, qualified on validation, evaluated on both held-out parts."""
    labels = staged(baskets.split(items, params.random_state), "split")
    pairs = staged(baskets.baskets(items), "pairs")
    part = {
        name: staged(pairs.join(labels.filter(F.col("split") == name).select("order_id"), "order_id"), name) for name in ("train", "validation", "test")
    }
    train = part["train"]
    n = train.select("order_id").distinct().count()
    sets = staged(baskets.itemsets(train, n, params), "itemsets")
    mined = baskets.rules(sets, n, params.min_confidence)
    qualified = staged(baskets.qualify(mined, part["validation"]), "rules")
    popular = baskets.popularity(train)
    head = baskets.popular_head(popular)
    owners, block = bootstrap_block(items, labels)
    cards = baskets.cards(qualified)
    shown = raw_cards(cards, qualified)
    out = {"split": labels, "itemsets": sets, "rules": qualified, "cards": cards, "shown": shown}
    for name, seed in (("validation", 42), ("test", 43)):
        cases = staged(baskets.completion_cases(part[name], popular, qualified, popular, seed), f"cases-{name}")
        out[f"{name}_metrics"] = baskets.basket_metrics(cases)
        out[f"{name}_strata"] = baskets.strata_metrics(cases, head)
        out[f"{name}_interval"] = baskets.bootstrap(cases.join(owners, "order_id"), block, seed=seed + 1000)
    return out


def raw_cards(cards: list[dict], qualified: DataFrame) -> DataFrame:
    """The shown rules (at most as many as cards are shown) as rows of the qualified ones."""
    keys = qualified.sparkSession.createDataFrame([(c["antecedents"], c["consequents"]) for c in cards], "antecedents string, consequents string")
    return qualified.join(F.broadcast(keys), ["antecedents", "consequents"], "left_semi")


def bootstrap_block(items: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """What is resampled as one: the customer where every row names one, else the ISO week of a split by time, else the order."""
    per = items.groupBy("order_id").agg(F.min("customer_id").alias("customer_id"), F.date_trunc("week", F.min("event_time")).cast("string").alias("week"))
    named = items.agg(F.coalesce(F.bool_and(F.col("customer_id").isNotNull()), F.lit(False)).alias("n")).first().n
    by_time = not labels.filter("split_mode = 'chronological'").isEmpty()
    block = "customer_id" if named else "week" if by_time else "order_id"
    return per.select("order_id", *([block] if block != "order_id" else [])), block


def customer_groups(view: DataFrame, kind: str, reference, params: Analysis = Analysis(), date_end=None) -> dict[str, DataFrame]:
    """RF or RFM features, candidate groupings, profiles of the best one and the follow-up list."""
    features = staged(customers.rfm_features(view, kind, date_end), "features")
    columns = ["recency_days", "frequency"] + (["monetary"] if kind == "rfm" else [])
    candidates, labels = customers.choose_k(features, columns, params)
    candidates = staged(candidates, "candidates")
    best = customers.best_candidate(candidates)
    chosen = labels.join(F.broadcast(best.select("k")), "k").select("customer_id", "cluster")
    assigned = features.join(chosen, "customer_id")
    total = features.count()
    gate = best.first()
    publishable = bool(gate and gate["publishable"] and total >= 50)
    late = staged(customers.followups(view, reference, publishable), "followups")
    return {
        "features": features,
        "candidates": candidates,
        "assignments": assigned,
        "profile": customers.cluster_profile(assigned, columns),
        "followups": late,
        "followup_summary": customers.followup_summary(late, total),
    }
