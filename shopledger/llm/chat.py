r"""Chat formatting of reply trees.

Messages (conv_id, node, parent, role, text, score) form trees. Iterative self-joins find every root-to-leaf path: a round joins
the pointers to ancestors with themselves, which doubles their reach, and only messages that have an ancestor so far up go on; then
the leaves' paths take in their ancestors by the same pointers, each once. A path of d messages takes about log2(d) rounds and d rows. The branches of a conversation are ranked by the sum of their scores (ties to the smaller leaf) and each chosen path
becomes one conversation:

    <|im_start|>role\ntext<|im_end|>\n ...

Control strings inside texts are escaped: every ``<``, backslashes, ``|`` gets one backslash more, so a text never holds ``<|`` and
unescaping takes one away. In roles ``%``, ``<`` and line feeds are percent-coded. The loss mask is a list of spans (start, length in code
points of the formatted text), one for each assistant text.

A message whose parent is null or absent is a root. Messages on a cycle have no root and take part in no path; null text or
role: empty; null score: 0; null conv_id: one conversation of its own. Equal (conv_id, node) keys are an error of the caller; ``chain`` makes
unique ones from turns, repeated turns following each other by role and text. Only the named columns are read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spread import attach
from .common import ranked, written

#: Fixed values of the template.
OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
KEY = ["_null", "_conv"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_escaped(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def chain(turns: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each row answers the one before."""
    plain = turns.select("conv_id", F.col("conv_id").isNull().alias("_null"), F.coalesce("conv_id", F.lit(0)).alias("_conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = ranked(plain, KEY, ["turn", "role", "text"], "chat-turns")
    score = F.when(F.col("role") == TRAINED, F.length("text")).otherwise(F.lit(0)).cast("double")
    return rows.select("conv_id", F.col("_rank").alias("node"), F.when(F.col("_rank") > 1, F.col("_rank") - 1).alias("parent"), "role", "text", score.alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """_null, _conv, leaf, node, dist: every message of every root-to-leaf path, with its distance from the leaf."""
    m = written(keyed(messages).select(*KEY, "node", "parent"), "chat-messages")
    sizes = m.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_size"))
    # a parent that is absent ends the path like a null one
    known = m.select(*KEY, F.col("node").alias("parent"))
    first = attach(m.filter("parent is not null").join(known, [*KEY, "parent"], "left_semi"), sizes, KEY)
    jumps, looped = [written(first.select(*KEY, "node", F.col("parent").alias("up"), "_size"), "chat-jumps")], []
    while not jumps[-1].isEmpty():
        reach = 2 ** len(jumps)
        above = jumps[-1].select(*KEY, F.col("node").alias("up"), F.col("up").alias("_up"))
        met = written(jumps[-1].join(above, [*KEY, "up"]).select(*KEY, "node", F.col("_up").alias("up"), "_size"), "chat-jumps")
        # no path is as long as its conversation: whoever has an ancestor that far up stands below a cycle
        looped.append(met.filter(F.col("_size") <= reach).select(*KEY, "node"))
        jumps.append(met.filter(F.col("_size") > reach))
    inner = m.filter("parent is not null").select(*KEY, F.col("parent").alias("node"))
    leaves = m.select(*KEY, "node").join(inner, [*KEY, "node"], "left_anti")
    for l in looped:
        leaves = leaves.join(l, [*KEY, "node"], "left_anti")
    steps = written(leaves.select(*KEY, F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), "chat-steps")
    for k, j in enumerate(jumps[:-1]):
        further = steps.join(j, [*KEY, "node"]).select(*KEY, "leaf", F.col("up").alias("node"), (F.col("dist") + 2**k).alias("dist"))
        steps = written(steps.union(further), "chat-steps")
    return steps


def keyed(messages: DataFrame) -> DataFrame:
    conv = F.col("conv_id").isNull().alias("_null"), F.coalesce("conv_id", F.lit(0)).alias("_conv")
    return messages.select(*conv, "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))


def branches(messages: DataFrame, best: int | None = None, steps: DataFrame | None = None) -> DataFrame:
    """_null, _conv, leaf, score, branch (rank from 1) of each conversation's ``best`` paths, or of all."""
    steps = paths(messages) if steps is None else steps
    scored = steps.join(keyed(messages).select(*KEY, "node", "score"), [*KEY, "node"]).groupBy(*KEY, "leaf").agg(F.sum("score").alias("score"))
    out = ranked(scored.withColumn("_worse", -F.col("score")), KEY, ["_worse", "leaf"], "chat-branches").withColumnRenamed("_rank", "branch").drop("_worse", "_n")
    return out if best is None else out.filter(F.col("branch") <= best)


def formatted(messages: DataFrame, best: int | None = None) -> DataFrame:
    """conv_id, leaf, branch, formatted, loss array<struct<start,n>>: one row per chosen path."""
    steps = paths(messages)
    chosen = steps.join(branches(messages, best, steps).select(*KEY, "leaf", "branch"), [*KEY, "leaf"]).select(*KEY, "leaf", "branch", (-F.col("dist")).alias("_at"), "node")
    rows = chosen.join(keyed(messages).select(*KEY, "node", "role", "text"), [*KEY, "node"])
    head = F.concat(F.lit(OPEN), role_escaped(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = rows.withColumn("_head", head).withColumn("_body", body).withColumn("_piece", F.concat("_head", "_body", F.lit(CLOSE + "\n")))
    before = Window.partitionBy(*KEY, "leaf").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.length("_piece").cast("long")).over(before), F.lit(0)) + F.length("_head"))
    span = F.when(F.col("role") == TRAINED, F.struct(F.col("_start").alias("start"), F.length("_body").alias("n")))
    whole = rows.groupBy(*KEY, "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"), F.sort_array(F.collect_list(span)).alias("loss"))
    conv = F.when(~F.col("_null"), F.col("_conv")).alias("conv_id")
    return whole.select(conv, "leaf", "branch", F.array_join(F.col("_pieces._piece"), "").alias("formatted"), "loss")


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``turns`` (array of role, text) and ``loss_text``, both read back from ``formatted`` and ``loss``."""
    parts = F.expr(f"filter(split(formatted, '\\\\Q{OPEN}\\\\E'), (x, i) -> i > 0)")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring_index(part.substr(F.length(role) + 2, F.length(part)), CLOSE, 1)
        return F.struct(role_unescaped(role).alias("role"), unescaped(text).alias("text"))

    texts = F.transform("loss", lambda s: unescaped(F.col("formatted").substr((s["start"] + 1).cast("int"), s["n"])))
    return rows.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(texts, ""))


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns of formatted conversations."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    p = parsed(rows)
    return p.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
