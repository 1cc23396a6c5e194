"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' tokens in a tree (domain, language, source). A token budget flows down from the root by the
weights of the children. A child that has fewer tokens than its share (counting up to `max_epochs` passes over them)
takes what it has, and the rest is dealt to its siblings by their weights; only what all of them together can't take
goes up, to the siblings of the parent. With capacities summed bottom-up this is one water-filling for each node, done
as a window over its children sorted by how soon they are full.

A leaf takes whole epochs and then the token-prefix of one more: documents in the order of a seeded hash, different in
each epoch, until the budget is met (the last one may pass it). The prefix is found by sums over hash ranges, so that no
leaf is sorted as a whole, however hot it is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacework.llm.common import SPACE, materialize, packed, text_or_empty

#: Hash ranges of a leaf; the order key has 60 bits.
RANGES = 4096
_ORDER_BITS = 60
#: Leaves whose plan is broadcast, some 20 MB at most; a larger plan meets the rows in a join that is salted by SALTS.
MOST_BROADCAST, SALTS = 100_000, 64


@dataclass(frozen=True)
class Mixture:
    """levels: the columns of the tree from the top; `weights` by the path of values from the top, 1 where none is
    given (null values are written as ""). budget_share: of all tokens, used where budget_tokens is None."""

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    budget_tokens: int | None = None
    budget_share: float = 0.5
    max_epochs: int = 4
    seed: int = 11


def token_count(text_col: str = "text") -> Column:
    """Words, as the measure of length."""
    return F.regexp_count(text_or_empty(text_col), F.lit(f"[^{SPACE}]+")).cast("long")


def order_key(seed: int, epoch: Column, id_col: str) -> Column:
    """60 bits of a hash that SQL engines share; null ids count as an empty string."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _weight(mixture: Mixture, path: list[str]) -> Column:
    known = {k: float(w) for k, w in mixture.weights.items() if len(k) == len(path)}
    if not known:
        return F.lit(1.0)
    pairs = [F.lit(x) for k, w in known.items() for x in ("\x1f".join(k), w)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\x1f", *path)), F.lit(1.0))


def leaf_budgets(leaves: DataFrame, budget: float, mixture: Mixture) -> DataFrame:
    """leaves: (mx_l0, mx_l1, ..., tokens); adds mx_budget (double, tokens)."""
    depth = sum(c.startswith("mx_l") for c in leaves.columns)
    path = [f"mx_l{k}" for k in range(depth)]
    parent = None
    for k in range(1, depth + 1):
        level, above = path[:k], path[: k - 1]
        rows = leaves.groupBy(*level).agg((F.sum("tokens") * mixture.max_epochs).cast("double").alias("cap")).withColumn("w", _weight(mixture, level))
        rows = rows.withColumn("given", F.lit(float(budget))) if parent is None else rows.join(parent.withColumnRenamed("mx_budget", "given"), above)
        # Children in the order in which they fill up; one without weight takes nothing.
        rows = rows.withColumn("fill", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
        order = Window.partitionBy(*above).orderBy("fill", *level) if above else Window.partitionBy(F.lit(0)).orderBy("fill", *level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        # The first child, in that order, that isn't full when all before it are sets the level for itself and the rest.
        rows = rows.withColumn("share", F.when(F.col("w") > 0, left / weight))
        full = F.max(F.when(F.col("share") * F.col("w") < F.col("cap"), F.col("share"))).over(Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0)))
        rows = rows.withColumn("level", full)
        parent = rows.select(*level, F.when(F.col("w") <= 0, 0.0).when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("mx_budget"))
    return leaves.join(parent, path)


def _planned(rows: DataFrame, plan: DataFrame, path: list[str], leaves: int) -> DataFrame:
    """rows (with mx_id) with the plan of their leaf. A leaf may have a third of all rows, so its rows don't meet in one task."""
    if leaves <= MOST_BROADCAST:
        return rows.join(F.broadcast(plan), path)
    salted = plan.withColumn("mx_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("mx_salt", F.pmod(F.xxhash64("mx_id"), F.lit(SALTS)).cast("int")).join(salted, [*path, "mx_salt"]).drop("mx_salt")


def mix(df: DataFrame, mixture: Mixture = Mixture(), levels: tuple[str | Column, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of df that are selected, all columns, with mx_epochs (long): how many epochs have the row.

    A null level is a value of its own (""). A null text counts as empty: no tokens, so it is in every whole epoch, and
    in the last one if its place comes before the budget is met. Rows that repeat an id share their place in the order;
    among them those with fewer tokens come first. An empty table gives no rows. Columns of df may have any names but
    mx_epochs.
    """
    path = [f"mx_l{k}" for k in range(len(levels))]
    named = [F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("")).alias(p) for p, x in zip(path, levels, strict=True)]
    placed = packed(df, F.col(id_col).alias("mx_id"), F.col(text_col).alias("mx_text"), *named)
    counts = materialize(placed.select("mx_id", *path, token_count("mx_text").alias("mx_tokens")), "token-counts")
    leaves = counts.groupBy(*path).agg(F.sum("mx_tokens").alias("tokens"))
    leaves = materialize(leaves, "leaves")
    n_leaves = leaves.count()
    budget = mixture.budget_tokens if mixture.budget_tokens is not None else (leaves.agg(F.sum("tokens")).first()[0] or 0) * mixture.budget_share
    plan = leaf_budgets(leaves, budget, mixture)
    plan = plan.withColumn("mx_full", F.when(F.col("tokens") > 0, F.least(F.floor(F.col("mx_budget") / F.col("tokens")), F.lit(mixture.max_epochs))).otherwise(0).cast("long"))
    plan = materialize(plan.select(*path, "mx_full", F.round(F.col("mx_budget") - F.col("mx_full") * F.col("tokens"), 6).alias("mx_rest")), "leaf-plan")

    key = order_key(mixture.seed, F.col("mx_full"), "mx_id")
    ranged = _planned(counts, plan, path, n_leaves).withColumn("mx_range", F.shiftright(key, _ORDER_BITS - RANGES.bit_length() + 1))
    sums = ranged.groupBy(*path, "mx_rest", "mx_range").agg(F.sum("mx_tokens").alias("t"))
    base = F.coalesce(F.sum("t").over(Window.partitionBy(*path).orderBy("mx_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The range in which the budget is met: the last one that starts before it.
    cut = sums.withColumn("mx_base", base).where(F.col("mx_base") < F.col("mx_rest")).groupBy(*path).agg(F.max(F.struct("mx_range", "mx_base")).alias("c"))
    plan = materialize(plan.join(cut, path, "left").select(*path, "mx_full", "mx_rest", F.coalesce("c.mx_range", F.lit(-1)).alias("mx_cut"), F.col("c.mx_base").alias("mx_base")), "leaf-cuts")

    rows = _planned(placed, plan, path, n_leaves).withColumn("mx_key", order_key(mixture.seed, F.col("mx_full"), "mx_id"))
    rows = rows.withColumn("mx_range", F.shiftright(F.col("mx_key"), _ORDER_BITS - RANGES.bit_length() + 1))
    clear = rows.where("mx_range <> mx_cut").withColumn("mx_epochs", F.col("mx_full") + (F.col("mx_range") < F.col("mx_cut")).cast("long"))
    inside = Window.partitionBy(*path).orderBy("mx_key", "mx_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("mx_base") + F.coalesce(F.sum("mx_tokens").over(inside), F.lit(0))
    met = rows.where("mx_range = mx_cut").withColumn("mx_tokens", token_count("mx_text")).withColumn("mx_epochs", F.col("mx_full") + (start < F.col("mx_rest")).cast("long"))
    return clear.select("row.*", "mx_epochs").union(met.select("row.*", "mx_epochs")).where("mx_epochs > 0")
