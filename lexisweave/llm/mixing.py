"""Mixing sources to target weights: budgets down a weight tree, and seeded token prefixes of each leaf."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Most epochs of a leaf, rows (about) of a slice of a leaf's seeded order, and the seed.
MAX_EPOCHS, SLICE_ROWS, SEED = 4, 4096, "mix"
#: log2 of the parts into which the last slice of a leaf is cut.
PART_BITS = 6
#: A token, and a token with the white space before it.
TOKENS = r"[^\x09-\x0D\x20]+"
SPACED = r"[\x09-\x0D\x20]*[^\x09-\x0D\x20]+"


def word_count(text: Column) -> Column:
    """White-space separated words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("long")


def _fill(nodes: DataFrame, parent: Sequence[str], budget: Column) -> DataFrame:
    """Adds `budget` to nodes (weight, cap): what each gets of its parent's budget.

    Children share by weight; a child that can't take its share gets its cap, and the rest goes to its siblings by weight. In
    ascending order of cap / weight the children up to some point are full, and the first whose cap is at least
    weight times the level of what's left sets the level for itself and all after it.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("fill"), F.col("name"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    level = (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = nodes.withColumn("given", budget).withColumn("fill", F.col("cap") / F.col("weight")).withColumn("level", level)
    stop = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "name", "level"))).over(whole)
    found = found.withColumn("stop", stop)
    return found.withColumn("budget", F.when(F.col("stop").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.greatest(F.lit(0.0), F.col("stop.level")) * F.col("weight")))).drop("given", "fill", "level", "stop")


def leaf_budgets(leaves: DataFrame, path: Sequence[str], weights: Sequence[Mapping[str, float]], budget: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(path..., tokens, budget) of the leaves (path..., tokens): whole tokens that each leaf is to give.

    weights has, for each level of the path, a weight by name; names without one weigh 1, and every weight must be over 0. The
    budget goes down from the root. A leaf can give max_epochs times its tokens, an inner node the sum of its children. What a
    child can't take goes to its siblings by weight, so a shortage only leaves a subtree when all of it is full.
    A budget above what all leaves can give gives every leaf its most. Only rows of the tree are handled here.
    """
    budgets: DataFrame | None = None
    nodes = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    for depth in range(1, len(path) + 1):
        names, parent = list(path[:depth]), list(path[: depth - 1])
        level = nodes.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("name", F.col(names[-1]))
        table = weights[depth - 1]
        if any(w <= 0 for w in table.values()):
            raise ValueError("weights must be over 0")
        known = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))]), F.coalesce(names[-1], F.lit(""))) if table else F.lit(None)
        level = level.withColumn("weight", F.coalesce(known, F.lit(1.0)))
        if budgets is None:
            total = F.least(F.lit(float(budget)), F.sum("cap").over(Window.partitionBy()))
            budgets = _fill(level, [], total).select(*names, "budget")
        else:
            joined = level.join(budgets.withColumnRenamed("budget", "above"), parent)
            budgets = _fill(joined, parent, F.col("above")).select(*names, "budget")
    return leaves.select(*path, "tokens").join(budgets, list(path)).withColumn("budget", F.floor(F.round("budget", 3)).cast("long"))


def mix(docs: DataFrame, path: Mapping[str, Column], weights: Sequence[Mapping[str, float]], budget: float | None = None, budget_share: float | None = None, id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text",
        max_epochs: int = MAX_EPOCHS, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each use of a document: (id, path..., epoch from 0, n_tokens, take_tokens).

    path names the levels of the tree, root first, as expressions over docs; a null is a branch of its own (""). The budget is
    a number of tokens or a share of all tokens. Each leaf's budget is a whole number (see leaf_budgets; what is rounded off, less than a token a leaf, is given to
    nobody) and met exactly: whole epochs, then a prefix of
    one more epoch in an order seeded by seed, leaf epoch and id, whose last document gives only the first take_tokens of its tokens.
    The order is by MD5; ties (repeated ids) are put in order by n_tokens and share a place otherwise. Documents without tokens
    come with the epochs and prefixes like others and give 0. An empty table gives an empty result. Other columns are ignored.

    Scale: leaves are counted by an aggregate that is summed before its shuffle. The running sum of a prefix isn't taken over a
    leaf, which may hold a third of all rows: the order is cut into slices of about slice_rows rows by the leading digits of the
    hash, slices are summed, the one slice of each leaf in which its budget ends is cut again into 2^PART_BITS parts, and only the one part
    in which it ends is looked at row by row.
    """
    names = list(path)
    if clash := {id_col, "epoch", "n_tokens", "take_tokens"} & set(names) or {id_col} & {"epoch", "n_tokens", "take_tokens"}:
        raise ValueError(f"columns of the result have one name: {sorted(clash)}")
    count = tokens if tokens is not None else word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("__id"), *[F.coalesce(e.cast("string"), F.lit("")).alias(f"__p{i}") for i, e in enumerate(path.values())], count.cast("long").alias("__n"))
    keys = [f"__p{i}" for i in range(len(names))]
    rows = materialize(rows, "mix-rows")  # texts are read once
    leaves = materialize(rows.groupBy(*keys).agg(F.sum("__n").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    if budget is None:
        budget = budget_share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    budgets = leaf_budgets(leaves.select(*keys, "tokens"), keys, weights, budget, max_epochs)
    plan = leaves.join(budgets.drop("tokens"), keys).select(
        *keys, F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("rest"), F.ceil(F.col("rows") / slice_rows).cast("long").alias("slices"))
    plan = materialize(plan, "mix-plan")

    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    # the leading digits of the hash, as a fraction of all slices, name the slice of a row and its part of that slice
    at = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * F.col("slices")
    ordered = rows.join(plan, keys).withColumn("__h", place).withColumn("__s", F.shiftright(at, 32)).withColumn("__t", F.shiftright(at.bitwiseAND(F.lit((1 << 32) - 1)), 32 - PART_BITS))

    def end_of(sums: DataFrame, part: str, goal: str) -> DataFrame:
        """The part of each leaf in which goal is reached, and what is left of goal at its start. sums has few rows a leaf."""
        upto = F.sum("__sum").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return sums.withColumn("__upto", upto).where(f"__upto >= {goal} and __upto - __sum < {goal}").select(*keys, F.col(part).alias(f"{part}_end"), (F.col(goal) - F.col("__upto") + F.col("__sum")).alias(f"{part}_left"))

    slices = ordered.where("rest > 0").groupBy(*keys, "__s").agg(F.sum("__n").alias("__sum"), F.first("rest").alias("rest"))
    ends = materialize(end_of(slices, "__s", "rest"), "mix-ends")
    cut = ordered.join(ends, keys)
    parts = cut.where("__s = __s_end").groupBy(*keys, "__t").agg(F.sum("__n").alias("__sum"), F.first("__s_left").alias("__s_left"))
    cut = cut.join(materialize(end_of(parts, "__t", "__s_left"), "mix-part-ends"), keys)

    out = [F.col("__id").alias(id_col), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]]
    full = ordered.where("epochs > 0").select(*out, F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"), F.col("__n").alias("n_tokens"), F.col("__n").alias("take_tokens"))
    inside = cut.where("__s < __s_end or __s = __s_end and __t < __t_end").select(*out, F.col("epochs").alias("epoch"), F.col("__n").alias("n_tokens"), F.col("__n").alias("take_tokens"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__h", "__n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = cut.where("__s = __s_end and __t = __t_end").withColumn("__before", before).where("__before < __t_left").select(*out, F.col("epochs").alias("epoch"), F.col("__n").alias("n_tokens"), F.least(F.col("__n"), F.col("__t_left") - F.col("__before")).alias("take_tokens"))
    return full.unionByName(inside).unionByName(last)
