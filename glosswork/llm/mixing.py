"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree (by default domain - language - source). At each node it is split
among the children by weight; a child that can't use its part (its tokens times the epochs allowed
are fewer) leaves the shortage to its siblings, and only what all siblings together can't use goes
back to the ancestors. Each level is one closed-form water-filling over a window of siblings: order
the children by capacity / weight, and the first child whose ratio exceeds the common level ends
the saturated ones. Only one row for each node takes part.

Each leaf then fills its allocation from seeded epochs: an epoch is the leaf's documents in an
order drawn from (seed, epoch, document), and the leaf takes the longest run of whole documents
from the start of the sequence of epochs that fits its allocation. Whole epochs are counted; only the
last one needs an order. It is found without sorting the leaf: tokens are summed over equal slices
of the order's key, the slice in which the allocation ends is found, and only that slice is ordered; while it
has more than ORDERED rows in some leaf it is sliced again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.shared import forget, small, written

LEVELS = ("domain", "lang", "source")
SEED = 17
EPOCHS = 3
SLICE_BITS = 12
KEY_BITS = 60
ORDERED = 100_000
WORD = r"[^\x20\x09-\x0D]+"
NO = "\x00none"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_slice(seed: int, epoch: Column, key: Column) -> Column:
    """A 60-bit number of a document's place in an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key)), 1, 15), 16, 10).cast("long")


def weight_of(level: str, weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(1.0))


def budgets(leaves: DataFrame, budget: int, levels=LEVELS, weights: Mapping[str, Mapping[str, float]] | None = None, epochs: int = EPOCHS) -> DataFrame:
    """Allocations of the leaves: the levels, tokens, capacity, allocation (long).

    leaves: one row for each leaf, with the levels (no nulls) and `tokens`. weights: for each level
    a map from value to weight (1 where it has none; 0 takes nothing unless all siblings have 0).
    """
    weights = weights or {}
    cap = leaves.withColumn("capacity", F.col("tokens") * epochs)
    nodes = cap.select(*levels, "tokens", "capacity")
    granted = None
    for depth in range(1, len(levels) + 1):
        upper, own = list(levels[: depth - 1]), levels[depth - 1]
        here = nodes.groupBy(*levels[:depth]).agg(F.sum("capacity").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", weight_of(own, weights.get(own)))
        if granted is None:
            here = here.withColumn("given", F.lit(int(budget)).cast("long"))
        else:
            here = here.join(granted.withColumnRenamed("got", "given"), upper)
        here = here.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))
        by = Window.partitionBy(*upper) if upper else Window.partitionBy(F.lit(1))
        before = by.orderBy(F.col("ratio").asc_nulls_last(), F.col(own)).rowsBetween(Window.unboundedPreceding, -1)
        here = (
            here.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
            .withColumn("w_all", F.sum("w").over(by))
            .withColumn("cap_all", F.sum("cap").over(by))
        )
        # the level at which this child and all after it would share what the earlier ones leave
        level = F.try_divide(F.col("given") - F.col("cap_before"), F.col("w_all") - F.col("w_before"))
        here = here.withColumn("level", F.when(F.col("ratio").isNotNull() & (F.col("ratio") > level), level))
        here = here.withColumn("level", F.max("level").over(by))  # later children's levels count this one as full
        got = (
            F.when(F.col("given") >= F.col("cap_all"), F.col("cap"))
            .when(F.col("level").isNull(), F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
            .otherwise(F.least(F.col("cap"), F.floor(F.col("w") * F.col("level"))))
            .cast("long")
        )
        here = here.withColumn("got", got)
        # floors leave a few tokens; they go to the first children that have room, in the level's order
        left = F.least(F.col("given"), F.col("cap_all")) - F.sum("got").over(by)
        room = F.col("cap") - F.col("got")
        room_before = F.coalesce(F.sum(room).over(by.orderBy((F.col("w") > 0).desc(), F.col("ratio").asc_nulls_last(), F.col(own)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = here.withColumn("got", F.col("got") + F.greatest(F.lit(0), F.least(room, left - room_before)).cast("long"))
        granted = here.select(*levels[:depth], "got")
        if depth == len(levels):
            granted = here.select(*levels, F.col("tokens"), F.col("cap").alias("capacity"), F.col("got").alias("allocation"))
    return granted


def mix(
    docs: DataFrame,
    budget: int | float,
    levels: Mapping[str, Column] | None = None,
    weights=None,
    epochs: int = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Adds to every row `mix_tokens` (long) and `mix_copies` (int): how often the mixture takes it.

    budget: tokens, or as a float a share of all tokens there are. levels: name -> expression.

    Defined cases: a null level value is a branch of its own; a null or empty text has 0 tokens and
    is taken where its place in an epoch comes before the end; repeated rows share one place in the
    order and are taken together or not at all; an empty table stays empty; extra columns pass
    unchanged whatever their names, but those named like an added one are replaced.
    """
    levels = dict(levels) if levels else {c: F.col(c) for c in LEVELS}
    names = [f"__l{i}" for i in range(len(levels))]
    through = [c for c in docs.columns if c not in ("mix_tokens", "mix_copies")]
    key = F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit(NO)), F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    # the columns of docs take names of their own until the end
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(through)], *[F.coalesce(e.cast("string"), F.lit(NO)).alias(n) for n, e in zip(names, levels.values(), strict=True)], words(F.col(text_col)).alias("mix_tokens"), key.alias("__key")
    )
    narrow = written(base.select(*names, "__key", "mix_tokens"), "mix-tokens")  # the texts are read once for the plan
    leaves = narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"))
    if isinstance(budget, float):
        budget = int((leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0) * budget)
    weights = {n: weights[k] for n, k in zip(names, levels, strict=True) if weights.get(k)} if weights else None
    plan = budgets(leaves, budget, tuple(names), weights, epochs)
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("allocation") / F.col("tokens"))).otherwise(0).cast("int"))
    # of each leaf's last epoch: the first bits of the order's key where it ends, and the tokens from there on
    plan = written(plan.withColumn("rest", F.col("allocation") - F.col("full") * F.col("tokens")).select(*names, "full", "rest", F.lit(0).cast("long").alias("cut"), F.lit(True).alias("open")), "mix-plan")

    def placed(df: DataFrame, by: DataFrame) -> DataFrame:
        return df.join(small(by), names).withColumn("__order", key_slice(seed, F.col("full"), F.col("__key")))

    bits = 0
    while True:
        # rows of the slices in which leaves end
        inside = placed(narrow, plan).where(F.col("open") & (F.shiftright("__order", KEY_BITS - bits) == F.col("cut")))
        if bits and (bits >= KEY_BITS or inside.groupBy(*names).count().where(F.col("count") > ORDERED).isEmpty()):
            break
        bits += SLICE_BITS
        sums = inside.groupBy(*names, "rest", F.shiftright("__order", KEY_BITS - bits).alias("slice")).agg(F.sum("mix_tokens").alias("n"))
        run = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
        ends = sums.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") > F.col("rest"))
        ends = ends.groupBy(*names).agg(F.min(F.struct("slice", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("c"))
        before = plan
        # a leaf without an end in the epoch (it has no tokens) is closed
        plan = written(plan.join(ends, names, "left").select(*names, "full", F.coalesce("c.left", "rest").alias("rest"), F.coalesce("c.slice", F.lit(0)).cast("long").alias("cut"), F.col("c").isNotNull().alias("open")), "mix-plan")
        forget(before)
    same = inside.groupBy(*names, "__order", "__key", "mix_tokens", "rest").agg(F.count(F.lit(1)).alias("same"))
    order = Window.partitionBy(*names).orderBy("__order", "__key", "mix_tokens").rowsBetween(Window.unboundedPreceding, 0)
    fits = same.withColumn("upto", F.sum(F.col("mix_tokens") * F.col("same")).over(order)).where(F.col("upto") <= F.col("rest"))
    last = fits.groupBy(*names).agg(F.max(F.struct("__order", "__key", "mix_tokens")).alias("last"))
    ends = written(plan.join(last, names, "left"), "mix-ends")
    taken = placed(base, ends).withColumn("__slice", F.shiftright("__order", KEY_BITS - bits))
    place = F.struct(F.col("__order"), F.col("__key"), F.col("mix_tokens"))
    more = F.col("open") & ((F.col("__slice") < F.col("cut")) | F.coalesce((F.col("__slice") == F.col("cut")) & (place <= F.col("last")), F.lit(False)))
    copies = (F.col("full") + F.coalesce(more, F.lit(False)).cast("int")).cast("int")
    forget(narrow)
    forget(plan)
    return taken.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(through)], "mix_tokens", copies.alias("mix_copies"))


def expanded(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mixture takes."""
    through = [c for c in mixed.columns if c not in ("mix_copies", "mix_tokens")]
    return mixed.where(F.col("mix_copies") > 0).select(*[F.col(f"`{c}`") for c in through], F.explode(F.expr("sequence(1, mix_copies)")).alias("__copy")).select(*[F.col(f"`{c}`") for c in through])
