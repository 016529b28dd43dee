"""Exact quantiles of any number of values, without gathering a group's values in one task.

Sketches (mergeable, made before anything is moved) bracket the wanted rank; values
below the bracket are counted exactly, and the search goes on inside it until few
values are left for each key. These are sorted. So what one task ever holds of a key is
a sketch, or a bounded list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import checkpointed, small

#: Values of a key that are sorted in one task.
SORTED = 10_000
#: Parts into which a sketch cuts a bracket.
_PARTS = 64
MAX_ROUNDS = 30


def exact_quantile(rows: DataFrame, column: str, q: float, keys: list[str] = (), most: int = SORTED) -> DataFrame:  # type: ignore[assignment]
    """(keys, value): the q-quantile of the column's values in each key, linear between neighbours.

    Nulls and NaN do not count; keys without values have no row. Without keys the result
    is one row, none for an empty table.
    """
    keys = list(keys)
    on = keys or ["__all"]
    values = rows.select(*keys, *([] if keys else [F.lit(0).alias("__all")]), F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = values.groupBy(*on).agg(F.count("*").alias("n"))
    # the two neighbouring ranks, from 0, each with an open bracket; null ends are no ends
    ranks = F.array(*[F.struct(F.lit(k).alias("which"), F.least(F.floor(F.lit(q) * (F.col("n") - 1)) + k, F.col("n") - 1).cast("long").alias("rank")) for k in (0, 1)])
    number = lambda v: F.lit(v).cast("double")
    state = sizes.select(*on, "n", F.explode(ranks).alias("r")).select(*on, "n", "r.*", number(None).alias("lo"), number(None).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), number(None).alias("found"))
    state = checkpointed(state)
    inner = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    steps = [k / _PARTS for k in range(_PARTS + 1)]
    for _ in range(MAX_ROUNDS):
        todo = state.where(F.col("found").isNull() & (F.col("inside") > most))
        if todo.isEmpty():
            break
        cuts = values.join(small(todo), on).where(inner).groupBy(*on, "which").agg(F.percentile_approx("v", steps, 10_000).alias("cuts"))
        # two cuts to each side, for what the sketch may be off
        at = ((F.col("rank") - F.col("below")) * F.lit(float(_PARTS)) / F.col("inside")).cast("int")
        ends = todo.join(cuts, [*on, "which"]).withColumns({"new_lo": F.get("cuts", F.greatest(at - 2, F.lit(0))), "new_hi": F.get("cuts", F.least(at + 3, F.lit(_PARTS)))}).drop("cuts")
        ends = checkpointed(ends)
        v = F.col("v")
        counted = values.join(small(ends), on).where(inner).groupBy(*on, "which").agg(
            F.count_if(v < F.col("new_lo")).alias("less"), F.count_if(v == F.col("new_lo")).alias("at_lo"), F.count_if((v > F.col("new_lo")) & (v < F.col("new_hi"))).alias("within"), F.count_if((v == F.col("new_hi")) & (v > F.col("new_lo"))).alias("at_hi")
        )
        after = ends.join(counted, [*on, "which"])
        place = F.col("rank") - F.col("below") - F.col("less")
        found = F.when((place >= 0) & (place < F.col("at_lo")), F.col("new_lo")).when((place >= F.col("at_lo") + F.col("within")) & (place < F.col("at_lo") + F.col("within") + F.col("at_hi")), F.col("new_hi"))
        # a bracket that misses its rank is not taken
        holds = (place >= F.col("at_lo")) & (place < F.col("at_lo") + F.col("within"))
        pick = lambda new, old: F.when(holds, new).otherwise(F.col(old)).alias(old)
        done = after.select(*on, "n", "which", "rank", pick(F.col("new_lo"), "lo"), pick(F.col("new_hi"), "hi"), pick(F.col("below") + F.col("less") + F.col("at_lo"), "below"), pick(F.col("within"), "inside"), found.alias("found"))
        state = checkpointed(state.where(F.col("found").isNotNull() | (F.col("inside") <= most)).unionByName(done))
    else:
        raise RuntimeError(f"the brackets did not close in {MAX_ROUNDS} rounds")
    lists = values.join(small(state.where("found IS NULL")), on).where(inner).groupBy(*on, "which", "rank", "below", "n").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    sorted_ = lists.select(*on, "n", "which", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("found"))
    both = sorted_.unionByName(state.where("found IS NOT NULL").select(*on, "n", "which", "found")).groupBy(*on, "n").agg(F.max(F.when(F.col("which") == 0, F.col("found"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("found"))).alias("b"))
    part = F.lit(q) * (F.col("n") - 1)
    share = part - F.floor(part)
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    return both.select(*keys, value.alias("value"))
