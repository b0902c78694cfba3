"""Heavy hitters: frequent keys found in one pass, and joins that deal their rows over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys called frequent at most; a broadcast of them is no longer than that.
FREQUENT = 64
#: Counters of the pass that looks for them.
TRACKED = 4096
#: Parts that the rows of a frequent key are dealt into.
SALTS = 64


def frequent(df: DataFrame, key: str, k: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """The ``k`` most frequent values of a column, about: one pass with ``tracked`` counters a task, merged at the end.

    A value that is missed costs evenness and never a row (see ``split_join``), so the approximation is harmless. Nulls
    are not counted. The table may be stored and serve all queries over the same months.
    """
    found = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {int(k)}, {int(tracked)})").alias("found"))
    return found.select(F.inline("found")).select(F.col("item").alias(key))


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    by: list[Column],
    hot: DataFrame,
    salts: int = SALTS,
    how: str = "inner",
    hint: str | None = None,
) -> DataFrame:
    """``left.join(right, key, how)`` for an inner, left or semi join; rows of hot keys are dealt over ``salts`` parts.

    ``hot`` holds FREQUENT keys at most. A left row of a hot key goes to the part that ``by`` says, the right rows of
    that key go to every part; so each left row meets each of its right rows once, whichever keys are called hot. ``by``
    should tell the left rows of a key apart. Null keys stay where a plain join has them.

    ``hint``: the join strategy; ``merge`` where rows made by an explode meet, which the optimizer doesn't count and
    would broadcast by the size of the table they come from.
    """
    marks = F.broadcast(hot.select(key).distinct().withColumn("_hot", F.lit(True)))
    is_hot, other = F.col("_hot").isNotNull(), F.lit(0).cast("bigint")
    dealt = left.join(marks, key, "left").withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(other))
    parts = F.when(is_hot, F.sequence(other, F.lit(salts - 1).cast("bigint"))).otherwise(F.array(other))
    repeated = right.join(marks, key, "left").withColumn("_part", F.explode(parts))
    met = repeated.drop("_hot")
    return dealt.drop("_hot").join(met.hint(hint) if hint else met, [key, "_part"], how).drop("_part")
