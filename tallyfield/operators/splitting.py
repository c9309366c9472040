"""Cost-balanced splitting of boxes in the plane.

Groups are cut in two again and again along their longer side, at the place that divides their costs in the ratio of the
numbers of shares the halves get, so that each share is a compact piece of the plane of nearly equal cost. A place is found by
sums of cost in `STEPS` intervals, narrowed `ROUNDS` times: a few aggregates per level for all groups together, no
sort and no group in one task. The driver sees a row a group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

STEPS = 128
ROUNDS = 5


def unwrapped(boxes: DataFrame, x: tuple[str, str], turn: float) -> DataFrame:
    """Boxes moved by whole turns in x, so that their middles lie within half a turn of the mean direction."""
    middle = (F.col(x[0]) + F.col(x[1])) / 2 * (2 * math.pi / turn)
    mean = boxes.agg(F.atan2(F.sum(F.sin(middle)), F.sum(F.cos(middle))).alias("_ref"))
    back = F.round((middle - F.col("_ref")) / (2 * math.pi)) * turn
    out = boxes.join(F.broadcast(mean)).withColumn("_back", F.coalesce(back, F.lit(0.0)))
    return out.withColumns({c: F.col(c) - F.col("_back") for c in x}).drop("_ref", "_back")


def shares(boxes: DataFrame, id: str, cost: str, y: tuple[str, str], x: tuple[str, str], n: int, turn: float | None = None) -> DataFrame:
    """boxes (id, cost, y from and to, x from and to) with `share`, 0 to n - 1, and boxes' x unwrapped if they turn.

    A share's cost is within one box's cost of its part at each cut, so after log2(n) cuts the loads differ by a few boxes' costs; boxes at
    the very same middle are told apart by a hash of id. Null costs count as 0, boxes with null corners go to share 0; fewer boxes than shares
    leave shares empty.
    """
    rows = boxes if turn is None else unwrapped(boxes, x, turn)
    names = rows.columns
    # Places along either side are whole numbers: the middle on a fine scale, the hash of the id below it.
    rows = rows.withColumns({"_my": (F.col(y[0]) + F.col(y[1])) / 2, "_mx": (F.col(x[0]) + F.col(x[1])) / 2, "_c": F.coalesce(F.col(cost).cast("double"), F.lit(0.0))})
    span = rows.agg(*[f(c).alias(f"{n_}{c}") for c in ("_my", "_mx") for n_, f in (("low", F.min), ("high", F.max))])
    tie = F.pmod(F.xxhash64(id), F.lit(1 << 10))
    place = lambda c: (F.floor(F.coalesce((F.col(c) - F.col(f"low{c}")) / F.nullif(F.col(f"high{c}") - F.col(f"low{c}"), F.lit(0.0)), F.lit(0.0)) * ((1 << 24) - 1)).cast("long") * (1 << 10) + tie)
    rows = rows.join(F.broadcast(span)).withColumns({"_py": place("_my"), "_px": place("_mx")})
    rows = cut(rows.select(*names, "_my", "_mx", "_c", "_py", "_px", F.lit(0).alias("_first"), F.lit(n).alias("_n")))
    while n > 1:
        rows = cut(_halved(rows))
        n = -(-n // 2)
    return rows.select(*names, F.col("_first").alias("share"))


def _halved(rows: DataFrame) -> DataFrame:
    """Every group of more than one share cut in two. A group is named by its first share."""
    groups = rows.where("_n > 1").groupBy("_first").agg(
        (F.max("_my") - F.min("_my") > F.max("_mx") - F.min("_mx")).alias("_tall"), F.sum("_c").alias("_all"), F.min("_py").alias("_y0"), F.max("_py").alias("_y1"), F.min("_px").alias("_x0"), F.max("_px").alias("_x1"), F.first("_n").alias("_of")
    )
    ends = lambda a, b: F.when(F.col("_tall"), F.col(a)).otherwise(F.col(b))
    goal = F.col("_all") * F.floor(F.col("_of") / 2) / F.col("_of")
    state = cut(groups.select("_first", "_tall", goal.alias("_goal"), ends("_y0", "_x0").alias("_low"), (ends("_y1", "_x1") + 1).alias("_high"), F.lit(0.0).alias("_below")))
    along = F.when(F.col("_tall"), F.col("_py")).otherwise(F.col("_px"))
    for _ in range(ROUNDS):
        # The interval in which the running cost passes the goal; below it lies less, with it no less.
        wide = F.greatest(F.ceil((F.col("_high") - F.col("_low")) / STEPS), F.lit(1))
        inside = rows.join(F.broadcast(state), "_first").where((along >= F.col("_low")) & (along < F.col("_high")))
        sums = inside.groupBy("_first", F.floor((along - F.col("_low")) / wide).alias("_k")).agg(F.sum("_c").alias("_s"))
        per = sums.groupBy("_first").agg(F.sort_array(F.collect_list(F.struct("_k", "_s"))).alias("_bins"))  # STEPS at most
        both = state.join(per, "_first")
        walked = F.aggregate(
            "_bins", F.struct(F.col("_below").alias("sum"), F.lit(-1).cast("long").alias("k"), F.col("_below").alias("before")),
            lambda a, b: F.when((a["k"] < 0) & (a["sum"] + b["_s"] >= F.col("_goal")), F.struct((a["sum"] + b["_s"]).alias("sum"), b["_k"].alias("k"), a["sum"].alias("before"))).otherwise(F.struct((a["sum"] + b["_s"]).alias("sum"), a["k"].alias("k"), F.when(a["k"] < 0, a["sum"] + b["_s"]).otherwise(a["before"]).alias("before"))),
        )
        both = both.withColumns({"_w": walked, "_wide": wide})
        k = F.when(F.col("_w.k") < 0, F.floor((F.col("_high") - 1 - F.col("_low")) / F.col("_wide"))).otherwise(F.col("_w.k"))
        low = F.col("_low") + k * F.col("_wide")
        state = cut(both.select("_first", "_tall", "_goal", low.alias("_low"), F.least(low + F.col("_wide"), F.col("_high")).alias("_high"), F.col("_w.before").alias("_below")))
    out = rows.join(F.broadcast(state.select("_first", "_tall", F.col("_high").alias("_at"))), "_first", "left")
    first = F.floor(F.col("_n") / 2).cast("int")
    left = along < F.col("_at")
    return out.withColumns({
        "_n": F.when(F.col("_at").isNull(), F.col("_n")).when(F.coalesce(left, F.lit(True)), first).otherwise(F.col("_n") - first),
        "_first": F.when(F.col("_at").isNotNull() & ~F.coalesce(left, F.lit(True)), F.col("_first") + first).otherwise(F.col("_first")),
    }).select(*rows.columns)
