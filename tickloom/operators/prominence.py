"""Prominences of one long series, spread over blocks of time.

The valley beside a peak reaches back to the last higher value, which may lie any number of blocks away. Inside a block a stack of falling
values finds it; a peak higher than all of its block asks on. A block hands on its record stack, no larger than the block, and
along the blocks runs a stack of their highest values, one entry a block at most. So a peak finds the block in which its valley ends, and
then the place in that block's records. Valleys are peaks of the negative, and the other side is the same in reverse.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.schema import KEYS
from tickloom.plans.scan import Kernel, fold, scan

#: The four ways a series is read: sign of the values, direction of the walk.
VIEWS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
#: Keys of a view of a series.
VIEW = ["symbol", "tf", "sign", "way"]


class Reach(Kernel):
    """For each value the least one since the last larger value of the block, itself included, and whether there is no larger one."""

    def __init__(self) -> None:
        self.falling: list[tuple[float, float]] = []

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        low, open_ = np.zeros(len(columns["v"])), np.zeros(len(columns["v"]))
        for k, x in enumerate(columns["v"].tolist()):
            least = x
            while self.falling and self.falling[-1][0] <= x:
                least = min(least, self.falling.pop()[1])
            low[k], open_[k] = least, not self.falling
            self.falling.append((x, least))
        return {"low": low, "open": open_}


class Records(Reach):
    """A block's highest and least value, and its records from the end: rising values, and the least value after each."""

    def result(self) -> dict[str, object]:
        values, least = zip(*reversed(self.falling), strict=True)
        after = np.minimum.accumulate(np.concatenate(([np.inf], least)))
        return {"top": values[-1], "bottom": float(after[-1]), "records": list(values), "after": after[:-1].tolist()}


class Higher(Kernel):
    """For each block the blocks before it that something in it may reach, nearest first: their tops and numbers, and the least
    value between. The first top higher than the block's own ends the list, or an endless one of no block. All lists together are no longer
    than two entries a block."""

    def __init__(self) -> None:
        self.stack: list[tuple[float, float, float]] = []

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {c: np.empty(len(columns["top"]), dtype=object) for c in ("tops", "between", "blocks")}
        for k, (top, bottom, block) in enumerate(zip(columns["top"].tolist(), columns["bottom"].tolist(), columns["block"].tolist(), strict=True)):
            tops, between, blocks, least = [], [], [], np.inf
            while self.stack:
                t, low, b = self.stack[-1]
                tops.append(t)
                between.append(least)
                blocks.append(int(b))
                if t > top:
                    break
                least = min(least, low)
                self.stack.pop()
            else:
                tops.append(np.inf)
                between.append(least)
                blocks.append(None)
            # an entry's least value is that of all blocks after the entry below it
            self.stack.append((top, min(bottom, least), block))
            out["tops"][k], out["between"][k], out["blocks"][k] = tops, between, blocks
        return out


def numbered_blocks(base: DataFrame, block: Column) -> tuple[DataFrame, DataFrame]:
    """The turns of base(keys, ts, price), which are the rows whose price differs from the one before, and all rows.

    Both have idx (place in the series, from 0), bno (number of the block), before (the price before) and total (bars of the series); turns also
    have the first turn of a later block (later_idx, later_price). What crosses blocks goes by one row a block.
    """
    rows = base.withColumn("b", block)
    facts = rows.groupBy(*KEYS, "b").agg(F.count("*").alias("n"), F.max_by("price", "ts").alias("last"))
    line = Window.partitionBy(*KEYS).orderBy("b")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = facts.select("*", F.row_number().over(line).cast("long").alias("bno"), F.lag("last").over(line).alias("__before"), F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy(*KEYS, "b").orderBy("ts")
    placed = rows.join(facts.drop("n", "last"), [*KEYS, "b"]).select("*", (F.row_number().over(inside) - 1 + F.col("offset")).alias("idx"), F.coalesce(F.lag("price").over(inside), F.col("__before")).alias("before"))
    turns = placed.where(F.col("before").isNull() | (F.col("before") != F.col("price"))).drop("b", "__before", "offset")
    firsts = turns.groupBy(*KEYS, "bno").agg(F.min_by(F.struct("idx", "price"), "idx").alias("first"))
    later = F.first("first").over(Window.partitionBy(*KEYS).orderBy("bno").rowsBetween(1, Window.unboundedFollowing))
    firsts = firsts.select(*KEYS, "bno", later["idx"].alias("later_idx"), later["price"].alias("later_price"))
    return turns.join(firsts, [*KEYS, "bno"]), placed


def blocked_extrema(bars: DataFrame, block: Column, plateaus: bool = True) -> DataFrame:
    """Local maxima and minima of bars(keys, ts, price) (the middle of a plateau, or single bars only without plateaus) with their
    prominence: keys, ts, bar_idx, price, kind, x, prominence.

    block must not fall as ts rises within a series, nor be null. No task holds more than a block of bars, whatever the course of the
    series; what runs along a whole series are one row a block. Null keys are left out, null prices must be gone.
    """
    turns, placed = numbered_blocks(bars.select(*KEYS, "ts", "price"), block)
    inside = Window.partitionBy(*KEYS, "bno").orderBy("idx")
    turns = turns.withColumns({"end": F.coalesce(F.lead("idx").over(inside), F.col("later_idx"), F.col("total")) - 1, "next": F.coalesce(F.lead("price").over(inside), F.col("later_price"))})
    x = F.col("price")
    top, bottom = (x > F.col("before")) & (x > F.col("next")), (x < F.col("before")) & (x < F.col("next"))
    if not plateaus:
        top, bottom = (e & (F.col("idx") == F.col("end")) for e in (top, bottom))
    turns = turns.withColumns({"kind": F.when(top, "peak").when(bottom, "valley"), "bar_idx": F.floor((F.col("idx") + F.col("end")) / 2)})
    views = F.explode(F.array(*(F.struct(F.lit(s).alias("sign"), F.lit(w).alias("way")) for s, w in VIEWS)))
    seen = turns.select(*KEYS, "ts", "idx", "end", "bar_idx", "bno", "price", "kind", views.alias("view")).select("*", "view.sign", "view.way").drop("view")
    seen = seen.select(*KEYS, "sign", "way", "ts", "idx", "end", "bar_idx", "price", (F.col("bno") * F.col("way")).alias("block"), (F.col("idx") * F.col("way")).alias("pos"), (F.col("price") * F.col("sign")).alias("v"), F.when((F.col("kind") == "peak") == (F.col("sign") == 1), F.col("kind")).alias("kind"))
    local = scan(seen, [*VIEW, "block"], ["pos"], ["v"], "low double, open double", Reach).where("kind is not null")
    records = fold(seen, [*VIEW, "block"], ["pos"], ["v"], "top double, bottom double, records array<double>, after array<double>", Records)
    higher = scan(records.select(*VIEW, "block", "top", "bottom"), VIEW, ["block"], ["top", "bottom", "block"], "tops array<double>, between array<double>, blocks array<bigint>", Higher)
    # where the block has nothing higher, the block that has, and the least value of the blocks between
    asks = local.where("open = 1").join(higher.select(*VIEW, "block", F.arrays_zip("tops", "between", "blocks").alias("before")), [*VIEW, "block"])
    asks = asks.withColumn("met", F.filter("before", lambda b: b["tops"] > F.col("v"))[0]).drop("before")
    asks = asks.withColumns({"low": F.least("low", F.col("met.between")), "block": F.col("met.blocks")}).drop("met")
    held = records.select(*VIEW, "block", F.arrays_zip("records", "after").alias("held"))
    met = asks.join(held, [*VIEW, "block"], "left").withColumn("low", F.least("low", F.filter("held", lambda r: r["records"] > F.col("v"))[0]["after"])).drop("held")
    lows = local.where("open = 0").select(*met.columns).unionByName(met)
    found = lows.groupBy(*KEYS, "kind", "bar_idx", "v").agg(F.max("low").alias("low"), F.first("price").alias("price"), F.first(F.when(F.col("idx") == F.col("end"), F.col("ts"))).alias("ts"))
    if not plateaus:
        return found.select(*KEYS, "ts", "bar_idx", "price", "kind", F.col("v").alias("x"), (F.col("v") - F.col("low")).alias("prominence"))
    # the bar in the middle of a plateau is looked up; most extrema are single bars and know theirs
    plateau = found.where("ts is null").drop("ts").join(placed.select(*KEYS, F.col("idx").alias("bar_idx"), "ts"), [*KEYS, "bar_idx"])
    every = found.where("ts is not null").unionByName(plateau)
    return every.select(*KEYS, "ts", "bar_idx", "price", "kind", F.col("v").alias("x"), (F.col("v") - F.col("low")).alias("prominence"))
