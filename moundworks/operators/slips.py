"""Combinations of legs into slips, and which slips to take.

A slip is a set of at most 16 legs, held as the bits of a number; legs are few by construction (the
best ``legs`` plays), so all that follows is bounded by that parameter and not by data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks.schemas import SLIP_PAYOUTS


def top_legs(plays: DataFrame, legs: int = 12) -> DataFrame:
    """The best plays with their position from 0; name and side settle ties."""
    best = plays.orderBy(F.desc_nulls_last("ev"), "pitcher_name", "play").limit(legs)
    by = Window.orderBy(F.desc_nulls_last("ev"), "pitcher_name", "play")  # at most ``legs`` rows
    p = F.when(F.col("play") == "over", F.col("mc_p_over")).otherwise(F.col("mc_p_under"))
    return best.withColumn("pos", F.row_number().over(by) - 1).withColumn("p", p)


def ordinal(mask: Column, legs: int) -> Column:
    """Sorts masks of one size as their lists of positions sort."""
    return reduce(lambda s, i: s + F.shiftright(mask, i).bitwiseAND(F.lit(1)) * (1 << (legs - 1 - i)), range(legs), F.lit(0)) * -1


def slips(legs: DataFrame, n_legs: int = 12, sizes: tuple[int, int] = (2, 8)) -> DataFrame:
    """Every combination of legs (pos, pitcher_name, play, p) of different pitchers whose size has a
    payout: mask, slip_size, p_win, payout, total_ev, avg_ev, ordinal."""
    spark = legs.sparkSession
    masks = spark.range(1 << n_legs).select(F.col("id").alias("mask")).where(F.bit_count("mask").between(*sizes))
    held = masks.join(F.broadcast(legs), F.expr("mask & shiftleft(1L, pos) <> 0"))  # n_legs rows
    x = held.groupBy("mask").agg(F.count("*").alias("slip_size"), F.countDistinct("pitcher_name").alias("names"), F.product("p").alias("p_win"))
    payout = F.coalesce(F.create_map(*[F.lit(v) for kv in SLIP_PAYOUTS.items() for v in kv])[F.col("slip_size").cast("int")], F.lit(0))
    # a leg that is not there would leave a smaller slip: only whole ones count
    x = x.where((F.col("names") == F.col("slip_size")) & (F.bit_count("mask") == F.col("slip_size"))).withColumn("payout", payout).where("payout <> 0 AND p_win <> 0")
    x = x.withColumn("total_ev", F.col("p_win") * F.col("payout") - 1)
    return x.select("mask", "slip_size", "p_win", "payout", "total_ev", (F.col("total_ev") / F.col("slip_size")).alias("avg_ev"), ordinal(F.col("mask"), n_legs).alias("ordinal"))


def with_legs(chosen: DataFrame, legs: DataFrame) -> DataFrame:
    """Slips with their legs' fields as an array of structs, in order of position."""
    fields = [c for c in ("pitcher_name", "play", "ev", "payout", "k_line", "pitcher_team") if c in legs.columns]
    leg = legs.select("pos", F.struct(*[F.col(c).alias("pitcher" if c == "pitcher_name" else c) for c in fields]).alias("leg"))
    x = chosen.join(F.broadcast(leg), F.expr("mask & shiftleft(1L, pos) <> 0"))  # as many rows as legs
    keys = chosen.columns
    return x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "leg"))).alias("_l")).select(*keys, F.transform("_l", lambda s: s.leg).alias("legs"))


def by_value(s: DataFrame) -> list[Column]:
    """Best total value first; equal ones (to 12 places, as a product's last digits follow the order of
    its factors) as they were made: by size, then by positions."""
    return [-F.round("total_ev", 12), F.col("slip_size"), F.col("ordinal")]


def as_made(s: DataFrame) -> list[Column]:
    return [F.col("slip_size"), F.col("ordinal")]


def diverse(s: DataFrame, order: list[Column] | None = None, most_shared: int = 3) -> DataFrame:
    """In order, each slip that shares at most so many legs with every slip kept before it. The fold
    runs over one array: slips are bounded by the number of legs."""
    order = by_value(s) if order is None else order
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in s.columns])
    listed = s.agg(F.array_sort(F.collect_list(row)).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: F.bit_count(k.bitwiseAND(x.mask)) > most_shared)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x.mask)))

    kept = listed.withColumn("kept", F.aggregate("all", F.array().cast("array<bigint>"), step))
    return kept.select(F.explode("kept").alias("mask")).join(s, "mask")


def conservative(s: DataFrame, bankroll: float = 143, share: float = 0.05, most: int = 3) -> DataFrame:
    """The first slips as made, one unit each, while the day's share of the bankroll lasts."""
    n = min(most, int(share * bankroll))
    by = Window.orderBy(*as_made(s))
    return s.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n").withColumn("units", F.lit(1))


def full_send(s: DataFrame, bankroll: float = 143, share: float = 0.05) -> DataFrame:
    """Best slips first, more units on better ones; one that does not fit is passed over, not the end."""
    cap = share * bankroll
    big = min(int(cap), 5)
    units = F.when((F.col("total_ev") > 1.5) & (F.col("p_win") > 0.5), big).when((F.col("total_ev") > 1.0) & (F.col("p_win") > 0.4), 2).otherwise(1).cast("int")
    s = s.withColumn("units", units)
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by_value(s))], "mask", "units")
    listed = s.agg(F.array_sort(F.collect_list(row)).alias("all"))
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<bigint>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = (a.spent < cap) & (a.spent + x.units <= cap)
        return F.struct(F.when(fits, a.spent + x.units).otherwise(a.spent).alias("spent"), F.when(fits, F.concat(a.kept, F.array(x.mask))).otherwise(a.kept).alias("kept"))

    kept = listed.select(F.explode(F.aggregate("all", start, step).kept).alias("mask"))
    return kept.join(s, "mask")
