"""Predictions against lines: probabilities, expected values, simulation, and picks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.functions.semantics import exact_normal_cdf, normal_cdf, soften, staked_ev
from moundworks.operators.odds import with_payouts


def ensemble(predictions: DataFrame, row: str = "row_id", floor: float = 0.75) -> DataFrame:
    """From (row, model, pred): mean and population deviation over models, the latter not below ``floor``."""
    x = predictions.groupBy(row).agg(F.avg("pred").alias("k_pred_mean"), F.stddev_pop("pred").alias("k_pred_std"))
    return x.withColumn("k_pred_std", F.when(F.col("k_pred_std").isNotNull(), F.greatest("k_pred_std", F.lit(floor))))


def residual_deviation(residuals: DataFrame, by: str = "pitcher_name") -> DataFrame:
    """Sample deviation of residuals by pitcher; that of all rows where a pitcher has one row only."""
    every = residuals.agg(F.stddev_samp("residual").alias("_all"))
    own = residuals.where(F.col(by).isNotNull()).groupBy(by).agg(F.stddev_samp("residual").alias("_own"))
    return own.crossJoin(F.broadcast(every)).select(by, F.coalesce("_own", "_all").alias("residual_std"))  # one row


def price(predictions: DataFrame, lines: DataFrame, residuals: DataFrame | None = None, exact: bool = False, strict_ev: bool = False) -> DataFrame:
    """Inner join by player, hybrid deviation, normal probabilities, payouts and expected values."""
    x = predictions.join(lines, predictions.pitcher_name == lines.player)
    if residuals is not None:
        every = residuals.agg(F.stddev_samp("residual").alias("_all"))
        x = x.join(residual_deviation(residuals), "pitcher_name", "left").crossJoin(F.broadcast(every)).withColumn("residual_std", F.coalesce("residual_std", "_all")).drop("_all")  # one row
    x = x.withColumn("hybrid_std", F.hypot("k_pred_std", "residual_std"))
    z = (F.col("k_line") - F.col("k_pred_mean")) / F.col("hybrid_std")
    x = x.withColumn("p_under", exact_normal_cdf(z) if exact else normal_cdf(z)).withColumn("p_over", F.lit(1.0) - F.col("p_under"))
    return evs(with_payouts(x), "p_over", "p_under", "ev_over", "ev_under", strict_ev)


def evs(x: DataFrame, p_over: str, p_under: str, over: str, under: str, strict: bool = False) -> DataFrame:
    return x.withColumns({over: staked_ev(p_over, "payout_over", strict), under: staked_ev(p_under, "payout_under", strict)})


def simulate(x: DataFrame, draws: int = 10_000, seed: int = 0, softness: float = 0.85, clip: bool = True) -> DataFrame:
    """``mc_p_over`` and ``mc_p_under`` from seeded normal draws, clipped at 0 and rounded half to even
    where ``clip``, then softened. Draws are made and averaged inside each row: no rows are added, and rows
    stay where they are (see ``spread``)."""
    start = F.xxhash64(F.lit(seed), F.col("pitcher_name"), F.col("k_line"))
    over = over_share(draws, clip)(start, *[F.col(c).cast("double") for c in ("k_pred_mean", "hybrid_std", "k_line")])
    x = x.withColumn("mc_p_over", soften(over, softness))
    return x.withColumn("mc_p_under", F.lit(1.0) - F.col("mc_p_over"))


def spread(x: DataFrame) -> DataFrame:
    """Rows dealt out to all cores: they are few and small, so that they lie in one or two tasks, but dear to
    simulate."""
    spark = x.sparkSession
    return x.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def normals(start: int, steps: np.ndarray) -> np.ndarray:
    """Standard normal values from hashes: the row's own hash goes on with each draw's number, as the
    engine's 64-bit xxHash does; ``steps`` are the numbers times the hash's first factor."""
    h = steps ^ np.uint64((start + PRIMES[4] + 4) & MASK)
    h = ((h << 23) | (h >> 41)) * PRIMES[1] + PRIMES[2]
    h ^= h >> 33
    h *= PRIMES[1]
    h ^= h >> 29
    h *= PRIMES[2]
    h ^= h >> 32
    u = ((h >> 33).astype(np.float64) + 0.5) / float(1 << 31)
    v = ((h & np.uint64((1 << 31) - 1)).astype(np.float64) + 0.5) / float(1 << 31)
    return np.sqrt(-2.0 * np.log(u)) * np.cos(v * (2 * np.pi))


MASK = (1 << 64) - 1
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def over_share(draws: int, clip: bool):
    """The share of a row's draws above its line. Nulls and NaN are as in expressions: a null value is none
    above the line (clipped: 0), NaN is above every number, and nothing is above a line that is null or NaN."""

    @F.arrow_udf("double")
    def share(start: pa.Array, mean: pa.Array, deviation: pa.Array, line: pa.Array) -> pa.Array:
        steps = np.array([i * PRIMES[0] & MASK for i in range(1, draws + 1)], np.uint64)
        out = []
        for h, m, s, k in zip(*[c.to_pylist() for c in (start, mean, deviation, line)], strict=True):
            if k is None or k != k:
                out.append(0.0)
                continue
            if m is None or s is None:
                out.append(1.0 if clip and k < 0 else 0.0)
                continue
            value = m + s * normals(h, steps)
            if clip:
                value = np.rint(np.maximum(value, 0.0))
            out.append(float(draws - np.count_nonzero(value <= k)) / draws)
        return pa.array(out, pa.float64())

    return share


def simulated_ev(x: DataFrame, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """The likelier side's value of a bet by plain draws: expected_value, over_pct, under_pct."""
    x = simulate(with_payouts(x), draws, seed, softness=1.0, clip=False)
    ev = F.when(F.col("mc_p_over") > 0.5, F.col("mc_p_over") * F.col("payout_over") - 1).otherwise(F.col("mc_p_under") * F.col("payout_under") - 1)
    return x.withColumns({"expected_value": ev, "over_pct": F.col("mc_p_over"), "under_pct": F.col("mc_p_under")}).drop("mc_p_over", "mc_p_under")


def plays(x: DataFrame, over: str = "mc_ev_over", under: str = "mc_ev_under") -> DataFrame:
    """A row per side: the side's value and payout as ``ev`` and ``payout``; the other side's columns
    stay and its own are null. Only positive values. ``x`` is made once for both sides."""
    kinds = dict(x.dtypes)
    first = {over: "ev", "payout_over": "payout"}
    own = {"over": first, "under": {under: "ev", "payout_under": "payout"}}

    def side(play: str):
        taken = {new: F.col(c) for c, new in own[play].items()}
        other = [F.when(F.lit(c not in own[play]), F.col(c)).cast(kinds[c]).alias(c) for names in own.values() for c in names]
        return F.struct(*[taken[n].alias(n) for n in ("ev", "payout")], *other, F.lit(play).alias("play"))

    x = x.withColumn("_side", F.explode(F.array(side("over"), side("under")))).where(F.col("_side.ev") > 0)
    sided = {"ev", "payout", *own["over"], *own["under"]}
    columns = [first.get(c, c) for c in x.columns if c != "_side"]
    return x.select(*[F.col(f"_side.{c}" if c in sided else c) for c in columns], F.col("_side.play").alias("play"), *[F.col(f"_side.{c}") for c in x.columns if c in first])


def edges(predictions: DataFrame, lines: DataFrame, n: int | None = 20) -> DataFrame:
    """Prediction minus line, largest distance first; players without a line last, names settling ties."""
    x = predictions.join(lines.select("player", "k_line"), F.col("pitcher_name") == F.col("player"), "left")
    x = x.withColumn("edge", F.col("model_k_pred") - F.col("k_line")).withColumn("abs_edge", F.abs("edge"))
    x = x.select("pitcher_name", "k_line", "model_k_pred", "edge", "abs_edge").orderBy(F.desc_nulls_last("abs_edge"), "pitcher_name")
    return x if n is None else x.limit(n)


def histogram(x: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """Counts in equal bins between the least and the largest value, which falls in the last bin."""
    span = x.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    x = x.where(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(span))  # one row
    at = F.floor((F.col(column) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins)
    return x.groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
