"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as
they are). The exponent is bisected so that the weights have a target entropy, or as near to alike as
a limit on repetition allows. A weight times the budget is a source's number of tokens: whole passes
over it and a part of one more. A pass takes the source's blocks in a seeded order of its own; the
last one takes whole blocks while the budget lasts, and of the next block documents while it lasts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundworks.llm import shared


def weights(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens)
    raised = [(t / top) ** exponent for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def passes(tokens: list[float], w: list[float], budget: float | None) -> list[float]:
    """How often each source is gone through; without a budget, the least often taken one once."""
    each = [x / t for x, t in zip(w, tokens, strict=True)]
    scale = budget if budget is not None else 1 / min(each)
    return [x * scale for x in each]


def bisect_exponent(tokens: list[float], target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None) -> float:
    """The least exponent in [0, 1] whose weights have at most the target entropy and repeat no source
    more often than the limit; 1 where none does. Both fall as the exponent rises."""

    def fits(x: float) -> bool:
        w = weights(tokens, x)
        return (target_entropy is None or entropy(w) <= target_entropy + 1e-12) and (repetition_limit is None or max(passes(tokens, w, budget)) <= repetition_limit * (1 + 1e-12))

    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space; a null or empty text has none."""
    t = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.array_remove(F.split(t, " "), "")).cast("long")


def mix(
    docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None, seed: int = 0, block_rows: int = 4096, max_sources: int = 100_000, tokens: Column | None = None
) -> DataFrame:
    """The mixture: the columns of ``docs`` and, where these do not have such names, mix_tokens,
    mix_pass (from 0), mix_block, mix_order (the block's hash in this pass) and mix_row (the row's):
    a pass goes by (mix_order, mix_block, mix_row), and the last one takes the first blocks and rows of
    that order.

    A null source is a source. A document without tokens is in every whole pass. The table of sources
    comes to the driver: more than ``max_sources`` are refused. Rows of one doc_id and text go together:
    they fall in one block, and where the budget ends all of them are taken or none. Columns of ``docs``
    may have any names. An empty table gives no rows.
    """
    n_tokens = tokens if tokens is not None else word_count()
    key = F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in docs.columns])
    # the row is one column, whatever names are inside
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), n_tokens.alias("_tokens"), key.alias("_key"))
    measured = shared.staged(rows.select("source", "_key", "_tokens"), "measured")
    sources = measured.groupBy("source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources.sort(key=lambda r: (r["source"] is not None, r["source"]))
    some = [r for r in sources if r["tokens"]]
    size = [float(r["tokens"]) for r in some]
    times = passes(size, weights(size, bisect_exponent(size, target_entropy, repetition_limit, budget)), budget) if some else []
    plan = {r["source"]: (int(x + 1e-9), max(0, round((x - int(x + 1e-9)) * r["tokens"]))) for r, x in zip(some, times, strict=True)}
    table = [(r["source"], *plan.get(r["source"], (1, 0)), -(-r["n"] // block_rows)) for r in sources]
    # bounded by max_sources
    shares = F.broadcast(docs.sparkSession.createDataFrame(table, "_source string, _whole long, _rest long, _blocks long"))

    def with_shares(x: DataFrame) -> DataFrame:
        x = x.join(shares, x["source"].cast("string").eqNullSafe(F.col("_source")))
        return x.withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(seed)), F.col("_blocks")))

    def order(*c: str) -> Column:
        return F.xxhash64(F.lit(seed), F.col("_whole"), *[F.col(x) for x in c])

    measured = with_shares(measured)
    blocks = measured.where("_rest > 0").groupBy("_source", "_block", "_whole", "_rest").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy(order("_source", "_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_left", F.col("_rest") - F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_left > 0")
    blocks = shared.staged(blocks.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_sum", "_left"), "blocks-taken")
    here = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))
    # the block in which a source's budget ends: its rows in order while it lasts
    inside = Window.partitionBy("_source", "_block").orderBy(order("_key"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    ends = measured.join(blocks.where("_sum > _left"), here).groupBy("_source", "_block", "_whole", "_left", "_key").agg(F.sum("_tokens").alias("_tokens"))
    edge = ends.withColumn("_upto", F.sum("_tokens").over(inside)).where("_upto <= _left")
    edge = edge.select(F.col("_source").alias("_es"), F.col("_key").alias("_ek"), F.lit(True).alias("_edge"))

    out = with_shares(rows).join(blocks.where("_sum <= _left").select("_s", "_b", F.lit(True).alias("_taken")), here, "left")
    out = out.join(edge, F.col("_source").eqNullSafe(F.col("_es")) & (F.col("_key") == F.col("_ek")), "left")
    n = F.col("_whole") + F.when(F.col("_taken").isNotNull() | F.col("_edge").isNotNull(), 1).otherwise(0)
    out = out.where(n > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("_pass"))
    more = {"mix_tokens": F.col("_tokens"), "mix_pass": F.col("_pass"), "mix_block": F.col("_block"), "mix_order": F.xxhash64(F.lit(seed), "_pass", "_source", "_block"), "mix_row": F.xxhash64(F.lit(seed), "_pass", "_key")}
    return out.select("row.*", *[c.alias(name) for name, c in more.items() if name not in docs.columns])
