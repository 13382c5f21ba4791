"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its pairs of neighbouring words, weighted by how often they occur. For each of
``samples`` independent draws a term of weight w has, from hashes of the term alone, r and c from
Gamma(2, 1) and b uniform; with t = floor(ln w / r + b) its value is ln c - r (t - b + 1), and the
text's sample is the term of least value. Two texts have the same sample with a probability equal to
their generalised Jaccard similarity: the sum of smaller weights over the sum of larger ones.

The least value itself stands for the sample (it is a function of term and t alone), so a sample is a
plain minimum that is combined before any shuffle.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundworks.llm import shared

LEAST = -(1 << 63)  # orders null doc_ids, before all others
TURN = 16
MOST_RANGES = 1 << 15  # beyond it ranges get longer: 3 GB of 100 TB each, sorted on disk


def constants(values: list | np.ndarray, kind: str) -> Column:
    """A constant array, handed over as one text that the planner folds once: a literal for each value
    takes the driver seconds."""
    text = ",".join(map(repr, map(float if kind == "double" else int, values)))
    return (F.split(F.lit(text), ",") if text else F.array()).cast(f"array<{kind}>")


def held(spark: SparkSession) -> DataFrame:
    """The tables of quantiles as one row of a written table, to be broadcast: as literals they would
    stand in every plan's description for each of their uses."""
    return shared.staged(spark.range(1).select(*[constants(t, "double").alias(c) for c, t in zip(("r_table", "c_table"), tables(), strict=True)]), "quantiles")


def ranges(docs: DataFrame, order: Column, n: int) -> tuple[Column, DataFrame]:
    """Deals rows to at most ``n`` ranges of doc_id of like size. Returns the range's number and, for
    the first doc_id of each range that has rows (``first``), the range before it (``into``; before
    the first range: the last). ``n`` bounds all that comes to the driver and goes back."""
    cuts = docs.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    step = max(1, math.isqrt(len(cuts)))

    def reached(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c <= order))

    # how many cuts are reached: whole steps of them first, then those of the next step
    whole = reached(constants(cuts[step - 1 :: step], "long")) * step
    number = (whole + reached(F.slice(constants(cuts, "long"), whole + 1, F.lit(step)))).cast("long")
    firsts = sorted((r["range"], r["first"]) for r in docs.groupBy(number.alias("range")).agg(F.min(order).alias("first")).collect())
    before = [firsts[-1][0], *(r for r, _ in firsts)] if firsts else []
    return number, docs.sparkSession.createDataFrame([(first, before[i]) for i, (_, first) in enumerate(firsts)], "first long, into long")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document beside the next one's text: range, rn (its place there), doc_id, text,
    next_text, and extra: true for a copy of the next range's first document, which closes a range."""
    order = F.coalesce("doc_id", F.lit(LEAST))
    tasks = shared.parts(docs.sparkSession, shared.input_bytes(docs), 2 << 20, MOST_RANGES)
    number, firsts = ranges(docs, order, min(MOST_RANGES, 2 * tasks))
    real = docs.select(number.alias("range"), F.lit(False).alias("extra"), order.alias("order"), "text")
    extra = docs.join(F.broadcast(firsts), order == F.col("first"))  # a row a range
    extra = extra.select(F.col("into").alias("range"), F.lit(True).alias("extra"), order.alias("order"), "text")
    by = Window.partitionBy("range").orderBy("extra", "order", F.xxhash64("text"))
    dealt = real.unionByName(extra).repartition(tasks, "range")
    return dealt.select("range", "extra", "order", "text", F.row_number().over(by).alias("rn"), F.lead("text", 1, "").over(by).alias("next_text"))


def gamma_quantile(u: float) -> float:
    """Of Gamma(2, 1), whose distribution is 1 - exp(-x) (1 + x); by bisection on log x."""
    low, high = -40.0, 5.0
    for _ in range(80):
        mid = (low + high) / 2
        x = math.exp(mid)
        # x * x / 2 stands for the difference where that would lose its digits
        p = x * x / 2 * (1 - 2 * x / 3) if x < 1e-4 else 1 - math.exp(-x) * (1 + x)
        low, high = (mid, high) if p < u else (low, mid)
    return math.exp(high)


R_BITS, STEPS, LEVELS = 12, 256, 6


@lru_cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of r at even steps; and of ln c, level after level, at steps from 0 to each of 1, 1/16,
    1/256, ...: the smaller u, the finer."""
    r = np.array([gamma_quantile((i + 0.5) / (1 << R_BITS)) for i in range(1 << R_BITS)])
    c = np.array([math.log(gamma_quantile((i + 0.5) / STEPS / 16**k)) for k in range(LEVELS) for i in range(STEPS)])
    return r, c


def value(h: Column, log_weight: str, r_table: Column, c_table: Column) -> Column:
    """A term's value in one sample, from its hash there. Logarithms would cost most, so r and ln c
    come from tables of the gamma distribution's quantiles, and one hash has the bits of r, b and c."""
    b_bits = 32 - R_BITS
    r = r_table[F.shiftrightunsigned(h, 64 - R_BITS).cast("int")]
    b = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit((1 << b_bits) - 1)).cast("double") * (0.5**b_bits) + 0.5 ** (b_bits + 1)
    x = h.bitwiseAND(F.lit((1 << 32) - 1))
    step = F.when(x >= 1 << 28, F.shiftright(x, 24))
    for level in range(1, LEVELS - 1):
        step = step.when(x >= 1 << (28 - 4 * level), F.shiftright(x, 24 - 4 * level) + level * STEPS)
    step = step.otherwise(F.shiftright(x, 28 - 4 * LEVELS) + (LEVELS - 1) * STEPS)
    return c_table[step.cast("int")] - r * (F.floor(F.col(log_weight) / r + b).cast("double") - b + 1.0)


def fingerprints(docs: DataFrame, samples: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text is the text whose last quarter of code points is replaced by as many first ones
    of the next document, by ascending doc_id (of one doc_id: by the text's hash; null first); the
    first follows the last. Null texts are empty; an empty text has one term of its own, so two
    empty texts are alike. A likeness is the share of equal samples.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(whole)
    n_chars = F.length("text").cast("long")
    part = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n_chars - part).cast("int")), F.substring("next_text", F.lit(1), part))

    # words that end before the last quarter are common to both texts: they are cut and counted once
    def cut(x: Column) -> Column:
        return F.array_remove(F.split(x, " "), "")

    kept = F.substring("text", F.lit(1), (n_chars - part).cast("int"))
    blank = [F.translate(x, "\t\n\x0b\f\r", "     ") for x in (kept, F.substring("text", (n_chars - part + 1).cast("int"), part), F.substring("next_text", F.lit(1), part))]
    x = rows.select("range", "rn", *[c.alias(n) for n, c in zip(("kept", "last", "next"), blank, strict=True)])
    x = x.withColumn("torn", F.substring_index("kept", " ", -1))
    x = x.select("range", "rn", cut(F.expr("left(kept, length(kept) - length(torn))")).alias("head"), cut(F.concat("torn", "last")).alias("own"), cut(F.concat("torn", "next")).alias("other"))
    seam = F.when(F.size("head") > 0, F.slice("head", -1, 1)).otherwise(F.array().cast("array<string>"))

    def pairs(w: Column, end: int) -> Column:
        return F.arrays_zip(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1 + end, F.lit(0))).alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(0))).alias("b"))

    def rest(c: str) -> Column:  # from the last common word on; no word at all is one empty word
        w = F.concat(seam, F.col(c))
        return F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(w)

    x = x.select("range", "rn", pairs(F.col("head"), 0).alias("p0"), pairs(rest("own"), 1).alias("p1"), pairs(rest("other"), 1).alias("p2"))
    x = x.select("range", "rn", F.inline(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(own).alias("own"), F.lit(other).alias("other")) for i, own, other in ((0, 1, 1), (1, 1, 0), (2, 0, 1))])))
    terms = x.select("range", "rn", "own", "other", F.inline("p"))
    weighted = terms.groupBy("range", "rn", F.xxhash64("a", "b").alias("term")).agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    # a term that weighs the same in both texts has one value there: whose 0 is both's, 1 and 2 are one's
    entry = [F.struct(F.lit(code).alias("whose"), F.ln(F.col(c).cast("double")).alias("w")) for code, c in ((0, "own"), (1, "own"), (2, "other"))]
    entries = F.when(F.col("own") == F.col("other"), F.array(entry[0])).when(F.col("other") == 0, F.array(entry[1])).when(F.col("own") == 0, F.array(entry[2])).otherwise(F.array(entry[1], entry[2]))
    # samples go by turns of TURN: more values in one aggregation are too much code for the compiler
    weighted = weighted.select("range", "rn", "term", F.inline(entries)).select("range", "rn", "term", "whose", "w", F.explode(F.array(*map(F.lit, range(0, samples, TURN)))).alias("turn"))
    weighted = weighted.crossJoin(F.broadcast(held(docs.sparkSession)))  # one row
    one_by_one = [F.min(value(F.xxhash64("term", F.col("turn") + k), "w", F.col("r_table"), F.col("c_table"))).alias(f"v{k}") for k in range(TURN)]
    least = weighted.groupBy("range", "rn", "whose", "turn").agg(*one_by_one)
    least = least.groupBy("range", "rn", "turn").agg(*[F.min(F.when(F.col("whose") != not_of, F.col(f"v{k}"))).alias(f"{c}{k}") for c, not_of in (("own", 2), ("other", 1)) for k in range(TURN)])

    def bits(c: str) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(f"{c}{k}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(TURN)]))

    turns = least.groupBy("range", "rn").agg(F.sort_array(F.collect_list(F.struct("turn", bits("own").alias("own"), bits("other").alias("other")))).alias("t"))  # samples / TURN entries
    prints = turns.select("range", "rn", *[F.concat(*[F.col("t")[i][c] for i in range(samples // TURN)]).alias(c) for c in ("own", "other")])
    by = Window.partitionBy("range").orderBy("rn")
    prints = prints.select("range", "rn", "own", "other", F.lead("own").over(by).alias("next"))

    def alike(a: str, b: str) -> Column:
        same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.substring(F.col(a), 4 * k + 1, F.lit(4)) == F.substring(F.col(b), 4 * k + 1, F.lit(4)))
        return F.size(same) / F.lit(float(samples))

    meta = rows.where(~F.col("extra")).select("range", "rn", F.when(F.col("order") != LEAST, F.col("order")).alias("doc_id"), n_chars.alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    return meta.join(prints, ["range", "rn"]).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("other")).alias("edited_fingerprint"), alike("own", "other").alias("near_edited"), alike("own", "next").alias("near_next")
    )
