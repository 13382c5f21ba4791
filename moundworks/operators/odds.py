"""Sportsbook documents to one row per priced line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.functions.semantics import decimal_odds


def strikeout_lines(odds: DataFrame, strict: bool = True) -> DataFrame:
    """Lines of players marked as starting, in each document's order of lines.

    Documents are kept apart: a line meets the appearances of its own document only, inside the row.
    Missing arrays are empty, and so is a document that could not be parsed. A line without a higher and
    a lower option is an error in the strict form, and has nulls in the lenient one. Numbers are text
    in the documents; what is none is null.
    """
    starting = F.filter(
        F.coalesce("appearances", F.array().cast("array<struct<id:string,badges:array<struct<label:string,value:string>>>>")),
        lambda a: F.exists(F.coalesce(a.badges, F.array().cast("array<struct<label:string,value:string>>")), lambda b: F.coalesce((b.label == "Starting") & (b.value == "Yes"), F.lit(False))),
    )
    x = odds.select(F.transform(starting, lambda a: a.id).alias("ids"), "over_under_lines")
    of_line = lambda line: line.over_under.appearance_stat.appearance_id
    lines = x.select(F.explode(F.filter("over_under_lines", lambda line: F.coalesce(F.array_contains("ids", of_line(line)), F.lit(False)))).alias("l"))
    pick = F.element_at if strict else F.try_element_at

    def option(choice: str):
        return pick(F.filter("l.options", lambda o: o.choice == choice), F.lit(1))

    x = lines.select(pick(F.col("l.options"), F.lit(1)).selection_header.alias("player"), F.col("l.stat_value").alias("k_line"), option("higher").alias("over"), option("lower").alias("under"))
    prices = [(c, t) for c, t in (("american_price", "int"), ("decimal_price", "double"), ("payout_multiplier", "double"))]
    return x.select("player", F.col("k_line").try_cast("double").alias("k_line"), *[F.col(f"{s}.{c}").try_cast(t).alias(f"{s}_{c}") for s in ("over", "under") for c, t in prices])


def with_payouts(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"payout_over": decimal_odds("over_american_price"), "payout_under": decimal_odds("under_american_price")})
