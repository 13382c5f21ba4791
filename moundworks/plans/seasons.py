"""The season loop: each season's feature table made on its own, one part of a table after another."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.operators.features import enriched_games
from moundworks.sources.versions import PartTable


@dataclass
class Report:
    made: list[int]
    empty: list[int]
    skipped: list[int]


def bootstrap(pitches: Callable[[int], DataFrame], seasons: Iterable[int], table: PartTable, make: Callable[[DataFrame], DataFrame] | None = None, again: bool = False) -> Report:
    """Make ``seasons`` in order from ``pitches(season)``, each a version of ``table`` that replaces that
    season's parts and no other's.

    A season without games is reported as empty and not retried. The first error ends the loop and is
    raised; what was made before it stays, and the next call goes on from there (``again`` makes all).
    """
    make = make or (lambda p: enriched_games(p, compat=False))
    report = Report([], [], [])
    for season in seasons:
        done = table.current().notes.get("seasons", {})
        if str(season) in done and not again:
            report.skipped.append(season)
            continue
        base = table.current()
        made = make(pitches(season)).withColumn(table.season, F.lit(season).cast("int"))
        old = [(s, int(b)) for s, b in ((p.split("/")[0].split("=")[1], p.split("/")[1].split("=")[1]) for p in base.parts) if s == str(season)]
        touched = sorted({*table.parts_of(made), *old})
        state = "made" if any(t not in old for t in touched) or made.limit(1).count() else "empty"
        notes = {"seasons": {**done, str(season): state}}
        table.replace(made, touched, base, notes)
        getattr(report, state).append(season)
    return report
