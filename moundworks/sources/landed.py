"""Landed pitches as a data source of its own: a range of dates is a filter, a day is a partition.

    spark.dataSource.register(LandedPitches)
    spark.read.format("landed_pitches").schema("pitcher long, game_date date").load(path).where(...)

Files stand under ``game_date=YYYY-MM-DD`` folders. Filters on game_date and season choose the days whose
files are opened (with ``spark.sql.python.filterPushdown.enabled``; without it all days are read and
Spark filters), and only columns of the given schema are read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from moundworks.schemas import PITCHES

COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class Day(InputPartition):
    day: str
    files: list[str]


class LandedPitches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pitches"

    def schema(self) -> str:
        return f"{PITCHES}, season int"

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"], schema)


class LandedReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on the day and its season; gives all others back to Spark."""
        for f in filters:
            name = f.attribute[0] if type(f) in COMPARE and len(f.attribute) == 1 else None
            if name in ("game_date", "season"):
                self.wanted.append((name, type(f), f.value))
            else:
                yield f

    def chosen(self, day: dt.date) -> bool:
        return all(COMPARE[kind](day if name == "game_date" else day.year, value) for name, kind, value in self.wanted)

    def partitions(self) -> list[Day]:
        store, top = fs.FileSystem.from_uri(self.path)
        out = []
        for folder in store.get_file_info(fs.FileSelector(top)):
            if folder.base_name.startswith("game_date=") and folder.type == fs.FileType.Directory:
                text = folder.base_name.split("=", 1)[1]
                try:
                    day = dt.date.fromisoformat(text)
                except ValueError:  # such as the folder of null dates: no range has it
                    continue
                if self.chosen(day):
                    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder.path)) if f.base_name.endswith(".parquet") and f.base_name[0] not in "._")
                    out.append(Day(text, files))
        return sorted(out, key=lambda d: d.day)

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        day = dt.date.fromisoformat(partition.day)
        given = {"game_date": day, "season": day.year}
        schema = to_arrow_schema(self.schema)
        for name in partition.files:
            with store.open_input_file(name) as source:
                file = pq.ParquetFile(source)
                has = set(file.schema_arrow.names)
                for batch in file.iter_batches(columns=[n for n in schema.names if n in has and n not in given]):
                    arrays = [pa.repeat(pa.scalar(given[f.name], f.type), batch.num_rows) if f.name in given else batch.column(f.name).cast(f.type) if f.name in has else pa.nulls(batch.num_rows, f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
