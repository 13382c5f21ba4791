"""Tables in parts that are replaced one by one, read as they were at one moment.

A table is a folder with ``data``, where every write has a folder of its own, and ``versions``, where
version n is one file that lists the folder of each part. A version's file is put in place by a rename
after all its data is written: a reader meets the version before or the one after, never none, and a
write that fails leaves files that nobody reads. A part is a season and one of ``buckets`` hashes of a key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Version:
    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)  # "season=2024/bucket=3" -> folder under data
    notes: dict = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


@dataclass
class PartTable:
    spark: SparkSession
    root: str
    schema: str
    season: str = "season"
    key: str = "pitcher"
    buckets: int = 16

    def _fs(self):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *more: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *more]))

    def current(self) -> Version:
        """The newest version; an empty one where there is no table."""
        _, fs = self._fs()
        folder = self._path("versions")
        if not fs.exists(folder):
            return Version()
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return Version()
        stream = fs.open(self._path("versions", names[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _commit(self, v: Version) -> None:
        jvm, fs = self._fs()
        name = f"{v.number:012d}.json"
        beside, place = self._path("versions", f".{name}.{uuid.uuid4().hex}"), self._path("versions", name)
        fs.mkdirs(self._path("versions"))
        out = fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(v.__dict__).encode()))
        finally:
            out.close()
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise Conflict(f"version {v.number} of {self.root} is there already")

    def part(self) -> tuple:
        return F.col(self.season).cast("string").alias("_season"), F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias("_bucket")

    def read(self, seasons: Iterable | None = None, buckets: Iterable[int] | None = None, version: Version | None = None) -> DataFrame:
        """Rows of one version. Parts of other seasons and buckets are not opened."""
        v = version or self.current()
        seasons = None if seasons is None else {str(s) for s in seasons}
        buckets = None if buckets is None else set(buckets)
        chosen = []
        for name, folder in sorted(v.parts.items()):
            s, b = (x.split("=", 1)[1] for x in name.split("/"))
            if (seasons is None or s in seasons) and (buckets is None or int(b) in buckets):
                chosen.append(f"{self.root.rstrip('/')}/data/{folder}/_season={s}/_bucket={b}")
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def parts_of(self, rows: DataFrame) -> list[tuple[str, int]]:
        """Seasons and buckets that rows fall into; at most as many as the table has parts."""
        return [(r["_season"], r["_bucket"]) for r in rows.select(*self.part()).distinct().collect()]

    def replace(self, rows: DataFrame, touched: list[tuple[str, int]], base: Version, notes: dict | None = None) -> Version:
        """A version in which the ``touched`` parts hold ``rows`` (all of which fall into them) and all
        other parts are those of ``base``. A touched part without rows goes."""
        folder = f"v{base.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root.rstrip('/')}/data/{folder}"
        season, bucket = self.part()
        rows.withColumns({"_season": season, "_bucket": bucket}).repartition(max(1, len(touched)), "_season", "_bucket").write.partitionBy("_season", "_bucket").parquet(path)
        _, fs = self._fs()
        parts = dict(base.parts)
        for s, b in touched:
            name = f"season={s}/bucket={b}"
            if fs.exists(self._path("data", folder, f"_season={s}", f"_bucket={b}")):
                parts[name] = folder
            else:
                parts.pop(name, None)
        v = Version(base.number + 1, parts, {**base.notes, **(notes or {})})
        self._commit(v)
        return v

    def upsert(self, rows: DataFrame, keys: list[str], notes: dict | None = None) -> Version:
        """Rows of ``rows`` take the place of those with equal ``keys``, nulls equal to nulls. Only parts
        that they fall into are read and written."""
        base = self.current()
        touched = self.parts_of(rows)
        if not touched:
            return base
        old = self.read({s for s, _ in touched}, {b for _, b in touched}, base)
        wanted = self.spark.createDataFrame(touched, "_season string, _bucket long")  # one row a part
        season, bucket = self.part()
        old = old.withColumns({"_season": season, "_bucket": bucket}).join(F.broadcast(wanted), ["_season", "_bucket"], "left_semi").drop("_season", "_bucket")
        new_keys = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        kept = old.join(new_keys, same, "left_anti")
        return self.replace(kept.unionByName(rows.select(*kept.columns)), touched, base, notes)

    def clean(self, keep: int = 2) -> int:
        """Remove versions but the newest ``keep`` and data that none of these has; how many folders
        went. Readers of removed versions fail, so ``keep`` covers the longest of them."""
        _, fs = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(self._path("versions")) if s.getPath().getName().endswith(".json"))
        for n in names[:-keep]:
            fs.delete(self._path("versions", n), False)
        used = set()
        for n in names[-keep:]:
            stream = fs.open(self._path("versions", n))
            used |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"].values())
            stream.close()
        gone = [s.getPath() for s in fs.listStatus(self._path("data")) if s.getPath().getName() not in used]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
