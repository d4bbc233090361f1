"""Tables that grow by parts, with a manifest that says which parts are live.

A part is a folder of files under ``data``; a manifest version is a small file
that lists the live parts. Writing a part changes nothing for readers. It
becomes visible, or several small ones are replaced by a merged one, when the
next version of the manifest appears, one file, put in place by a rename. So a
reader sees the parts of one version, never both old and merged ones, and a
crash before that moment leaves the table as it was.

Parts are labelled with the range of batches they hold. A batch that is
replayed after it became visible is skipped; one that was only half written is
written again. When ``FAN_IN`` parts of one level have gathered they are merged
into one of the next level, so the number of live parts grows with the
logarithm of the batches, and a row is rewritten once a level.

One writer at a time: merge and expire between batches, in the same query.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 16

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Part:
    """Batches ``first`` to ``last``; ``latest`` is the greatest event time in them, in microseconds, if the table keeps one."""

    part: str
    level: int
    first: int
    last: int
    latest: int | None = None


class Generations:
    """One table at ``path``. ``month`` says that parts are partitioned by event_month; ``time`` names the event-time column."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, month: bool = False, time: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.month, self.time = month, time

    # Reading

    def manifest(self) -> tuple[int, list[Part], int | None]:
        """(version, live parts in batch order, first month that is kept). Parts are few: a fan-in per level."""
        version = max(self._versions(), default=0)
        return (version, *self._version(version)) if version else (0, [], None)

    def read(self, before: int | None = None, after: int | None = None) -> DataFrame:
        """Rows of the live parts; of batches below ``before``, or of parts that reach beyond batch ``after``."""
        _, parts, first_month = self.manifest()
        chosen = [p for p in parts if (before is None or p.last < before) and (after is None or p.last > after)]
        if not chosen:
            return self.spark.createDataFrame([], self._stored())
        return self._load(chosen, first_month)

    def landed(self) -> int | None:
        """The last batch that readers see."""
        parts = self.manifest()[1]
        return max((p.last for p in parts), default=None)

    def latest(self, before: int | None = None) -> int | None:
        """The greatest event time of the batches below ``before``, in microseconds."""
        return max((p.latest for p in self.manifest()[1] if p.latest is not None and (before is None or p.last < before)), default=None)

    # Writing

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Write a batch as a part and make it visible; False if it had been visible before.

        Batches come in ascending order and only the last may come again, as a
        stream does. A number below it means that a stream was started afresh.
        """
        version, parts, first_month = self.manifest()
        last = max((p.last for p in parts), default=None)
        if last is not None and batch < last:
            raise ValueError(f"{self.path} holds batches up to {last}; a stream with a new checkpoint needs a new table")
        if batch == last:
            return False
        name, seen = f"batch-{batch}", Observation()
        self._write(rows.observe(seen, F.max(F.unix_micros(self.time)).alias("latest")) if self.time else rows, name)
        latest = seen.get["latest"] if self.time else None
        self._commit(version + 1, [*parts, Part(name, 0, batch, batch, latest)], first_month)
        return True

    def compact(self, merge: Merge | None = None, fan_in: int = FAN_IN) -> int:
        """Merge the parts of every level that has ``fan_in`` of them; returns how many merges were made.

        ``merge`` folds the rows of several parts, which must not depend on how
        they are grouped; by default rows are only rewritten together.
        """
        made = 0
        while True:
            version, parts, first_month = self.manifest()
            run = next((r for r in _runs(parts) if len(r) >= fan_in), None)
            if run is None:
                return made
            rows = self._load(run, first_month)
            name = f"merged-{run[0].first}-{run[-1].last}-{version + 1}"
            self._write(merge(rows) if merge else rows, name)
            latest = max((p.latest for p in run if p.latest is not None), default=None)
            merged = Part(name, run[0].level + 1, run[0].first, run[-1].last, latest)
            self._commit(version + 1, [p for p in parts if p not in run] + [merged], first_month)
            made += 1

    def expire(self, first_month: int) -> None:
        """From the next version on, readers skip months before ``first_month``; ``vacuum`` removes their files."""
        version, parts, known = self.manifest()
        if not self.month:
            raise ValueError("only tables by month expire")
        if parts and (known is None or first_month > known):
            self._commit(version + 1, parts, first_month)

    def vacuum(self, keep_versions: int = 2) -> list[str]:
        """Remove parts, expired months and manifests that none of the last ``keep_versions`` versions refers to.

        A reader that started on one of those versions is unharmed. Returns the
        folders that were removed.
        """
        versions = self._versions()
        version = max(versions, default=0)
        kept = [self._version(v) for v in versions if v > version - keep_versions]
        live, months = {p.part for parts, _ in kept for p in parts}, [first for _, first in kept]
        oldest = None if None in months else min(months, default=None)
        removed = []
        for part in self._names("data"):
            if part.removeprefix("part=") not in live:
                removed.append(f"data/{part}")
            elif oldest is not None:
                folders = self._names(f"data/{part}")
                removed += [f"data/{part}/{m}" for m in folders if m[12:].isdigit() and int(m[12:]) < oldest]
        removed += [f"manifest/{v}.json" for v in versions if v <= version - keep_versions]
        for name in removed:
            self._fs(f"{self.path}/{name}")[0].delete(self._fs(f"{self.path}/{name}")[1], True)
        return removed

    # Files

    def _stored(self) -> T.StructType:
        schema = T.StructType(list(self.schema.fields))
        return schema.add("event_month", T.IntegerType()) if self.month else schema

    def _load(self, parts: list[Part], first_month: int | None) -> DataFrame:
        base = f"{self.path}/data"
        rows = self.spark.read.schema(self._stored()).option("basePath", base).parquet(*[f"{base}/part={p.part}" for p in parts]).drop("part")
        return rows if first_month is None or not self.month else rows.where(F.col("event_month") >= first_month)

    def _write(self, rows: DataFrame, name: str) -> None:
        writer = rows.select(*self._stored().names).write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("event_month") if self.month else writer).parquet(f"{self.path}/data/part={name}")

    def _versions(self) -> list[int]:
        return sorted(int(name[:-5]) for name in self._names("manifest"))

    def _version(self, version: int) -> tuple[list[Part], int | None]:
        fs, where = self._fs(f"{self.path}/manifest/{version}.json")
        stream = fs.open(where)
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return sorted((Part(**p) for p in held["parts"]), key=lambda p: p.first), held["first_month"]

    def _commit(self, version: int, parts: list[Part], first_month: int | None) -> None:
        fs, fresh = self._fs(f"{self.path}/pending/{version}.json")
        target = self._fs(f"{self.path}/manifest/{version}.json")[1]
        body = json.dumps({"parts": [asdict(p) for p in parts], "first_month": first_month})
        stream = fs.create(fresh, True)
        stream.write(body.encode())
        stream.close()
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(fresh, target):
            raise RuntimeError(f"version {version} of {self.path} exists; is there a second writer?")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _names(self, folder: str) -> list[str]:
        if not self._exists(f"{self.path}/{folder}"):
            return []
        fs, where = self._fs(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(where) if not f.getPath().getName().startswith((".", "_")))


def _runs(parts: list[Part]) -> list[list[Part]]:
    """Neighbouring parts of one level, lowest level first."""
    runs: list[list[Part]] = []
    for p in parts:
        if runs and runs[-1][0].level == p.level:
            runs[-1].append(p)
        else:
            runs.append([p])
    return sorted(runs, key=lambda r: r[0].level)
