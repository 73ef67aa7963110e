"""A table with one row per key, upserted in batches, whose files do not grow with the number of batches.

Rows lie in date buckets. A batch rewrites the buckets it touches, and no other, into a folder of its own:

    data/<version>-<attempt>/bucket=<number>/*.parquet
    versions/<version>.json      which folder holds each bucket, and the last batch of each stream

The version file is created at once or not at all and is all that readers follow, so a reader sees a whole version, a
batch that stopped half way is invisible, and a repeated batch is recognised by its number. Of two writers one takes the
next version; the other starts again from that. After a commit, versions beyond the last ``keep`` are removed, then
buckets that no remaining version names in folders older than these, which includes what lost or stopped writers left.

Bounds: a batch reads and writes the buckets it has dates in; a bucket is rewritten into ``files`` files, or one per
``ROWS_PER_FILE`` rows if that is more, so the table has at most buckets x ``files`` x ``keep`` files until it is large. The version record has one entry per bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date as Day

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsspark.sources.commits import Versions

ROWS_PER_FILE = 1_000_000

#: (rows already there or None, rows of the batch) to the rows that take their place.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class KeyedTable:
    """``schema`` has the key columns and ``date``; all rows of a key lie in the bucket of its date."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], date: str = "date", bucket_days: int = 31, files: int = 1, keep: int = 2):
        if date not in keys:
            raise ValueError(f"The date column '{date}' must be one of the keys {list(keys)}.")
        self._spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, tuple(keys)
        self.date, self._days, self._files, self._keep = date, bucket_days, files, max(keep, 1)
        self._versions = Versions(spark, self.path)

    def _bucket(self) -> Column:
        return F.floor(F.unix_date(F.col(self.date).cast("date")) / self._days).cast("int")

    def _number(self, day: Day) -> int:
        return (day - Day(1970, 1, 1)).days // self._days

    def version(self) -> int:
        """The current version, 0 before the first batch."""
        found = self._versions.latest()
        return found[0] if found else 0

    def last_batch(self, stream: str) -> int | None:
        found = self._versions.latest()
        return found[1]["batches"].get(stream) if found else None

    def read(self, first: Day | None = None, last: Day | None = None) -> DataFrame:
        """The current rows; with dates, only buckets that can hold them are opened."""
        found = self._versions.latest()
        places = found[1]["buckets"] if found else {}
        wanted = [b for b in places if (first is None or int(b) >= self._number(first)) and (last is None or int(b) <= self._number(last))]
        rows = self._open(places, wanted)
        for bound, keep in ((first, lambda c: c >= F.lit(first)), (last, lambda c: c <= F.lit(last))):
            rows = rows.where(keep(F.col(self.date).cast("date"))) if bound is not None else rows
        return rows

    def _open(self, places: dict[str, str], buckets: Sequence[str]) -> DataFrame:
        paths = [f"{self.path}/data/{places[b]}/bucket={b}" for b in buckets]
        if not paths:
            return self._spark.createDataFrame([], self.schema)
        return self._spark.read.schema(self.schema).parquet(*paths)

    def upsert(self, rows: DataFrame, merge: Merge, batch: tuple[str, int] | None = None) -> int:
        """Merge ``rows`` into the buckets they touch and return the version.

        ``batch`` is the stream's name (its checkpoint, which numbers the batches) and the number; a batch applied before
        changes nothing. ``merge`` must return one row per key. Rows without a date belong nowhere and are refused.
        """
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            held = dict(rows.groupBy(self._bucket().alias("bucket")).count().collect())  # one number per bucket
            touched = list(held)
            if None in touched:
                raise ValueError(f"Rows without '{self.date}' can't be kept by date.")
            while True:
                found = self._versions.latest()
                number, record = found or (0, {"batches": {}, "buckets": {}})
                if batch and record["batches"].get(batch[0], -1) >= batch[1]:
                    return number
                places = record["buckets"]
                folder = f"{number + 1:012d}-{uuid.uuid4().hex}"
                old = [str(b) for b in touched if str(b) in places]
                there = self._open(places, old) if old else None
                merged = merge(there, rows)
                try:
                    n_rows = sum(held.values()) + (there.count() if old else 0)
                    self._write(merged, folder, len(touched), n_rows)
                except Exception:
                    if self.version() < number + self._keep:
                        raise
                    continue  # overtaken so far that the folder or what it was made from is gone
                done = record["batches"] | ({batch[0]: batch[1]} if batch else {})
                record = {"batches": done, "buckets": places | {str(b): folder for b in touched}}
                if self._versions.commit(number + 1, record):
                    self.clean()
                    return number + 1
        finally:
            rows.unpersist()

    def _files_for(self, n_rows: int, buckets: int) -> int:
        return max(self._files, -(-n_rows // (max(buckets, 1) * ROWS_PER_FILE)))

    def _write(self, merged: DataFrame, folder: str, buckets: int, n_rows: int = 0) -> None:
        rows = merged.select(*self.schema.names).withColumn("bucket", self._bucket())
        files = self._files_for(n_rows, buckets)
        dealt = F.pmod(F.xxhash64(*self.keys), F.lit(files))
        parts = max(1, buckets * files)
        rows.repartition(parts, "bucket", dealt).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")

    def clean(self) -> None:
        """Remove superseded versions, and folders that no kept version names; safe to repeat and to stop half way."""
        numbers = self._versions.numbers()
        if not numbers:
            return
        for old in numbers[: -self._keep]:
            self._versions.remove(old)
        kept, files = numbers[-self._keep :], self._versions.files
        named: dict[str, set[str]] = {}
        for n in kept:
            for bucket, folder in self._versions.read(n)["buckets"].items():
                named.setdefault(folder, set()).add(f"bucket={bucket}")
        for folder in files.names("data"):
            if folder not in named and int(folder.split("-")[0]) < kept[0]:
                files.remove(f"data/{folder}")
            elif folder in named:
                for bucket in files.names(f"data/{folder}"):
                    if bucket.startswith("bucket=") and bucket not in named[folder]:
                        files.remove(f"data/{folder}/{bucket}")


def newest(keys: Sequence[str], order: Sequence[str]) -> Merge:
    """Per key the row with the greatest ``order``; between an old and a new row that tie, the new one."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new.withColumn("_fresh", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("_fresh", F.lit(0)))
        rest = [c for c in new.columns if c not in order]
        row = F.max(F.struct(*order, "_fresh", *rest))
        return both.groupBy(*keys).agg(row.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in new.columns])

    return merge
