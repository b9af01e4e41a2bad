"""Versioned Parquet tables: each write is a new directory, the pointer file of the largest number names the current ones."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schema import KEYS, REFERENCES, TABLES, conform


#: Pointers that stay: a reader that has listed the folder can still open the last one.
POINTERS = 8
#: Seconds after which a lease counts as left behind.
LEASE = 3600.0


class Conflict(OSError):
    """Another writer published first."""


class Pointers:
    """Numbered states of a folder, each a small JSON file; the largest number is the state that counts.

    A state is complete before it gets its name, and the name is claimed in one step that fails if it is taken: a hard
    link on a local file system, a rename (which HDFS refuses on an existing name) on others. No file is ever replaced.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, number: int):
        return self._path(f"{self.root}/CURRENT-{number:012}.json")

    def _numbers(self) -> list[int]:
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(m[1]) for m in (re.fullmatch(r"CURRENT-([0-9]{12})\.json", n) for n in names) if m)

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._name(number))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self) -> tuple[int, dict]:
        """The last state and its number; (0, {}) before the first."""
        numbers = self._numbers()
        return (numbers[-1], self._load(numbers[-1])) if numbers else (0, {})

    def states(self) -> list[dict]:
        """All states that readers may still be at."""
        return [self._load(n) for n in self._numbers()]

    def _claim(self, new, name) -> bool:
        """Gives a complete file its name unless that is taken."""
        if self._fs.getScheme() != "file":
            return not self._fs.exists(name) and self._fs.rename(new, name)
        try:
            os.link(new.toUri().getPath(), name.toUri().getPath())
        except FileExistsError:
            return False
        self._fs.delete(new, False)
        return True

    def publish(self, number: int, state: dict) -> int:
        """Makes `state` the one that follows `number`, which must still be the last; its number."""
        new = self._path(f"{self.root}/.CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(json.dumps(state).encode())
        out.close()
        # names that were taken and have gone since are below the last one
        if (self._numbers() or [0])[-1] != number or not self._claim(new, self._name(number + 1)):
            self._fs.delete(new, False)
            raise Conflict("another writer was faster")
        for old in self._numbers()[:-POINTERS]:
            self._fs.delete(self._name(old), False)
        return number + 1

    def folders(self, prefixes: tuple[str, ...]) -> set[str]:
        root = self._path(self.root)
        return {s.getPath().getName() for s in self._fs.listStatus(root) if s.getPath().getName().startswith(prefixes)} if self._fs.exists(root) else set()

    def remove(self, names) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Library(Pointers):
    """Tables under a root folder on any file system Spark can reach.

    A change writes whole new versions beside the old ones and then publishes a state that names them, so readers see one
    state or the other at any moment, and a failed write leaves nothing behind that is referred to. Of two writers that
    began with the same state one fails.

    Backup, restore and compaction hold a lease, which is itself a published state: its number fences off all writers that
    began before it, and those that begin later see it and are refused. A lease that has run out may be passed over by
    the next writer; its late holder then fails when it publishes. Maintenance deletes only what the states before its
    own named, never what a later writer may have begun.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time) -> None:
        super().__init__(spark, root)
        self._clock = clock
        self._held: str | None = None

    def _pointer(self) -> dict[str, str]:
        return {k: v for k, v in self.state()[1].items() if k != "_lease"}

    def _move(self, number: int, state: dict) -> None:
        """Publishes tables for a writer: refused under another's lease, and keeps its own."""
        lease = self.state()[1].get("_lease")
        if lease and lease["holder"] != self._held and lease["until"] > self._clock():
            raise OSError("the library is being maintained")
        if self._held and (not lease or lease["holder"] != self._held):
            raise Conflict("the lease was lost")
        tables = {k: v for k, v in state.items() if k != "_lease"}
        self.publish(number, tables | ({"_lease": lease} if self._held else {}))

    @contextmanager
    def exclusive(self, seconds: float = LEASE) -> Iterator[None]:
        """Holds the lease for so many seconds at most."""
        if self._held:
            yield
            return
        number, state = self.state()
        lease = state.get("_lease")
        if lease and lease["until"] > self._clock():
            raise OSError("the library is being maintained")
        holder = uuid.uuid4().hex
        try:
            self.publish(number, state | {"_lease": {"holder": holder, "until": self._clock() + seconds}})
        except Conflict as e:
            raise OSError("the library is being maintained") from e
        self._held = holder
        try:
            yield
        finally:
            number, state = self.state()
            try:
                if state.get("_lease", {}).get("holder") == holder:
                    self.publish(number, {k: v for k, v in state.items() if k != "_lease"})
            except Conflict:  # the lease had run out and another writer went on
                pass
            finally:
                self._held = None

    def read(self, name: str) -> DataFrame:
        path = self._pointer().get(name)
        if path is None:
            return self.spark.createDataFrame([], TABLES[name])
        return conform(self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{path}"), name)

    def write(self, **tables: DataFrame) -> None:
        """Replaces tables together."""
        number, pointer = self.state()
        if (lease := pointer.get("_lease")) and lease["holder"] != self._held and lease["until"] > self._clock():
            raise OSError("the library is being maintained")
        for name, df in tables.items():
            path = f"{name}/v-{time.time_ns()}"
            conform(df, name).write.parquet(f"{self.root}/{path}")
            pointer[name] = path
        self._move(number, pointer)

    def size(self) -> int:
        return int(self._fs.getContentSummary(self._path(self.root)).getLength())

    def compact(self, rows_per_file: int = 1_000_000) -> tuple[int, int]:
        """Rewrites the current versions in full files and removes what was there before; bytes before and after."""
        before = self.size()
        with self.exclusive():
            old = {(name, f.getPath().getName()) for name in self._pointer() for f in self._fs.listStatus(self._path(f"{self.root}/{name}"))}
            for name in self._pointer():
                df = self.read(name)
                n = max(1, -(-df.count() // rows_per_file))
                self.write(**{name: df.repartition(n)})
            # published: from here on nobody begins with the old versions
            now = {tuple(path.split("/")) for path in self._pointer().values()}
            self.remove("/".join(x) for x in old - now)
        return before, self.size()

    # ---- backups

    def fingerprint(self) -> dict[str, tuple[int, str]]:
        """Rows and an order-free hash of each table."""
        out = {}
        for name in sorted(self._pointer()):
            row = self.read(name).select(F.xxhash64(*TABLES[name].names).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")).first()
            out[name] = (row["n"], str(row["h"]))
        return out

    def backup(self, target: str) -> None:
        """A verified copy in a new folder; an existing target is refused, a copy that differs is removed."""
        path = self._path(target)
        if self._fs.exists(path):
            raise FileExistsError(target)
        copy = Library(self.spark, target)
        try:
            with self.exclusive():
                copy.write(**{name: self.read(name) for name in self._pointer()})
                if copy.fingerprint() != self.fingerprint():
                    raise OSError("the copy differs")
        except Exception:
            self._fs.delete(path, True)
            raise

    def restore(self, source: str, safety: str) -> None:
        """Takes over a backup after saving the present state to `safety`; a broken backup is refused first."""
        from_ = Library(self.spark, source)
        if not from_._pointer() or from_.broken().take(1):
            raise ValueError("the backup is not sound")
        with self.exclusive():
            self.backup(safety)
            self.write(**{name: from_.read(name) for name in from_._pointer()})

    def broken(self) -> DataFrame:
        return integrity({name: self.read(name) for name in TABLES})


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, problem, key): repeated keys, and references to rows that are not there."""
    found = []
    for name, df in tables.items():
        keys = KEYS[name]
        twice = df.groupBy(*keys).count().filter("count > 1")
        found.append(twice.select(F.lit(name).alias("table"), F.lit("repeated key").alias("problem"), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)).alias("key")))
    found += [orphans(tables[t], c, tables[to]).select(F.lit(t).alias("table"), F.lit(f"{c} is not in {to}").alias("problem"), F.col(c).cast("string").alias("key")) for t, c, to in REFERENCES if t in tables and to in tables]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def orphans(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col("id").alias("_p")), F.col(column) == F.col("_p"), "left_anti")


def keep_latest(backups: DataFrame, n: int = 10) -> DataFrame:
    """(name, modified, keep): of listed backups the newest n are kept."""
    newest = backups.orderBy(F.desc("modified"), F.desc("name")).limit(n).select(F.col("name").alias("_name"))
    return backups.join(F.broadcast(newest), F.col("name") == F.col("_name"), "left").withColumn("keep", F.col("_name").isNotNull()).drop("_name")
