"""Tables that grow by whole batches, and a log whose entries are claimed one at a time, in the folder that all executors share.

Rows are written first, by all executors, where no reader looks. A small entry file that names them then makes them visible, all tables
of a batch at once. Entries are made under another name and renamed, so nobody sees half of one, and a run that dies leaves only rows
that no entry names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.relational import number_events, number_many_events

#: Fixed value: how often an append is tried before it gives up.
TRIES = 5
EVENT = "job_id long, type string, payload string, seq long"


class Conflict(RuntimeError):
    """Somebody else was first, every time."""


@dataclass
class Folder:
    """A folder on any file system that Spark reads."""

    spark: SparkSession
    path: str
    _fs: Any = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._fs = self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """The entries, sorted; none if the folder isn't there."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if not n.startswith("."))

    def read(self, name: str) -> dict[str, Any]:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _draft(self, content: dict[str, Any]) -> str:
        name = f".draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return name

    def put(self, name: str, content: dict[str, Any]) -> None:
        """Makes the entry, or replaces it whole."""
        draft, hadoop = self._draft(content), self.spark._jvm.org.apache.hadoop.fs
        whole = self._fs.makeQualified(self._at(""))
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(hadoop.Path(whole, draft), hadoop.Path(whole, name), how)

    def claim(self, name: str, content: dict[str, Any]) -> bool:
        """Makes the entry unless there is one of the name already; of several who try at once, one gets it."""
        draft = self._draft(content)
        try:
            if self._fs.getScheme() == "file":  # where renaming would replace a file, a hard link doesn't
                here = unquote(urlparse(self.path).path)
                os.link(f"{here}/{draft}", f"{here}/{name}")
                return True
            return bool(self._fs.rename(self._at(draft), self._at(name)))
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._at(draft), False)

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass
class Batches:
    """Tables of a job, written in batches; sending a batch again replaces it.

    root/rows/BATCH-x/TABLE holds a batch's rows, root/done/BATCH names them and has their numbers. A batch should be what a
    cluster works on for minutes: readers list one folder for each.
    """

    spark: SparkSession
    root: str

    @property
    def done(self) -> Folder:
        return Folder(self.spark, f"{self.root}/done")

    def insert(self, batch: str, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Writes all tables of a batch, then makes them visible at once; returns the numbers of rows."""
        at, rows = f"{batch}-{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            path = f"{self.root}/rows/{at}/{name}"
            df.write.parquet(path)
            rows[name] = self.spark.read.parquet(path).count()
        old = self.done.read(batch)["at"] if batch in self.done.names() else None
        self.done.put(batch, {"at": at, "rows": rows})
        if old:
            Folder(self.spark, f"{self.root}/rows").drop(old)
        return rows

    def manifest(self) -> DataFrame:
        """batch, table, rows of the batches that are there."""
        done = self.done
        found = [(b, t, n) for b in done.names() for t, n in done.read(b)["rows"].items()]
        return self.spark.createDataFrame(found, "batch string, table string, rows long")

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """All rows of a table, with their batch. Without any batch the schema is needed."""
        done = self.done
        parts = {b: f"{self.root}/rows/{e['at']}/{name}" for b, e in ((b, done.read(b)) for b in done.names()) if name in e["rows"]}
        if not parts:
            if schema is None:
                raise ValueError(f"no batch has the table {name}")
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
        df = self.spark.read.parquet(*parts.values())
        return df.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/rows/(.*)-[0-9a-f]{32}/", 1))


@dataclass
class EventLog:
    """Events of jobs, numbered per job from 1 without gaps, whoever writes.

    A commit holds any number of events of any jobs. Its rows are numbered after those of all commits before it and written; then the
    next number in the log is claimed. Who finds it taken numbers again, after the commit that was first, TRIES times at most. Each
    commit also keeps the last number of each of its jobs, so that no append reads the events themselves.
    """

    spark: SparkSession
    root: str

    @property
    def log(self) -> Folder:
        return Folder(self.spark, f"{self.root}/log")

    def _commits(self) -> list[dict[str, Any]]:
        log = self.log
        return [log.read(n) for n in log.names()]

    def _read(self, part: str, commits: list[dict[str, Any]], schema: str) -> DataFrame:
        paths = [f"{self.root}/{part}/{c['at']}" for c in commits]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def events(self, kinds: tuple[str, ...] = ()) -> DataFrame:
        """job_id, type, payload, seq; of some kinds only, from the commits that have any."""
        return self._events(self._commits(), kinds)

    def _events(self, commits: list[dict[str, Any]], kinds: tuple[str, ...]) -> DataFrame:
        if not kinds:
            return self._read("rows", commits, EVENT)
        return self._read("rows", [c for c in commits if set(c["kinds"]) & set(kinds)], EVENT).where(F.col("type").isin(*kinds))

    def tags(self) -> set[str]:
        return {c["tag"] for c in self._commits() if c["tag"]}

    def append(self, events: DataFrame, order: list[str], kinds: tuple[str, ...], tag: str | None = None, before: Callable[[], None] | None = None, few: bool = False) -> int | None:
        """Appends events (job_id, type, payload and the columns of order) of the kinds named; returns the commit's number.

        A tag is committed once only: None comes back if it is there already. before is called between numbering and claiming. few says
        that a job has a handful of them, which one task may number.
        """
        return self.append_when(lambda known: events, order, kinds, tag, before, few)

    def append_when(self, made: Callable[[Callable[..., DataFrame]], DataFrame], order: list[str], kinds: tuple[str, ...], tag: str | None = None, before: Callable[[], None] | None = None, few: bool = False) -> int | None:
        """As append, with events made anew at each try: made gets a function that returns the log's events of some kinds as they are."""
        for _ in range(TRIES):
            commits = self._commits()
            if tag is not None and any(c["tag"] == tag for c in commits):
                return None
            ends, at = self._read("ends", commits, "job_id long, seq long"), uuid.uuid4().hex
            new = made(lambda *wanted, seen=commits: self._events(seen, wanted))
            (number_events if few else number_many_events)(ends, new, order).select("job_id", "type", "payload", F.col("seq").cast("long")).write.parquet(f"{self.root}/rows/{at}")
            rows = self.spark.read.schema(EVENT).parquet(f"{self.root}/rows/{at}")
            rows.groupBy("job_id").agg(F.max("seq").alias("seq")).write.parquet(f"{self.root}/ends/{at}")
            if before:
                before()
            if self.log.claim(f"{len(commits):012d}", {"at": at, "tag": tag, "kinds": list(kinds)}):
                return len(commits)
            for part in ("rows", "ends"):
                Folder(self.spark, f"{self.root}/{part}").drop(at)
        raise Conflict(f"the log was written by others {TRIES} times in a row")
