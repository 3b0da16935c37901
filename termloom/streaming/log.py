"""Update logs: adds and deletes of documents, checkpoints, and replay."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.build import Index, index_documents, latest
from ..sources import files

ADD, DELETE = "add", "delete"
EVENTS = "event_id bigint, op string, doc_id bigint, terms array<string>"
#: Folders of one level that are merged into one of the next.
FAN = 8


def state(events: DataFrame, snapshot: DataFrame | None = None, last_event_id: int = 0) -> DataFrame:
    """(doc_id, terms) after a log (event_id, op, doc_id, terms).

    With a snapshot (doc_id, terms) of the state at ``last_event_id`` only later
    events are read.  Of a document's events the last one counts.
    """
    rows = events.select("event_id", "op", "doc_id", "terms")
    if snapshot is not None:
        base = snapshot.select(F.lit(last_event_id).cast("long").alias("event_id"), F.lit(ADD).alias("op"), "doc_id", "terms")
        rows = base.unionByName(rows.where(F.col("event_id") > last_event_id))
    return latest(rows, "doc_id", "event_id").where(F.col("op") == ADD).select("doc_id", "terms")


def replay(events: DataFrame, snapshot: DataFrame | None = None, last_event_id: int = 0, positional: bool = False) -> Index:
    return index_documents(state(events, snapshot, last_event_id), positional)


@dataclass(frozen=True)
class Run:
    """One sorted-out folder of events: the last one of each of its documents."""

    level: int
    path: str
    last_event_id: int


@dataclass(frozen=True)
class LogState:
    """The state of a followed log, in folders by level.

    A batch writes only its own events.  Once a level has FAN folders they become one of the
    next level, so an event is rewritten once a level: on average a logarithm of the number
    of batches times, whatever the size of the state.  ``heads/<batch>`` names the folders that
    count after a batch; the largest is the state, and a batch that runs again after a
    failure writes the same again.  Folders that no head names any more stay until
    :func:`clean`.

    keep: how many event ids a delete is remembered for.  A merge that includes all older
    folders drops deletes older than that; an add that comes later still, with a smaller
    event id than such a delete, would count.  None: for ever.
    """

    spark: SparkSession
    path: str
    keep: int | None = None

    def head(self, before: int | None = None) -> list[Run]:
        """The folders that count (after the batches before one)."""
        done = [int(n) for n in files.names(self.spark, f"{self.path}/heads") if n.isdigit() and files.exists(self.spark, f"{self.path}/heads/{n}/_SUCCESS")]
        done = [n for n in done if before is None or n < before]
        if not done:
            return []
        rows = self.spark.read.text(f"{self.path}/heads/{max(done)}").collect()  # one row
        return [Run(*r) for r in json.loads(rows[0].value)]

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/{r.path}" for r in runs])

    def events(self) -> DataFrame:
        """The last event of each document, deletes too."""
        runs = self.head()
        return latest(self._read(runs), "doc_id", "event_id") if runs else self.spark.createDataFrame([], EVENTS)

    def live(self) -> DataFrame:
        """(doc_id, terms, event_id) of live documents."""
        return self.events().where(F.col("op") == ADD).select("doc_id", "terms", "event_id")

    def index(self, positional: bool = False) -> Index:
        return index_documents(self.live(), positional)

    def _write(self, rows: DataFrame, level: int, name: str) -> Run:
        latest(rows, "doc_id", "event_id").select("event_id", "op", "doc_id", "terms").write.mode("overwrite").parquet(f"{self.path}/{name}")
        last = self.spark.read.schema(EVENTS).parquet(f"{self.path}/{name}").agg(F.max("event_id")).first()[0]
        return Run(level, name, -1 if last is None else last)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Adds the events of a batch (foreachBatch)."""
        runs = [*self.head(batch_id), self._write(batch.select("event_id", "op", "doc_id", "terms"), 0, f"level=0/batch={batch_id}")]
        level = 0
        while len(full := [r for r in runs if r.level == level]) >= FAN:
            oldest = all(r.level <= level for r in runs)
            rows = latest(self._read(full), "doc_id", "event_id")
            if self.keep is not None and oldest:
                rows = rows.where((F.col("op") == ADD) | (F.col("event_id") > max(r.last_event_id for r in runs) - self.keep))
            merged = self._write(rows, level + 1, f"level={level + 1}/batch={batch_id}")
            runs = [r for r in runs if r.level > level] + [merged]
            level += 1
        told = json.dumps([[r.level, r.path, r.last_event_id] for r in runs])
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/heads/{batch_id}")

    def clean(self, readers: int = 2) -> list[str]:
        """Removes folders that none of the last ``readers`` heads names; returns their names.

        A reader of an older head would miss them, so it's for when there are none.
        """
        numbers = sorted(int(n) for n in files.names(self.spark, f"{self.path}/heads") if n.isdigit())[-readers:]
        named = {r.path for n in numbers for r in self.head(n + 1)}
        gone = []
        for level in files.names(self.spark, self.path):
            for batch in files.names(self.spark, f"{self.path}/{level}") if level.startswith("level=") else []:
                if f"{level}/{batch}" not in named:
                    fs, p = files.fs_of(self.spark, f"{self.path}/{level}/{batch}")
                    fs.delete(p, True)
                    gone.append(f"{level}/{batch}")
        return gone


def follow(stream: DataFrame, state_path: str, checkpoint: str, keep: int | None = None) -> StreamingQuery:
    """Keeps the state of a streamed log under ``state_path``, as :class:`LogState` reads it.

    Of a document's events the one with the largest id counts, in whatever batch it comes.
    Bytes written are in proportion to the batches.  Processes what is there, then stops.
    """
    kept = LogState(stream.sparkSession, state_path, keep)
    return stream.writeStream.foreachBatch(kept.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
