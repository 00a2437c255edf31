"""Structured Streaming forms of ingest, event windows and ratings (extensions of the batch operators)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from matchgrid.operators import tables
from matchgrid.operators.merge import missing_rows
from matchgrid.operators.ratings import START, change_of


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_absent(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append rows whose keys the Parquet table lacks, one a key, the first by its other columns; a batch that is run again adds nothing.

    One query may write the table: two at once could both add a key.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [F.col(c).asc_nulls_last() for c in batch.columns if c not in keys]
        first = W.partitionBy(*keys).orderBy(*(rest or keys))
        new = batch.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            new = missing_rows(new, spark.read.parquet(path), keys)
        new.write.mode("append").parquet(path)

    return run


def ingest_into(path: str, name: str, rules: dict[str, Column] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: upsert each batch into a table made by ``tables.create``; of rows with one key in a batch the largest by its other columns counts.

    Only the buckets that a batch falls in are read and written. The table's log knows the
    batches of the stream ``name``, so one that is run again adds nothing, and several
    streams may write the table.
    """

    def run(batch: DataFrame, number: int) -> None:
        keys = tables.versions(batch.sparkSession, path)[0]["keys"]
        rest = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else batch.distinct()
        tables.upsert_into(one, path, rules, batch=f"{name}-{number}")

    return run


def event_windows(events: DataFrame, time: str, keys: list[str], made: list[Column], width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by keys and tumbling or sliding windows, rows up to ``late`` behind counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(*made)


def sessions(events: DataFrame, time: str, keys: list[str], made: list[Column], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*made)


def rolling_elo(matches: DataFrame, component: str, order: str, home: str = "home", away: str = "away", hg: str = "hg", ag: str = "ag") -> DataFrame:
    """(component, order, home, away, elo_home, elo_away) before each match, ratings kept as state by component.

    Matches of a batch are folded in order; a match that comes in a later batch than a
    newer one is folded on arrival. ``ordered_elo`` waits for them.
    """
    kinds = dict(matches.dtypes)
    output = f"{component} {kinds[component]}, {order} {kinds[order]}, {home} string, {away} string, elo_home double, elo_away double"

    def fold(key, frames, state: GroupState):
        rating = dict(zip(*state.get)) if state.exists else {}
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows = []
        for at, h, a, x, y in zip(pdf[order], pdf[home], pdf[away], pdf[hg], pdf[ag]):
            rh, ra = rating.get(h, START), rating.get(a, START)
            change = change_of(rh, ra, x, y)
            rating[h], rating[a] = rh + change, ra - change
            rows.append((key[0], at, h, a, rh, ra))
        state.update((list(rating), list(rating.values())))
        yield pd.DataFrame(rows, columns=[component, order, home, away, "elo_home", "elo_away"])

    return matches.groupBy(component).applyInPandasWithState(fold, output, "teams array<string>, elos array<double>", "append", GroupStateTimeout.NoTimeout)


class OrderedElo(StatefulProcessor):
    """Holds a component's matches until the watermark has passed them, and folds them in order then."""

    def __init__(self, waiting: StructType, names: tuple[str, str, str, str, str], output: list[str]):
        self.waiting_schema, self.names, self.output = waiting, names, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState("ratings", "team string", "elo double", None)
        self.waiting = handle.getListState("waiting", self.waiting_schema, None)

    def handleInputRows(self, key, rows, timerValues):
        order = self.names[0]
        for pdf in rows:
            pdf = pdf[[f.name for f in self.waiting_schema]]
            self.waiting.appendList([tuple(r) for r in pdf.astype(object).itertuples(index=False)])
            for at in pdf[order].unique():
                self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The first timer that fires folds all that the watermark has passed; the others find nothing left of it."""
        order, home, away, hg, ag = self.names
        at = [f.name for f in self.waiting_schema].index
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if _naive(r[at(order)]) <= passed), key=lambda r: (_naive(r[at(order)]), r[at(home)], r[at(away)]))
        if not due:
            return
        rest = [r for r in held if _naive(r[at(order)]) > passed]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        out = []
        for r in due:
            h, a = r[at(home)], r[at(away)]
            before = [self.ratings.getValue((t,))[0] if self.ratings.containsKey((t,)) else START for t in (h, a)]
            change = change_of(*before, r[at(hg)], r[at(ag)])
            for team, elo in ((h, before[0] + change), (a, before[1] - change)):
                self.ratings.updateValue((team,), (elo,))
            out.append((*key, _naive(r[at(order)]), h, a, *before))
        yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass


def _naive(at) -> pd.Timestamp:
    at = pd.Timestamp(at)
    return at.tz_localize(None) if at.tzinfo is None else at.tz_convert("UTC").tz_localize(None)


def ordered_elo(matches: DataFrame, component: str, order: str, late: str = "1 day", home: str = "home", away: str = "away", hg: str = "hg", ag: str = "ag") -> DataFrame:
    """(component, order, home, away, elo_home, elo_away) before each match, as the batch fold gives them, whatever order matches arrive in within ``late``.

    Ratings and waiting matches are keyed state; a timer for each match's time (a timestamp)
    fires once the watermark has passed it. Matches of one time fold by home and away team.
    Later ones than the watermark allows are dropped. Needs the RocksDB state store and a session in UTC.
    """
    kinds = dict(matches.dtypes)
    names = (order, home, away, hg, ag)
    waiting = matches.select(*names).schema
    output = f"{component} {kinds[component]}, {order} {kinds[order]}, {home} string, {away} string, elo_home double, elo_away double"
    processor = OrderedElo(waiting, names, [component, order, home, away, "elo_home", "elo_away"])
    held = matches.select(component, *names).withWatermark(order, late).groupBy(component)
    return held.transformWithStateInPandas(processor, output, "append", "eventTime")
