"""A landing zone of match files as a Spark data source, for batch and streaming reads.

Files lie as ``<root>/<competition>/<season>/<match>/<kind>.json``, each a JSON array of
records (``events``, ``line_ups``) or one record (``match``). A partition is a match; filters
on competition, season and match_id choose matches before a file is opened. Records come as
JSON text, which ``records`` parses with an explicit schema.

Workers open files through Arrow's file systems, so the root may be a path or a URI that
these know.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

NAME = "matchgrid_landing"
KINDS = ("events", "line_ups", "match")
SCHEMA = "competition string, season string, match_id string, position int, record string"
_KEYS = ("competition", "season", "match_id")


@dataclass
class MatchFile(InputPartition):
    """One match's file of a kind."""

    path: str
    competition: str
    season: str
    match_id: str


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _landed(root: str, kind: str, wanted: dict[str, set[str]] | None = None) -> list[tuple[int, MatchFile]]:
    """(time of arrival, file) of the matches that are wanted, by time and path; folders that are not wanted are not listed."""
    store, top = _open(root)
    wanted = wanted or {}
    found: list[tuple[int, MatchFile]] = []

    def walk(folder: str, names: tuple[str, ...]) -> None:
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if len(names) < 3:
                allowed = wanted.get(_KEYS[len(names)])
                if info.type == fs.FileType.Directory and (allowed is None or info.base_name in allowed):
                    walk(info.path, (*names, info.base_name))
            elif info.base_name == f"{kind}.json":
                found.append((info.mtime_ns, MatchFile(info.path, *names)))

    walk(top.rstrip("/"), ())
    return sorted(found, key=lambda x: (x[0], x[1].path))


def _records(root: str, part: MatchFile) -> Iterator[tuple]:
    store, _ = _open(root)
    with store.open_input_stream(part.path) as f:
        found = json.loads(f.read())
    for i, record in enumerate(found if isinstance(found, list) else [found]):
        yield part.competition, part.season, part.match_id, i, json.dumps(record)


class LandingZone(DataSource):
    """Options: ``path``, and ``kind``, one of ``KINDS``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[str, str]:
        root, kind = self.options.get("path"), self.options.get("kind", "events")
        if not root or kind not in KINDS:
            raise ValueError(f"a landing zone needs a path and a kind of {KINDS}")
        return root, kind

    def reader(self, schema) -> LandingReader:
        return LandingReader(*self._where())

    def streamReader(self, schema) -> LandingStream:
        return LandingStream(*self._where())


class LandingReader(DataSourceReader):
    def __init__(self, root: str, kind: str):
        self.root, self.kind = root, kind
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in _KEYS:
                values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[MatchFile]:
        return [part for _, part in _landed(self.root, self.kind, self.wanted)]

    def read(self, partition: MatchFile) -> Iterator[tuple]:
        if partition is not None:
            yield from _records(self.root, partition)


class LandingStream(DataSourceStreamReader):
    """An offset is the last file's time and path; files must be moved in whole, with the time of their arrival."""

    def __init__(self, root: str, kind: str):
        self.root, self.kind = root, kind

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        landed = _landed(self.root, self.kind)
        return {"time": landed[-1][0], "path": landed[-1][1].path} if landed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[MatchFile]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return [part for time, part in _landed(self.root, self.kind) if low < (time, part.path) <= high]

    def read(self, partition: MatchFile) -> Iterator[tuple]:
        yield from _records(self.root, partition)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandingZone)


def landed(spark: SparkSession, path: str, kind: str = "events", stream: bool = False) -> DataFrame:
    """The raw records of a landing zone, columns as ``SCHEMA``."""
    register(spark)
    return (spark.readStream if stream else spark.read).format(NAME).option("path", path).option("kind", kind).load()


def records(raw: DataFrame, schema: str) -> DataFrame:
    """``landed`` records parsed by ``schema``: its columns after competition, season, match_id and position; a damaged record has nulls."""
    return raw.select(*_KEYS, "position", F.from_json("record", schema).alias("r")).select(*_KEYS, "position", "r.*")
