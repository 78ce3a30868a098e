"""Versioned tables below one folder, and the log that says which versions count.

    root/<table>/<version>/         files of one version, never changed once written
    root/_progress/<number>.json    tables finished so far, from which a failed run resumes
    root/_published/<number>.json   the tables that readers see

A write goes to a folder of its own, so a failed job leaves the earlier version as it was, and so does a finished one: what
readers see changes with a single new file, and frames opened before keep reading their version until
`drop_unused` removes it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quorica.sources.sinks import read_bucketed

_EXPRESSION_ID = re.compile(r"#\d+L?")
# Inputs without files of which Spark would tell us: rows in memory, and tables inside subqueries.
_UNNAMED_INPUT = re.compile(r"\b(LocalRelation|LogicalRDD|ExternalRDD|Range|\w+-subquery)\b")


@dataclass(frozen=True)
class Entry:
    """One version of one table. `notes` holds what the writer measured on it."""

    version: str
    fingerprint: str | None
    schema: str
    layout: dict
    notes: dict

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class Files:
    """The few file operations Spark's readers and writers don't offer, in whatever file system the folder is."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def listed(self, folder: str) -> list:
        """Status of everything directly below the folder; nothing if there is none."""
        return list(self._fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def names(self, folder: str) -> list[str]:
        return [status.getPath().getName() for status in self.listed(folder)]

    def read(self, name: str) -> str:
        return self._spark.read.text(name, wholetext=True).first()[0]

    def write_once(self, name: str, text: str) -> None:
        """Create a file that appears under its name only when it is complete; an existing one is an error."""
        draft = self.path(f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self.path(name)), options)

    def drop(self, folder: str) -> None:
        self._fs.delete(self.path(folder), True)


class Store:
    """Tables of one folder. One run may write at a time, any number may read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self.files = Files(spark, root)

    def _numbers(self, log: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/{log}") if re.fullmatch(r"\d+\.json", n))

    def _latest(self, log: str) -> dict | None:
        numbers = self._numbers(log)
        return json.loads(self.files.read(f"{self.root}/{log}/{numbers[-1]:012d}.json")) if numbers else None

    def _append(self, log: str, state: dict) -> None:
        number = (self._numbers(log) or [0])[-1] + 1
        self.files.write_once(f"{self.root}/{log}/{number:012d}.json", json.dumps(state, indent=1, sort_keys=True))

    def progress(self) -> dict[str, Entry]:
        """Tables that any run has finished, published or not."""
        state = self._latest("_progress") or {"tables": {}}
        return {name: Entry(**entry) for name, entry in state["tables"].items()}

    def note_progress(self, tables: dict[str, Entry]) -> None:
        self._append("_progress", {"tables": {name: asdict(entry) for name, entry in tables.items()}})

    def published(self) -> tuple[dict, dict[str, Entry]] | None:
        """Scope and tables that readers see; None before the first publication."""
        state = self._latest("_published")
        return state and (state["scope"], {name: Entry(**entry) for name, entry in state["tables"].items()})

    def publish(self, scope: dict, tables: dict[str, Entry]) -> None:
        """Switch readers to these versions, all at once."""
        if self.published() != (scope, tables):
            self._append("_published", {"scope": scope, "tables": {n: asdict(entry) for n, entry in tables.items()}})

    def path_of(self, name: str, version: str) -> str:
        return f"{self.root}/{name}/{version}"

    def is_whole(self, name: str, entry: Entry) -> bool:
        return self.files.exists(f"{self.path_of(name, entry.version)}/_SUCCESS")

    def write(self, name: str, write: Callable[[str], None], fingerprint: str | None, layout: dict) -> Entry:
        """Let `write` fill a new version's folder. Nobody reads it before `publish`."""
        version = uuid.uuid4().hex
        path = self.path_of(name, version)
        write(path)
        return Entry(version, fingerprint, self.spark.read.parquet(path).schema.json(), layout, {})

    def read(self, name: str, entry: Entry) -> DataFrame:
        """One version with the schema it was written with; nothing is inferred from files."""
        if buckets := entry.layout.get("buckets"):
            path = self.path_of(name, entry.version)
            return read_bucketed(self.spark, path, entry.struct, entry.layout["bucket"], buckets)
        return self.spark.read.schema(entry.struct).parquet(self.path_of(name, entry.version))

    def drop_unused(self) -> list[str]:
        """Remove the versions that are neither published nor of the latest run; returns their folders.

        Readers that opened an earlier publication lose their files.
        """
        published = self.published()
        used = {(n, e.version) for tables in (self.progress(), published[1] if published else {}) for n, e in tables.items()}
        gone = [
            self.path_of(name, version)
            for name in self.files.names(self.root)
            if not name.startswith("_")
            for version in self.files.names(f"{self.root}/{name}")
            if (name, version) not in used
        ]
        for folder in gone:
            self.files.drop(folder)
        return gone

    def _status(self, files: list[str]) -> list[list]:
        """Folder, name, length and time of each file, from one listing per folder."""
        folders: dict[str, set[str]] = {}
        for file in files:
            folder, name = file.rsplit("/", 1)
            folders.setdefault(folder, set()).add(name)
        return sorted(
            [folder, status.getPath().getName(), status.getLen(), status.getModificationTime()]
            for folder, names in folders.items()
            for status in Files(self.spark, folder).listed(folder)
            if status.getPath().getName() in names
        )

    def volume(self, *frames: DataFrame) -> int:
        """Bytes of the files the frames read; 0 for frames without files."""
        files = sorted({file for df in frames for file in df.inputFiles()})
        return sum(length for _, _, length, _ in self._status(files))

    def fingerprint(self, df: DataFrame, given: object, input_version: str | None) -> str | None:
        """What a table is made from: the steps of its plan, `given`, and the versions and files it reads.

        None if the plan reads something without files and no `input_version` stands for the data: such a table is
        always written anew.
        """
        plan = _EXPRESSION_ID.sub("", df._jdf.queryExecution().analyzed().toString())
        if input_version is None and _UNNAMED_INPUT.search(plan):
            return None
        versions, outside = set(), []
        inside = re.compile(re.escape(f"{self.files.path(self.root).toUri().getPath()}/") + r"([^/]+/[^/]+)/")
        for file in df.inputFiles():
            if own := inside.search(file):
                versions.add(own.group(1))
            elif input_version is None:
                outside.append(file)
        raw = self._status(outside)
        text = json.dumps([plan, given, input_version, sorted(versions), raw], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()
