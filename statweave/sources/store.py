"""Dataset versions as Parquet tables, and the logs of versions and runs as one JSON file for each commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statweave.operators.cleaning import observed_operations
from statweave.operators.profile import quality_score
from statweave.plans.tables import null_safe
from statweave.result import StatResult
from statweave.sources.files import infer_datetime, with_row_id

LOG_SCHEMA = (
    "seq long, event string, version_from int, version_to int, current int, operation string, params string, note string, "
    "n_rows long, n_cols int, quality_score double, folder string, at timestamp"
)
RUN_SCHEMA = "seq long, run_id string, dataset string, version int, method string, params string, `by` string, statistics string, checks string, validation string, at timestamp"


MADE = ("ingest", "write", "clean")


class VersionStore:
    """Immutable versions of named tables under a shared folder.

    Undo and restore move a pointer in an append-only log; a new version always
    gets the next unused number, so nothing is ever overwritten.  Writers do not
    wait for each other: a commit creates the log file of the next sequence
    number, and a writer that finds it taken reads the log again and takes the
    one after.  The file system must create a file by one writer only, as HDFS
    and local ones do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths and logs --

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _files(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._files(path)
        return fs.exists(p)

    def _read(self, path: str, schema: str) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(path)

    def _publish(self, path: str, content: str) -> bool:
        """Create a file whole; False if another writer has created it."""
        jvm = self.spark._jvm
        fs, target = self._files(path)
        part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(content.encode())
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                # Renaming a local file would replace the other writer's; a link never does.
                files = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, part)]
                jvm.java.nio.file.Files.createLink(*files)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
                how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(fs.makeQualified(part), fs.makeQualified(target), how)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            fs.delete(part, False)
        return True

    def _commit(self, folder: str, schema: str, events: Callable[[], Sequence[dict]]) -> list[dict]:
        """Append events under the next free numbers; ``events`` is asked again after a lost race, to see the log as it then is."""
        while True:
            last = self._read(folder, schema).agg(F.max("seq")).first()[0] or 0
            at = datetime.now(timezone.utc).isoformat()
            rows = [{"seq": last + 1 + i, **e, "at": at} for i, e in enumerate(events())]
            if self._publish(f"{folder}/{last + 1:019d}.json", "".join(json.dumps(r) + "\n" for r in rows)):
                return rows

    def log(self, name: str) -> DataFrame:
        return self._read(self._path(name, "log"), LOG_SCHEMA)

    def _record(self, name: str, events: Callable[[], Sequence[dict]]) -> list[dict]:
        return self._commit(self._path(name, "log"), LOG_SCHEMA, events)

    def _made(self, name: str, version: int):
        """The log row of the write that made a version."""
        row = self.log(name).where((F.col("version_to") == version) & F.col("event").isin(*MADE)).orderBy("seq").first()
        if row is None:
            raise FileNotFoundError(f"Version {version} of '{name}' has no file")
        return row

    # -- versions --

    def _store(self, name: str, df: DataFrame) -> dict:
        """Write rows into a folder of their own, which no version names yet."""
        folder = uuid.uuid4().hex
        path = self._path(name, "data", folder)
        df.write.mode("errorifexists").parquet(path)
        stored = self.spark.read.parquet(path)
        return {"folder": folder, "n_rows": stored.count(), "n_cols": len([c for c in stored.columns if not c.startswith("_row_id")])}

    def _add(self, name: str, stored: dict, note: str, event: str, operations: Sequence[dict] = (), base: int | None = None) -> int:
        """Make stored rows the next version and the current one."""

        def events() -> list[dict]:
            seen = self.log(name).agg(F.max("version_to").alias("v"), F.max_by("current", "seq").alias("c")).first()
            version = (seen["v"] or 0) + 1
            about = {**stored, "version_from": seen["c"] if base is None else base, "version_to": version, "current": version}
            steps = [{**about, "event": "transformation", "operation": op.get("operation"), "params": json.dumps(op, default=str)} for op in operations]
            return [{**about, "event": event, "note": note}, *steps]

        return self._record(name, events)[0]["version_to"]

    def write(self, name: str, df: DataFrame, note: str = "", event: str = "write", operations: Sequence[dict] = ()) -> int:
        """Store the next version and make it current."""
        return self._add(name, self._store(name, df), note, event, operations)

    def ingest(self, name: str, df: DataFrame) -> int:
        """Promote ISO dates, number the rows, write version 1 and note its quality score."""
        version = self.write(name, with_row_id(infer_datetime(df)), "Original ingest", "ingest")
        made = self._made(name, version)
        score = quality_score(self.load(name, version))
        self._record(name, lambda: [{"event": "profile", "version_to": version, "current": self.current(name), "n_rows": made["n_rows"], "n_cols": made["n_cols"], "quality_score": score}])
        return version

    def current(self, name: str) -> int:
        row = self.log(name).orderBy(F.desc("seq")).first()
        if row is None:
            raise FileNotFoundError(f"There is no dataset '{name}'")
        return row["current"]

    def load(self, name: str, version: int | None = None) -> DataFrame:
        version = self.current(name) if version is None else version
        return self.spark.read.parquet(self._path(name, "data", self._made(name, version)["folder"]))

    def clean(self, name: str, operations: Sequence[dict]) -> tuple[int, list[str]]:
        """Apply operations to the current version as one plan and one write, which counts the rows of each step."""
        base = self.current(name)
        df, tell = observed_operations(self.load(name, base), operations)
        stored = self._store(name, df)
        notes = tell()
        return self._add(name, stored, "; ".join(notes), "clean", operations, base), notes

    def _move(self, name: str, event: str, to: Callable[[int], int]) -> int:
        """Make an earlier version the current one; ``to`` finds it from the one that is current."""

        def events() -> list[dict]:
            before = self.current(name)
            version = to(before)
            made = self._made(name, version)
            return [{"event": event, "version_from": before, "current": version, "n_rows": made["n_rows"], "n_cols": made["n_cols"]}]

        return self._record(name, events)[0]["current"]

    def undo(self, name: str) -> int:
        """Go back to the version that the current one was made from."""

        def parent(current: int) -> int:
            version = self._made(name, current)["version_from"]
            if version is None:
                raise ValueError(f"Version {current} is the first of '{name}'.")
            return version

        return self._move(name, "undo", parent)

    def restore(self, name: str, version: int = 1) -> int:
        return self._move(name, "restore", lambda _: int(version))

    def history(self, name: str) -> dict[str, DataFrame]:
        log = self.log(name)
        versions = log.where(F.col("event").isin(*MADE)).select(F.col("version_to").alias("version"), "note", "n_rows", "n_cols", "at").orderBy("version")
        changes = log.where("event = 'transformation'").select("operation", "params", "version_from", "version_to", "at", "seq").orderBy("seq")
        return {"versions": versions, "transformations": changes}

    def drop(self, name: str) -> None:
        """Remove every version and the log of a dataset."""
        if not self._exists(self._path(name)):
            raise FileNotFoundError(f"There is no dataset '{name}'")
        fs, p = self._files(self._path(name))
        fs.delete(p, True)

    # -- runs --

    def record_run(self, dataset: str, version: int, method: str, params: dict, by: Sequence[str], statistics: DataFrame, checks: DataFrame, validation: DataFrame) -> str:
        """Keep a run: its row in the list, and its three tables whole, as Parquet in the run's folder."""
        run_id = uuid.uuid4().hex
        paths = []
        for part, table in (("statistics", statistics), ("checks", checks), ("validation", validation)):
            paths.append(self._path("_run_tables", run_id, part))
            table.write.parquet(paths[-1])
        run = {"run_id": run_id, "dataset": dataset, "version": version, "method": method, "params": json.dumps(params, default=str), "by": json.dumps(list(by))}
        run |= dict(zip(("statistics", "checks", "validation"), paths, strict=True))
        self._commit(self._path("_runs"), RUN_SCHEMA, lambda: [run])
        return run_id

    def list_runs(self, dataset: str | None = None, limit: int | None = 50) -> DataFrame:
        """Recorded runs, newest first, with the folders of their tables."""
        runs = self._read(self._path("_runs"), RUN_SCHEMA)
        if dataset is not None:
            runs = runs.where(F.col("dataset") == dataset)
        runs = runs.orderBy(F.desc("seq"))
        return runs if limit is None else runs.limit(limit)

    def reproduce(self, run_id: str) -> tuple[StatResult, bool]:
        """Run a stored method again on its recorded version; tells whether all statistics agree."""
        from statweave.registry import run_method

        row = self._read(self._path("_runs"), RUN_SCHEMA).where(F.col("run_id") == run_id).first()
        if row is None:
            raise FileNotFoundError(f"There is no run {run_id}")
        by = json.loads(row["by"])
        result = run_method(self.load(row["dataset"], row["version"]), row["method"], json.loads(row["params"]), by)
        return result, same_tables(result.statistics, self.spark.read.parquet(row["statistics"]), by)


def same_tables(a: DataFrame, b: DataFrame, by: Sequence[str] = (), tolerance: float = 1e-9) -> bool:
    """Whether two tables of one row per segment hold the same columns, segments and values; numbers up to a relative tolerance."""
    if a.columns != b.columns or a.count() != b.count():
        return False
    values = [c for c in a.columns if c not in by]
    keys = [*by, "_one"]
    left = a.withColumn("_one", F.lit(1)).select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`") for c in values]).alias("_a"))
    right = b.withColumn("_one", F.lit(1)).select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`") for c in values]).alias("_b"))
    same = F.lit(True)
    for c in values:
        x, y = F.col("_a").getField(c), F.col("_b").getField(c)
        if isinstance(a.schema[c].dataType, (T.DoubleType, T.FloatType)):
            near = F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
            same &= x.eqNullSafe(y) | F.coalesce(near, F.lit(False))
        elif isinstance(a.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
            same &= F.to_json(F.struct(x)).eqNullSafe(F.to_json(F.struct(y)))
        else:
            same &= x.eqNullSafe(y)
    agreeing = null_safe(left, right, keys).where(same).count()
    return agreeing == a.count()
