"""Tables that are published by a manifest.

Rows are written to a folder of their own first; a table's content is the list of
folders in its newest manifest, and writing that manifest is the commit.  So readers
see a load whole or not at all, a failed or refused load leaves the table as it was,
and a retried batch (a batch id that the table holds already) changes nothing.

* ``AppendTable``: each batch adds a folder.
* ``KeyedTable``: rows are dealt to buckets by a hash of their key; an upsert writes
  the buckets that hold its keys anew and takes the others over as they are.

One writer at a time, as Structured Streaming grants; manifests and folders that the
last ``KEEP`` versions do not name are deleted after a commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEEP = 2  # versions whose rows stay readable
BUCKET = "_bucket"


class _Published:
    """A folder with ``data`` and ``manifest``; a manifest is a JSON text of the
    table's folders in order, each with its batch or bucket."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/manifest") if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        versions = self.versions()
        return self._manifest(versions[-1]) if versions else {"folders": [], "batch": None}

    def _new_folder(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def _commit(self, manifest: dict) -> None:
        versions = self.versions()
        version = versions[-1] + 1 if versions else 0
        name = f"{self.root}/manifest/{version:012d}"
        out = self._fs.create(self._path(f"{name}.tmp"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{name}.tmp"), self._path(f"{name}.json")):
            raise RuntimeError(f"version {version} of {self.root} was committed by another writer")
        self._drop_old([*versions, version])

    def _drop_old(self, versions: list[int]) -> None:
        for v in versions[:-KEEP]:
            self._fs.delete(self._path(f"{self.root}/manifest/{v:012d}.json"), False)
        named = {f["path"].split("/")[0] for v in versions[-KEEP:] for f in self._manifest(v)["folders"]}
        for n in self._names(f"{self.root}/data"):
            if n not in named:
                self._fs.delete(self._path(f"{self.root}/data/{n}"), True)

    def paths(self) -> list[str]:
        return [f"{self.root}/data/{f['path']}" for f in self.current()["folders"]]

    def read(self) -> DataFrame:
        return self._rows(self.paths())

    def _rows(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _has(self, batch: int | str | None) -> bool:
        return batch is not None and any(f.get("batch") == batch for f in self.current()["folders"])


class AppendTable(_Published):
    """Batches of rows one after the other."""

    def append(self, rows: DataFrame, batch: int | str | None = None, key: Sequence[str] = ()) -> int:
        """Add ``rows`` as one batch; the number of rows, 0 for a batch that the table
        holds already.  ``key``: columns that must be unique within the batch (K07).
        Rows and the most repeats of a key are counted in the pass that writes them;
        what breaks the rule, or a cell that cannot be cast, publishes nothing."""
        if self._has(batch):
            return 0
        folder = self._new_folder()
        seen = Observation("landed")
        names = [f.name for f in self.schema.fields]
        landed = rows.select(*names)
        if key:
            from pyspark.sql import Window

            landed = landed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
            landed = landed.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("_n").alias("most")).drop("_n")
        else:
            landed = landed.observe(seen, F.count(F.lit(1)).alias("rows"))
        try:
            landed.write.parquet(folder)
            counts = seen.get
            if key and (counts["most"] or 0) > 1:
                raise ValueError(f"duplicate key {tuple(key)} in the batch for {self.root}")
        except Exception:
            self._fs.delete(self._path(folder), True)
            raise
        now = self.current()
        self._commit({"folders": [*now["folders"], {"path": folder.rsplit("/", 1)[1], "batch": batch}], "batch": batch})
        return int(counts["rows"])


class KeyedTable(_Published):
    """One row per key, in ``buckets`` folders by a hash of the key.  NULL is a
    key like any other."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, key: Sequence[str], buckets: int = 32):
        super().__init__(spark, root, schema)
        self.key, self.buckets = list(key), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows by bucket in a new folder; the buckets that have any."""
        folder = self._new_folder()
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return folder, sorted(int(n.split("=")[1]) for n in self._names(folder) if n.startswith(f"{BUCKET}="))

    def upsert(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Replace or add ``rows`` (one per key); the buckets that were written.  A
        batch no higher than the last one committed was applied before: nothing is
        done."""
        now = self.current()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return []
        names = [f.name for f in self.schema.fields]
        staged, touched = self._write(rows.select(*names))
        if not touched:
            self._commit(now | {"batch": batch if batch is not None else now["batch"]})
            return []
        old = [f for f in now["folders"] if f["bucket"] in touched]
        if old:
            new = self._rows([f"{staged}/{BUCKET}={b}" for b in touched])
            stored = self._rows([f"{self.root}/data/{f['path']}" for f in old])
            keys = new.select(*[F.col(k).alias(f"_new_{k}") for k in self.key])
            same = F.lit(True)
            for k in self.key:
                same = same & stored[k].eqNullSafe(keys[f"_new_{k}"])
            folder, _ = self._write(stored.join(keys, same, "left_anti").unionByName(new))
        else:
            folder = staged
        name = folder.rsplit("/", 1)[1]
        kept = [f for f in now["folders"] if f["bucket"] not in touched]
        written = [{"path": f"{name}/{BUCKET}={b}", "bucket": b} for b in touched]
        self._commit({"folders": sorted(kept + written, key=lambda f: f["bucket"]), "batch": batch if batch is not None else now["batch"]})
        return touched

    def glob(self) -> str:
        """The current version as one path pattern."""
        paths = [f["path"] for f in self.current()["folders"]]
        return f"{self.root}/data/{{{','.join(paths)}}}"
