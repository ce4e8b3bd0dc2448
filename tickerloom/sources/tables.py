"""Tables kept as files that a manifest names.

A commit writes its rows to a folder of its own, split by a partition column, and then puts one new manifest in place: a small
file that lists every partition's folders and the batches applied so far. Putting it in place fails if another commit took that
number. Readers follow the newest manifest, so they never see files of a batch that failed or is still being written, and a
batch that comes again is known by its id and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class WrittenTable:
    """A table under a folder, partitioned by the text of a column expression."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, part: Column):
        self.spark, self.folder, self.schema, self.part = spark, folder.rstrip("/"), schema, part.cast("string")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, inner: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{inner}".rstrip("/"))

    def _names(self, inner: str) -> list[str]:
        at = self._path(inner)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _manifest(self) -> tuple[int, dict]:
        versions = sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))
        if not versions:
            return 0, {"batches": [], "parts": {}}
        stream = self._fs.open(self._path(f"manifests/{versions[-1]:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return versions[-1], json.loads(text)

    def _publish(self, version: int, manifest: dict) -> None:
        waiting = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(waiting, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri() if waiting.toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context.rename(self._fs.makeQualified(waiting), self._fs.makeQualified(self._path(f"manifests/{version:012d}.json")), options)

    def applied(self, batch: str) -> bool:
        return batch in self._manifest()[1]["batches"]

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """All rows, or those of some partitions; an absent table is empty."""
        held = self._manifest()[1]["parts"]
        folders = [f"{self.folder}/data/{at}" for part in (held if parts is None else parts) for at in held.get(part, [])]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _commit(self, batch: str, rows: DataFrame, replaced: list[str] | None) -> bool:
        version, manifest = self._manifest()
        if batch in manifest["batches"]:
            return False
        at = uuid.uuid4().hex
        rows.select(*self.schema.names, self.part.alias(PART)).repartition(PART).write.partitionBy(PART).parquet(f"{self.folder}/data/{at}")
        for part in replaced or []:
            manifest["parts"].pop(part, None)
        for name in self._names(f"data/{at}"):
            if name.startswith(f"{PART}="):
                manifest["parts"].setdefault(name.removeprefix(f"{PART}="), []).append(f"{at}/{name}")
        manifest["batches"].append(batch)
        self._publish(version + 1, manifest)
        return True

    def append(self, batch: str, rows: DataFrame) -> bool:
        """Add rows; False if the batch was applied before."""
        return self._commit(batch, rows, None)

    def merge(self, batch: str, arrivals: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the partitions that the arrivals touch by ``step(their rows, arrivals)``; all others stay as they are.

        The touched partitions' names are collected: a partition column has few values by its nature.
        """
        if self.applied(batch):
            return False
        touched = [r[0] for r in arrivals.select(self.part).distinct().collect()]
        return self._commit(batch, step(self.read(touched), arrivals), touched)


def hashed(keys: list[str], parts: int = 16) -> Column:
    """Partition of a row by its keys, for tables without a natural one."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts))
