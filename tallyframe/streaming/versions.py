"""A table of versions that streams append to, with compaction behind a manifest.

Streams write each batch as a folder of its own and never touch another. A compaction folds what is
finished into a base with one row per key, and then publishes a manifest that names the base and the batches in it, by
renaming one small file. A reader takes one manifest and, for as long as its frame lives, that base and the
batches that were there and not in it: it sees one snapshot however many compactions follow, until ``vacuum``
removes what only older manifests name. Reading costs the live rows and the batches since the last compaction.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: files of a base; keys are dealt to them by hash, so a compaction's writes are even
BASE_FILES = 32


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    base: str | None = None
    #: batches that are in the base, relative to the table
    folded: tuple[str, ...] = ()


class VersionedTable:
    """Rows by key in ``path``; ``schema`` is that of the batches, which name their version and writer as folders."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "point_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType([*(f for f in schema if f.name not in ("version", "writer")), T.StructField("version", T.LongType()), T.StructField("writer", T.StringType())])
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- files

    def _at(self, relative: str):
        return self._hadoop.Path(f"{self.path}/{relative}")

    def _names(self, relative: str) -> list[str]:
        at = self._at(relative)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def batches(self) -> list[str]:
        """Batches whose writing is finished."""
        found = [f"{v}/{w}" for v in self._names(".") if v.startswith("version=") for w in self._names(v)]
        return [b for b in found if self._fs.exists(self._at(f"{b}/_SUCCESS"))]

    def manifest(self) -> Manifest:
        """The last published manifest."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifests/{max(numbers)}.json", wholetext=True).first()[0]
        held = json.loads(text)
        return Manifest(held["number"], held["base"], tuple(held["folded"]))

    def _publish(self, manifest: Manifest) -> None:
        """The rename is the switch: before it readers find the old manifest, after it the new one."""
        text = json.dumps({"number": manifest.number, "base": manifest.base, "folded": manifest.folded})
        hidden, shown = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{manifest.number}.json")
        self._fs.mkdirs(self._at("manifests"))
        out = self._fs.create(hidden)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self._fs.exists(shown) or not self._fs.rename(hidden, shown):
            self._fs.delete(hidden, False)
            raise RuntimeError("Another compaction was published first; nothing was switched")

    # ---- reading

    def _batch_rows(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/{b}" for b in batches])

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [f.name for f in self.schema if f.name not in (self.key, "version", "writer")]
        best = rows.groupBy(self.key).agg(F.max(F.struct("version", "writer")).alias("_at"), F.max_by(F.struct(*others), F.struct("version", "writer")).alias("_row"))
        return best.select(self.key, *[F.col(f"_row.{c}").alias(c) for c in others], "_at.version", "_at.writer").select(*self.schema.names)

    def _rows(self, manifest: Manifest, batches: list[str]) -> DataFrame:
        """Newest rows of a base and batches beside it; base rows whose key no batch has pass untouched."""
        fresh = self._batch_rows([b for b in batches if b not in set(manifest.folded)])
        if manifest.base is None:
            return self._newest(fresh)
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/{manifest.base}")
        if set(batches) <= set(manifest.folded):
            return base
        keys = fresh.select(self.key).distinct()
        # a batch may be older than the base, if its run began before one that was folded
        met = self._newest(fresh.unionByName(base.join(keys, self.key, "left_semi")))
        return base.join(keys, self.key, "left_anti").unionByName(met)

    def rows(self) -> DataFrame:
        """The newest version of every key, as of now."""
        return self._rows(self.manifest(), self.batches()).drop("version", "writer")

    # ---- compacting

    def compact(self, files: int = BASE_FILES) -> Manifest:
        """Fold all finished batches into a new base and switch to it; without new batches nothing happens.

        A compaction that fails leaves an unnamed folder and no manifest, so readers notice nothing.
        """
        before, batches = self.manifest(), self.batches()
        if set(batches) <= set(before.folded):
            return before
        base = f"base/{uuid.uuid4().hex}"
        self._rows(before, batches).repartition(files, self.key).sortWithinPartitions(self.key).write.parquet(f"{self.path}/{base}")
        after = Manifest(before.number + 1, base, tuple(batches))
        self._publish(after)
        return after

    def vacuum(self) -> list[str]:
        """Remove what the last manifest does not need: older bases and manifests, and batches that are in its base.

        Readers of older snapshots must be done. A batch that its stream repeats after that counts as new, with its old version.
        """
        now, removed = self.manifest(), []
        if now.base is None:
            return removed
        gone = [b for b in self._names("base") if f"base/{b}" != now.base]
        old = [f"base/{b}" for b in gone] + [b for b in now.folded if self._fs.exists(self._at(b))] + [
            f"manifests/{n}" for n in self._names("manifests") if n != f"{now.number}.json" and not n.startswith(".")]
        for relative in old:
            self._fs.delete(self._at(relative), True)
            removed.append(relative)
        return removed
