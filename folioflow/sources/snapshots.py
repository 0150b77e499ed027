"""A table of rows by owner that is replaced owner by owner, with snapshots: writers commit a manifest, readers keep to
the one they found."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.shared import delete


@dataclass(frozen=True)
class Snapshot:
    """What a manifest names: its number, and of each bucket the layers (writes) that are part of it, oldest first."""

    number: int
    layers: dict[int, tuple[str, ...]]

    def pairs(self) -> list[tuple[int, str, int]]:
        return [(b, layer, i) for b, layers in sorted(self.layers.items()) for i, layer in enumerate(layers)]


class Conflict(Exception):
    """Another writer committed first; what was written is not part of the table."""


class SnapshotTable:
    """Rows named by `owner` in `buckets` by its hash.

    A write is a layer: a folder of rows and one of the owners that it replaces, both by bucket. It becomes part of the
    table when its manifest, the list of all layers of each bucket, is created under the next number; only one writer
    can create it. Manifests are small: buckets times the layers that `compact` leaves. Nothing that a manifest names
    is written again, so a reader sees the whole of its snapshot until `vacuum` drops it.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str = "document_id", buckets: int = 16) -> None:
        self.spark, self.path, self.owner, self.buckets = spark, path.rstrip("/"), owner, buckets

    # manifests, in any store that Spark writes to

    def _store(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def numbers(self) -> list[int]:
        """The numbers of the snapshots that are kept."""
        store, place = self._store("manifests")
        if not store.exists(place):
            return []
        names = [f.getPath().getName() for f in store.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest state or that of a number; an empty one before the first commit."""
        number = number if number is not None else max(self.numbers(), default=0)
        if not number:
            return Snapshot(0, {})
        store, place = self._store(f"manifests/{number:012d}.json")
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream := store.open(place), "UTF-8")
        stream.close()
        return Snapshot(number, {int(b): tuple(v) for b, v in json.loads(text).items()})

    def _commit(self, before: Snapshot, layers: dict[int, tuple[str, ...]]) -> Snapshot:
        """Create the next manifest: whole under a name of its own first, then renamed, which fails if the name is taken."""
        store, draft = self._store(f"manifests/_{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps({str(b): v for b, v in layers.items()}).encode()))
        out.close()
        place = self._store(f"manifests/{before.number + 1:012d}.json")[1]
        if store.exists(place) or not store.rename(draft, place):
            store.delete(draft, False)
            raise Conflict(f"snapshot {before.number + 1} of {self.path} was committed by another writer")
        return Snapshot(before.number + 1, layers)

    # rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.owner), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, owners: DataFrame) -> str:
        """A bucket is a folder; where its rows are many, several tasks write it, each a file of its own."""
        layer = uuid.uuid4().hex
        for kind, df in (("owners", owners), ("rows", rows)):
            df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{kind}/layer={layer}")
        return layer

    def _filled(self, kind: str, layer: str) -> set[int]:
        store, place = self._store(f"{kind}/layer={layer}")
        names = [f.getPath().getName() for f in store.listStatus(place)]
        return {int(n.partition("=")[2]) for n in names if n.startswith("bucket=")}

    def replace(self, rows: DataFrame, owners: DataFrame, on: Snapshot | None = None) -> Snapshot:
        """Owners (a column) get exactly these rows, those without rows none; rows of other owners are an error. `on`
        is the state that the rows were made from: if another write came after it, nothing is changed."""
        before = on or self.snapshot()
        ids = owners.select(self.owner).where(F.col(self.owner).isNotNull()).distinct()
        layer = self._write(rows, ids)
        written = self.spark.read.parquet(f"{self.path}/owners/layer={layer}") if self._filled("owners", layer) else ids.limit(0)
        if self._filled("rows", layer):
            strays = self.spark.read.parquet(f"{self.path}/rows/layer={layer}").join(written.select(self.owner), self.owner, "left_anti")
            if strays.limit(1).count():
                raise ValueError("rows of owners that aren't replaced")
        touched = self._filled("owners", layer)
        return self._commit(before, {b: (*before.layers.get(b, ()), *([layer] if b in touched else [])) for b in {*before.layers, *touched}})

    def _read(self, kind: str, at: Snapshot, pairs: Sequence[tuple[int, str, int]]) -> DataFrame:
        """Rows of (bucket, layer) pairs with the layers' places; folders are named, so nothing else is listed."""
        named = self.spark.createDataFrame(list(pairs), "bucket int, layer string, _place int")
        have = {layer: self._filled(kind, layer) for layer in {layer for _, layer, _ in pairs}}
        paths = [f"{self.path}/{kind}/layer={layer}/bucket={b}" for b, layer, _ in pairs if b in have[layer]]
        found = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return found.join(F.broadcast(named), ["bucket", "layer"])  # as small as the manifest

    def read(self, at: Snapshot | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a snapshot: of each owner those of the last layer that replaced it."""
        at = at or self.snapshot()
        pairs = [p for p in at.pairs() if buckets is None or p[0] in buckets]
        if not any(b in self._filled("rows", layer) for b, layer, _ in pairs):
            raise ValueError("the table has no rows")
        last = self._read("owners", at, pairs).groupBy("bucket", self.owner).agg(F.max("_place").alias("_place"))
        return self._read("rows", at, pairs).join(last, ["bucket", self.owner, "_place"]).drop("bucket", "layer", "_place")

    def compact(self, most: int = 8) -> Snapshot:
        """Buckets of more than `most` layers become one layer each; the others stay as they are."""
        before = self.snapshot()
        long = [b for b, layers in before.layers.items() if len(layers) > most]
        if not long:
            return before
        rows = self.read(before, long)
        layer = self._write(rows, self._read("owners", before, [p for p in before.pairs() if p[0] in long]).select(self.owner).distinct())
        return self._commit(before, before.layers | {b: (layer,) for b in long})

    def vacuum(self, keep: int = 1) -> None:
        """Drop all but the newest `keep` snapshots, and layers that none of these names."""
        numbers = self.numbers()
        kept = [self.snapshot(n) for n in numbers[-keep:]]
        for n in numbers[:-keep]:
            delete(self.spark, f"{self.path}/manifests/{n:012d}.json")
        used = {layer for s in kept for _, layer, _ in s.pairs()}
        for kind in ("rows", "owners"):
            store, place = self._store(kind)
            for f in store.listStatus(place) if store.exists(place) else []:
                name = f.getPath().getName()
                if name.partition("=")[2] not in used:
                    delete(self.spark, f"{self.path}/{kind}/{name}")
