"""Bucketed tables that grow by layers, and the manifest that says which layers count."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerlane.workspace import catalogued, children, filesystem, remove


class Manifest:
    """The state of a store under ``path``, in numbered files that are never changed: the newest one counts.

    A file is written under another name and then renamed, so one that bears a number is whole; a driver that dies at
    any moment leaves the former state or the new one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/manifest"

    def _numbered(self) -> list[tuple[int, str]]:
        names = [(p.rsplit("/", 1)[-1], p) for p in children(self.spark, self.path)]
        return sorted((int(n.removesuffix(".json")), p) for n, p in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def read(self) -> dict | None:
        found = self._numbered()
        return json.loads(self.spark.read.text(found[-1][1], wholetext=True).first()[0]) if found else None

    def write(self, state: dict) -> None:
        found = self._numbered()
        fs, new = filesystem(self.spark, f"{self.path}/new-{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        number = found[-1][0] + 1 if found else 0
        _, target = filesystem(self.spark, f"{self.path}/{number:012d}.json")
        if not fs.rename(new, target):
            raise RuntimeError(f"{target} was written by another driver")
        for _, p in found[:-1]:  # the former one stays for a reader that has just listed it
            remove(self.spark, p)


class LayeredTable:
    """Rows in ``buckets`` by a hash of ``by``, sorted by it, in layers of which each is one write.

    Layers are folders below ``path``; the caller keeps their list (name and rows, oldest first) in a manifest. Adding
    rows writes one more layer and reads nothing. All layers are scanned bucket by bucket, so an aggregate or a join by ``by``
    moves no held row. ``fold`` makes one layer of several (``FAN`` at least) where that is due.
    """

    FAN = 4

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, by: list[str], buckets: int):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), by, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, df: DataFrame, placed: bool = False) -> list:
        """A new layer, not yet part of any list: [name, rows]. ``placed`` rows are partitioned by a hash of ``by`` already."""
        name, table = uuid.uuid4().hex[:16], f"wickerlane_{uuid.uuid4().hex[:16]}"
        rows = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields])
        if not placed:
            rows = rows.repartition(self.buckets, *[F.col(f"`{c}`") for c in self.by])
        rows.write.format("parquet").bucketBy(self.buckets, *self.by).sortBy(*self.by).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the catalog's entry only; the files stay
        return [name, self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").count()]

    def read(self, layers: list) -> DataFrame:
        """The rows of the layers with ``layer``, their place in the list."""
        if not layers:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("layer", T.IntegerType())]))
        name = catalogued(self.spark, f"wickerlane_{uuid.uuid4().hex[:16]}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        by = ", ".join(f"`{c}`" for c in self.by)
        self.spark.sql(f"CREATE TABLE {name} ({columns}, layer int) USING parquet PARTITIONED BY (layer) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        parts = " ".join(f"PARTITION (layer={i}) LOCATION '{self.path}/{layer}'" for i, (layer, _) in enumerate(layers))
        self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return self.spark.table(name)

    @staticmethod
    def due(layers: list) -> int:
        """From which place on the layers should be folded into one: each layer is to hold over twice what lies above it.

        With ``FAN`` layers in between there are at most about FAN times log2 of the rows, and a row is written again about
        log2 times.
        """
        i, above = len(layers) - 1, layers[-1][1] if layers else 0
        while i > 0 and layers[i - 1][1] <= 2 * above:
            i -= 1
            above += layers[i][1]
        return i

    def fold(self, layers: list, folded) -> list:
        """The list with its upper layers folded by ``folded`` (a function from rows with ``layer`` to rows), if that is due."""
        i = self.due(layers)
        if len(layers) - i < self.FAN:
            return layers
        return [*layers[:i], self.write(folded(self.read(layers[i:])), placed=True)]

    def drop(self, layers: list) -> None:
        for name, _ in layers:
            remove(self.spark, f"{self.path}/{name}")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the highest ``layer``."""
    rest = [c for c in rows.columns if c not in (*keys, "layer")]
    names = [F.col(f"`{k}`") for k in keys]
    one = rows.groupBy(*names).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "layer").alias("newest_"))
    return one.select(*names, *[F.col(f"newest_.`{c}`") for c in rest])


class UpsertedTable:
    """Rows by unique ``keys``, bucketed by ``by``, brought up to date by batches that say the whole new row of a key.

    Batches of one source are numbered; one that was applied before is left out. Opening the same path again goes on.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], by: list[str] | None = None, buckets: int | None = None):
        self.keys, self.manifest = keys, Manifest(spark, path)
        self.state = self.manifest.read() or {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "layers": [], "applied": {}}
        self.table = LayeredTable(spark, f"{path.rstrip('/')}/layers", schema, by or keys, self.state["buckets"])

    def upsert(self, changes: DataFrame, source: str = "", number: int | None = None) -> bool:
        """Add a layer with the rows of ``changes``; false if this batch of the source was applied before."""
        done = self.state["applied"].get(source)
        if number is not None and done is not None and number <= done:
            return False
        layer = self.table.write(changes)
        layers = [*self.state["layers"], layer] if layer[1] else self.state["layers"]
        folded = self.table.fold(layers, lambda rows: newest(rows, self.keys))
        before = self.state["layers"]
        state = self.state | {"layers": folded, "applied": self.state["applied"] | ({} if number is None else {source: number})}
        self.manifest.write(state)
        self.state = state
        self.table.drop([x for x in [*before, layer] if x not in folded])
        return True

    def read(self) -> DataFrame:
        rows = self.table.read(self.state["layers"])
        return newest(rows, self.keys) if len(self.state["layers"]) > 1 else rows.drop("layer")
