"""The lake: Parquet layers, views by folder name, immutable artifacts with checksums, JSON-lines logs."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType().add("path", "string").add("sha256", "string").add("bytes", "long").add("source", "string").add("dataset", "string").add("url", "string").add("ingest_date", "string").add("retired", "boolean").add("reason", "string").add("seq", "long")


class NotBuilt(FileNotFoundError):
    """A dataset that has not been written yet."""


class Lake:
    """A root folder on any file system that Spark reads, with silver and gold tables, bronze artifacts and a manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ------------------------------------------------------------------------------------------------------

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        return self._path(p).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, layer: str, dataset: str) -> bool:
        p = f"{self.root}/{layer}/{dataset}"
        return self._fs(p).exists(self._path(p))

    def _folders(self, top: str) -> list[str]:
        """Dataset folders below a layer: those that hold Parquet files."""
        fs, found, todo = self._fs(top), [], [top]
        while todo:
            here = todo.pop()
            if not fs.exists(self._path(here)):
                continue
            items = list(fs.listStatus(self._path(here)))
            names = [s.getPath().getName() for s in items]
            if any(n.endswith(".parquet") and not s.isDirectory() for n, s in zip(names, items, strict=True)):
                found.append(here)
                continue
            todo += [f"{here}/{n}" for n, s in zip(names, items, strict=True) if s.isDirectory() and n[:1] not in "_."]
        return sorted(found)

    # -- tables -----------------------------------------------------------------------------------------------------

    def write(self, df: DataFrame, layer: str, dataset: str, *by: str) -> str:
        """Overwrite a table (zstd), partitioned by columns if given; its path."""
        path = f"{self.root}/{layer}/{dataset}"
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*by) if by else w).parquet(path)
        return path

    def read(self, layer: str, dataset: str, schema: T.StructType | None = None) -> DataFrame:
        if not self.exists(layer, dataset):
            raise NotBuilt(f"{layer}/{dataset} is not built yet")
        r = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return r.parquet(f"{self.root}/{layer}/{dataset}")

    def views(self) -> dict[str, str]:
        """View names and paths: the last folder's name, with gold_ in front for gold; where two would share a name, the
        first keeps it and the others take their whole path."""
        out: dict[str, str] = {}
        for layer in ("silver", "gold"):
            for path in self._folders(f"{self.root}/{layer}"):
                rel = path.removeprefix(f"{self.root}/{layer}/")
                name = ("gold_" if layer == "gold" else "") + rel.split("/")[-1]
                if name in out:
                    name = ("gold_" if layer == "gold" else "") + rel.replace("/", "_")
                out[name] = path
        return out

    def register(self) -> list[str]:
        """Create the views; their names."""
        views = self.views()
        for name, path in views.items():
            self.spark.read.parquet(path).createOrReplaceTempView(name)
        return list(views)

    def catalog(self) -> DataFrame:
        """name, rows (-1 where a table cannot be read), path."""
        rows = []
        for name, path in self.views().items():
            try:
                n = self.spark.read.parquet(path).count()
            except Exception:  # noqa: BLE001
                n = -1
            rows.append((name, n, path))
        return self.spark.createDataFrame(rows, "name string, rows long, path string").orderBy("name")

    def query(self, sql: str, limit: int = 1000) -> DataFrame:
        self.register()
        return self.spark.sql(sql).limit(limit)

    # -- artifacts --------------------------------------------------------------------------------------------------

    def _manifest(self) -> str:
        return f"{self.root}/manifest"

    def _append(self, record: dict) -> None:
        row = {f.name: record.get(f.name) for f in MANIFEST.fields}
        self.spark.createDataFrame([tuple(row.values())], MANIFEST).coalesce(1).write.mode("append").json(self._manifest())

    def _next(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]

    def manifest(self) -> DataFrame:
        """All manifest records; unreadable lines are left out."""
        if not self._fs(self._manifest()).exists(self._path(self._manifest())):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(self._manifest())

    def write_bronze(self, source: str, dataset: str, filename: str, content: bytes, url: str = "", ingest_date: str | None = None, layer: str = "bronze") -> str:
        """Write bytes once, with a record in the manifest. Equal content again changes nothing; other content at the
        same place is an error."""
        when = ingest_date or datetime.datetime.now(datetime.UTC).date().isoformat()
        middle = f"ingest_date={when}/" if layer == "bronze" else ""
        path = f"{self.root}/{layer}/{source}/{dataset}/{middle}{filename}"
        digest, fs = hashlib.sha256(content).hexdigest(), self._fs(path)
        if fs.exists(self._path(path)):
            have = self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
            if have != digest:
                raise FileExistsError(f"{path} has other content")
            return path
        stream = fs.create(self._path(path), False)
        stream.write(bytearray(content))
        stream.close()
        self._append({"path": path, "sha256": digest, "bytes": len(content), "source": source, "dataset": dataset, "url": url, "ingest_date": when, "retired": False, "seq": self._next()})
        return path

    def retire(self, path: str, reason: str) -> None:
        self._append({"path": path, "retired": True, "reason": reason, "seq": self._next()})

    def verify(self) -> DataFrame:
        """path, status (ok, missing, corrupt, retired): the last record of a path counts."""
        last = self.manifest().groupBy("path").agg(F.max_by(F.struct("sha256", "retired"), "seq").alias("r"))
        tops = [f"{self.root}/{x}" for x in ("bronze", "vault") if self._fs(f"{self.root}/{x}").exists(self._path(f"{self.root}/{x}"))]
        if not tops:
            return last.select("path", F.when(F.col("r.retired"), "retired").otherwise("missing").alias("status"))
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tops)
        found = files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("p"), F.sha2("content", 256).alias("have"))
        status = F.when(F.col("r.retired"), "retired").when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("r.sha256"), "corrupt").otherwise("ok")
        return last.join(found, F.regexp_replace("path", "^[a-z]+:/*", "/") == F.col("p"), "left").select("path", status.alias("status"))


def append_jsonl(spark: SparkSession, path: str, records: list[dict], schema: T.StructType) -> None:
    """Append records to a folder of JSON lines; each append is a file of its own, so nothing can be half written."""
    spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema).coalesce(1).write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a schema; lines that cannot be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def canonical(params: dict) -> str:
    """A configuration as one JSON text whatever the order of its keys."""
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def usage_by_source(manifest: DataFrame) -> DataFrame:
    return manifest.where("NOT retired").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def collisions(paths: list[str]) -> dict[str, int]:
    """Leaf names that several paths share."""
    n = Counter(p.split("/")[-1] for p in paths)
    return {k: v for k, v in n.items() if v > 1}
