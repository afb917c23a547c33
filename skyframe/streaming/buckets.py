"""Tables for upserts on plain Parquet: rows hashed into buckets, and a manifest that says which version of each bucket holds.

A batch reads and rewrites only the buckets that its keys fall into, so what it writes follows the batch and not the table. New files go
to folders of the next version, which nobody reads until the manifest of that version appears, by one rename; so a reader
sees all tables of one version. A batch that stopped halfway left no manifest and is written again over its own
folders; one that is repeated after it was done is known by its token and changes nothing. Buckets that neither of the two newest
manifests names are deleted. A bucket is one task's work: choose their number so that one fits.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]
_EMPTY: dict = {"version": -1, "token": None, "buckets": 0, "tables": {}, "appended": {}}


class Files:
    """The few file operations that a manifest needs, in whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        with_close = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(with_close, "UTF-8")
        finally:
            with_close.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file under another name and renames it: it is there as a whole or not at all."""
        draft = f"{name}.draft"
        out = self.fs.create(self._path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self._path(draft), self._path(name)):
            raise OSError(f"{name} could not be renamed into place")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _manifests(files: Files, newest: int = 3) -> list[dict]:
    names = [n for n in files.names("manifests") if n.endswith(".json")][-newest:]
    return [json.loads(files.read(f"manifests/{n}")) for n in names]


def _folder(table: str, version: int) -> str:
    return f"data/{table}/version={version}"


def _read(spark: SparkSession, root: str, table: str, entry: dict, buckets: list[str]) -> DataFrame | None:
    paths = [f"{root}/{_folder(table, entry['buckets'][b])}/bucket={b}" for b in buckets if b in entry["buckets"]]
    return spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(*paths) if paths else None


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the newest version; nothing before the first."""
    found = _manifests(Files(spark, root), 1)
    if not found:
        return {}
    m = found[-1]
    out = {t: _read(spark, root, t, e, list(e["buckets"])) for t, e in m["tables"].items()}
    for t, schema in m["appended"].items():
        parts = spark.read.schema(T.StructType.fromJson(schema).add("version", "long")).parquet(f"{root}/data/{t}")
        out[t] = parts.filter(F.col("version") <= m["version"]).drop("version")
    return {t: df for t, df in out.items() if df is not None}


def merge(spark: SparkSession, root: str, token: str, changes: dict[str, tuple[DataFrame, str, Merge]], appends: dict[str, DataFrame] | None = None, buckets: int = 64) -> dict[str, list[int]]:
    """Applies a batch to the tables as their next version; the buckets that each table had rewritten.

    ``changes`` holds for each table its changed rows, their key, and how old and changed rows become the new ones; ``appends`` rows that are only
    added. ``token`` names the batch: the newest version's own token changes nothing. ``buckets`` counts for a new store.
    """
    files = Files(spark, root)
    found = _manifests(files)
    last = found[-1] if found else {**_EMPTY, "buckets": buckets}
    if last["token"] == token:
        return {}
    version, n, touched = last["version"] + 1, last["buckets"], {}
    tables, appended = {t: {"schema": e["schema"], "buckets": dict(e["buckets"])} for t, e in last["tables"].items()}, dict(last["appended"])
    bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")
    for t, (rows, key, how) in changes.items():
        hit = sorted(x.bucket for x in rows.select(bucket(key)).distinct().collect())  # at most as many as there are buckets
        touched[t] = hit
        if not hit:
            continue
        old = _read(spark, root, t, tables[t], [str(b) for b in hit]) if t in tables else None
        merged = how(old, rows)
        merged.withColumn("bucket", bucket(key)).repartition(len(hit), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/{_folder(t, version)}")
        entry = tables.setdefault(t, {"buckets": {}})
        entry["schema"] = json.loads(merged.schema.json())
        entry["buckets"] |= {str(b): version for b in hit}
    for t, rows in (appends or {}).items():
        rows.write.mode("overwrite").parquet(f"{root}/{_folder(t, version)}")
        appended[t] = json.loads(rows.schema.json())
    files.publish(f"manifests/{version:012}.json", json.dumps({"version": version, "token": token, "buckets": n, "tables": tables, "appended": appended}))
    _clean(files, _manifests(files))
    return touched


def _clean(files: Files, found: list[dict]) -> None:
    """Deletes what the third newest manifest names and the two newest don't, and that manifest."""
    if len(found) < 3:
        return
    old, kept = found[0], {(t, b, v) for m in found[1:] for t, e in m["tables"].items() for b, v in e["buckets"].items()}
    for t, e in old["tables"].items():
        for b, v in e["buckets"].items():
            if (t, b, v) not in kept:
                files.delete(f"{_folder(t, v)}/bucket={b}")
    files.delete(f"manifests/{old['version']:012}.json")
