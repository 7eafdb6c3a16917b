"""A folder of versioned tables: every write makes a new version, and a numbered manifest names the current ones."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

HEADER = "id long, namespace string, scope string, kind string, tags array<string>, evidence string, metadata string, created_at_us long, updated_at_us long, revision long"
STATE = "pinned boolean, strength long, useful_count long, useful_score double, last_recalled_at_us long, last_decay_at_us long"
SCHEMAS = {
    "memory": f"{HEADER}, memory_type string, judgment string, reasoning string, {STATE}",
    "entity": f"{HEADER}, name string, entity_type string, aliases array<string>, attributes map<string,array<string>>, summary string",
    "relation": f"{HEADER}, src long, predicate string, dst long, confidence double, reason string",
    "event": f"{HEADER}, name string, summary string, participants array<long>, confidence double, reason string",
    "note": f"{HEADER}, path string, title string, chunk_chars long, chunk_overlap long",
    "chunk": f"{HEADER}, note_id long, ordinal long, offset long, limit long, content string",
    "vector": "space string, id long, namespace string, scope string, kind string, tags array<string>, note_id long, vector array<float>, scale float, codes array<tinyint>",
}


class Conflict(ValueError):
    """Another writer, a revision that has moved on, or a reference stands against the change."""


class Folder:
    """Files of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._fs_package = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._configuration = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        at = self._fs_package.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self._configuration), at

    def exists(self, name: str = "") -> bool:
        fs, at = self._at(name)
        return fs.exists(at)

    def list(self, name: str = "") -> list[str]:
        fs, at = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, name: str = "") -> None:
        fs, at = self._at(name)
        fs.delete(at, True)

    def write(self, name: str, text: str) -> None:
        """Writes a new file; one that is there stays, and the write fails."""
        fs, at = self._at(name)
        try:
            out = fs.create(at, False)
        except Exception as error:
            raise Conflict(f"{name} was written by another") from error
        out.write(bytearray(text.encode()))
        out.close()


class Tables:
    """Current versions of all tables, and a state of small settings, under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self.manifest: dict[str, Any] = {"revision": 0, "versions": {}, "next_id": 1, "settings": {}}
        if names := self.folder.list("manifests"):
            last = [n for n in names if n.endswith(".json")][-1]
            text = "\n".join(r[0] for r in spark.read.text(f"{self.folder.path}/manifests/{last}").collect())
            self.manifest = json.loads(text)

    def read(self, name: str) -> DataFrame:
        version = self.manifest["versions"].get(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder.path}/{name}/v{version}")

    def commit(self, changed: dict[str, DataFrame] | None = None, **updates: Any) -> int:
        """Writes new versions of the changed tables, then the manifest that makes them current; all or nothing."""
        revision = self.manifest["revision"] + 1
        versions = dict(self.manifest["versions"])
        for name, df in (changed or {}).items():
            df.select(*[f"`{f.split()[0]}`" for f in _fields(SCHEMAS[name])]).write.mode("overwrite").parquet(f"{self.folder.path}/{name}/v{revision}")
            versions[name] = revision
        manifest = {**self.manifest, **updates, "versions": versions, "revision": revision}
        self.folder.write(f"manifests/{revision:012d}.json", json.dumps(manifest))
        self.manifest = manifest
        return revision

    def vacuum(self) -> None:
        """Deletes versions that the current manifest does not name."""
        for name in SCHEMAS:
            for version in self.folder.list(name):
                if version != f"v{self.manifest['versions'].get(name)}":
                    self.folder.delete(f"{name}/{version}")

    def copy_to(self, path: str) -> None:
        target = Folder(self.spark, path)
        if target.exists():
            raise Conflict(f"{path} is there already")
        for name in self.manifest["versions"]:
            self.read(name).write.parquet(f"{path.rstrip('/')}/{name}/v{self.manifest['versions'][name]}")
        target.write(f"manifests/{self.manifest['revision']:012d}.json", json.dumps(self.manifest))


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
