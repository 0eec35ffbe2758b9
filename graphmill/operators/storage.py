"""Keyed tables: upsert, cascading delete, delete by tag, metadata, incremental maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.session import SharedFiles, durable


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key is not in new; a key repeated in new keeps its greatest row.

    The old table is filtered by an anti-join on the new keys and otherwise
    passed on; nothing but keys is aggregated.
    """
    cols = old.columns
    rest = [c for c in cols if c not in keys]
    latest = new.select(*cols).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else new.select(*cols).distinct()
    return old.join(latest.select(*keys), keys, "left_anti").select(*cols).unionByName(latest.select(*cols))


def cascade_delete(files: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the files of `paths` (path), their symbols, these symbols' chunks, and edges at either end."""
    gone = symbols.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    return {
        "files": files.join(paths.select("path"), "path", "left_anti"),
        "symbols": symbols.join(gone, "id", "left_anti"),
        "chunks": chunks.join(gone.withColumnRenamed("id", "parent_symbol_id"), "parent_symbol_id", "left_anti"),
        "edges": edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"),
    }


def delete_by_tag(edges: DataFrame, tag: str) -> DataFrame:
    """Edges without the tag; null tags hold none."""
    return edges.filter(~F.coalesce(F.array_contains("tags", tag), F.lit(False)))


class TableStore:
    """Versioned Parquet tables and metadata under one folder of any file system that Spark can reach.

    The state of the store, table versions and metadata together, is one small
    file per commit, numbered; the highest number counts. A commit is one
    rename: readers see all of it or nothing, and a writer that another one
    overtook fails instead of losing the other's work. Old commits and the
    table versions that only they name can be removed by `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = SharedFiles(spark, f"{self.root}/_commits")

    def _state(self) -> tuple[int, dict]:
        names = [n for n in self.commits.names() if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return 0, {}
        return int(names[-1][:-5]), self.commits.read_json(names[-1])

    def commit(self, tables: dict[str, DataFrame], metadata: dict | None = None) -> None:
        """New versions of tables and metadata (a value of None removes its key) in one commit."""
        number, state = self._state()
        new = dict(state)
        for name, df in tables.items():
            path = f"{name}/v{number + 1}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.root}/{path}")
            new[f"table:{name}"] = path
        for key, value in (metadata or {}).items():
            if value is None:
                new.pop(key, None)
            else:
                new[key] = value
        if not self.commits.create_json(f"{number + 1:012d}.json", new):
            raise RuntimeError("the store was changed by another writer")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._state()[1][f'table:{name}']}")

    def has(self, name: str) -> bool:
        return f"table:{name}" in self._state()[1]

    def write(self, name: str, df: DataFrame, metadata: dict | None = None) -> None:
        self.commit({name: df}, metadata)

    def truncate(self, name: str) -> None:
        self.write(name, self.read(name).limit(0))

    def metadata(self, key: str):
        return self._state()[1].get(key)

    def set_metadata(self, key: str, value) -> None:
        self.commit({}, {key: value})

    def vacuum(self) -> None:
        """Remove all commits but the last and the table versions that it does not name; no reader may still use them."""
        number, state = self._state()
        live = {v for k, v in state.items() if k.startswith("table:")}
        for name in self.commits.names():
            if name.endswith(".json") and int(name[:-5]) < number:
                self.commits.delete(name)
        for table in {k.split(":", 1)[1] for k in state if k.startswith("table:")}:
            files = SharedFiles(self.spark, f"{self.root}/{table}")
            for v in files.names():
                if f"{table}/{v}" not in live:
                    files.delete(v)


def incremental(old: DataFrame, new: DataFrame, key: str, digest: str, derive) -> tuple[DataFrame, DataFrame]:
    """(changes, derived rows of changed and new keys): `derive` runs over nothing that is unchanged."""
    from graphmill.operators.binding import change_class

    changes = durable(change_class(old, new, key, digest))
    todo = new.join(changes.filter("change in ('new', 'modified')").select(key), key, "left_semi")
    return changes, derive(todo)
