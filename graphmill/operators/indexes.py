"""Derived indexes: deltas of postings and vectors, lazy rebuilding, result cache, plug-ins."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.vectors import hash_embedding
from graphmill.operators.storage import TableStore

#: Rows of one embedding batch and its bound, entries and bytes of the result cache.
BATCH, BATCH_MOST, CACHE_ENTRIES, CACHE_BYTES, ENTRY_BYTES = 32, 256, 2_048, 64 << 20, 4 << 20


class Embedder(Protocol):
    """A text embedder: `fingerprint` names model and settings; vectors of different fingerprints never mix."""

    fingerprint: str
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """The deterministic embedder; as a column expression it needs no Python at all."""

    def __init__(self, dimension: int = 16):
        self.dimension, self.fingerprint = dimension, f"sha256-{dimension}"

    def column(self, text):
        return hash_embedding(text, self.dimension)


def embed(docs: DataFrame, embedder, text: str = "text", key: str = "id", batch: int = BATCH) -> DataFrame:
    """(key, vec, fingerprint) of docs; an embedder with a `column` stays in the JVM, any other runs in batches per Arrow chunk."""
    mark = F.lit(embedder.fingerprint).alias("fingerprint")
    if hasattr(embedder, "column"):
        return docs.select(key, embedder.column(F.col(text)).alias("vec"), mark)
    size = max(1, min(batch, BATCH_MOST))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = [t or "" for t in part], []
            for i in range(0, len(texts), size):
                got = embedder.embed_batch(texts[i : i + size])
                if len(got) != len(texts[i : i + size]):
                    raise ValueError("the embedder returned another number of vectors than texts")
                out += got
            yield pd.Series(out, index=part.index, dtype=object)

    return docs.select(key, run(F.col(text)).alias("vec"), mark)


def vectors_of(vectors: DataFrame, fingerprint: str) -> DataFrame:
    """The stored vectors of one fingerprint."""
    return vectors.filter(F.col("fingerprint") == fingerprint)


def rerank(candidates: DataFrame, score: Callable[[str, list[str]], list[float]], mix: tuple[float, float] = (0.35, 0.65)) -> DataFrame:
    """candidates (qid, id, score, query, text) with score mixed from the old one and a sigmoid of a pair scorer's logit, per query."""
    kinds = dict(candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pd.Series(score(pdf["query"].iloc[0], pdf["text"].tolist()), index=pdf.index, dtype=float)
        got = mix[0] * pdf["score"] + mix[1] / (1 + (-raw).map(lambda x: 2.718281828459045**x))
        return pd.DataFrame({"qid": pdf["qid"], "id": pdf["id"], "score": got})

    return candidates.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, score double")


def update_index(index: DataFrame, removed: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """An index (postings or vectors) without the rows of removed and added keys, and with the added rows."""
    gone = removed.select(key).union(added.select(key)).distinct()
    return index.join(gone, key, "left_anti").unionByName(added.select(*index.columns))


def ensure_index(store: TableStore, name: str, documents: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """The stored index, rebuilt first where it does not cover as many keys as there are documents."""
    want = documents.select(key).distinct().count()
    if not store.has(name) or store.metadata(f"keys:{name}") != want:
        store.write(name, build(documents), {f"keys:{name}": want})
    return store.read(name)


class QueryCache:
    """Rows of recent queries on the driver, by key, least recently used first out; entries expire and large ones are not kept."""

    def __init__(self, entries: int = CACHE_ENTRIES, total: int = CACHE_BYTES, seconds: float = 300.0):
        self.entries, self.total, self.seconds = entries, total, seconds
        self._rows: OrderedDict[str, tuple[float, int, list]] = OrderedDict()
        self._bytes = 0

    @staticmethod
    def key(*parts) -> str:
        """One key of everything that a result depends on: table version, mode, limits, settings, canonical query."""
        return "|".join(map(str, parts))

    def get(self, key: str) -> list | None:
        hit = self._rows.get(key)
        if hit is None:
            return None
        if time.monotonic() - hit[0] > self.seconds:
            self._drop(key)
            return None
        self._rows.move_to_end(key)
        return hit[2]

    def put(self, key: str, rows: list) -> bool:
        size = sum(len(str(r)) for r in rows) + 64
        if size > ENTRY_BYTES or self.entries < 1:
            return False
        if key in self._rows:
            self._drop(key)
        while self._rows and (len(self._rows) >= self.entries or self._bytes + size > self.total):
            self._drop(next(iter(self._rows)))
        self._rows[key] = (time.monotonic(), size, rows)
        self._bytes += size
        return True

    def _drop(self, key: str) -> None:
        self._bytes -= self._rows.pop(key)[1]


def graph_view(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, confidence: float = 0.6, focus: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an interactive view: edges of the kinds with enough confidence, nodes whose name, kind or path holds the focus, and their neighbours."""
    e = edges.filter(F.col("confidence") >= confidence)
    if kinds is not None:
        e = e.filter(F.col("edge_type").isin(kinds))
    if not focus:
        return nodes, e
    low = focus.lower()
    hit = nodes.filter(F.lower("name").contains(low) | F.lower("kind").contains(low) | F.lower("file_path").contains(low)).select("id")
    near = e.join(hit.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    near = near.union(e.join(hit.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")))
    keep = hit.union(near).distinct()
    k = keep.withColumnRenamed("id", "src")
    return nodes.join(keep, "id", "left_semi"), e.join(k, "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def render(df: DataFrame, mode: str = "structured") -> DataFrame:
    """(line): rows as JSON (structured), tab-separated values (compact) or ``name=value`` text."""
    if mode == "structured":
        return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    if mode == "compact":
        return df.select(F.concat_ws("\t", *cols).alias("line"))
    if mode == "text":
        return df.select(F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), c) for n, c in zip(df.columns, cols)]).alias("line"))
    raise ValueError(f"unknown mode {mode}")
