"""JSON-lines queues and JSON settings."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the queue, of a request line, and of one upload.
MAX_EVENTS, MAX_BYTES, MAX_LINE, UPLOAD_BATCH = 1_000, 4 << 20, 1 << 20, 20


def read_queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that are no JSON of the schema, or longer than MAX_LINE, are dropped."""
    lines = spark.read.text(path).filter(F.octet_length("value") <= MAX_LINE)
    parsed = lines.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def append_queue(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def next_upload(queue: DataFrame, acknowledged: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The oldest UPLOAD_BATCH rows that are not acknowledged."""
    return queue.join(acknowledged.select(key), key, "left_anti").orderBy(order, key).limit(UPLOAD_BATCH)


@dataclass
class Retrieval:
    hops: int = 1
    candidates: int = 32
    budget: int = 2_048
    cache_entries: int = 128
    cache_seconds: int = 300
    mmr_lambda: float = 0.75


@dataclass
class Settings:
    """Settings with defaults; values are clamped to their bounds on load and save."""

    version: int = 2
    retrieval: Retrieval = field(default_factory=Retrieval)
    structural_prefetch: bool = True
    vfs_shadowing: bool = True
    execution_trace_pinning: bool = True

    def normalised(self) -> Settings:
        r = self.retrieval
        clamp = lambda x, lo, hi: max(lo, min(hi, x))
        r.hops, r.candidates, r.budget = clamp(r.hops, 0, 4), clamp(r.candidates, 1, 200), clamp(r.budget, 128, 32_768)
        r.cache_entries, r.cache_seconds, r.mmr_lambda = clamp(r.cache_entries, 0, 2_048), clamp(r.cache_seconds, 0, 86_400), clamp(r.mmr_lambda, 0.0, 1.0)
        return self

    @staticmethod
    def load(path: str) -> Settings:
        """A missing file gives the defaults, a partial one inherits them."""
        try:
            with open(path) as f:
                raw = json.load(f)
        except (FileNotFoundError, ValueError):
            return Settings()
        out = Settings()
        for f_ in fields(Settings):
            if f_.name == "retrieval":
                for k, v in raw.get("retrieval", {}).items():
                    if hasattr(out.retrieval, k):
                        setattr(out.retrieval, k, v)
            elif f_.name in raw:
                setattr(out, f_.name, raw[f_.name])
        return out.normalised()

    def save(self, path: str) -> None:
        with open(path + ".new", "w") as f:
            json.dump(asdict(self.normalised()), f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".new", path)
