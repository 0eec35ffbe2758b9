"""Source files as DataFrames: discovery with ignore rules, lossy decoding, hashing."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.classify import extensions, in_generated_dir, is_supported
from graphmill.functions.text import line_count


def ignore_rules(root: str) -> list[str]:
    """Patterns of the root's .gitignore and exclude files, comments and negations left out."""
    out: list[str] = []
    for name in (".gitignore", ".git/info/exclude"):
        try:
            with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
                out += [x.strip() for x in f if x.strip() and not x.startswith(("#", "!"))]
        except OSError:
            continue
    return out


def _rule_regex(rule: str) -> str:
    """A gitignore pattern as a regular expression over relative paths."""
    anchored = "/" in rule.rstrip("/")
    body = fnmatch.translate(rule.strip("/"))
    body = body[body.index(":") + 1 : body.rindex(")")] if body.startswith("(?s:") else body
    body = body.replace(".*", "[^/]*") if "**" not in rule else body
    return ("^" if anchored else "(^|/)") + body + "(/|$)"


def discover(spark: SparkSession, root: str, keep_generated: bool = False, rules: list[str] | None = None) -> DataFrame:
    """(path, hash, size, content) of the supported files below root, by the binary file source.

    path is relative to root. Hidden entries, ignored paths and output folders
    are left out; content is decoded as UTF-8 with replacement, hash is SHA-256
    of the bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions()) + "}").load(root)
    base = F.lit("file:" + os.path.abspath(root).rstrip("/") + "/")
    rel = F.regexp_replace(F.col("path"), r"^file:/+", "file:/")
    df = raw.select(F.replace(rel, base, F.lit("")).alias("path"), F.col("length").alias("size"), "content")
    df = df.filter(is_supported(F.col("path")) & ~F.col("path").rlike(r"(^|/)\."))
    if not keep_generated:
        df = df.filter(~in_generated_dir(F.col("path")))
    for rule in rules if rules is not None else ignore_rules(root):
        df = df.filter(~F.col("path").rlike(_rule_regex(rule)))
    return df.select("path", F.sha2("content", 256).alias("hash"), "size", F.expr("try_validate_utf8(string(content))").alias("valid"), F.col("content").alias("raw")).select(
        "path", "hash", "size", F.coalesce("valid", F.expr("make_valid_utf8(string(raw))")).alias("content")
    )


def with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", line_count(F.col("content")))


def line_range(files: DataFrame, path: str, start: int, end: int, budget: int | None = None) -> DataFrame:
    """(line_no, line) of one file between two lines; with a token budget, up to the first line that exceeds it."""
    from graphmill.functions.text import count_tokens
    from graphmill.operators.budget import prefix_within

    rows = files.filter(F.col("path") == path).select(F.posexplode(F.split("content", "\n")).alias("i", "line"))
    rows = rows.select((F.col("i") + 1).cast("long").alias("line_no"), "line").filter(F.col("line_no").between(start, end))
    if budget is None:
        return rows
    rows = rows.withColumn("c", count_tokens(F.col("line"))).withColumn("one", F.lit(1))
    return prefix_within(rows, ["one"], ["line_no"], "c", budget).select("line_no", "line")
