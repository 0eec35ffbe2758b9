"""Budgets, bounded queues and ordered fills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.functions.text import body_slice
from graphmill.operators.binding import within
from graphmill.operators.graph import predict_context

#: Tokens of a chunk, least tokens of a chunk limit.
CHUNK_TOKENS, CHUNK_LEAST = 256, 32


def prefix_within(df: DataFrame, by: list[str], order: list, cost: str, budget: Column | int) -> DataFrame:
    """Rows of each group in order up to the first whose running cost exceeds the budget; later rows are not taken."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(cost).over(w).cast("long")).filter(F.col("running") <= budget)


def greedy_fill(df: DataFrame, by: list[str], order: list[tuple[str, bool]], key: str, cost: str, budget: Column | int) -> DataFrame:
    """(by, key) of the rows that a walk in order takes, each taken when it still fits; others are skipped, not stopped at.

    order: (column, descending). The walk is a fold over a sorted array, inside
    the JVM; a group is one query's candidate list, bounded by its stage-one
    width. Negative and null costs count as zero; ties go to the least key.
    """
    cols = [F.when(F.lit(d), -F.col(c).cast("double")).otherwise(F.col(c).cast("double")).alias(f"o{i}") for i, (c, d) in enumerate(order)]
    row = F.struct(*cols, F.col(key).alias("k"), F.greatest(F.coalesce(F.col(cost), F.lit(0)), F.lit(0)).cast("long").alias("c"))
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.first(F.lit(budget) if isinstance(budget, int) else budget).cast("long").alias("b"))
    kind = dict(df.dtypes)[key]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r["c"] <= F.col("b")
        return F.struct(
            F.when(fits, acc["used"] + r["c"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(r["k"]))).otherwise(acc["kept"]).alias("kept")
        )

    return g.select(*by, F.explode(F.aggregate("rows", start, step)["kept"]).alias(key))


def newest_within(df: DataFrame, by: list[str], order: list, size: str, count: int, total: int) -> DataFrame:
    """Newest rows of each group while both their number and their running size stay within bounds."""
    w = W.partitionBy(*by).orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("nth", F.row_number().over(w).cast("long")).withColumn("running", run.cast("long")).filter((F.col("nth") <= count) & (F.col("running") <= total))


def bounded_queue(df: DataFrame, by: list[str], order: str, size: str, key: str, count: int = 1_000, total: int = 4 << 20) -> DataFrame:
    """(by, key) kept from newest to oldest: at most `count` rows and `total` size, oversize rows skipped.

    The walk needs sizes and keys only; it runs over batches of one group's
    sorted stream and stops once `count` rows are kept.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, key])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, key], ascending=[False, False], kind="stable")
        used, kept = 0, []
        for i, s in enumerate(pdf[size].fillna(0)):
            if len(kept) >= count:
                break
            if used + s <= total:
                used += s
                kept.append(i)
        return pdf.iloc[kept][[*by, key]]

    return df.select(*by, order, size, key).groupBy(*by).applyInPandas(walk, schema)


def token_cost(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, cost): the greater of a symbol's own tokens and those of its chunks, at least one."""
    c = chunks.groupBy(F.col("parent_symbol_id").alias("id")).agg(F.sum("token_count").alias("chunk_tokens"))
    return nodes.select("id", "token_count").join(c, "id", "left").select("id", F.greatest(F.coalesce("chunk_tokens", F.lit(0)), F.coalesce("token_count", F.lit(0)), F.lit(1)).cast("long").alias("cost"))


def prune_context(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, costs: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (qid, id, seed) kept within a token budget around the seeds (qid, id), and the edges among them.

    Seeds are always kept. Predicted neighbours follow by score per square root
    of their cost, each taken when it still fits what the seeds leave.
    """
    limit = max(64, min(2_000, budget // 8))
    found = predict_context(nodes, edges, seeds)
    best = found.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= limit)
    fixed = seeds.select("qid", "id").distinct().join(costs, "id").groupBy("qid").agg(F.sum("cost").alias("fixed"))
    c = best.join(costs, "id").join(fixed, "qid", "left").withColumn("density", F.col("score") / F.sqrt("cost"))
    room = F.greatest(F.lit(budget) - F.coalesce("fixed", F.lit(0)), F.lit(0))
    taken = greedy_fill(c, ["qid"], [("density", True), ("score", True)], "id", "cost", room)
    kept = seeds.select("qid", "id").distinct().withColumn("seed", F.lit(True)).unionByName(taken.withColumn("seed", F.lit(False)))
    return kept, within(edges, kept.select("id").distinct())


def _chunks(text: str, most: int) -> Iterator[tuple[int, int]]:
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    counts = [len(x.split()) for x in lines]
    tokens = lambda w: -(-w * 13 // 10)
    if tokens(sum(counts)) <= most:
        yield 0, len(lines)
        return
    start = 0
    while start < len(lines):
        words, boundary, end = 0, None, start
        while end < len(lines):
            words += counts[end]
            s = lines[end].strip()
            end += 1
            t = tokens(words)
            if t >= most // 2 and (not s or s[-1] in "};" or s.startswith(("match ", "if ", "for ", "while ", "try:", "except "))):
                boundary = end
            if t >= most:
                end = boundary or end
                break
        yield start, end
        start = end


def chunk_texts(docs: DataFrame, key: str, text: str, most: int = CHUNK_TOKENS) -> DataFrame:
    """(key, chunk_index, start_line, end_line, token_count): contiguous line chunks, cut at the last boundary that leaves half a chunk.

    Lines count from 1. A text within the limit is one chunk; a null text has none.
    """
    most = max(most, CHUNK_LEAST)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                if t is None:
                    continue
                lines = t.split("\n")
                for i, (s, e) in enumerate(_chunks(t, most)):
                    rows.append((k, i, s + 1, e, -(-len("\n".join(lines[s:e]).split()) * 13 // 10)))
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "start_line", "end_line", "token_count"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index long, start_line long, end_line long, token_count long")


def chunk_bodies(chunks: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """chunks with the text of their lines."""
    return chunks.join(docs.select(key, text), key).withColumn("body", body_slice(F.col(text), F.col("start_line"), F.col("end_line").cast("int"))).drop(text)
