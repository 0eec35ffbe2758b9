"""Queries of the training-data problems over the code-index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import docpairs, handwritten, leakage, packing, residue, splitting, tokenizer
from graphmill.operators.hierarchy import current_rows
from graphmill.session import spread, table

# --- 1: filling containers ---------------------------------------------------------------

#: Capacity into which p1_pack_chunks packs the chunks.
CHUNK_BUDGET = 4_096


def p1_pack_items(spark: SparkSession, d: str) -> DataFrame:
    """The context items of each bundle in containers of its token budget."""
    items = table(spark, d, "context_items").select("item_id", "bundle_id", "symbol_id", "score", "tokens").filter("item_id is not null")
    items = items.dropDuplicates(["item_id", "bundle_id"])
    bundles = table(spark, d, "context_bundles").select("bundle_id", "token_budget")
    txt = F.concat_ws(" ", F.regexp_extract("symbol_id", r"([^/]+/[^/#]+)#", 1), F.regexp_extract("symbol_id", r"#([^:]*)", 1))
    ready = items.join(bundles, "bundle_id").select(
        F.col("bundle_id").alias("grp"), F.col("item_id").alias("item"), "tokens", "score", F.col("token_budget").alias("capacity"), txt.alias("txt")
    )
    out = packing.fill_containers(ready)
    return out.select(
        F.col("grp").cast("long").alias("bundle_id"), "container", F.col("item").cast("long").alias("item_id"), "score", F.col("tokens").alias("tokens_placed"), F.col("capacity").alias("token_budget")
    )


def p1_pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All chunks in containers of CHUNK_BUDGET tokens; token counts are taken anew from the texts, for stored ones are stale.

    Retrieval is by the terms of the whole text, file and symbol name.
    """
    chunks = table(spark, d, "chunks").select("id", "text").filter("id is not null").dropDuplicates(["id"])
    name = F.regexp_replace(F.regexp_extract("id", r"([^/]+)$", 1), r":L\d+C\d+$", "")  # places tell nothing of the content
    ready = chunks.select(
        F.lit("chunks").alias("grp"), F.col("id").alias("item"), splitting.count_tokens(F.col("text")).alias("tokens"),
        F.lit(None).cast("double").alias("score"), F.lit(CHUNK_BUDGET).alias("capacity"), F.concat_ws(" ", name, "text").alias("txt"),
    )
    out = packing.fill_containers(ready)
    return out.select("container", F.col("item").alias("chunk_id"), F.col("tokens").alias("tokens_placed"), F.col("capacity").alias("token_budget"))


# --- 2: functions with their documentation -----------------------------------------------


def _current_files(spark: SparkSession, d: str, cols: list[str]) -> DataFrame:
    return current_rows(table(spark, d, "files").select("path", "scanned_at", *cols), "path", "scanned_at", cols)


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code-description pairs of the current symbols."""
    cols = ["name", "kind", "signature", "file_path", "start_line", "end_line", "docstring", "language", "deleted_at"]
    symbols = current_rows(table(spark, d, "symbols").select("id", "ingested_at", *cols), "id", "ingested_at", cols)
    pairs = docpairs.doc_pairs(symbols, _current_files(spark, d, ["content"]))
    return pairs.withColumnRenamed("id", "symbol_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("symbol_id").distinct()


# --- 5: files nobody wrote by hand -------------------------------------------------------


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label of every file by evidence, folders and copies; symbols lie in files, so their paths are among these."""
    files = spread(table(spark, d, "files").select("path", "scanned_at", "content"))
    return handwritten.label_files(files, "scanned_at").select("path", "label", F.round("belief", 6).alias("belief"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_labels(spark, d).filter("label <> 'handwritten'").select("path")


# --- 6: splitting oversized chunks -------------------------------------------------------


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every chunk above the limit of its language."""
    chunks = table(spark, d, "chunks").select("id", "parent_symbol_id", "text")
    owners = current_rows(table(spark, d, "symbols").select("id", "ingested_at", "language"), "id", "ingested_at", ["language"])
    owners = owners.select(F.col("id").alias("parent_symbol_id"), "language")
    big = splitting.oversized(chunks, owners, splitting.limits_of(table(spark, d, "size_limits")), [])
    return splitting.pieces(big)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).select(F.col("id").alias("chunk_id")).distinct()


_WS = splitting.WHITE_SPACE

P6_SQL = f"""
with cur as (select id, arg_max(struct_pack(l := language), ingested_at).l as l from symbols where id is not null group by id),
sized as (
  select c.id, lower(trim(cur.l)) as l,
    coalesce(len(regexp_extract_all(c.text, '[^{_WS}]+')), 0) as words
  from chunks c left join cur on cur.id = c.parent_symbol_id)
select distinct s.id as chunk_id from sized s
  left join size_limits own on own.language = s.l
  cross join (select max_tokens from size_limits where language = '*') o
where ceil(s.words * 13 / 10.0) > coalesce(own.max_tokens, o.max_tokens)
"""


# --- 8: token ids ------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by the byte_bpe_50k vocabulary."""
    return tokenizer.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


# --- 9: evaluation texts in training text ------------------------------------------------


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items that leaked into them, the number of leaked windows and the first one's place."""
    return leakage.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Proximity matches: documents that hold most words of a window of an item close together."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return leakage.near_leaks(docs, table(spark, d, "eval_items")).withColumn("share", F.round("share", 4))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


# --- 10: residue in place of content -----------------------------------------------------


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue and its labels."""
    return residue.residue(spread(table(spark, d, "documents").select("doc_id", "text")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay once residue is excluded."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "doc_kind")
    return docs.join(p10_found(spark, d), "doc_id", "left_anti")


def queries() -> dict:
    return {
        "p1_pack_items": p1_pack_items,
        "p1_pack_chunks": p1_pack_chunks,
        "p2_found": p2_found,
        "p2_pairs": p2_pairs,
        "p5_found": p5_found,
        "p5_labels": p5_labels,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p9_leaks": p9_leaks,
        "p9_near": p9_near,
        "p10_found": p10_found,
        "p10_residue": p10_residue,
        "p10_clean": p10_clean,
    }


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL}
