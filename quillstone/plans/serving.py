"""Queries of the serving layer, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone import serving
from quillstone.plans.registry import query, table


@query("chk10_batch_conversion", "SELECT page_id AS doc_id, CASE WHEN page_id % 5 <> 0 THEN html END AS markdown, CASE WHEN page_id % 5 = 0 THEN 'ValueError: not a document' END AS error FROM pages")
def chk10(spark, sf):
    def convert(data: bytes) -> str:
        if data[:1] == b"!":
            raise ValueError("not a document")
        return data.decode()

    content = F.concat(F.when(F.col("page_id") % 5 == 0, F.lit("!")).otherwise(F.lit("")), "html").cast("binary")
    return serving.convert_documents(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), content.alias("content")), convert)


@query("ui02_session_replay", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS speaker, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations")
def ui02(spark, sf):
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", who.alias("speaker"), (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))).alias("last"))


@query("ui03_path_aliases", "SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '(\\.html|/)$', '') AS path FROM pages")
def ui03(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), r"(\.html|/)$", "").alias("path"))


@query("ui04_entry_points", "SELECT unnest(['answer', 'bench', 'chunk', 'evaluate', 'search', 'sync']) AS target")
def ui04(spark, sf):
    from quillstone.operators import chunking, search
    from quillstone.plans import retrieval
    from quillstone.streaming import sync

    targets = {"answer": serving.answer_question, "bench": table, "chunk": chunking.chunk_documents, "evaluate": retrieval.eval_items, "search": search.find_papers, "sync": sync.sync_full}
    return spark.createDataFrame([(t,) for t in targets], "target string")
