"""Entry points: answering a question over an indexed corpus, and a small HTTP service around it."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import cited, cited_numbers, renumber_citations
from quillstone.operators import answers, search

APOLOGY = "Sorry, there is no answer just now."
NO_SOURCES = "The answer does not rest on retrieved passages."
FIELDS = {"content": 1.0, "title": 2.0, "section_headers": 1.0}


def retrieve(spark: SparkSession, corpus: DataFrame, question: str, k: int = search.PER_RETRIEVER) -> list[dict]:
    """Reranked passages of corpus(doc_key, title, content, and section_headers if there) for one question, best first."""
    q = spark.createDataFrame([(1, question)], "query_id int, query string")
    hits = search.bm25(corpus, q, {f: w for f, w in FIELDS.items() if f in corpus.columns}, k=k).select("query_id", "doc_key", F.col("pos").alias("place"))
    scored = hits.join(corpus, "doc_key").withColumn("score", search.lexical_score(F.lit(question), F.col("content")))
    rows = search.rerank(scored).orderBy("rank").select("doc_key", "title").collect()
    return [{"key": r["doc_key"], "title": r["title"]} for r in rows]


def answer_question(spark: SparkSession, corpus: DataFrame, question: str, history: list[dict], model: answers.ChatModel | None = None) -> tuple[str, str]:
    """(reply with [1], [2] ..., lines of the sources used). Only the last messages of the history count."""
    history = history[-answers.HISTORY :]
    tools = {"search_papers": lambda a: retrieve(spark, corpus, a["query"])}
    a = answers.answer_loop(model or answers.RuleModel(), question, retrieve(spark, corpus, question), tools)
    row = spark.createDataFrame([(a.reply, len(a.docs))], "reply string, n int")
    got = row.select(renumber_citations(F.col("reply")).alias("reply"), cited_numbers(cited(F.col("reply")), F.col("n")).alias("numbers")).first()
    lines = [f"[{k}] *{a.docs[n - 1]['title']}*" for k, n in enumerate(got["numbers"], 1) if n]
    return got["reply"], "\n\n".join(lines) or NO_SOURCES


def handler(answer: Callable[[str, list[dict]], tuple[str | None, str | None]], origins: tuple[str, ...] = ()):
    """A request handler: POST /api/chat {message, history} -> {reply, sources}; GET /health."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            if self.headers.get("Origin") in origins:
                self.send_header("Access-Control-Allow-Origin", self.headers["Origin"])
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send(*((200, {"status": "ok"}) if self.path == "/health" else (404, {})))

        def do_POST(self) -> None:
            if self.path != "/api/chat":
                return self._send(404, {})
            try:
                got = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                message, history = str(got["message"]), list(got.get("history") or [])
            except (ValueError, KeyError, TypeError):
                return self._send(422, {"detail": "message is missing"})
            reply, sources = answer(message, history)
            self._send(200, {"reply": reply or APOLOGY, "sources": sources})

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(answer: Callable[[str, list[dict]], tuple[str | None, str | None]], port: int = 0, origins: tuple[str, ...] = ()) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(answer, origins))


def convert_documents(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """doc_id, markdown, error of files(doc_id, content): a converter run file by file, so that one failure stays with its file."""
    import pyarrow as pa

    from quillstone.functions.batches import in_slices

    def run(batches):
        for doc_ids, contents in in_slices(batches):
            rows = []
            for doc_id, content in zip(doc_ids, contents, strict=True):
                try:
                    rows.append((doc_id, convert(bytes(content)), None))
                except Exception as e:  # the converter is foreign code
                    rows.append((doc_id, None, f"{type(e).__name__}: {e}"))
            ids, texts, errors = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "markdown", "error"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, markdown string, error string")
