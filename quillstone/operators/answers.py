"""Answer assembly: context blocks, source lines, history, tools and the answer loop with a pluggable model."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 4
FOLLOW_UPS = 2
NOTHING_NEW = "Everything this search found was given before."


def source_line(number: Column, short: Column, title: Column, link: Column, published: Column, section: Column, doi: Column, arxiv: Column) -> Column:
    """One numbered line: reference, linked title, month of publication, section and links to copies."""
    linked = F.when(link.isNotNull(), F.concat(F.lit("["), title, F.lit("]("), link, F.lit(")"))).otherwise(title)
    month = F.when(F.length(published) > 4, F.concat(F.lit(", published "), published)).otherwise(F.lit(""))
    extra = F.array_compact(F.array(F.concat(F.lit("[publisher](https://doi.org/"), doi, F.lit(")")), F.concat(F.lit("[arXiv](https://arxiv.org/abs/"), arxiv, F.lit(")"))))
    copies = F.when(F.size(extra) > 0, F.concat(F.lit(" ("), F.array_join(extra, " · "), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), short, F.lit(" *"), linked, F.lit("*"), month, F.lit(" — "), section, copies)


def format_passage(number: Column, title: Column, published: Column, coverage: Column, content: Column) -> Column:
    """JSON header and content of a passage; the coverage is named only where there is no full text."""
    only = F.when(coverage == "abstract only", coverage)
    return F.concat(F.to_json(F.struct(number.alias("passage"), title.alias("title"), published.alias("published"), only.alias("coverage"))), F.lit("\n"), content)


def history_window(turns: DataFrame, n: int = HISTORY) -> DataFrame:
    """conv_id, turn, history: the n messages before each turn as 'role: text' lines."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(F.concat("role", F.lit(": "), "text")).over(w), "\n").alias("history"))


class ChatModel(Protocol):
    """A language model: messages in, text or tool calls out."""

    def complete(self, messages: list[dict], tools: list[str]) -> dict: ...


@dataclass
class RuleModel:
    """A deterministic stand-in: searches once with the question, then quotes the passages it was given."""

    def complete(self, messages: list[dict], tools: list[str]) -> dict:
        given = sum(m["role"] == "tool" for m in messages)
        if tools and not given:
            return {"calls": [{"name": tools[0], "arguments": json.dumps({"query": messages[-1]["content"]})}]}
        numbers = [n for m in messages if m["role"] in ("context", "tool") for n in m.get("passages", [])]
        return {"text": "Found: " + ", ".join(f"<cite>{n}</cite>" for n in numbers[:3]) if numbers else "Nothing was found."}


def route(model: Callable[[str], str], question: str, tries: int = 3) -> dict:
    """Whether the question is about the service itself, and what to search for; a failing model means the question as it is."""
    for _ in range(tries):
        try:
            got = json.loads(model(question))
            return {"about_service": bool(got["about_service"]), "search_query": " ".join(str(got["search_query"]).split())}
        except Exception:  # the model is foreign code
            continue
    return {"about_service": False, "search_query": question}


def prompt(system: str, blocks: list[str], history: str, question: str) -> str:
    """System text, instruction blocks, history and question, kept apart by rules."""
    parts = [system, *[b for b in blocks if b], *([f"Conversation so far:\n{history}"] if history else []), f"User message: {question}"]
    return "\n\n---\n\n".join(parts)


TOOLS = {
    "search_papers": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]},
    "search_site": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]},
    "find_papers": {"type": "object", "properties": {"query": {"type": "string"}, "author": {"type": "string"}, "first_author_only": {"type": "boolean"}, "year_from": {"type": "integer"}, "year_to": {"type": "integer"}, "limit": {"type": "integer"}}},
}


def dispatch(call: dict, tools: dict[str, Callable[[dict], list]], given: set[str]) -> tuple[list, str | None]:
    """(new documents, message). Never raises: unknown tools and bad arguments become messages."""
    if call.get("name") not in tools:
        return [], f"There is no tool named {call.get('name')}."
    try:
        arguments = json.loads(call.get("arguments") or "")
    except ValueError:
        return [], "The arguments are not JSON."
    if not isinstance(arguments, dict):
        return [], "The arguments are not an object."
    if not str(arguments.get("query") or arguments.get("author") or "").strip():
        return [], "The arguments hold no query."
    try:
        found = tools[call["name"]](arguments)
    except Exception as e:  # a tool's failure is told to the model
        return [], f"The search failed: {e}"
    fresh = [d for d in found if d["key"] not in given]
    return fresh, None if fresh else NOTHING_NEW if found else "Nothing was found."


def search_summary(filters: dict, shown: int, total: int, limit: int, weak: bool = False, given: list[int] | None = None) -> str:
    """What a paper search tells the model: its filters, how many papers match, what was cut, and what it was given before."""
    said = "; ".join(f"{k}: {v}" for k, v in filters.items() if v not in (None, "", False)) or "no filters"
    if not total:
        return f"{said}; no paper of the list matches"
    if not shown:
        return f"{said}; {total} papers match the filters, none of them the query"
    if weak:
        return f"{said}; no paper is clearly about this, the {shown} closest follow"
    more = f"{total} papers match, the {shown} best follow" if shown < total else f"{total} papers match, all follow"
    cut = f"; at most {limit} are shown" if shown == limit < total else ""
    old = f"; given before: {', '.join(map(str, given))}" if given else ""
    return f"{said}; {more}{cut}{old}"


class Trace:
    """Spans of a run as rows (span, kind, parent, seconds, error); parent is the row of the span around it, -1 for none."""

    KINDS = ("CHAIN", "RETRIEVER", "RERANKER", "TOOL", "AGENT", "LLM")

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.rows, self._around = clock, [], [-1]

    @contextmanager
    def span(self, name: str, kind: str) -> Iterator[dict]:
        if kind not in self.KINDS:
            raise ValueError(f"no kind of span is named {kind}")
        row = {"span": name, "kind": kind, "parent": self._around[-1], "seconds": 0.0, "error": None}
        self._around.append(len(self.rows))
        self.rows.append(row)
        begun = self.clock()
        try:
            yield row
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            row["seconds"] = self.clock() - begun
            self._around.pop()


@dataclass
class Answer:
    reply: str
    docs: list = field(default_factory=list)
    calls: list = field(default_factory=list)


def answer_loop(model: ChatModel, question: str, first: list, tools: dict[str, Callable[[dict], list]], budget: int = FOLLOW_UPS, trace: Trace | None = None) -> Answer:
    """Rounds of completion; tools are offered while the budget lasts, calls of a round share it, passages count on.

    The loop is recorded as a span, and in it every completion and every call.
    """
    trace = trace or Trace()
    with trace.span("answer", "AGENT"):
        return _answer(model, question, first, tools, budget, trace)


def _answer(model: ChatModel, question: str, first: list, tools: dict[str, Callable[[dict], list]], budget: int, trace: Trace) -> Answer:
    docs, calls = list(first), []
    messages = [{"role": "context", "passages": list(range(1, len(docs) + 1))}, {"role": "user", "content": question}]
    while True:
        with trace.span("completion", "LLM"):
            out = model.complete(messages, list(tools) if budget > 0 else [])
        if "calls" not in out or budget <= 0:
            return Answer(out.get("text", ""), docs, calls)
        budget -= 1
        for call in out["calls"]:
            with trace.span(str(call.get("name")), "TOOL"):
                fresh, message = dispatch(call, tools, {d["key"] for d in docs})
            numbers = list(range(len(docs) + 1, len(docs) + len(fresh) + 1))
            docs += fresh
            calls.append({"name": call.get("name"), "arguments": call.get("arguments"), "found": len(fresh)})
            messages.append({"role": "tool", "passages": numbers, "content": message or ""})
        messages.append({"role": "user", "content": question})
