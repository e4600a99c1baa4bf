"""Conversation structure repair (operator 12): cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

A conversation is a path through a small automaton (START, after s, after u, after a); every row is kept, given the role that is
due, or deleted, and rows of the role that is due can be inserted. Minimum costs are found forward from the start and backward from the
end, at every place between two rows; an edit lies on a cheapest path exactly if the cost up to it, its own and the cost behind it
add up to the least total. From the start the least letter (D, I, K, R) among these edits is taken at each step by the whole set
of places that the letters so far can have led to.

At scale: rows are range-partitioned by (conversation, turn), so a conversation of any length spreads over partitions. A
conversation that lies within one partition and one block (MOST_ROWS rows, MOST_BYTES of text) is repaired there and then.
The others go on as blocks: a block is a (min, +) matrix of costs between the states at its ends, matrices are folded along the
conversation in both directions, each block then walks from every state it may be entered in, the states are followed through
the conversation, and blocks give their letters and texts. What an earlier block of the conversation holds (for duplicates)
comes from a partial aggregation by content. The folds read one small row a block. The checksum of a
repaired conversation is one chain over its whole text by definition, so its last step streams the blocks of a conversation in order; it
holds one block at a time, besides the letters.

Defined results: a null role or text is one space, as a null id or turn is in the checksum that decides the damage; a null id is a conversation
of its own; null turns come first; rows of equal turn stand by a hash of role and text, so copies stand side by side;
an empty role has no initial; a conversation without rows, or whose rows are all deleted, is repaired to nothing; repeated rows are
duplicates; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MOST_ROWS, MOST_BYTES = 1024, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
INF = 1 << 60
STATES = range(4)  # at the start, after s, after u, after a
DUE = (2, 2, 3, 2)  # the state after a row of the role that is due
DUE_ROLE = ("user", "user", "assistant", "user")
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
FINE_PAIRS = {"su", "ua", "au"}
START = [0, INF, INF, INF]
_STATS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"

_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_TYPES |= {f"array<{k}>": pa.list_(t) for k, t in _TYPES.items()}


def inserted(costs: list[int]) -> list[int]:
    """Least costs at a place once rows have been inserted there."""
    after_u = min(costs[2], costs[0] + INSERT, costs[1] + INSERT, costs[3] + INSERT)
    return [costs[0], costs[1], after_u, min(costs[3], after_u + INSERT)]


def arcs(state: int, row: tuple[str, int, bool]) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row (initial, cost of staying, must be deleted)."""
    initial, stay, must_go = row
    out = [("D", DELETE, state)]
    if not must_go:
        if initial in KEPT[state]:
            out.append(("K", KEEP + stay, KEPT[state][initial]))
        out.append(("R", REROLE + stay, DUE[state]))
    return out


def forward(rows: list, entry: list[int]) -> list[list[int]]:
    """Least costs of every state at each of the places before, between and behind rows, insertions at the last place not included."""
    places = [entry]
    for row in rows:
        costs, after = inserted(places[-1]), [INF] * 4
        for q in STATES:
            if costs[q] < INF:
                for _, cost, to in arcs(q, row):
                    after[to] = min(after[to], costs[q] + cost)
        places.append(after)
    return places


def backward(rows: list, end: list[int]) -> list[list[int]]:
    """Least costs from every state at each place to the end, insertions there included."""
    places = [end]
    for row in reversed(rows):
        costs = [min(cost + places[-1][to] for _, cost, to in arcs(q, row)) for q in STATES]
        places.append(left(costs))
    return places[::-1]


def left(costs: list[int]) -> list[int]:
    """Least costs from a place on, where rows may be inserted first."""
    u = min(costs[2], INSERT + costs[3])
    a = min(costs[3], INSERT + u)
    return [min(costs[0], INSERT + u), min(costs[1], INSERT + u), u, a]


def walk(rows: list, before: list[list[int]], behind: list[list[int]], entry: set[int], last: bool) -> tuple[list[tuple[str, int, int]], set[int]]:
    """([(letter, row, state before)], states at the end): the least letters along cheapest edits, up to the last row or, in the last block, the end."""
    total = min(before[0][q] + behind[0][q] for q in entry)
    i, at, out = 0, set(entry), []
    costs = inserted(before[0])
    while i < len(rows) or (last and not any(q in FINAL and costs[q] == total for q in at)):
        best: dict[str, set[tuple[int, int]]] = {}
        for q in at:
            steps = arcs(q, rows[i]) if i < len(rows) else []
            for letter, cost, to in steps:
                if costs[q] + cost + behind[i + 1][to] == total:
                    best.setdefault(letter, set()).add((q, to))
            if costs[q] + INSERT + behind[i][DUE[q]] == total:
                best.setdefault("I", set()).add((q, DUE[q]))
        letter = min(best)
        # the letters so far and the rows fix the state, so one is left to write down
        out.append((letter, i, min(best[letter])[0]))
        at = {to for _, to in best[letter]}
        if letter != "I":
            i += 1
            costs = inserted(before[i])
    return out, at


END = left([0, INF, INF, 0])


def faults(rows: list[tuple[str, str]], seen: set) -> tuple[list[tuple[str, int, bool]], list[int]]:
    """Rows for `arcs`, and the numbers of blank, duplicate, truncated rows and of illegal neighbours; what is seen is added to `seen`."""
    out, counts = [], [0, 0, 0, 0]
    for role, text in rows:
        bare, key = text.strip(BLANKS), (role, text)
        fault = 0 if not bare else 1 if key in seen else 2 if bare[-1] not in ENDS else 3
        seen.add(key)
        if fault < 3:
            counts[fault] += 1
        out.append((role[:1], TRUNCATED if fault == 2 else 0, fault < 2))
    counts[3] = sum(a[0] + b[0] not in FINE_PAIRS for a, b in pairwise(out))
    return out, counts


def written(rows: list[tuple[str, str]], edits: list[tuple[str, int, int]]) -> list[str]:
    """The lines `role:text` that the edits leave."""
    out = []
    for letter, i, state in edits:
        if letter == "K":
            out.append(f"{rows[i][0]}:{rows[i][1]}")
        elif letter == "R":
            out.append(f"{DUE_ROLE[state]}:{rows[i][1]}")
        elif letter == "I":
            out.append(f"{DUE_ROLE[state]}:")
    return out


def spent(judged: list, edits: list[tuple[str, int, int]]) -> int:
    return sum({"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[letter] + (judged[i][1] if letter in "KR" else 0) for letter, i, _ in edits)


def gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def repair(turns: list, rows: list[tuple[str, str]]) -> tuple:
    """gaps, the four counts, cost, audit and lines of a conversation that is at hand as a whole."""
    judged, counts = faults(rows, set())
    edits, _ = walk(judged, forward(judged, START), backward(judged, END), {0}, True)
    return (gaps(turns), *counts, spent(judged, edits), "".join(e[0] for e in edits), "\n".join(written(rows, edits)))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: rows after damage; a dropped row stays as one that is not alive, so its conversation stays known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("alive"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "alive", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_")


_BLOCK = "conv_id long, whole boolean, part int, no long, turns array<long>, roles array<string>, texts array<string>, " + _RESULT


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*((c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def blocks(rows: DataFrame) -> DataFrame:
    """Repaired conversations (whole), and the blocks of those that reach a partition's edge or are long, in order of (part, no)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, out = TaskContext.get().partitionId(), 0, []
        own: list = []  # turn, role, text of the open block
        conv, size, held, open_, first = None, 0, 0, False, True

        def closed(ends: bool) -> None:
            """ends: the conversation ends here and within this partition."""
            nonlocal own, size, held, no
            turns, texts = [r[0] for r in own], [(r[1], r[2]) for r in own]
            if ends and not first:
                out.append((conv, True, None, None, None, None, None, *repair(turns, texts)))
            else:
                out.append((conv, False, part, no, turns, [r[0] for r in texts], [r[1] for r in texts], *[None] * 8))
            no += 1
            held += size
            own, size = [], 0

        for batch in batches:
            ids, turns, roles, texts, alive = (batch.column(k).to_pylist() for k in range(5))
            for c, turn, role, text, live in zip(ids, turns, roles, texts, alive, strict=True):
                if not open_ or c != conv:
                    if open_:
                        closed(True)
                        first = False  # only a partition's first conversation can have begun in the one before
                    conv, open_ = c, True
                elif len(own) >= MOST_ROWS or size >= MOST_BYTES:
                    first = True  # the rest of this conversation goes as blocks too
                    closed(False)
                if live:
                    own.append((turn, role, text))
                    size += 4 * len(text) + 64
                if len(out) >= 1024 or held >= 4 * MOST_BYTES:
                    yield _arrow(out, _BLOCK)
                    out, held = [], 0
        if open_:
            closed(False)  # it may go on in the next partition
        if out:
            yield _arrow(out, _BLOCK)

    return rows.mapInArrow(cut, _BLOCK)


def _streamed(df: DataFrame, step, schema: str, down: bool = False) -> DataFrame:
    """step(iterator over a conversation's rows in order) -> rows, conversation after conversation; a row at a time is held."""
    order = ["conv", F.desc("part") if down else "part", F.desc("no") if down else "no"]

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for _, own in groupby(rows, key=lambda r: r["conv"]):
            told = step(own)
            while held := list(islice(told, 256)):
                yield _arrow([tuple(r[n] for n in names) for r in held], schema)

    return df.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def _each(df: DataFrame, step, schema: str) -> DataFrame:
    """step(row) -> row, for every row by itself."""

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = step(b.slice(k, 1).to_pylist()[0])
                yield _arrow([tuple(r[n] for n in names)], schema)

    return df.mapInArrow(run, schema)


_KEY = "conv string, part int, no long"


def _earlier(parts: DataFrame) -> DataFrame:
    """part, no, earlier: the checksums of a block's rows that an earlier block of the conversation holds."""
    each = parts.select("conv", "part", "no", F.explode(F.array_distinct(F.transform(F.arrays_zip("roles", "texts"), lambda r: F.md5(F.concat_ws("\x00", r["roles"], r["texts"]).cast("binary"))))).alias("h"))
    first = each.groupBy("conv", "h").agg(F.min(F.struct("part", "no")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = each.join(first, ["conv", "h"]).filter(F.struct("part", "no") > F.col("first"))
    return found.groupBy("part", "no").agg(F.collect_list("h").alias("earlier"))  # at most a block's rows


def _judge(r: dict) -> dict:
    """Rows of a block as initials, costs of staying and duties to go, with the block's counts and its matrix of costs."""
    rows = list(zip(r["roles"], r["texts"], strict=True))
    before = set(r["earlier"] or ())
    seen = {row for row in set(rows) if before and hashlib.md5("\x00".join(row).encode()).hexdigest() in before}
    judged, counts = faults(rows, seen)
    matrix = [c for q in STATES for c in forward(judged, [0 if k == q else INF for k in STATES])[-1]]
    return {"conv": r["conv"], "part": r["part"], "no": r["no"], "initials": [j[0] for j in judged], "stay": [j[1] for j in judged], "go": [j[2] for j in judged], "counts": counts, "matrix": matrix}


def _fold_forward(own: Iterator[dict]) -> Iterator[dict]:
    at = START
    for r in own:
        yield r | {"before": at}
        at = [min(INF, *(at[q] + r["matrix"][4 * q + to] for q in STATES)) for to in STATES]


def _fold_backward(own: Iterator[dict]) -> Iterator[dict]:
    at = END
    for k, r in enumerate(own):
        yield r | {"behind": at, "last": int(k == 0)}
        at = [min(r["matrix"][4 * q + to] + at[to] for to in STATES) for q in STATES]


def _walked(r: dict, q: int) -> tuple[list, set[int], list]:
    judged = list(zip(r["initials"], r["stay"], r["go"], strict=True))
    entry = [c if k == q else INF for k, c in enumerate(r["before"])]
    edits, at = walk(judged, forward(judged, entry), backward(judged, r["behind"]), {q}, bool(r["last"]))
    return edits, at, judged


def _exits(r: dict) -> dict:
    """The state in which a block is left, for each state in which it may be entered on a cheapest path."""
    return {"conv": r["conv"], "part": r["part"], "no": r["no"], "exits": [min(_walked(r, q)[1]) if r["before"][q] < INF else -1 for q in STATES]}


def _follow(own: Iterator[dict]) -> Iterator[dict]:
    at = 0
    for r in own:
        yield r | {"entry": at}
        at = r["exits"][at]


def _write(r: dict) -> dict:
    edits, _, judged = _walked(r, r["entry"])
    lines = written(list(zip(r["roles"], r["texts"], strict=True)), edits)
    known = [t for t in r["turns"] if t is not None]
    return {
        "conv": r["conv"], "part": r["part"], "no": r["no"], "counts": r["counts"], "cost": spent(judged, edits), "audit": "".join(e[0] for e in edits), "lines": len(lines), "repaired": "\n".join(lines),
        "ends": ["".join(r["initials"][:1]), "".join(r["initials"][-1:])], "rows": len(judged), "turns": [known[0], known[-1], len(set(known))] if known else None,
    }


def _assemble(own: Iterator[dict]) -> Iterator[dict]:
    """One row a conversation: letters, counts, turns, and the checksum carried from block to block."""
    counts, cost, audit, digest, any_line = [0, 0, 0, 0], 0, [], hashlib.sha256(), False
    last, low, high, distinct, conv = None, None, None, 0, None
    for r in own:
        conv = r["conv"]
        counts = [a + b for a, b in zip(counts, r["counts"], strict=True)]
        if r["rows"]:
            if last is not None and last + r["ends"][0] not in FINE_PAIRS:
                counts[3] += 1
            last = r["ends"][1]
        if r["turns"]:
            distinct += r["turns"][2] - (high == r["turns"][0])
            low, high = r["turns"][0] if low is None else low, r["turns"][1]
        cost += r["cost"]
        audit.append(r["audit"])
        if r["lines"]:
            digest.update((b"\n" if any_line else b"") + r["repaired"].encode())
            any_line = True
    yield {"conv": conv, "gaps": high - low + 1 - distinct if low is not None else 0, **dict(zip(_STATS, counts, strict=True)), "cost": cost, "audit": "".join(audit), "sha": digest.hexdigest()}


_JUDGED = f"{_KEY}, initials array<string>, stay array<int>, go array<boolean>, counts array<long>, matrix array<long>"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired (null for those that span blocks) of rows(conv_id, turn, role, text, alive)."""
    ordered = rows.withColumn("_tie", F.xxhash64("role", "text"))
    keys = ["conv_id", "turn", "_tie"]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "alive")
    cut = materialise(blocks(ordered), "conversation_blocks")
    done = cut.filter("whole").select("conv_id", "gaps", *_STATS, "cost", "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"), "repaired")
    # a null id is a conversation of its own
    parts = cut.filter("not whole").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "part", "no", "turns", "roles", "texts")
    judged = parts.join(_earlier(parts), ["part", "no"], "left").select("conv", "part", "no", "roles", "texts", "earlier")
    judged = materialise(_each(judged, _judge, _JUDGED), "judged_blocks")
    folded = _streamed(judged.select("conv", "part", "no", "matrix"), _fold_forward, f"{_KEY}, matrix array<long>, before array<long>")
    folded = materialise(_streamed(folded, _fold_backward, f"{_KEY}, before array<long>, behind array<long>, last int", True), "folded_blocks")
    at = ["conv", "part", "no"]
    known = judged.drop("matrix").join(folded, at)
    followed = materialise(_streamed(_each(known, _exits, f"{_KEY}, exits array<int>"), _follow, f"{_KEY}, entry int"), "followed_blocks")
    texts = known.join(followed, at).join(parts, at)
    fields = f"{_KEY}, counts array<long>, cost long, audit string, lines long, repaired string, ends array<string>, rows long, turns array<long>"
    told = _streamed(_each(texts, _write, fields), _assemble, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string")
    spread = told.select(F.nullif(F.col("conv"), F.lit("")).cast("long").alias("conv_id"), "gaps", *_STATS, "cost", "audit", F.col("sha").alias("repaired_sha256"), F.lit(None).cast("string").alias("repaired"))
    return done.unionByName(spread)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("repaired")
