import hashlib
import random
import zlib
from itertools import groupby, pairwise

import pytest
from pyspark.sql import functions as F

from quillstone.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    """Rows (conv_id, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The contract's columns of one conversation's rows (turn, role, text) in order: a table of the best (cost, letters) from every place on."""
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role, text, fault))
    n, due = len(judged), {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    best = {(n, q): (0, "") if q in (0, 3) else (10**9, "") for q in range(4)}
    for i in range(n, -1, -1):
        if i < n:
            role, _, fault = judged[i]
            for q in range(4):
                found = [(best[i + 1, q][0] + 4, "D" + best[i + 1, q][1])]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    to = due[q][1] if role[:1] == due[q][0] else 1 if q == 0 and role[:1] == "s" else None
                    if to is not None:
                        found.append((best[i + 1, to][0] + more, "K" + best[i + 1, to][1]))
                    found.append((best[i + 1, due[q][1]][0] + 3 + more, "R" + best[i + 1, due[q][1]][1]))
                best[i, q] = min(found)
        for _ in range(3):
            for q in range(4):
                to = best[i, due[q][1]]
                best[i, q] = min(best[i, q], (to[0] + 3, "I" + to[1]))
    cost, letters = best[0, 0]
    i, q, lines = 0, 0, []
    for letter in letters:
        role, text = judged[i][:2] if i < n else ("", "")
        if letter in "RI":
            lines.append(f"{'user' if due[q][0] == 'u' else 'assistant'}:{text if letter == 'R' else ''}")
            q = due[q][1]
        elif letter == "K":
            lines.append(f"{role}:{text}")
            q = 1 if role[:1] == "s" else due[q][1]
        i += letter != "I"
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_all(rows):
    convs = {r[0] for r in rows}
    key = lambda r: (r[0] is not None, r[0] or 0)
    own = {c: [] for c in convs}
    for c, g in groupby(sorted(plain_damage(rows), key=key), key=lambda r: r[0]):
        own[c] = sorted(((t, role, text) for _, t, role, text in g), key=lambda r: (r[0] is not None, r[0] or 0))
    return {c: plain_repair(v) for c, v in own.items()}


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op12_equals_the_plain_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(C.op12_conversation_repair(spark, sf_dir)) == plain_all(rows)


def test_random_conversations_in_memory():
    rng = random.Random(4)
    for _ in range(3000):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Hi.", "no", "", " ", "Yes!", f"x{t}?"])) for t in range(rng.randint(0, 9))]
        have = C.repair([r[0] for r in rows], [r[1:] for r in rows])
        assert (*have[:-1], hashlib.sha256(have[-1].encode()).hexdigest()) == plain_repair(rows)


@pytest.mark.parametrize("most_rows", [1, 3, 50])
def test_long_conversations_go_by_blocks(spark, monkeypatch, most_rows):
    """Conversations cut into blocks and spread over partitions give what they give in one piece."""
    rng, rows = random.Random(most_rows), []
    for conv, n in ((1, 400), (2, 5), (None, 60), (3, 1), (-7, 30)):
        rows += [(conv, t, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice([f"Say {t}.", f"say {t % 9}", "ok.", None, f"Why {t}?"])) for t in range(n)]
    monkeypatch.setattr(C, "MOST_ROWS", most_rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(C.repair_conversations(C.damaged(df))) == plain_all(rows)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_conversations(C.damaged(empty)).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (5, None, "user", "A."), (5, None, None, None), (5, None, "user", "A."), (6, 1, "user", "Long. " * 300_000), (6, 1, "user", "Long. " * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("gaps", F.lit(1))
    have = got(C.repair_conversations(C.damaged(df)))
    assert have[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert have[5][0] == 0 and have[6][2] >= 1 and set(have) == {lost, 5, 6}
