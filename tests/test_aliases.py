import random

from quillstone.operators import aliases as A


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def canonical(spark, pairs):
    rows = A.canonical(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert len(rows) == len({r["name"] for r in rows})
    return {r["name"]: r["root"] for r in rows}


def test_components_equal_union_find(spark, monkeypatch):
    """Random graphs, a long chain, a hub that is dealt to parts, names alone, nulls and repeated rows."""
    monkeypatch.setattr(A, "HUB", 20)
    monkeypatch.setattr(A, "SALTS", 4)
    rng = random.Random(7)
    pairs = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    pairs += [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(70)] + [(f"s{k}", "hub") for k in range(150)]
    pairs += [("alone", "alone"), ("x", None), (None, "y"), (None, None)] + pairs[:10]
    assert canonical(spark, pairs) == union_find(pairs)
    assert canonical(spark, []) == {}


def test_chains_of_renames_lead_to_one_paper(spark):
    kind = "bib string, aliases array<string>"
    now = spark.createDataFrame([("p1", ["p1", "a1"]), ("p2", None), ("p3", [])], kind)
    lists = [spark.createDataFrame(rows, kind) for rows in ([("a1", ["b1"]), ("p2", ["a2"])], [("b1", ["c1", "d1"])], [("lost", ["gone"]), ("d1", ["e1"])])]
    got = {r["alias"]: r["bib"] for r in A.transitive_aliases(now, *lists).collect()}
    assert got == {"p1": "p1", "a1": "p1", "b1": "p1", "c1": "p1", "d1": "p1", "e1": "p1", "p2": "p2", "a2": "p2", "p3": "p3"}


def test_a_shared_name_leaves_current_papers_their_own(spark):
    kind = "bib string, aliases array<string>"
    now = spark.createDataFrame([("p1", ["shared"]), ("p2", ["shared", "own2"])], kind)
    got = {r["alias"]: r["bib"] for r in A.transitive_aliases(now).collect()}
    assert got == {"p1": "p1", "p2": "p2", "shared": "p1", "own2": "p1"}
