import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.operators import ranks
from quillstone.operators.facets import facet_bitmaps, facet_totals


def rows(seed=1, n=500):
    """Groups of very different size, null groups, ties."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(40)) for i in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "id long, g string, v long").repartition(5)


def test_numbers_within_groups(df):
    got = {r["id"]: r["n"] for r in ranks.numbered(df, ["g"], [F.desc("v"), "id"], "n").collect()}
    by = defaultdict(list)
    for i, g, v in rows():
        by[g].append((-v, i))
    assert got == {i: k for own in by.values() for k, (_, i) in enumerate(sorted(own), 1)}
    assert sorted(r["n"] for r in ranks.numbered(df, [], ["v"], "n").collect()) == list(range(1, 501))


def test_prefix_sums_and_ranks(spark, df):
    got = {r["id"]: r["before"] for r in ranks.prefix_sums(df, ["g"], ["id"], "v").collect()}
    seen, want = defaultdict(int), {}
    for i, g, v in rows():
        want[i] = seen[g]
        seen[g] += v
    assert got == want
    vs = [v for *_, v in rows()] + [None, None]
    both = df.select("v").unionAll(spark.createDataFrame([(None,), (None,)], "v long"))
    order = sorted(vs, key=lambda v: (v is None, v or 0))
    assert sorted(((r["v"], r["place"]) for r in ranks.ranked(both, "v").collect()), key=str) == sorted(((v, order.index(v) + 1) for v in vs), key=str)


def test_scores_come_back_in_the_input_order(spark):
    rng = random.Random(3)
    texts = [(i, None if i % 50 == 7 else "w" * rng.randrange(30)) for i in range(203)]
    batches = []

    def score(batch):
        if not 1 <= len(batch) <= 4:
            raise ValueError("not a batch")
        return [10.0 * len(t) + max(map(len, batch)) - max(map(len, batch)) for t in batch]

    out = ranks.scored_in_batches(spark.createDataFrame(texts, "id long, text string").repartition(3), "text", [F.desc("id")], score).collect()
    assert [r["id"] for r in out] == sorted((i for i, _ in texts), reverse=True)
    assert all(r["score"] == 10.0 * len(r["text"] or "") for r in out)
    batches = defaultdict(list)
    for r in out:
        batches[r["batch"]].append(len(r["text"] or ""))
    assert all(len(b) == 4 for k, b in batches.items() if k < max(batches)) and all(max(batches[k]) <= min(batches[k + 1]) for k in range(max(batches)))


def test_empty_tables(df):
    none = df.limit(0)
    assert ranks.numbered(none, ["g"], ["id"]).count() == ranks.prefix_sums(none, [], ["id"], "v").count() == ranks.ranked(none, "v").count() == 0


def test_facet_totals_equal_a_scan(spark):
    rng = random.Random(5)
    people = ["ada", "bo", "van dyk", "dyk"]
    papers = [(f"p{i}", rng.choice([None, [], rng.sample(people, 2), [people[0]] * 2]), rng.choice([None, [people[1]], [people[0]]]), rng.choice([None, 1999, 2000, 2010])) for i in range(300)]
    bits = facet_bitmaps(spark.createDataFrame(papers, "bib string, author_keys array<string>, first_author_keys array<string>, year int"))
    asks = [(k, a, f, lo, hi) for k, (a, f, lo, hi) in enumerate((a, f, lo, hi) for a in (None, "ada", "dyk", "nobody") for f in (None, False, True) for lo in (None, 2000) for hi in (None, 1999, 2005))]
    got = {r["ask"]: r["total"] for r in facet_totals(bits, spark.createDataFrame(asks, "ask int, author string, first_author_only boolean, year_from int, year_to int")).collect()}

    def total(a, f, lo, hi):
        keys = lambda p: (p[2] if f else p[1]) or []
        return sum((a is None or a in keys(p)) and ((lo is None and hi is None) or (p[3] is not None and (lo is None or p[3] >= lo) and (hi is None or p[3] <= hi))) for p in papers)

    assert got == {k: total(*rest) for k, *rest in asks}
