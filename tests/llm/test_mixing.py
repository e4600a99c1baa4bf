import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import mixing
from quillstone.llm.mixing import TARGETS, document_rates, fit_rates, mix, op7_mixing_sources


def test_totals_match_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op7_mixing_sources(spark, sf_dir).toPandas()
    assert len(rows) == docs.count() and (rows["rate"] >= 0).all()
    total = rows["n_tokens"].sum()
    for d, w in TARGETS.items():
        assert abs((rows["rate"] * rows["n_tokens"] * rows[f"p_{d}"]).sum() / total - w) < 1e-3
    assert np.allclose(rows[[f"p_{d}" for d in TARGETS]].sum(1), 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    truth = np.where(both["toxic"] == 1, "toxic", np.where(both["quality"] == 0, "poor", "clean"))
    guess = both[[f"p_{d}" for d in TARGETS]].to_numpy().argmax(1)
    assert (np.array(list(TARGETS))[guess] == truth).mean() > 0.9


def test_against_plain_projected_gradient(spark):
    rnd = np.random.default_rng(4)
    p = rnd.dirichlet([1, 0.5, 0.3], 50)
    n = rnd.integers(1, 900, 50)
    w = np.array([0.2, 0.5, 0.3])
    groups = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, _p array<double>")
    history = fit_rates(groups, w.tolist(), 60, 0)
    r, y, own = np.ones(50), np.ones(50), (n[:, None] * p).sum(0) / n.sum()
    for *g, momentum in history:
        now = (n[:, None] * p * y[:, None]).sum(0) / n.sum()
        assert np.allclose(g, (now - w) / own, atol=1e-9)
        before, r = r, np.maximum(0, y - p @ ((now - w) / own))
        y = r + momentum * (r - before)
    assert np.abs((n[:, None] * p * r[:, None]).sum(0) / n.sum() - w).max() < 1e-3


def test_edges(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x y"), (3, "a " * 60000)], "doc_id long, text string").withColumns({c: F.lit("q") for c in ("domain", "rate", "n_tokens", "y")})
    for known in (labels.withColumn("text", F.lit(1)), labels.filter("doc_id < 0")):
        rows = document_rates(docs, known, steps=3).collect()
        assert len(rows) == 5 and all(r["rate"] >= 0 for r in rows)
    mixed = mix(docs, labels)
    assert mixed.columns == docs.columns and mixed.filter("rate <> 'q' OR n_tokens <> 'q'").count() == 0
    assert document_rates(docs.filter(F.lit(False)), labels).count() == 0


def test_posteriors_against_plain_naive_bayes(spark):
    """Bins, counts and posteriors of every document against a plain version of the model."""
    import math
    import re
    from collections import Counter

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    domains = tuple(mixing.TARGETS)
    model = mixing.train_posterior(docs, labels, domains, mixing.label_domain())

    def share(n, size):
        s = n / max(1, size)
        return sum(s > c for c in (0.001, 0.02, 0.06, 0.2))

    def bins(text):
        text = text or ""
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        out = [min(15, int(math.log2(len(words) + 1))), share(len(re.findall(r"[#*$%&|<>]", text)), len(text)), share(len(re.findall("[A-Z]", text)), len(text))]
        return len(words), tuple(out + [min(3, len(set(words) & set(w))) for w in model.lexicons])

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    domain = {r["doc_id"]: "toxic" if r["toxic"] == 1 else "poor" if r["quality"] == 0 else "clean" for r in labels.collect()}
    seen, totals = Counter(), Counter()
    for i, k in domain.items():
        if i in texts:
            totals[k] += 1
            for f, b in enumerate(bins(texts[i])[1]):
                seen[f, b, k] += 1
    sizes = [16, 5, 5] + [4] * len(model.lexicons)
    for r in mixing.document_rates(docs, labels).collect():
        n, b = bins(texts[r["doc_id"]])
        z = [math.log((totals[k] + 1) / (sum(totals.values()) + 3)) + sum(math.log((seen[f, v, k] + 1) / (totals[k] + sizes[f])) for f, v in enumerate(b)) for k in domains]
        e = [math.exp(v - max(z)) for v in z]
        assert r["n_tokens"] == n
        assert all(abs(p - v / sum(e)) < 1e-9 for p, v in zip(r["posteriors"], e))


def test_targets_that_cannot_be_met(spark):
    """Without a limit of steps the fit ends near the smallest miss, and says that the targets are not met."""
    p = np.array([[0.9, 0.1], [0.6, 0.4], [0.5, 0.5]])
    n = np.array([100, 300, 50])
    groups = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, _p array<double>")
    w = np.array([0.2, 0.8])
    got = mixing.fit(groups, w.tolist())
    assert not got.met
    share, own = n[:, None] * p / n.sum(), (n[:, None] * p).sum(0) / n.sum()
    # plain projected gradient, run long
    r = np.ones(3)
    for _ in range(20000):
        r = np.maximum(0, r - p @ ((r @ share - w) / own))
    least = np.sqrt(((r @ share - w) ** 2 / own).sum())
    assert least * (1 - 1e-9) <= np.sqrt((np.array(got.misses) ** 2 / own).sum()) <= least * (1 + mixing.GAP)
    assert mixing.fit(groups, [0.7, 0.3]).met


def test_ceiling_that_cannot_be_reached(spark):
    """Clean documents carry some toxic probability and always stay, so a low ceiling is missed; the fit still ends."""
    p = np.array([[0.95, 0.05], [0.7, 0.3], [0.1, 0.9]])
    n = np.array([400, 300, 200])
    groups = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, _p array<double>")
    got = mixing.fit(groups, [0.999, 0.001], ceilings=[1])
    assert not got.met and got.misses[1] > 0
    assert mixing.fit(groups, [0.5, 0.5], ceilings=[1]).history == []


def test_bound_is_never_above_a_reachable_miss(spark):
    rnd = np.random.default_rng(8)
    for floor in (0.0, 1.0):
        for _ in range(200):
            k, m = int(rnd.integers(2, 5)), int(rnd.integers(1, 7))
            p, n, w = rnd.dirichlet(np.ones(k), m), rnd.integers(1, 90, m), rnd.dirichlet(np.ones(k))
            share, own = n / n.sum(), (n[:, None] * p).sum(0) / n.sum()
            held = (p.argmax(1) == 0) & (floor > 0)
            pull = rnd.normal(size=k)
            q = p @ pull
            low = q[~held].min() if (~held).any() else None
            bound = mixing.least_miss(pull.tolist(), own.tolist(), w.tolist(), low, ((share * q)[~held].sum(), share[~held].sum()), (np.minimum(0, share * q)[held].sum(), share[held].sum()), floor)
            r = np.where(held, rnd.random((50, m)), floor + rnd.exponential(1, (50, m)))
            v = np.einsum("sm,mk->sk", r * share, p) - w
            assert bound <= np.sqrt((v**2 / own).sum(1)).min() + 1e-9
