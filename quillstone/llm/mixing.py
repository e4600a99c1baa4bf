"""Mixing sources to target weights (operator 7), in DataFrame functions only.

Domains come from the labels table. A naive Bayes classifier over a text's length, symbols, capitals and hits in
word lists is trained on a bounded, documented sample of labelled rows (SAMPLE) and gives every document posteriors
over the domains. Nonnegative rates per document are then fitted by projected gradient so that the expected tokens
of each domain, the sum of rate * tokens * posterior, match the targets in the least-squares sense. Rates start at 1
and steps are preconditioned by tokens and domain totals (the largest step that must converge), so the rates settle
at the solution nearest to 1. A target may be a ceiling: it holds only where the expected share of all documents exceeds
it, documents of such a domain (their most probable one) are never copied, and those of the others never left out. As posteriors depend on the binned features alone, documents with equal bins have equal
rates at every step; the steps run over those groups, weighted with their tokens, and a document's rate
is the same fold over the steps' gradients. There are at most 16 * 5 * 5 * 4 ** (domains - 1) groups, so a step is a small job
however large the corpus is. Tokens are runs of letters and digits.

Steps go on until every target is met within a tolerance, or until it is proven that no rates meet them all and the miss is
within GAP of the smallest possible one (see fit); the column met says which of the two it was. Closer to a target that cannot be
met, ever larger rates of ever fewer documents would gain ever less.

Defined results: null and empty texts have no tokens and a rate like their group's; repeated rows have equal rates;
without labels the posteriors are uniform; an empty table gives no rows; further columns are kept, those
named like a result give way to it; labels that are null, or have no id, are left out; of several labels of an id the largest count.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

SAMPLE = 8000
WORDS = 48
TOLERANCE = 1e-5
GAP = 0.1
WRITTEN = 32  # steps between two written states, which keep a step's work constant
SYMBOLS = "[#*$%&|<>]"
TARGETS = {"clean": 0.85, "poor": 0.05, "toxic": 0.10}
_BINS = {"length": 16, "symbols": 5, "capitals": 5}


def label_domain() -> Column:
    """clean, poor or toxic by the columns quality and toxic."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")


@dataclass(frozen=True)
class Posterior:
    domains: tuple[str, ...]
    lexicons: tuple[tuple[str, ...], ...]
    prior: tuple[float, ...]
    tables: dict[str, tuple[tuple[float, ...], ...]]  # feature -> log likelihoods by bin, of each domain

    def logits(self) -> list[Column]:
        out = []
        for d in range(len(self.domains)):
            z = F.lit(self.prior[d])
            for name, table in self.tables.items():
                z = z + F.element_at(F.from_json(F.lit(json.dumps([row[d] for row in table])), "array<double>"), F.col(name) + 1)
            out.append(z)
        return out


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _share_bin(count: Column, size: Column) -> Column:
    share = count / F.greatest(size, F.lit(1))
    return F.when(share <= 0.001, 0).when(share <= 0.02, 1).when(share <= 0.06, 2).when(share <= 0.2, 3).otherwise(4)


def with_features(docs: DataFrame, lexicons: tuple[tuple[str, ...], ...]) -> DataFrame:
    """docs with _n, the number of tokens, and the binned features, under names that begin with an underscore."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_words", _words(text))
    rows = rows.withColumn("_n", F.size("_words").cast("long"))
    cols = {
        "_length": F.least(F.floor(F.log2(F.col("_n") + 1)), F.lit(15)).cast("int"),
        "_symbols": _share_bin(F.regexp_count(text, F.lit(SYMBOLS)), F.char_length(text)),
        "_capitals": _share_bin(F.regexp_count(text, F.lit("[A-Z]")), F.char_length(text)),
    }
    for k, words in enumerate(lexicons):
        listed = F.from_json(F.lit(json.dumps(list(words))), "array<string>")
        cols[f"_hits{k}"] = F.least(F.size(F.array_intersect("_words", listed)), F.lit(3))
    return rows.withColumns(cols).drop("_words")


def train_posterior(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], domain: Column, sample: int = SAMPLE, words: int = WORDS) -> Posterior:
    ids = labels.filter(F.col("doc_id").isNotNull() & domain.isNotNull()).groupBy("doc_id").agg(F.max(domain).alias("domain"))
    n = max(1, ids.count())
    if n > sample:
        ids = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_003)) < int(1_000_003 * sample / n))
    ids = materialise(ids.coalesce(1), "mix_ids")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = materialise(rows.groupBy("doc_id", "domain").agg(F.max("text").alias("text")), "mix_sample")
    totals = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = rows.select("domain", F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("w")).groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)])
    lexicons = []
    for k, d in enumerate(domains[1:], 1):
        own, rest = max(1, totals.get(d, 0)), max(1, sum(totals.get(x, 0) for x in domains if x != d))
        p, q = F.col(f"c{k}") / own, sum(F.col(f"c{j}") for j in range(len(domains)) if j != k) / rest
        # words of at least 3 documents and a twentieth of the domain's, four times as common there as elsewhere
        lead = F.when((F.col(f"c{k}") >= max(3, own / 20)) & (p >= 4 * q), p * F.log((p + 0.5 / own) / (q + 0.5 / rest))).otherwise(0.0)
        lexicons.append(tuple(r["w"] for r in seen.select("w", lead.alias("lead")).filter("lead > 0").orderBy(F.desc("lead"), "w").limit(words).collect()))
    bins = _BINS | {f"hits{k}": 4 for k in range(len(lexicons))}
    counted = with_features(rows, tuple(lexicons))
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("f"), F.col(f"_{b}").alias("b")) for b in bins])).alias("x")
    counts = {(r["f"], r["b"], r["domain"]): r["n"] for r in counted.select("domain", pairs).groupBy("x.f", "x.b", "domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    tables = {
        f"_{f}": tuple(tuple(math.log((counts.get((f, b, d), 0) + 1) / (totals.get(d, 0) + size)) for d in domains) for b in range(size))
        for f, size in bins.items()
    }
    everything = sum(totals.get(d, 0) for d in domains)
    prior = tuple(math.log((totals.get(d, 0) + 1) / (everything + len(domains))) for d in domains)
    return Posterior(domains, tuple(lexicons), prior, tables)


def with_group(docs: DataFrame, model: Posterior) -> DataFrame:
    """docs with _n and _group, the bins of all features."""
    rows = with_features(docs, model.lexicons)
    features = list(model.tables)
    return rows.withColumn("_group", F.concat_ws(",", *features)).drop(*features)


def with_posteriors(groups: DataFrame, model: Posterior) -> DataFrame:
    """groups(_group, n_tokens) with _p: posteriors in order of the domains."""
    bins = F.split("_group", ",")
    rows = groups.withColumns({f: F.get(bins, F.lit(k)).cast("int") for k, f in enumerate(model.tables)})
    rows = rows.withColumn("_z", F.array(*model.logits())).drop(*model.tables)
    rows = rows.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("_p", F.transform("_e", lambda x: x / total)).drop("_z", "_e")


def _capped(ceilings: list[int]) -> Column:
    """Whether the most probable domain is one with a ceiling."""
    return (F.array_position("_p", F.array_max("_p")) - 1).isin(ceilings) if ceilings else F.lit(False)


def _bounded(rate: Column, ceilings: list[int]) -> Column:
    """The rate's nearest allowed value: at most 1 where a domain with a ceiling is the most probable, else at least 1."""
    r = F.greatest(F.lit(0.0), rate)
    return F.when(_capped(ceilings), F.least(F.lit(1.0), r)).otherwise(F.greatest(F.lit(1.0), r)) if ceilings else r


def _fold(steps: list[list[float]], ceilings: list[int], start: tuple[Column, Column] | None = None) -> Column:
    """(r, y) after the steps, each a gradient and the momentum that follows it: the rate, and the point of the next gradient."""
    history = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    r0, y0 = start or (F.lit(1.0), F.lit(1.0))

    def step(at: Column, g: Column) -> Column:
        # zip_with pads the posteriors with a null for the momentum, which the sum leaves out
        move = F.aggregate(F.zip_with("_p", g, lambda p, x: F.coalesce(p * x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        r = _bounded(at["y"] - move, ceilings)
        return F.struct(r.alias("r"), (r + F.element_at(g, -1) * (r - at["r"])).alias("y"))

    return F.aggregate(history, F.struct(r0.alias("r"), y0.alias("y")), step)


@dataclass
class Fit:
    """Gradients and momentum of every step; by domain, the share that is missing (negative) or too much."""

    history: list[list[float]] = field(default_factory=list)
    misses: list[float] = field(default_factory=list)
    met: bool = True


def least_miss(pull: list[float], scales: list[float], weights: list[float], low: float | None, free: tuple[float, float], held: tuple[float, float], floor: float) -> float:
    """A lower bound for the miss of all allowed rates, in the norm that divides by the domains' shares (weak duality).

    For any multipliers m of the domains, the miss v of rates r is at least (m . totals(r) - m . weights) / |m|. The least value of
    m . totals(r) is finite if m . p >= 0 for every group whose rate has no upper limit; the gradient, moved by the same number for
    all domains, is such an m, since posteriors add up to 1. low: the least pull . p of these groups; free, held: (sum of token
    share * pull . p, of token shares) of the groups without and with an upper limit, of the latter negative values alone.
    """
    shift = 0.0 if low is None else -low
    smallest = floor * (free[0] + shift * free[1]) + held[0] + min(0.0, shift) * held[1]
    m = [g + shift for g in pull]
    size = math.sqrt(sum(x * x * s for x, s in zip(m, scales, strict=True)))
    return (smallest - sum(x * w for x, w in zip(m, weights, strict=True))) / size if size else 0.0


def fit(groups: DataFrame, weights: list[float], steps: int | None = None, tolerance: float = TOLERANCE, ceilings: list[int] | None = None) -> Fit:
    """Rates over groups(_p, n_tokens); targets are weights * all tokens.

    The weights of domains in ceilings are lowered to their expected shares; the others take what is left, in proportion.

    Accelerated projected gradient (Nesterov). Errors are taken relative to each domain's share, which makes the largest
    eigenvalue 1, so whole steps converge. It ends when all targets are met within the tolerance, or when the miss is proven to be
    at most 1 + GAP times the least one (or within the tolerance of it), or after `steps` where such a limit is given.
    """
    ceilings = ceilings or []
    k = len(weights)
    part = [F.get("_p", F.lit(i)) * F.col("n_tokens") for i in range(k)]
    first = groups.agg(*[F.sum(p).alias(f"y{i}") for i, p in enumerate(part)], F.sum("n_tokens").alias("n")).first()
    total = first["n"] or 0
    if not total:
        return Fit()
    own = [first[f"y{i}"] / total for i in range(k)]
    if ceilings:
        held = {i: min(weights[i], own[i]) for i in ceilings}
        if all(held[i] == own[i] for i in ceilings):
            return Fit()
        rest = sum(w for i, w in enumerate(weights) if i not in held) or 1.0
        weights = [held[i] if i in held else w / rest * (1 - sum(held.values())) for i, w in enumerate(weights)]
    scales = [max(x, 1e-9) for x in own]
    capped, share = _capped(ceilings), F.col("n_tokens") / F.lit(float(total))
    out, recent, state, start = Fit(met=False), [], groups, None
    at, t, proven = list(own), 1.0, 0.0
    while steps is None or len(out.history) < steps:
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pull = [(at[i] - weights[i]) / scales[i] for i in range(k)]
        recent.append([*pull, (t - 1) / after])
        out.history.append(recent[-1])
        q = sum(F.get("_p", F.lit(i)) * F.lit(g) for i, g in enumerate(pull))
        rated = state.withColumn("_f", _fold(recent, ceilings, start))
        bounds = {
            "low": F.min(F.when(~capped & (F.col("n_tokens") > 0), q)),
            "free_q": F.sum(F.when(capped, 0.0).otherwise(share * q)),
            "free": F.sum(F.when(capped, 0.0).otherwise(share)),
            "held_q": F.sum(F.when(capped, share * F.least(F.lit(0.0), q)).otherwise(0.0)),
            "held": F.sum(F.when(capped, share).otherwise(0.0)),
        }
        row = rated.agg(*[F.sum(p * F.col(f"_f.{c}")).alias(f"{c}{i}") for i, p in enumerate(part) for c in ("r", "y")], *[c.alias(n) for n, c in bounds.items()]).first()
        at = [row[f"y{i}"] / total for i in range(k)]
        out.misses = [row[f"r{i}"] / total - weights[i] for i in range(k)]
        miss = math.sqrt(sum(x * x / s for x, s in zip(out.misses, scales, strict=True)))
        proven = max(proven, least_miss(pull, scales, weights, row["low"], (row["free_q"], row["free"]), (row["held_q"], row["held"]), 1.0 if ceilings else 0.0))
        out.met = max(map(abs, out.misses)) < tolerance
        if out.met or miss - proven < tolerance or (tolerance < proven and miss <= (1 + GAP) * proven):
            break
        t = after
        if len(recent) == WRITTEN:
            state = materialise(rated.select("_p", "n_tokens", F.col("_f.r").alias("_r"), F.col("_f.y").alias("_y")), "mix_state")
            recent, start = [], (F.col("_r"), F.col("_y"))
    return out


def fit_rates(groups: DataFrame, weights: list[float], steps: int | None = None, tolerance: float = TOLERANCE, ceilings: list[int] | None = None) -> list[list[float]]:
    """The steps of `fit` alone."""
    return fit(groups, weights, steps, tolerance, ceilings).history


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: Column, steps: int | None = None, ceilings: frozenset[str] = frozenset(), columns: list[str] | None = None) -> DataFrame:
    """docs with _n (tokens), _p (posteriors in order of the targets), _rate and _met (whether the fit met the targets).

    Where some columns of docs are enough, their rows are written with their groups, so texts are read and counted once.
    """
    total = sum(targets.values())
    model = train_posterior(docs, labels, tuple(targets), domain)
    rows = with_group(docs, model)
    if columns is not None:
        rows = materialise(rows.select(*columns, "_n", "_group"), "mix_rows")
    groups = materialise(with_posteriors(rows.groupBy("_group").agg(F.sum("_n").alias("n_tokens")), model), "mix_groups")
    capped = [i for i, d in enumerate(targets) if d in ceilings]
    found = fit(groups, [w / total for w in targets.values()], steps, ceilings=capped)
    # one row for each combination of bins, so the side is bounded whatever the corpus
    rates = materialise(groups.select("_group", "_p", _fold(found.history, capped)["r"].alias("_rate"), F.lit(found.met).alias("_met")), "mix_rates")
    return rows.join(F.broadcast(rates), "_group", "left").drop("_group")


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None, steps: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs, or some columns of it, with n_tokens, posteriors (in order of the targets), rate and met; columns of these names give way."""
    own = ("n_tokens", "posteriors", "rate", "met")
    kept = [c for c in (docs.columns if columns is None else columns) if c not in own]
    rows = _rated(docs, labels, targets or TARGETS, label_domain() if domain is None else domain, steps, columns=None if columns is None else kept)
    return rows.select(*kept, F.col("_n").alias("n_tokens"), F.col("_p").alias("posteriors"), F.col("_rate").alias("rate"), F.col("_met").alias("met"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None, ceilings: frozenset[str] = frozenset()) -> DataFrame:
    """docs in as many copies as their rates say; the fraction is rounded by a hash of the row. Columns stay as they are."""
    rows = _rated(docs, labels, targets or TARGETS, label_domain() if domain is None else domain, ceilings=ceilings)
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("_rate") + u).cast("int")
    return rows.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = document_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id"])
    return rows.select("doc_id", "n_tokens", *[F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(TARGETS)], "rate", "met")
