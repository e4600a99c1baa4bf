"""Retrieval: BM25 over postings, vectors, candidate union, reranking with fallback, faceted paper search.

BM25: lower-cased runs of letters and digits, k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)), scores of the fields
times their boosts added up; a query's repeated terms count once. Queries are broadcast behind a check of their number; only
postings of their terms are counted, a part of the documents keeps its own best k of a query, and every top-k is found per query with a
bounded window.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import written

K1, B = 1.2, 0.75
PER_RETRIEVER, TOP, FALLBACK, THRESHOLD = 15, 7, 2, 0.5
#: Paper search: fields with their boosts, candidates of each retriever, papers shown where none is good.
PAPER_FIELDS, PAPER_CANDIDATES, PAPER_FALLBACK = {"title": 2.0, "abstract": 1.0, "keywords": 1.0}, 20, 3
#: Queries are broadcast up to this number of rows; more are joined by shuffling.
MOST_QUERIES = 100_000
#: Vectors and queries of a group of the exact vector search, postings of one of the text search, and scores that either holds at once.
VECTOR_ROWS, QUERY_ROWS, POSTING_ROWS, SCORES = 32_768, 16_384, 1 << 16, 1 << 21


def terms(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def small(df: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if len(df.limit(most + 1).take(most + 1)) <= most else df


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, float], key: str = "doc_key", k: int | None = PER_RETRIEVER) -> DataFrame:
    """query_id, key, score, pos: the best k rows of docs for each of queries(query_id, query)."""
    q = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term"))
    # texts are read once: postings of the queries' terms, and for each text's length a posting of the empty term, which no text has
    wanted = q.select("term").unionByName(q.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    each = docs.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])).alias("x"))
    posted = each.select(key, "x.field", F.size("x.t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "x.t")).alias("term"))
    counted = written(posted.join(small(wanted), "term", "left_semi").groupBy(key, "field", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    # an empty corpus has no average
    stats = counted.filter("term = ''").groupBy("field").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    boosts = F.create_map(*[F.lit(x) for f, boost in fields.items() for x in (f, float(boost))])
    found = counted.filter("term <> ''").withColumn("boost", boosts[F.col("field")])
    df = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.join(F.broadcast(stats), "field").select("field", "term", "avg_len", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    w = F.col("boost") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weighed = found.join(small(written(weights, "weights")), ["field", "term"]).select(F.col(key).alias("key"), "term", w.alias("w"))
    # all postings of a document lie in one part: neither a frequent term nor the pairs of documents and queries are shuffled
    n = max(1, -(-counted.count() // POSTING_ROWS))
    left = weighed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    right = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, keys, s = best_sums(rows, asked, k)
        return pa.table({"query_id": ids, "key": keys, "score": s})

    kinds = dict(left.dtypes)["key"], dict(right.dtypes)["query_id"]
    hits = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(score, f"query_id {kinds[1]}, key {kinds[0]}, score double")
    totals = hits.select("query_id", F.col("key").alias(key), F.round("score", 6).alias("score"))
    return top_k(totals, k, key) if k else totals


def best_sums(rows: pa.Table, asked: pa.Table, k: int | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(query_id, key, score) of each query's k best keys by rounded score, then key: weights of rows(key, term, w) summed over the terms of asked(query_id, term).

    Scores are not rounded; keys without a term of the query are no hits; all hits where k is None. Queries are taken in blocks, so that
    SCORES pairs of rows and queries at most are held, or one query's.
    """
    keys, ids = (c.combine_chunks().dictionary_encode("encode") for c in (rows["key"], asked["query_id"]))
    doc, of, names = keys.indices.to_numpy(), ids.indices.to_numpy(), keys.dictionary
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(names))
    words = asked["term"].unique()
    t, u = (pc.fill_null(pc.index_in(c, words), -1).to_numpy() for c in (rows["term"], asked["term"]))
    known = t >= 0
    t, doc, w = t[known], doc[known], rows["w"].to_numpy()[known]
    at, hit, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, SCORES // max(1, len(t)))
    for a in range(0, len(ids.dictionary) if len(t) else 0, step):
        m = min(step, len(ids.dictionary) - a)
        own = np.flatnonzero((of >= a) & (of < a + m))
        own = own[np.argsort(u[own], kind="stable")]
        start = np.searchsorted(u[own], np.arange(len(words) + 1))
        n = (start[1:] - start[:-1])[t]
        row = np.repeat(np.arange(len(t)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        cell = (of[own[start[t[row]] + nth]] - a) * len(names) + doc[row]
        s = np.bincount(cell, w[row], m * len(names)).reshape(m, len(names))
        s[np.bincount(cell, minlength=s.size).reshape(s.shape) == 0] = -np.inf
        # room for what rounding may change
        least = np.partition(s, -k, axis=1)[:, [-k]] - 2e-6 if k and k < len(names) else -np.inf
        i, j = np.nonzero((s >= least) & (s > -np.inf))
        x = s[i, j]
        if k:
            order = np.lexsort((rank[j], -_rounded(x), i))
            i, j, x = i[order], j[order], x[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, x = i[keep], j[keep], x[keep]
        at.append(a + i)
        hit.append(j)
        scores.append(x)
    return ids.dictionary.take(pa.array(np.concatenate(at))), names.take(pa.array(np.concatenate(hit))), np.concatenate(scores)


def top_k(scored: DataFrame, k: int, key: str = "doc_key") -> DataFrame:
    """The best k rows of each query by score, then key, with their position from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = PER_RETRIEVER, key: str = "doc_key") -> DataFrame:
    """query_id, key, score, pos: the k rows of vectors(key, embedding) nearest to each of queries(query_id, q), exact.

    A stated set of queries against all rows: vectors are dealt to parts of about VECTOR_ROWS and queries to blocks of about QUERY_ROWS,
    and each pair of a part and a block is a task's group, which multiplies matrices and keeps its own best k of a query. Scores are
    dot products in double precision, added up in the order of the elements. A row without a vector of the query's length has no
    score and stands last.
    """
    parts = max(1, -(-vectors.count() // VECTOR_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = vectors.select(F.col(key).alias("key"), "embedding", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")).select("*", every(blocks, "block"))
    right = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).select("*", every(parts, "part"))

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        at, of, s = best_pairs(rows["embedding"], rows["key"], asked["q"], k)
        return pa.table({"query_id": asked["query_id"].take(pa.array(at)), "key": rows["key"].take(pa.array(of)), "score": s})

    kinds = dict(left.dtypes)["key"], dict(right.dtypes)["query_id"]
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(score, f"query_id {kinds[1]}, key {kinds[0]}, score double")
    return top_k(found.select("query_id", F.col("key").alias(key), F.round("score", 6).alias("score")), k, key)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: the numbers of the lists of that length, and their values as rows of a matrix. Lists with nulls are left out."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    out = {}
    for n in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == n)
        flat = pc.list_flatten(column.take(pa.array(at))).combine_chunks()
        x = pc.cast(flat, pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(at), n)
        whole = pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(len(at), n).all(1)
        out[n] = at[whole], np.ascontiguousarray(x[whole])
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """Millionths of x as Spark's round(x, 6) gives them: half up, on the decimal form where that matters."""
    scaled = np.abs(x) * 1e6
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled % 1 - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return np.copysign(out, x)


def best_pairs(vectors: pa.ChunkedArray, keys: pa.ChunkedArray, queries: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, row, score) of the k best rows of each query by rounded score, then key; scores are not rounded, those without one last."""
    rank = np.empty(len(keys), np.int64)
    rank[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
    rows = _by_length(vectors)
    at, of, scores, done = [], [], [], np.zeros(len(queries), bool)

    def without(asked: np.ndarray, scored: np.ndarray) -> None:
        """Rows that have no score stand after the others: the k first of them by key."""
        rest = np.setdiff1d(np.arange(len(keys)), scored)
        rest = rest[np.argsort(rank[rest])][:k]
        at.append(np.repeat(asked, len(rest)))
        of.append(np.tile(rest, len(asked)))
        scores.append(np.full(len(asked) * len(rest), None, object))

    for n, (asked, q) in _by_length(queries).items():
        own, x = rows.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
        done[asked] = True
        if len(own) < len(keys):
            without(asked, own)
        if not len(own):
            continue
        if n:  # of equal vectors the k first by key are enough
            _, same = np.unique(x.view(f"V{8 * n}").ravel(), return_inverse=True)
            order = np.lexsort((rank[own], same))
            first = np.searchsorted(same[order], same[order])
            kept = np.sort(order[np.arange(len(order)) - first < k])
            own, x = own[kept], x[kept]
        reach = np.nan_to_num(np.linalg.norm(x, axis=1), nan=0.0, posinf=0.0).max()
        step = max(1, SCORES // len(own))
        for a in range(0, len(asked), step):
            y = q[a : a + step]
            s = y @ x.T
            s[np.isnan(s)] = np.inf  # NaN is the largest, as in Spark
            least = np.partition(s, len(own) - min(k, len(own)), axis=1)[:, len(own) - min(k, len(own))]
            # room for what rounding and another order of adding may change
            room = 2e-6 + 1e-12 * np.nan_to_num(np.linalg.norm(y, axis=1), nan=0.0, posinf=0.0) * reach
            i, j = np.nonzero(s >= (least - room)[:, None])
            exact = np.zeros(len(i))
            for d in range(n):
                exact += x[j, d] * y[i, d]
            order = np.lexsort((rank[own[j]], -np.where(np.isnan(exact), np.inf, _rounded(exact)), ~np.isnan(exact), i))
            i, j, exact = i[order], j[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            at.append(asked[a + i[keep]])
            of.append(own[j[keep]])
            scores.append(exact[keep].astype(object))
    without(np.flatnonzero(~done), np.zeros(0, np.int64))
    whole = np.concatenate(scores)
    return np.concatenate(at), np.concatenate(of), pa.array(whole, pa.float64(), from_pandas=False)


def union_candidates(vector_hits: DataFrame, text_hits: DataFrame, key: str = "doc_key") -> DataFrame:
    """query_id, key, place, found_by: both retrievers' hits once each, vector hits first; no scores are fused."""
    a = vector_hits.select("query_id", key, F.col("pos").alias("place"), F.lit("vector").alias("label"))
    b = text_hits.select("query_id", key, (F.col("pos") + 1_000_000).alias("place"), F.lit("bm25").alias("label"))
    return a.unionByName(b).groupBy("query_id", key).agg(F.min("place").alias("place"), F.array_sort(F.collect_set("label")).alias("found_by"))


def rerank(candidates: DataFrame, threshold: float = THRESHOLD, top: int = TOP, fallback: int = FALLBACK, order: str = "place") -> DataFrame:
    """Candidates over the threshold, at most `top`, best first; where there is none, the best `fallback` as weak.

    Ties of score keep the candidates' order.
    """
    w = Window.partitionBy("query_id")
    ranked = candidates.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), order))).withColumn("n_over", F.count_if(F.col("score") > threshold).over(w))
    keep = F.when(F.col("n_over") > 0, (F.col("score") > threshold) & (F.col("rank") <= top)).otherwise(F.col("rank") <= fallback)
    return ranked.filter(keep).withColumn("weak", F.col("n_over") == 0).drop("n_over")


def lexical_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's terms that the text holds."""
    q = terms(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, terms(text))) / F.size(q))


def paper_filter(author_key: str | None, first_author_only: bool, year_from: int | None, year_to: int | None) -> Column:
    cond = F.lit(True)
    if author_key:
        cond = cond & F.array_contains("first_author_keys" if first_author_only else "author_keys", author_key)
    if year_from is not None:
        cond = cond & (F.col("year") >= year_from)
    if year_to is not None:
        cond = cond & (F.col("year") <= year_to)
    return cond


def find_papers(papers: DataFrame, query: str | None = None, author_key: str | None = None, first_author_only: bool = False, year_from: int | None = None, year_to: int | None = None, limit: int | None = None, embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, int, str | None]:
    """(papers, total, key used). Without a query the newest first; with one the union of vector and BM25 candidates reranked, weak ones if none is good.

    papers may hold `keywords` and `embedding`; without the latter, title and abstract are embedded.

    Filters are applied before anything is scored. An author key of several words that matches nothing is tried again with its last word.
    """
    limit, embed = max(1, min(limit or 10, 25)), embed or embed_checksums
    query = (query or "").strip()
    rows = papers.filter(paper_filter(author_key, first_author_only, year_from, year_to))
    total = rows.count()
    if not total and author_key and " " in author_key:
        author_key = author_key.split()[-1]
        rows = papers.filter(paper_filter(author_key, first_author_only, year_from, year_to))
        total = rows.count()
    if not query:
        return rows.orderBy(F.col("pub_date").desc_nulls_last(), "bib").limit(limit).withColumn("weak", F.lit(False)), total, author_key
    q = rows.sparkSession.createDataFrame([(1, query)], "query_id int, query string")
    text = F.concat_ws("\n\n", "title", "abstract")
    vectors = rows.select("bib", "embedding" if "embedding" in rows.columns else embed(text).alias("embedding"))
    near = nearest(vectors, q.select("query_id", embed(F.col("query")).alias("q")), PAPER_CANDIDATES, "bib")
    hits = bm25(rows, q, {f: w for f, w in PAPER_FIELDS.items() if f in rows.columns}, "bib", PAPER_CANDIDATES)
    scored = union_candidates(near, hits, "bib").join(rows, "bib").withColumn("score", lexical_score(F.lit(query), text))
    return rerank(scored, THRESHOLD, limit, PAPER_FALLBACK, "place").drop("query_id", "found_by"), total, author_key


def fresh_only(found: DataFrame, given: DataFrame, key: str = "doc_key") -> DataFrame:
    """Documents of a follow-up that were not given before."""
    return found.join(given.select(key).distinct(), key, "left_anti")


def _embedded(c: Column, place: Callable[[Column], Column], dims: int) -> Column:
    """Counts of terms by the place (from 0) that each has, of unit length."""
    from quillstone.functions.text import let
    from quillstone.functions.values import unit

    at = F.transform(tokens(c), lambda x: F.pmod(place(x), F.lit(dims)).cast("int"))
    return unit(let(at, lambda t: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(t, lambda a: a == i)).cast("double"))))


def embed_hashing(c: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedder: hashed term counts, of unit length."""
    return _embedded(c, lambda x: F.xxhash64(x), dims)


def embed_checksums(c: Column, dims: int = 64) -> Column:
    """The same with the terms' MD5 in place of Spark's own hash, so that another engine can follow it."""
    return _embedded(c, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"), dims)
