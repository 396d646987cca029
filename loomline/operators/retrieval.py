"""Ranked retrieval over tables of terms and vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import round6, topic_key, words
from loomline.session import shared_folder
from loomline.sources.stages import chained, fingerprint, stage

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Folders of a kept index, by hash of the term.
PARTS = 64
#: Bytes of one matrix of scores; cells of an inverted file, those a vector is in, those a query looks into, and vectors the
#: cells are fitted on.
TILE, CELLS, OWN, PROBES, SAMPLE = 1 << 26, 64, 2, 24, 20_000


def index_text() -> Column:
    """What is indexed of a document: title, topic and text."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "topic", "text")))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, dl) of every term of every document."""
    listed = docs.select(key, words(text).alias("w")).withColumn("dl", F.size("w"))
    return listed.select(key, "dl", F.explode("w").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def _idf(terms: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df) with the idf of BM25; a term in more than half of the documents has a share of the mean idf."""
    raw = terms.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # n is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw"))).drop("n", "raw", "mean")


def term_stats(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, df, idf) of all terms."""
    # a document's distinct terms, so that the count needs no second grouping
    terms = docs.select(F.explode(F.array_distinct(words(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return _idf(terms, docs.agg(F.count(key).alias("n")))


def query_terms(queries: DataFrame, key: str, text: Column) -> DataFrame:
    """Distinct (key, term) of each query: a repeated word counts once."""
    return queries.select(key, F.explode(words(text)).alias("term")).distinct()


@dataclass
class Index:
    """A kept index: postings (key, term, tf, dl, part) and statistics (term, df, idf, part), both in folders by part, and
    totals (avgdl), one row."""

    postings: DataFrame
    stats: DataFrame
    totals: DataFrame


def _part(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def build_index(docs: DataFrame, key: str, text: Column) -> Index:
    """The index of ``docs``, kept in the shared folder as long as the indexed texts are the same.

    The corpus is read once for its fingerprint and, where no index has it, once to build one. Searches read the index.
    """
    spark, rows = docs.sparkSession, docs.select(key, text.alias("text"))
    mark, folder = chained("index", PARTS, fingerprint(rows)), f"{shared_folder(spark)}/index"
    listed = lambda: postings(rows, key, F.col("text")).withColumn("part", _part("term")).repartition("part").sortWithinPartitions("term")
    held = stage(spark, f"{folder}/postings", mark, listed, "part", f"`{key}` {rows.schema[key].dataType.simpleString()}, dl int, term string, tf bigint, part int")
    n = rows.agg(F.count(key).alias("n"))
    counted = held.groupBy("part", "term").agg(F.count("*").alias("df"))
    stats = stage(spark, f"{folder}/stats", mark, lambda: _idf(counted, n).repartition("part"), "part", "term string, df bigint, idf double, part int")
    totals = stage(spark, f"{folder}/totals", mark, lambda: held.agg(F.sum("tf").alias("t")).crossJoin(n).select((F.col("t") / F.col("n")).alias("avgdl")))
    return Index(held, stats, totals)


def bm25(asked: DataFrame, index: Index, query: str, key: str) -> DataFrame:
    """(query, key, score) of every document with a term of (query, term): BM25 and the number of query terms it holds.

    Only the parts of the index that hold an asked term are read.
    """
    wanted = asked.withColumn("part", _part("term"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = wanted.join(index.stats, ["part", "term"]).join(index.postings, ["part", "term"]).crossJoin(F.broadcast(index.totals))  # one row
    return scored.groupBy(query, key).agg(round6(F.sum(part) + F.count("*")).alias("score"))


def same_topic(scores: DataFrame, queries: DataFrame, docs: DataFrame, query: str, key: str) -> DataFrame:
    """Those of (query, key, score) whose document has the query's topic; a query without a topic keeps all."""
    wanted = queries.select(query, topic_key(F.col("topic")).alias("_asked"))
    own = docs.select(key, topic_key(F.col("topic")).alias("_own"))
    return scores.join(wanted, query).join(own, key).where("_asked = '' or _asked = _own").drop("_asked", "_own")


def rerank(ranked: DataFrame, score: Callable[[Column, Column], Column], question: str, text: str, query: str, key: str, k: int) -> DataFrame:
    """The ``k`` best of (query, key, question, text) by ``score`` of question and text, any column function or pandas UDF."""
    scored = ranked.select(query, key, score(F.col(question), F.col(text)).alias("score"))
    return top_k(scored, query, key, k)


def shared_terms(question: Column, text: Column) -> Column:
    """A score for ``rerank``: the share of the question's terms that the text holds."""
    asked = F.array_distinct(words(question))
    return round6(F.coalesce(F.size(F.array_intersect(asked, words(text))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0)))


def top_k(scores: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best of each query with their rank; ties by the key. Spark drops others before it shuffles."""
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], query: str, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, key, rank) with weights."""
    parts = [x.select(query, key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for x, w in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(query, key).agg(round6(F.sum("part")).alias("score"))


def weighted(first: DataFrame, second: DataFrame, query: str, key: str, alpha: float = 0.4) -> DataFrame:
    """(1 - alpha) of the first score and alpha of the second, each over its greatest of the query."""

    def over(df: DataFrame, n: str) -> DataFrame:
        # the greatest by an aggregate, which is combined before the shuffle, and joined back
        most = df.groupBy(query).agg(F.max("score").alias("_most"))
        return df.join(most, query).select(query, key, (F.greatest(F.lit(0.0), F.col("score")) / F.col("_most")).alias(n))

    both = over(first, "x").join(over(second, "y"), [query, key], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return both.select(query, key, round6(F.when(y > 0, (1 - alpha) * x + alpha * y).otherwise(x)).alias("score"))


def term_frequency(queries: DataFrame, docs: DataFrame, query: str, question: Column, key: str) -> DataFrame:
    """Occurrences of query terms in text, title (five times) and topic (twice)."""
    asked = queries.select(query, F.explode(F.array_distinct(words(question))).alias("term"))
    fields = F.explode(F.array(*(F.struct(words(F.col(c)).alias("w"), F.lit(n).alias("n")) for c, n in (("text", 1), ("title", 5), ("topic", 2))))).alias("f")
    terms = docs.select(key, fields).select(key, "f.n", F.explode("f.w").alias("term"))
    return terms.join(asked, "term").groupBy(query, key).agg(F.sum("n").cast("double").alias("score"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 50_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` greatest inner products of each query with all vectors.

    Queries come in blocks of about ``block`` rows, each multiplied with each batch of vectors as matrices inside the tasks;
    a batch's own best ``k`` are what is shuffled. More queries make more blocks.
    """
    asked = queries.select("vec_id", "embedding")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else asked
        scored = _inner_products(part.toPandas(), vectors, k)
        found = scored if found is None else found.union(scored)
    return top_k(found.where("query_id <> vec_id").withColumn("score", round6(F.col("score"))), "query_id", "vec_id", k)


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["embedding"].tolist(), dtype=np.float64).reshape(len(frame), -1)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` greatest values of each column, in any order, with all that tie with the least of them."""
    least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if k < len(s) else s.min(axis=0)
    return s >= least


def _inner_products(part: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best ``k`` + 1 of every batch of vectors for each query of one block."""
    sent = vectors.sparkSession.sparkContext.broadcast((part["vec_id"].to_numpy(), _matrix(part)))

    def score(frames):
        own, m = sent.value
        for f in frames:
            if not len(f) or not len(own):
                continue
            x, keys = _matrix(f), f["vec_id"].to_numpy()
            wide = max(1, TILE // (8 * len(f)))
            for i in range(0, len(own), wide):
                s = x @ m[i : i + wide].T
                at, query = np.nonzero(_best(s, k + 1))
                yield pd.DataFrame({"query_id": own[i : i + wide][query], "vec_id": keys[at], "score": s[at, query]})

    return vectors.select("vec_id", "embedding").mapInPandas(score, "query_id bigint, vec_id bigint, score double")


def fit_cells(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centres of ``cells`` groups of directions, by spherical k-means over at most ``sample`` vectors by hash order."""
    few = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(few):
        return np.zeros((0, 0))
    x = _matrix(few)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _in_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Rows (vec_id, embedding) with each of their ``probes`` nearest cells."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def place(frames):
        c = sent.value
        for f in frames:
            if len(f) and len(c):
                cell = np.argsort(-(_matrix(f) @ c.T), axis=1, kind="stable")[:, :probes]
                yield f.loc[f.index.repeat(cell.shape[1])].assign(cell=cell.ravel())

    return rows.select("vec_id", "embedding").mapInPandas(place, "vec_id bigint, embedding array<float>, cell int")


def nearest_in_cells(queries: DataFrame, vectors: DataFrame, k: int = 10, cells: int = CELLS, probes: int = PROBES) -> DataFrame:
    """``nearest`` by an inverted file: each vector is in its OWN nearest cells, each query looks into its ``probes`` nearest.

    Every vector is indexed; the cells are fitted on a bounded sample. Vectors that lie outside the cells looked into are
    missed: ``nearest`` is the exact way. A hot cell is left to AQE's skew join.
    """
    centres = fit_cells(vectors, cells)
    held = _in_cells(vectors, centres, OWN)
    asked = _in_cells(queries, centres, probes).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), "cell")
    product = F.aggregate(F.zip_with("asked", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = asked.join(held, "cell").where("query_id <> vec_id").select("query_id", "vec_id", round6(product).alias("score")).distinct()
    return top_k(scored, "query_id", "vec_id", k)


def recall(found: DataFrame, exact: DataFrame, query: str, key: str) -> DataFrame:
    """(expected, found, recall) of one list of neighbours against the exact one; one row."""
    hits = exact.select(query, key).join(found.select(query, key).withColumn("hit", F.lit(1)), [query, key], "left")
    return hits.agg(F.count("*").alias("expected"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def diversify(ranked: DataFrame, query: str, key: str, k: int, pool: int, weight: float = 0.18) -> DataFrame:
    """(query, key, score, place): greedy choice by score less ``weight`` times the greatest Jaccard similarity to those chosen.

    ``ranked`` has (query, key, score, rank, terms); only the first ``pool`` of a query are looked at, so a group is bounded.
    """
    schema = ranked.select(query, key, "score").schema

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rank"])
        sets, left, out = [set(t) for t in f["terms"]], list(range(len(f))), []
        scores = f["score"].tolist()
        while left and len(out) < k:
            worth = [scores[i] - weight * max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in out), default=0.0) for i in left]
            out.append(left.pop(worth.index(max(worth))))
        return f.iloc[out].assign(place=range(1, len(out) + 1))[[query, key, "score", "place"]]

    return ranked.where(F.col("rank") <= pool).groupBy(query).applyInPandas(choose, T.StructType([*schema.fields, T.StructField("place", T.IntegerType())]))


def ranking_metrics(ranked: DataFrame, queries: DataFrame, query: str, found: str, expected: str, groups: list[str]) -> DataFrame:
    """Hit rates at 1, 3, 5, 10 and mean reciprocal rank: over all queries, and by each of ``groups``."""
    wanted = queries.select(query, F.explode(expected).alias(found)).distinct()
    first = ranked.join(wanted, [query, found]).groupBy(query).agg(F.min("rank").alias("first"))
    each = queries.select(query, *groups).join(first, query, "left")
    hit = lambda n: round6(F.avg(F.coalesce((F.col("first") <= n).cast("int"), F.lit(0)))).alias(f"hit_{n}")
    sets = [[], *([g] for g in groups)]
    columns = [F.col(g) for g in groups]
    return each.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.count("*").alias("queries"), *(hit(n) for n in (1, 3, 5, 10)), round6(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr")
    )


def expand_terms(asked: DataFrame, aliases: DataFrame, query: str) -> DataFrame:
    """(query, term) with the aliases (term, alias) of each term beside it, each once."""
    more = asked.join(aliases, "term").select(query, F.col("alias").alias("term"))
    return asked.select(query, "term").union(more).distinct()
