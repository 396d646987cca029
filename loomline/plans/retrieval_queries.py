"""Queries of ranked retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions.text import STOP_WORDS, WORD, round6, words
from loomline.operators import retrieval as R
from loomline.operators import segments
from loomline.plans.shared import REGISTRY, topic_sql
from loomline.plans.text_queries import _SENTENCES
from loomline.sources.tables import table, texts

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _words(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '{WORD}'), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


_TEXT = "concat_ws(' ', coalesce(title, ''), coalesce(topic, ''), coalesce(text, ''))"
_STATS = f"""d AS (SELECT doc_id, {_words(_TEXT)} AS w FROM documents),
    t AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM d) GROUP BY term),
    n AS (SELECT count(*) AS n FROM d), r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM t, n),
    st AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM r) * 0.25 ELSE raw END AS idf FROM r)"""
_ASKED = f"SELECT DISTINCT qid, unnest({_words('question')}) AS term FROM retrieval_eval"


def _bm25(asked: str) -> str:
    return f"""{_STATS}, q AS ({asked}),
    p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
    a AS (SELECT avg(len(w)) AS avgdl FROM d),
    s AS (SELECT qid, doc_id, floor((sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) + count(*)) * 1e6 + 0.5) / 1e6 AS score
      FROM q JOIN st USING (term) JOIN tf USING (term), a GROUP BY qid, doc_id)"""


_BM25 = _bm25(_ASKED)


def _rank(source: str, k: int, columns: str = "qid, doc_id, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM {source}) WHERE rank <= {k}"


def _index(spark, d):
    return R.build_index(texts(spark, d, "documents"), "doc_id", R.index_text())


def _scores(spark, d):
    return R.bm25(R.query_terms(table(spark, d, "retrieval_eval"), "qid", F.col("question")), _index(spark, d), "qid", "doc_id")


@REGISTRY.query("term_stats", f"WITH {_STATS} SELECT term, df, floor(idf * 1e6 + 0.5) / 1e6 AS idf FROM st")
def term_stats(spark, d):
    return _index(spark, d).stats.select("term", "df", round6(F.col("idf")).alias("idf"))


@REGISTRY.query("index_postings", f"WITH d AS (SELECT doc_id, {_words(_TEXT)} AS w FROM documents) SELECT doc_id, term, CAST(dl AS INT) AS dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL")
def index_postings(spark, d):
    return _index(spark, d).postings.select("doc_id", "term", "dl", "tf")


@REGISTRY.query("bm25_topk", f"WITH {_BM25} {_rank('s', 10)}")
def bm25_topk(spark, d):
    return R.top_k(_scores(spark, d), "qid", "doc_id", 10)


_TF = f"""f AS (SELECT doc_id, 1 AS n, unnest({_words("coalesce(text, '')")}) AS term FROM documents UNION ALL SELECT doc_id, 5, unnest({_words("coalesce(title, '')")}) FROM documents
    UNION ALL SELECT doc_id, 2, unnest({_words("coalesce(topic, '')")}) FROM documents),
    fq AS (SELECT DISTINCT qid, unnest({_words("question")}) AS term FROM retrieval_eval),
    fs AS (SELECT qid, doc_id, CAST(sum(n) AS DOUBLE) AS score FROM f JOIN fq USING (term) GROUP BY qid, doc_id)"""


def _tf(spark, d):
    return R.term_frequency(table(spark, d, "retrieval_eval"), texts(spark, d, "documents"), "qid", F.col("question"), "doc_id")


@REGISTRY.query("term_frequency_topk", f"WITH {_TF} {_rank('fs', 10)}")
def term_frequency_topk(spark, d):
    return R.top_k(_tf(spark, d), "qid", "doc_id", 10)


@REGISTRY.query(
    "rank_fusion",
    f"""WITH {_BM25}, {_TF}, x AS ({_rank("s", 100)}), y AS ({_rank("fs", 100)}),
    z AS (SELECT qid, doc_id, floor(sum(part) * 1e6 + 0.5) / 1e6 AS score FROM (SELECT qid, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM x UNION ALL SELECT qid, doc_id, 0.4::DOUBLE / (60 + rank) FROM y) GROUP BY ALL)
    {_rank("z", 10)}""",
)
def rank_fusion(spark, d):
    lists = [(R.top_k(_scores(spark, d), "qid", "doc_id", 100), 1.0), (R.top_k(_tf(spark, d), "qid", "doc_id", 100), 0.4)]
    return R.top_k(R.fuse(lists, "qid", "doc_id"), "qid", "doc_id", 10)


@REGISTRY.query(
    "weighted_fusion",
    f"""WITH {_BM25}, {_TF}, x AS (SELECT qid, doc_id, greatest(0, score) / max(score) OVER (PARTITION BY qid) AS x FROM s),
    y AS (SELECT qid, doc_id, greatest(0, score) / max(score) OVER (PARTITION BY qid) AS y FROM fs),
    z AS (SELECT qid, doc_id, floor((CASE WHEN coalesce(y, 0) > 0 THEN (1 - 0.4::DOUBLE) * coalesce(x, 0) + 0.4::DOUBLE * y ELSE coalesce(x, 0) END) * 1e6 + 0.5) / 1e6 AS score FROM x FULL JOIN y USING (qid, doc_id))
    {_rank("z", 10)}""",
)
def weighted_fusion(spark, d):
    return R.top_k(R.weighted(_scores(spark, d), _tf(spark, d), "qid", "doc_id"), "qid", "doc_id", 10)


def _documents_found(spark, d):
    """The first rank of each registered document among the ten best rows of a question."""
    ids = texts(spark, d, "documents").select("doc_id", F.col("ref_doc_id").alias("found"))
    ranked = R.top_k(_scores(spark, d), "qid", "doc_id", 10).join(ids, "doc_id").where("found is not null")
    return ranked.groupBy("qid", "found").agg(F.min("rank").alias("rank"))


@REGISTRY.query(
    "retrieval_metrics",
    f"""WITH {_BM25}, x AS ({_rank("s", 10)}), w AS (SELECT DISTINCT qid, unnest(expected_doc_ids) AS found FROM retrieval_eval),
    h AS (SELECT x.qid, min(rank) AS first FROM x JOIN documents ON documents.doc_id = x.doc_id JOIN w ON w.qid = x.qid AND w.found = ref_doc_id GROUP BY x.qid),
    e AS (SELECT qid, topic, intent, first FROM retrieval_eval LEFT JOIN h USING (qid))
    SELECT topic, intent, count(*) AS queries, {", ".join(f"floor(avg(CASE WHEN first <= {k} THEN 1 ELSE 0 END) * 1e6 + 0.5) / 1e6 AS hit_{k}" for k in (1, 3, 5, 10))},
    floor(avg(coalesce(1.0::DOUBLE / first, 0)) * 1e6 + 0.5) / 1e6 AS mrr FROM e GROUP BY GROUPING SETS ((), (topic), (intent))""",
)
def retrieval_metrics(spark, d):
    return R.ranking_metrics(_documents_found(spark, d), table(spark, d, "retrieval_eval"), "qid", "found", "expected_doc_ids", ["topic", "intent"])


@REGISTRY.query("diverse_topk")
def diverse_topk(spark, d):
    docs = texts(spark, d, "documents")
    ranked = R.top_k(_scores(spark, d), "qid", "doc_id", 30).join(docs.select("doc_id", F.array_distinct(words(R.index_text())).alias("terms")), "doc_id")
    return R.diversify(ranked, "qid", "doc_id", 5, 30)


@REGISTRY.query(
    "vector_topk",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, floor(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS score
      FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 10""",
)
def vector_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return R.nearest(vectors.where("vec_id % 100 = 0"), vectors)


@REGISTRY.query(
    "extracted_answers",
    f"""WITH {_BM25}, x AS ({_rank("s", 3)}), sn AS ({_SENTENCES}),
    qt AS (SELECT DISTINCT qid, unnest({_words("question")}) AS term FROM retrieval_eval),
    stm AS (SELECT DISTINCT x.qid, x.rank, sn.doc_id, sentence_index, text, unnest({_words("text")}) AS term FROM x JOIN sn ON sn.doc_id = x.doc_id),
    o AS (SELECT qid, rank, doc_id, sentence_index, text, count(*) AS shared FROM stm JOIN qt USING (qid, term) GROUP BY ALL)
    SELECT qid, doc_id, sentence_index, text, shared, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, rank, sentence_index) AS place FROM o) WHERE place <= 3""",
)
def extracted_answers(spark, d):
    """Of the three best documents the three sentences that share most terms with the question."""
    best = R.top_k(_scores(spark, d), "qid", "doc_id", 3).select("qid", "doc_id", F.col("rank").alias("doc_rank"))
    docs = texts(spark, d, "documents")
    picked = docs.join(best.select("doc_id").distinct(), "doc_id", "left_semi")
    held = segments.sentences(picked, ["doc_id"]).withColumn("w", F.array_distinct(words(F.col("text"))))
    asked = table(spark, d, "retrieval_eval").select("qid", F.array_distinct(words(F.col("question"))).alias("q"))
    both = held.join(best, "doc_id").join(asked, "qid").withColumn("shared", F.size(F.array_intersect("w", "q")).cast("bigint")).where("shared > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("shared"), "doc_rank", "sentence_index")
    return both.withColumn("place", F.row_number().over(order)).where("place <= 3").select("qid", "doc_id", "sentence_index", "text", "shared", "place")


_ALIASES = f"""SELECT DISTINCT w[1] AS term, unnest(w[2:]) AS alias FROM (SELECT DISTINCT {_words("coalesce(title, '')")} AS w FROM metadata WHERE title IS NOT NULL) WHERE len(w) > 1"""
_EXPANDED = f"SELECT qid, term FROM ({_ASKED}) UNION SELECT qid, alias FROM ({_ASKED}) JOIN ({_ALIASES}) USING (term)"


@REGISTRY.query("expanded_terms", _EXPANDED)
def expanded_terms(spark, d):
    """Question terms with the other words of titles that begin with one of them."""
    titles = table(spark, d, "metadata").select(words(F.col("title")).alias("w")).where(F.size("w") > 1)
    aliases = titles.select(F.col("w")[0].alias("term"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("alias")).distinct()
    return R.expand_terms(R.query_terms(table(spark, d, "retrieval_eval"), "qid", F.col("question")), aliases, "qid")


@REGISTRY.query("expanded_topk", f"WITH {_bm25(_EXPANDED)} {_rank('s', 10)}")
def expanded_topk(spark, d):
    """BM25 of the expanded questions."""
    return R.top_k(R.bm25(expanded_terms(spark, d), _index(spark, d), "qid", "doc_id"), "qid", "doc_id", 10)


_SAME_TOPIC = f"x AS (SELECT s.* FROM s JOIN (SELECT qid, {topic_sql()} AS asked FROM retrieval_eval) USING (qid) JOIN (SELECT doc_id, {topic_sql()} AS own FROM documents) USING (doc_id) WHERE asked = '' OR asked = own)"


@REGISTRY.query("topic_topk", f"WITH {_BM25}, {_SAME_TOPIC} {_rank('x', 10)}")
def topic_topk(spark, d):
    """BM25 among the documents of the question's topic."""
    scores = R.same_topic(_scores(spark, d), table(spark, d, "retrieval_eval"), table(spark, d, "documents"), "qid", "doc_id")
    return R.top_k(scores, "qid", "doc_id", 10)


@REGISTRY.query(
    "reranked_topk",
    f"""WITH {_BM25}, x AS ({_rank("s", 30)}), v AS (SELECT qid, x.doc_id, list_distinct({_words("question")}) AS a, {_words(_TEXT.replace("topic", "documents.topic"))} AS w
      FROM x JOIN retrieval_eval USING (qid) JOIN documents ON documents.doc_id = x.doc_id),
    y AS (SELECT qid, doc_id, floor(coalesce(len(list_filter(a, lambda t: list_contains(w, t))) / nullif(len(a), 0), 0) * 1e6 + 0.5) / 1e6 AS score FROM v)
    {_rank("y", 10)}""",
)
def reranked_topk(spark, d):
    """The best thirty by BM25 in the order of the share of question terms that they hold."""
    docs = texts(spark, d, "documents").select("doc_id", R.index_text().alias("text"))
    asked = table(spark, d, "retrieval_eval").select("qid", "question")
    ranked = R.top_k(_scores(spark, d), "qid", "doc_id", 30).select("qid", "doc_id").join(docs, "doc_id").join(asked, "qid")
    return R.rerank(ranked, R.shared_terms, "question", "text", "qid", "doc_id", 10)


@REGISTRY.query("vector_cells_topk")
def vector_cells_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return R.nearest_in_cells(vectors.where("vec_id % 100 = 0"), vectors)


@REGISTRY.query("vector_cells_recall")
def vector_cells_recall(spark, d):
    return R.recall(vector_cells_topk(spark, d), vector_topk(spark, d), "query_id", "vec_id")
