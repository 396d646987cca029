"""Queries over the register, labels, timelines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.text import DAMAGE, MARKUP, topic_key
from loomline.operators import classify, corpus, labelling, timeline
from loomline.plans.shared import REGISTRY, STRIP, topic_sql
from loomline.session import cut_lineage
from loomline.sources.tables import table, texts
from loomline.streaming import windows

LABELS = "labeling_candidates_sample"
_STRIP, _topic = STRIP, topic_sql


def _year(*columns: str) -> str:
    return "CAST(coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce({c}, ''), '(?:19|20)\\d{{2}}'), '')" for c in columns) + ") AS INT)"


_REGISTER = f"""SELECT doc_id, {_STRIP.format("title")} AS title, {_topic()} AS topic, {_year("year", "published_date")} AS year,
    list_filter(list_transform(string_split(authors, ';'), lambda a: {_STRIP.format("a")}), lambda a: a <> '') AS authors, source_url FROM (
    SELECT doc_id, m.* FROM (SELECT doc_id, max({{'r': coalesce(retrieved_at, ''), {", ".join(f"'{c}': coalesce({c}, '')" for c in ("title", "topic", "year", "published_date", "authors", "source_url"))}}}) AS m
    FROM metadata WHERE doc_id IS NOT NULL GROUP BY doc_id))"""


@REGISTRY.query("registered_documents", f"SELECT doc_id, title, topic, year, array_to_string(authors, '|') AS authors, source_url FROM ({_REGISTER})")
def registered_documents(spark, d):
    return corpus.register(table(spark, d, "metadata")).withColumn("authors", F.array_join("authors", "|"))


@REGISTRY.query(
    "topic_overview",
    f"""WITH r AS ({_REGISTER}), a AS (SELECT topic, count(*) AS documents, min(year) AS first_year, max(year) AS last_year FROM r GROUP BY topic),
    c AS (SELECT {_topic()} AS topic, count(*) AS chunks FROM chunks GROUP BY 1),
    l AS (SELECT {_topic()} AS topic, count(*) AS labels, count(*) FILTER (is_event = '1') AS events, count(DISTINCT sentence_id) AS sentences FROM {LABELS} GROUP BY 1)
    SELECT topic, coalesce(documents, 0) AS documents, first_year, last_year, coalesce(chunks, 0) AS chunks, coalesce(labels, 0) AS labels, coalesce(events, 0) AS events, coalesce(sentences, 0) AS sentences
    FROM a FULL JOIN c USING (topic) FULL JOIN l USING (topic)""",
)
def topic_overview(spark, d):
    docs = corpus.register(table(spark, d, "metadata")).groupBy("topic").agg(F.count("*").alias("documents"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    key = topic_key(F.col("topic")).alias("topic")
    chunks = table(spark, d, "chunks").groupBy(key).agg(F.count("*").alias("chunks"))
    labels = table(spark, d, LABELS).groupBy(key).agg(F.count("*").alias("labels"), F.count_if(F.col("is_event") == "1").alias("events"), F.countDistinct("sentence_id").alias("sentences"))
    return docs.join(chunks, "topic", "full").join(labels, "topic", "full").fillna(0, ["documents", "chunks", "labels", "events", "sentences"])


@REGISTRY.query(
    "new_candidates",
    f"""WITH k AS (SELECT DISTINCT trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM metadata),
    f AS (SELECT DISTINCT doc_id, {_topic()} AS topic, title, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS k, {_year("year", "published_date")} AS year FROM candidate_sources_p0),
    g AS (SELECT * FROM f WHERE k <> '' AND year BETWEEN 2020 AND 2024 AND k NOT IN (SELECT k FROM k)),
    o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY topic, k ORDER BY year DESC, doc_id, title) = 1)
    SELECT topic, year, doc_id, title, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year DESC, doc_id) AS place FROM o) WHERE place <= 25""",
)
def new_candidates(spark, d):
    return corpus.new_candidates(table(spark, d, "candidate_sources_p0"), table(spark, d, "metadata"), 2020, 2024, 25)


@REGISTRY.query(
    "next_numbers",
    r"SELECT prefix, max(n) + 1 AS next FROM (SELECT regexp_extract(doc_id, '^(.+)_(\d+)$', 1) AS prefix, TRY_CAST(regexp_extract(doc_id, '^(.+)_(\d+)$', 2) AS BIGINT) AS n FROM metadata WHERE regexp_matches(doc_id, '^(.+)_(\d+)$')) GROUP BY prefix",
)
def next_numbers(spark, d):
    return corpus.next_numbers(table(spark, d, "metadata"))


@REGISTRY.query(
    "document_splits",
    """WITH u AS (SELECT doc_id, CAST(CAST('0x' || left(md5('42:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM documents)
    SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split FROM u""",
)
def document_splits(spark, d):
    return corpus.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def _times(pattern: str) -> str:
    return f"len(regexp_extract_all(sentence, '(?i){pattern}'))"


_SCORE = f"2 * ({_times(labelling.DATES[0])} + {_times(labelling.DATES[1])}) + " + " + ".join(_times(rf"\b(?:{'|'.join(w)})\b") for w in (labelling.EVENT_VERBS, labelling.ENTITIES))


@REGISTRY.query("label_scores", f"SELECT DISTINCT sentence_id, CAST(s AS BIGINT) AS score, CASE WHEN s >= 3 THEN 'high' WHEN s >= 1 THEN 'medium' ELSE 'low' END AS bucket FROM (SELECT sentence_id, {_SCORE} AS s FROM {LABELS} WHERE sentence IS NOT NULL)")
def label_scores(spark, d):
    rows = table(spark, d, LABELS).where("sentence is not null").select("sentence_id", labelling.event_score(F.col("sentence")).alias("score"))
    return rows.withColumn("bucket", labelling.bucket(F.col("score"))).distinct()


#: Rows of a topic, fewest and most of a document, and size up to which a document is small.
_TARGET, _LEAST, _CAP, _SMALL = 600, 10, 100, 60
_BUDGETS = f"""b AS (SELECT *, least(n, {_LEAST}) AS floor, greatest(CASE WHEN n <= {_SMALL} THEN n ELSE least(n, {_CAP}) END - least(n, {_LEAST}), 0) AS extra FROM n),
    s AS (SELECT topic, doc, unnest(generate_series(1, extra)) AS round FROM b WHERE extra > 0),
    g AS (SELECT topic, {_TARGET} - sum(floor) AS room FROM b GROUP BY topic),
    t AS (SELECT topic, doc, count(*) AS more FROM (SELECT s.topic, doc, row_number() OVER (PARTITION BY s.topic ORDER BY round, doc) AS at_slot, room FROM s JOIN g USING (topic)) WHERE at_slot <= room GROUP BY ALL),
    u AS (SELECT b.*, row_number() OVER (PARTITION BY b.topic ORDER BY doc) AS at_doc, room FROM b JOIN g USING (topic)),
    budgets AS (SELECT topic, doc, CAST(greatest(0, floor - CASE WHEN at_doc <= -room THEN 1 ELSE 0 END) + coalesce(more, 0) AS BIGINT) AS budget FROM u LEFT JOIN t USING (topic, doc))"""


def _budgets(sizes):
    return labelling.doc_budgets(sizes, "topic", "doc", _TARGET, _LEAST, _CAP, _SMALL)


@REGISTRY.query(
    "label_budgets",
    f"""WITH n AS (SELECT {_topic()} AS topic, doc_id AS doc, count(DISTINCT sentence_id) AS n FROM {LABELS} WHERE doc_id IS NOT NULL AND sentence_id IS NOT NULL GROUP BY 1, 2),
    {_BUDGETS} SELECT topic, doc, budget FROM budgets""",
)
def label_budgets(spark, d):
    rows = table(spark, d, LABELS).where("doc_id is not null and sentence_id is not null")
    return _budgets(rows.groupBy(topic_key(F.col("topic")).alias("topic"), F.col("doc_id").alias("doc")).agg(F.countDistinct("sentence_id").alias("n")))


_KIND, _EVENT, _SENT = "lower(trim(coalesce(event_type, '')))", "trim(coalesce(is_event, ''))", "coalesce(sentence, '')"
_TYPES = ", ".join(f"'{t}'" for t in labelling.EVENT_TYPES)
_RULES = {
    "empty_sentence": f"trim({_SENT}) = ''",
    "length": f"length({_SENT}) < 20 OR length({_SENT}) > 500",
    "is_event_value": f"{_EVENT} NOT IN ('0', '1')",
    "event_type_value": f"{_KIND} NOT IN ({_TYPES})",
    "event_without_type": f"{_EVENT} = '1' AND {_KIND} IN ('none', '')",
    "type_without_event": f"{_EVENT} = '0' AND {_KIND} IN ({_TYPES}) AND {_KIND} <> 'none'",
    "no_document": "trim(coalesce(doc_id, '')) = ''",
}


_LABEL_RULES = _RULES | {
    "missing_id": "trim(coalesce(sentence_id, '')) = ''",
    "label_method_value": "trim(coalesce(label_method, '')) <> 'human'",
    "no_annotator": "trim(coalesce(annotator, '')) = ''",
}


def _share(c: str, name: str, broken: str) -> str:
    return f"SELECT '{name}', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT trim({c}) AS v, count(*) AS n, count(*) / (SELECT count(*) FROM {LABELS}) AS share FROM {LABELS} WHERE trim(coalesce({c}, '')) <> '' GROUP BY 1) WHERE {broken}"


_LABEL_SUMS = [
    f"SELECT 'repeated_id', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) - 1 AS n FROM {LABELS} WHERE sentence_id IS NOT NULL GROUP BY sentence_id)",
    _share("doc_id", "document_share", "share > 0.08"),
    _share("topic", "topic_share", "share NOT BETWEEN 0.3 AND 0.366"),
]


@REGISTRY.query("label_violations", "SELECT rule, rows FROM (" + " UNION ALL ".join([f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS rows FROM {LABELS}" for n, r in _LABEL_RULES.items()] + _LABEL_SUMS) + ") WHERE rows > 0")
def label_violations(spark, d):
    return labelling.violations(table(spark, d, LABELS), shares=True)


_DOCUMENT_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> ''))"
_EMPTY = f"coalesce(length({_STRIP.format('text')}), 0) = 0"
_NOISE = " OR ".join([f"contains(lower(text), '{m}')" for m in MARKUP] + [f"contains(text, '{m}')" for m in DAMAGE])
_DOCUMENT_RULES = {
    "no_text": "text IS NULL",
    "empty_text": f"text IS NOT NULL AND {_EMPTY}",
    "too_few_words": f"NOT {_EMPTY} AND {_DOCUMENT_WORDS} < 100",
    "few_words": f"coalesce(lower({_STRIP.format('source_type')}) IN ({', '.join(f"'{x}'" for x in labelling.LONG_SOURCES)}), false) AND {_DOCUMENT_WORDS} BETWEEN 100 AND 499",
    "noise": f"text IS NOT NULL AND ({_NOISE})",
    "no_title": "coalesce(trim(title), '') = ''",
    "no_year": "year IS NULL",
}


@REGISTRY.query("document_violations", "SELECT rule, rows FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS rows FROM documents" for n, r in _DOCUMENT_RULES.items()) + ") WHERE rows > 0")
def document_violations(spark, d):
    return labelling.document_violations(texts(spark, d, "documents"))


@REGISTRY.query(
    "sentence_violations",
    f"""SELECT rule, rows FROM (SELECT 'unknown_document' AS rule, count(*) AS rows FROM {LABELS} l WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM metadata m WHERE m.doc_id = l.doc_id)
    UNION ALL SELECT 'unknown_chunk', count(*) FROM {LABELS} l WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = l.chunk_id)) WHERE rows > 0""",
)
def sentence_violations(spark, d):
    return labelling.sentence_violations(table(spark, d, LABELS), table(spark, d, "metadata"), table(spark, d, "chunks"))


@REGISTRY.query("label_titles", f"WITH r AS ({_REGISTER}) SELECT DISTINCT sentence_id, l.doc_id, r.title AS registered_title, r.source_url AS registered_url FROM {LABELS} l LEFT JOIN r ON r.doc_id = l.doc_id WHERE sentence_id IS NOT NULL")
def label_titles(spark, d):
    """Labelled sentences with the registered title of their document."""
    rows = table(spark, d, LABELS).where("sentence_id is not null").select("sentence_id", "doc_id").distinct()
    return corpus.with_titles(rows, corpus.register(table(spark, d, "metadata"))).select("sentence_id", "doc_id", "registered_title", "registered_url")


@REGISTRY.query(
    "loaded_documents",
    """SELECT doc_id, coalesce(n, 0) AS texts, CASE WHEN n > 0 THEN 'loaded' ELSE 'missing' END AS status FROM (SELECT DISTINCT doc_id FROM metadata WHERE doc_id IS NOT NULL)
    LEFT JOIN (SELECT ref_doc_id AS doc_id, count(*) AS n FROM documents WHERE ref_doc_id IS NOT NULL GROUP BY 1) USING (doc_id)""",
)
def loaded_documents(spark, d):
    return corpus.loaded(corpus.register(table(spark, d, "metadata")), table(spark, d, "documents"))


@REGISTRY.query("renumbered_documents", f"WITH r AS ({_REGISTER}) SELECT doc_id, format('{{}}_{{:04d}}', topic, row_number() OVER (PARTITION BY topic ORDER BY doc_id)) AS new_id FROM r")
def renumbered_documents(spark, d):
    return corpus.renumbered(corpus.register(table(spark, d, "metadata")))


@REGISTRY.query("large_documents", "SELECT doc_id, rows, floor(rows / total * 1e6 + 0.5) / 1e6 AS share FROM (SELECT doc_id, count(*) AS rows, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM chunks GROUP BY doc_id) WHERE rows > total * 0.08")
def large_documents(spark, d):
    return labelling.doc_shares(table(spark, d, "chunks"))


@REGISTRY.query("unregistered_chunks", "SELECT chunk_id, doc_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM metadata m WHERE m.doc_id = c.doc_id)")
def unregistered_chunks(spark, d):
    return labelling.integrity(table(spark, d, "chunks").select("chunk_id", "doc_id"), table(spark, d, "metadata"), "doc_id").select("chunk_id", "doc_id")


@REGISTRY.query("unchunked_labels", f"SELECT sentence_id, chunk_id FROM {LABELS} l WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = l.chunk_id)")
def unchunked_labels(spark, d):
    return labelling.integrity(table(spark, d, LABELS).select("sentence_id", "chunk_id"), table(spark, d, "chunks"), "chunk_id").select("sentence_id", "chunk_id")


_CONFUSION = f"""SELECT truth, guess, count(*) AS rows FROM (SELECT sentence_id, min(is_event) AS truth FROM {LABELS} WHERE label_method = 'human' GROUP BY 1)
    JOIN (SELECT sentence_id, min(is_event) AS guess FROM {LABELS} WHERE label_method = 'model_assist' GROUP BY 1) USING (sentence_id) WHERE truth IS NOT NULL AND guess IS NOT NULL GROUP BY ALL"""


def _agreement(spark, d):
    return labelling.agreement(table(spark, d, LABELS), "sentence_id", "is_event", "label_method", "human", "model_assist")


@REGISTRY.query("label_confusion", _CONFUSION)
def label_confusion(spark, d):
    return _agreement(spark, d)


@REGISTRY.query(
    "label_agreement",
    f"""WITH c AS ({_CONFUSION}), t AS (SELECT truth AS label, sum(rows) AS support FROM c GROUP BY 1), g AS (SELECT guess AS label, sum(rows) AS guessed FROM c GROUP BY 1),
    j AS (SELECT label, coalesce(support, 0) AS s, coalesce(guessed, 0) AS g, coalesce((SELECT sum(rows) FROM c WHERE truth = label AND guess = label), 0) AS h FROM t FULL JOIN g USING (label))
    SELECT label, CAST(s AS BIGINT) AS support, floor(coalesce(h / nullif(g, 0), 0) * 1e6 + 0.5) / 1e6 AS precision, floor(coalesce(h / nullif(s, 0), 0) * 1e6 + 0.5) / 1e6 AS recall, floor(coalesce(2 * h / nullif(s + g, 0), 0) * 1e6 + 0.5) / 1e6 AS f1 FROM j""",
)
def label_agreement(spark, d):
    return labelling.class_metrics(_agreement(spark, d))


_SECOND = f"""WITH o AS (SELECT sentence_id, annotator, min(is_event) AS label FROM {LABELS} WHERE sentence_id IS NOT NULL AND annotator IS NOT NULL AND is_event IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT sentence_id, min(annotator) AS j, min_by(label, annotator) AS truth FROM o GROUP BY 1)
    SELECT truth, label AS guess, count(*) AS rows FROM o JOIN f USING (sentence_id) WHERE annotator <> j GROUP BY ALL"""


@REGISTRY.query("second_labels", _SECOND)
def second_labels(spark, d):
    """Labels of the second and later annotators of a sentence against those of the first."""
    return labelling.second_labels(table(spark, d, LABELS), "sentence_id", "is_event", "annotator")


def _scores_sql(confusion: str) -> str:
    six = lambda x, n: f"floor(({x}) * 1e6 + 0.5) / 1e6 AS {n}"
    over = lambda x: f"sum({x} * s) / sum(s)"
    return f"""WITH c AS ({confusion}), l AS (SELECT DISTINCT unnest([truth, guess]) AS label FROM c),
    k AS (SELECT label, coalesce((SELECT sum(rows) FROM c WHERE truth = label), 0)::DOUBLE AS s, coalesce((SELECT sum(rows) FROM c WHERE guess = label), 0)::DOUBLE AS g,
      coalesce((SELECT sum(rows) FROM c WHERE truth = label AND guess = label), 0)::DOUBLE AS h FROM l),
    e AS (SELECT s, h, coalesce(h / nullif(g, 0), 0) AS p, coalesce(h / nullif(s, 0), 0) AS r, coalesce(2 * h / nullif(s + g, 0), 0) AS f FROM k)
    SELECT CAST(sum(s) AS BIGINT) AS rows, {six("sum(h) / sum(s)", "accuracy")}, {six("avg(p)", "macro_precision")}, {six("avg(r)", "macro_recall")}, {six("avg(f)", "macro_f1")},
    {six(over("p"), "weighted_precision")}, {six(over("r"), "weighted_recall")}, {six(over("f"), "weighted_f1")} FROM e HAVING sum(s) > 0"""


@REGISTRY.query("second_label_scores", _scores_sql(_SECOND))
def second_label_scores(spark, d):
    return classify.scores(second_labels(spark, d).withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


@REGISTRY.query("timeline_events")
def timeline_events(spark, d):
    return timeline.timeline(timeline.event_rows(table(spark, d, LABELS)))


@REGISTRY.query("timeline_candidates")
def timeline_candidates(spark, d):
    """Predicted sentences that can stand in a timeline, with their scores."""
    return timeline.candidates(classify.predicted_rows(table(spark, d, LABELS)))


@REGISTRY.query("predicted_timeline")
def predicted_timeline(spark, d):
    return timeline.ranked_timeline(timeline_candidates(spark, d))


@REGISTRY.query("prediction_summary")
def prediction_summary(spark, d):
    rows = classify.predicted_rows(table(spark, d, LABELS))
    return classify.summary(rows.withColumn("topic", topic_key(F.col("topic"))))


@REGISTRY.query("topic_predictions")
def topic_predictions(spark, d):
    """The thirty surest predicted events of each topic."""
    rows = classify.predicted_rows(table(spark, d, LABELS)).where("is_event = 1").select("sentence_id", "topic", "event_probability", "event_type", "event_type_confidence", "sentence")
    return corpus.newest(rows, topic_key(F.col("topic")), [F.desc("event_probability"), F.desc("event_type_confidence"), "sentence_id"], 30)


@REGISTRY.query("classifier_scores")
def classifier_scores(spark, d):
    """Accuracy, macro and weighted scores of the event model and the type model by split."""
    rows = classify.labelled_sentences(table(spark, d, LABELS))
    found = cut_lineage(classify.predict(rows, classify.kept_models(rows)))
    truth = rows.select("sentence_id", F.col("label").cast("int").cast("string").alias("event"), F.col("event_type").alias("kind"))
    both = found.join(truth, "sentence_id")
    event = both.select(F.lit("event").alias("model"), "split", F.col("event").alias("truth"), F.col("is_event").cast("string").alias("guess"))
    kind = both.where(F.col("kind").isin(*classify.TYPES) & (F.col("event") == "1") & (F.col("is_event") == 1)).select(F.lit("event_type").alias("model"), "split", F.col("kind").alias("truth"), F.col("event_type").alias("guess"))
    return classify.scores(event.union(kind).groupBy("model", "split", "truth", "guess").agg(F.count("*").alias("rows")), ["model", "split"])


@REGISTRY.query("event_predictions")
def event_predictions(spark, d):
    return classify.predict_events(table(spark, d, LABELS))


@REGISTRY.query(
    "event_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, count(DISTINCT user_id) AS users, floor(sum(value) * 1e3 + 0.5) / 1e3 AS total
    FROM events WHERE ts IS NOT NULL GROUP BY ALL""",
)
def event_windows(spark, d):
    return windows.hourly(table(spark, d, "events"))


@REGISTRY.query(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS began, count(*) AS events FROM s GROUP BY user_id, s""",
)
def sessions(spark, d):
    return windows.sessions(table(spark, d, "events"))


_LABEL_ROWS = f"SELECT DISTINCT {_topic()} AS topic, doc_id AS doc, sentence_id, sentence FROM {LABELS} WHERE doc_id IS NOT NULL AND sentence_id IS NOT NULL"


@REGISTRY.query(
    "label_sample",
    f"""WITH r AS (SELECT topic, doc, sentence_id, max({_SCORE}) AS s FROM ({_LABEL_ROWS}) WHERE sentence IS NOT NULL GROUP BY ALL),
    k AS (SELECT topic, doc, sentence_id, CASE WHEN s >= 3 THEN 'high' WHEN s >= 1 THEN 'medium' ELSE 'low' END AS bucket, md5('42:' || sentence_id) AS h FROM r),
    n AS (SELECT topic, doc, count(*) AS n FROM k GROUP BY ALL), {_BUDGETS},
    o AS (SELECT k.*, budget, row_number() OVER (PARTITION BY topic, doc, bucket ORDER BY h, sentence_id) AS r FROM k JOIN budgets USING (topic, doc)),
    q AS (SELECT *, CASE bucket WHEN 'high' THEN floor(budget * 0.4::DOUBLE + 0.5) WHEN 'medium' THEN floor(budget * 0.3::DOUBLE + 0.5) ELSE budget - floor(budget * 0.4::DOUBLE + 0.5) - floor(budget * 0.3::DOUBLE + 0.5) END AS quota FROM o WHERE r <= budget),
    z AS (SELECT *, row_number() OVER (PARTITION BY topic, doc ORDER BY CASE WHEN r > quota THEN 1 ELSE 0 END, CASE bucket WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, h, sentence_id) AS z FROM q)
    SELECT topic, doc, sentence_id, bucket FROM z WHERE z <= budget""",
)
def label_sample(spark, d):
    rows = table(spark, d, LABELS).where("doc_id is not null and sentence_id is not null and sentence is not null")
    scored = rows.groupBy(topic_key(F.col("topic")).alias("topic"), F.col("doc_id").alias("doc"), "sentence_id").agg(F.max(labelling.event_score(F.col("sentence"))).alias("s"))
    scored = scored.select("topic", "doc", "sentence_id", labelling.bucket(F.col("s")).alias("bucket"))
    budgets = cut_lineage(_budgets(scored.groupBy("topic", "doc").agg(F.count("*").alias("n"))))
    return labelling.draw_by_bucket(scored, budgets, "topic", "doc", "sentence_id")


_CHUNK_RULES = {
    "no_text": f"coalesce(length({_STRIP.format('text')}), 0) = 0",
    "no_position": "start_char IS NULL OR end_char IS NULL",
    "negative_start": "start_char < 0",
    "end_before_start": "end_char <= start_char",
    "length_differs": "end_char - start_char <> length(text)",
    "too_long": "length(text) > 1000",
    "number": "coalesce(chunk_index, 0) < 1",
    "no_document": "doc_id IS NULL",
}


@REGISTRY.query("chunk_violations", "SELECT rule, rows FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS rows FROM chunks" for n, r in _CHUNK_RULES.items()) + ") WHERE rows > 0")
def chunk_violations(spark, d):
    return labelling.chunk_violations(table(spark, d, "chunks"))


@REGISTRY.query("repeated_chunks", "SELECT chunk_id, count(*) AS times FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1")
def repeated_chunks(spark, d):
    return labelling.repeated(table(spark, d, "chunks"), "chunk_id")


@REGISTRY.query("repeated_registrations", "SELECT doc_id, count(*) AS times FROM metadata WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1")
def repeated_registrations(spark, d):
    return labelling.repeated(table(spark, d, "metadata"), "doc_id")


@REGISTRY.query("texts_missing", "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM metadata WHERE doc_id IS NOT NULL) m WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.ref_doc_id = m.doc_id)")
def texts_missing(spark, d):
    """Registered documents that no text was loaded for."""
    loaded = table(spark, d, "documents").select(F.col("ref_doc_id").alias("doc_id"))
    return labelling.integrity(table(spark, d, "metadata").where("doc_id is not null").select("doc_id").distinct(), loaded, "doc_id")


@REGISTRY.query(
    "newest_documents",
    f"""SELECT doc_id, group_key, ingested_at, CAST(place AS INT) AS place FROM (SELECT doc_id, ingested_at, {_topic()} AS group_key,
    row_number() OVER (PARTITION BY {_topic()} ORDER BY ingested_at DESC NULLS LAST, doc_id) AS place FROM documents) WHERE place <= 30""",
)
def newest_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "ingested_at", "topic")
    return corpus.newest(rows, topic_key(F.col("topic")), [F.desc_nulls_last("ingested_at"), "doc_id"], 30).select("doc_id", "group_key", "ingested_at", "place")


@REGISTRY.query(
    "label_summary",
    f"""SELECT {_topic()} AS topic, lower(trim(coalesce(event_type, ''))) AS event_type, count(*) AS rows, count(*) FILTER (is_event = '1') AS events,
    count(DISTINCT sentence_id) AS sentences FROM {LABELS} GROUP BY GROUPING SETS ((), (1), (1, 2))""",
)
def label_summary(spark, d):
    rows = table(spark, d, LABELS).select(topic_key(F.col("topic")).alias("topic"), F.lower(F.trim(F.coalesce("event_type", F.lit("")))).alias("event_type"), "is_event", "sentence_id")
    return rows.rollup("topic", "event_type").agg(F.count("*").alias("rows"), F.count_if(F.col("is_event") == "1").alias("events"), F.countDistinct("sentence_id").alias("sentences"))


@REGISTRY.query(
    "split_seeds",
    f"""WITH r AS (SELECT doc_id, {_topic()} AS topic, event_type FROM {LABELS} WHERE doc_id IS NOT NULL AND event_type IS NOT NULL),
    c AS (SELECT doc_id, topic, event_type, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT count(*) AS total, count(DISTINCT event_type) AS labels, count(DISTINCT topic) AS groups FROM r),
    s AS (SELECT *, unnest(generate_series(42, 61)) AS seed FROM c),
    u AS (SELECT *, CAST(CAST('0x' || left(md5(seed || ':' || doc_id), 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM s),
    b AS (SELECT seed, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split, n, topic, event_type FROM u),
    g AS (SELECT seed, split, sum(n) AS n, count(DISTINCT event_type) AS l, count(DISTINCT topic) AS g FROM b GROUP BY ALL),
    o AS (SELECT seed, sum(CASE split WHEN 'train' THEN 1000 ELSE 80 END * (labels - l) + 20 * (groups - g) + 100 * abs(n::DOUBLE / total - CASE split WHEN 'train' THEN 0.7::DOUBLE ELSE 0.15::DOUBLE END)) AS loss, count(*) AS splits FROM g, t GROUP BY seed)
    SELECT CAST(seed AS INT) AS seed, floor((-loss - 10000 * (3 - splits)) * 1e6 + 0.5) / 1e6 AS score FROM o""",
)
def split_seeds(spark, d):
    rows = table(spark, d, LABELS).where("doc_id is not null and event_type is not null").select("doc_id", topic_key(F.col("topic")).alias("topic"), "event_type")
    return corpus.choose_split(rows, "doc_id", "topic", "event_type", range(42, 62))
