"""Timelines of events from labelled sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import date_struct, mend_hyphens, round6, strip, topic_key
from loomline.session import cut_lineage

#: The least similarity of a paraphrase, and the events of a topic's timeline.
SIMILAR, MOST = 0.78, 30


def event_rows(labelled: DataFrame) -> DataFrame:
    """(sentence_id, doc_id, topic, event_type, year, date, confidence, sentence) of sentences that are dated events.

    One row a sentence id: the least (event_type, sentence). A plain year counts only if it is the document's.
    """
    year = F.try_to_number(F.regexp_extract(F.coalesce("year", F.lit("")), r"(?:19|20)\d{2}", 0), F.lit("9999")).cast("int")
    clean = strip(F.regexp_replace(mend_hyphens(F.regexp_replace("sentence", r"\s+", " ")), " +", " "))
    rows = labelled.where("is_event = '1' and sentence_id is not null and event_type is not null and event_type <> 'none'")
    rows = rows.select("sentence_id", "doc_id", topic_key(F.col("topic")).alias("topic"), F.lower(F.trim("event_type")).alias("event_type"), year.alias("own"), clean.alias("sentence"))
    once = rows.groupBy("sentence_id").agg(F.min(F.struct("event_type", "sentence", "doc_id", "topic", "own")).alias("r")).select("sentence_id", "r.*")
    dated = once.withColumn("d", date_struct(F.col("sentence"), F.col("own")))
    kept = dated.where("d.extracted_year is not null and (d.source <> 'sentence_plain_year' or d.extracted_year = own)")
    return kept.select("sentence_id", "doc_id", "topic", "event_type", F.col("d.extracted_year").alias("year"), F.col("d.normalized_date").alias("date"), F.col("d.confidence").alias("confidence"), "sentence")


GROUP = ["topic", "year", "event_type"]
# How an unusable sentence begins, what it holds, how it ends.
BAD_STARTS = ("published as", "proceedings of", "copyright", "figure ", "table ", "appendix", "references")
BAD_PARTS = (
    "arxiv:", "http://", "https://", "www.", "doi:", "isbn", "appendix", "more details are", "as mentioned", "what is more", "this is perhaps", "interestingly,", "besides,",
    "with regards", "dataset leakage", "kilt versions", "requiring knowledge not present", "the pretraining objective",
)
BAD_ENDS = (" vs", " vs.", " et al", " et al.", " with", " and", " or", " to", " of")
# Signs of an action, and of each type of event.
ACTIONS = (
    "propose", "proposed", "introduce", "introduced", "present", "presented", "develop", "developed", "release", "released", "evaluate", "evaluated", "outperform", "outperformed",
    "achieve", "achieved", "state-of-the-art", "benchmark", "survey", "recent", "recently", "apply", "applied", "extend", "extended",
)
SIGNS = {
    "method_proposed": ("propose", "proposed", "introduce", "introduced", "present", "presented", "develop", "developed", "framework", "method", "approach", "model"),
    "release": ("release", "released", "available", "open-source", "open source", "introducing"),
    "benchmark": ("evaluate", "evaluated", "benchmark", "outperform", "outperformed", "achieve", "achieved", "state-of-the-art", "accuracy", "score", "results"),
    "trend_application": ("recent", "recently", "trend", "survey", "apply", "applied", "extend", "extended", "used", "adopted", "focus", "progress"),
}
# Signs by which a type is inferred, the first that fits.
INFERRED = {"release": ("released", "available", "introducing"), "benchmark": ("outperform", "achieve", "benchmark", "state-of-the-art", "accuracy")}
# Signs of quality, worth 0.2 each; of an introduction by name, worth 0.45 together; by type, with their worth.
STRONG = (
    "we propose", "we introduce", "we present", "we develop", "proposed", "introduced", "presented", "developed", "our approach", "our method", "named ", "called ", "introducing ",
    "released", "outperforms", "achieves", "state-of-the-art",
)
BY_NAME = ("we introduce rag models", "refer to as retrieval-augmented generation", "approach, named react", "called distilbert", "we introduce generative agents", "called tinybert")
WORTH = {
    "release": (0.25, ("released", "available", "introducing")),
    "method_proposed": (0.25, ("we propose", "we introduce", "we present", "proposed method", "proposed approach", "introduced", "proposed")),
    "trend_application": (0.15, ("recently", "recent work", "survey", "extended", "applied")),
}
FIGURES = r"\b\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s+vs\.?\s+\d"
# Signs that let a sentence of lesser probability through, and the least probabilities.
RESCUE = (
    "we introduce", "we propose", "we present", "we develop", "our approach, named", "approach, named", "called distilbert", "called tinybert", "called react",
    "refer to as retrieval-augmented generation", "introduce generative agents",
)
LEAST, RESCUED, DATED, GOOD = 0.55, 0.35, 0.4, 0.15
# Names and order of the types.
TITLES = {"method_proposed": "Method", "release": "Release", "benchmark": "Benchmark", "trend_application": "Trend"}


def _held(c: Column, signs: tuple[str, ...]) -> Column:
    """Which of the signs the text holds; one literal, so that generated code stays small."""
    return F.filter(F.array(*map(F.lit, signs)), lambda s: F.contains(c, s))


def _any(c: Column, signs: tuple[str, ...]) -> Column:
    return F.size(_held(c, signs)) > 0


def clean_sentence(c: Column) -> Column:
    """One line without markdown marks and citations, hyphens mended, nothing but words at the ends."""
    c = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), r"[*_`#]+", "")
    c = F.regexp_replace(c, r"\[[0-9,\s-]+\]|\([A-Z][A-Za-z]+(?:\s+et\s+al\.)?,?\s+\d{4}[a-z]?\)", "")
    return F.regexp_replace(F.regexp_replace(mend_hyphens(c), r"\s+", " "), "^[ -]+|[ -]+$", "")


def infer_type(c: Column) -> Column:
    """The type of event that a sentence looks like."""
    low = F.lower(c)
    return F.when(_any(low, INFERRED["release"]), "release").when(_any(low, INFERRED["benchmark"]), "benchmark").otherwise("method_proposed")


def _years(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\b(?:19|20)\d{2}\b"))


def quality(c: Column, kind: Column) -> Column:
    """How much a sentence reads like an event of its type, from 0."""
    low = F.lower(c)
    parts = [0.2 * F.size(_held(low, STRONG)), F.when(_any(low, BY_NAME), 0.45).otherwise(0.0)]
    parts += [F.when((kind == k) & _any(low, signs), worth).otherwise(0.0) for k, (worth, signs) in WORTH.items()]
    parts += [F.when((kind == "benchmark") & low.rlike(FIGURES), 0.25).otherwise(0.0)]
    parts += [F.when(c.rlike(r"^[A-Z][A-Za-z0-9 -]{2,30}:"), -0.1).otherwise(0.0), F.when(_years(c) >= 3, -0.2).otherwise(0.0)]
    return F.greatest(F.lit(0.0), round6(reduce(lambda x, y: x + y, parts)))


def usable(c: Column, kind: Column, good: Column) -> Column:
    """Whether a cleaned sentence of that quality can stand in a timeline as an event of its type."""
    low = F.lower(c)
    first = F.regexp_extract(c, "[A-Za-z]", 0)
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    bare = F.regexp_replace(low, "[ .,:;]+$", "")
    signed = reduce(lambda x, y: x | y, ((kind == k) & _any(low, signs) for k, signs in SIGNS.items()))
    return (
        F.length(c).between(35, 520)
        & ~c.rlike(r"^\d+(?:\.\d+)*\.?\s+[A-Z]|^\d+\)\s+")
        & ((first == F.upper(first)) | low.startswith("we "))
        & ~F.exists(F.array(*map(F.lit, BAD_STARTS)), lambda s: F.startswith(low, s))
        & ~_any(low, BAD_PARTS)
        & ~F.exists(F.array(*map(F.lit, BAD_ENDS)), lambda s: F.endswith(bare, s))
        & ((F.regexp_count(c, F.lit(";")) < 3) | low.contains("recently proposed"))
        & ((_years(c) < 4) | _any(low, ACTIONS))
        & signed
        & (good >= GOOD)
        & (letters / F.greatest(F.length(c), F.lit(1)) >= 0.45)
    )


def event_title(c: Column, kind: Column) -> Column:
    """The type and the sentence, without a year it begins with, at most 95 letters long."""
    text = F.regexp_replace(strip(c), r"(?i)^(?:in|by|during|around|since|after|before)\s+\d{4},?\s+", "")
    short = F.concat(F.regexp_replace(F.substring(text, 1, 92), "[ ,.;:]+$", ""), F.lit("..."))
    name = reduce(lambda x, t: x.when(kind == t[0], t[1]), TITLES.items(), F.when(F.lit(False), "")).otherwise("Event")
    return F.concat(name, F.lit(": "), F.when(F.length(text) > 95, short).otherwise(text))


def candidates(predictions: DataFrame) -> DataFrame:
    """Predicted sentences that can stand in a timeline, with quality, representative and rank scores.

    ``predictions`` has sentence_id, doc_id, topic, year (the document's), sentence, is_event, event_probability,
    event_type, event_type_confidence. A predicted event counts from LEAST on, any sentence with a sign of RESCUE from
    RESCUED on; it needs a date of DATED, and a plain year must be the document's. Nulls count as 0 or as no text.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = predictions.withColumns({"text": clean_sentence(F.col("sentence")), "p": zero("event_probability"), "tp": zero("event_type_confidence")})
    # the likely ones first: the rules below need not see the other sentences
    rows = rows.where(F.col("p") >= min(LEAST, RESCUED)).withColumn("d", date_struct(F.col("text"), F.col("year")))
    known = F.coalesce(F.col("event_type").isin(*SIGNS), F.lit(False))
    rescue = (F.col("p") >= RESCUED) & (F.col("d.confidence") >= DATED) & _any(F.lower("text"), RESCUE)
    event = F.coalesce(F.col("is_event") == 1, F.lit(False)) & known & (F.col("p") >= LEAST)
    dated = (F.col("d.confidence") >= DATED) & F.col("d.extracted_year").isNotNull()
    own = (F.col("d.source") != "sentence_plain_year") | F.coalesce(F.col("d.extracted_year") == F.col("year"), F.lit(False))
    kept = rows.where((event | rescue) & dated & own).withColumn("kind", F.when(known, F.col("event_type")).otherwise(infer_type(F.col("text"))))
    kept = kept.withColumn("good", quality(F.col("text"), F.col("kind"))).where(usable(F.col("text"), F.col("kind"), F.col("good")))
    bonus = F.when(F.col("d.source") != "document_year", 0.08).otherwise(0.0)
    representative = round6(0.55 * F.col("p") + 0.25 * F.col("tp") + 0.20 * F.col("d.confidence") + bonus)
    out = kept.select(
        "sentence_id", "doc_id", topic_key(F.col("topic")).alias("topic"), F.col("kind").alias("event_type"), F.col("d.extracted_year").alias("year"), F.col("d.normalized_date").alias("date"),
        F.col("text").alias("sentence"), F.col("p").alias("event_probability"), F.col("tp").alias("type_confidence"), F.col("d.confidence").alias("date_confidence"),
        F.col("good").alias("quality"), representative.alias("representative"),
    )
    return out.withColumn("confidence", round6(F.col("quality") + F.col("representative")))


def _weighed(once: DataFrame) -> DataFrame:
    """(id, GROUP, term, weight, first) of each sentence's words and pairs of words: tf-idf within the group, of length one.

    ``first`` marks the rarest terms, up to where the others together are shorter than SIMILAR. Two sentences as similar as
    that share a term which is marked in both: of their common terms the rarest.
    """
    w = F.regexp_extract_all(F.lower(F.coalesce("sentence", F.lit(""))), F.lit(r"(?U)\w\w+"), 0)
    listed = once.select("id", *GROUP, "times", w.alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    terms = F.concat("w", F.filter(pairs, lambda p: p.isNotNull()))
    counted = listed.select("id", *GROUP, "times", F.explode(terms).alias("term")).groupBy("id", *GROUP, "times", "term").agg(F.count("*").alias("tf"))
    df = counted.groupBy(*GROUP, "term").agg(F.sum("times").alias("df"))
    sizes = once.groupBy(*GROUP).agg(F.sum("times").alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighed = counted.join(df, [*GROUP, "term"]).join(sizes, GROUP).withColumn("x", F.col("tf") * idf)
    own = Window.partitionBy("id")
    before = F.sum(F.col("x") * F.col("x")).over(own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    whole = weighed.withColumn("whole", F.sum(F.col("x") * F.col("x")).over(own)).withColumn("before", F.coalesce(before, F.lit(0.0)))
    marked = F.col("whole") - F.col("before") >= (SIMILAR * SIMILAR - 1e-9) * F.col("whole")
    return whole.select("id", *GROUP, "term", (F.col("x") / F.sqrt("whole")).alias("weight"), marked.alias("first"))


def similar_sentences(once: DataFrame) -> DataFrame:
    """(id, to): pairs of different sentences of a group at least SIMILAR, from the later one (by ``at``) to the earlier."""
    weighed = cut_lineage(_weighed(once))
    marked = weighed.where("first").join(once.select("id", "at"), "id").select("id", "at", *GROUP, "term")
    x = marked.select(*GROUP, "term", "id", "at")
    y = marked.select(*GROUP, "term", F.col("id").alias("to"), F.col("at").alias("to_at"))
    pairs = x.join(y, [*GROUP, "term"]).where("to_at < at").select("id", "to").distinct()
    # the product of the pair, term by term, so that no sentence is too long
    left, right = weighed.select("id", "term", "weight"), weighed.select(F.col("id").alias("to"), "term", F.col("weight").alias("other"))
    product = pairs.join(left, "id").join(right, ["to", "term"]).groupBy("id", "to").agg(F.sum(F.col("weight") * F.col("other")).alias("s"))
    return product.where(F.col("s") >= SIMILAR - 1e-9).select("id", "to")


def clusters(rows: DataFrame) -> DataFrame:
    """Events with their cluster: greedy leaders within (topic, year, event_type), the surest sentences first.

    Equal sentences of a group count as one, at the place of the surest. A sentence joins the first cluster that an earlier
    sentence at least SIMILAR to it is in, else it starts one. That is the first leader it reaches over links to earlier
    sentences, so the least leader is passed along the links until nothing changes, whatever the size of a group.
    """
    order = F.struct((-F.col("confidence")).alias("c"), F.col("sentence_id"))
    once = rows.groupBy(*GROUP, "sentence").agg(F.min(order).alias("at"), F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id())
    once = cut_lineage(once)  # so that an id stays with its sentence
    links = cut_lineage(similar_sentences(once))
    following = links.select("id").distinct().withColumn("follows", F.lit(True))
    labels = once.select("id", "at").join(following, "id", "left").select("id", F.when(F.col("follows").isNull(), F.col("at")).alias("leader"))
    labels, changed = cut_lineage(labels), not links.isEmpty()
    while changed:
        told = links.join(labels.select(F.col("id").alias("to"), "leader"), "to").groupBy("id").agg(F.min("leader").alias("told"))
        nearer = F.coalesce(F.col("told") < F.col("leader"), F.col("told").isNotNull())
        now = labels.join(told, "id", "left").select("id", F.when(nearer, F.col("told")).otherwise(F.col("leader")).alias("leader"), nearer.alias("moved"))
        now = cut_lineage(now)
        changed, labels = not now.where("moved").isEmpty(), now.drop("moved")
    named = once.join(labels, "id").select(*GROUP, "sentence", F.col("leader.sentence_id").alias("cluster"))
    same = reduce(lambda x, y: x & y, (rows[c].eqNullSafe(named[c]) for c in (*GROUP, "sentence")))
    return rows.join(named, same).select(*(rows[c] for c in rows.columns), named["cluster"])


def timeline(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The ``most`` surest events of each topic in order of time: (topic, event_id, date, year, event_type, sentence, sources, size)."""
    best = F.struct(F.col("confidence"), F.col("sentence_id"))
    events = clusters(rows).groupBy("topic", "year", "event_type", "cluster").agg(
        F.max_by("sentence", best).alias("sentence"),
        F.max_by("date", best).alias("date"),
        F.max("confidence").alias("confidence"),
        F.countDistinct("doc_id").alias("sources"),
        F.count("*").alias("size"),
    )
    top = Window.partitionBy("topic").orderBy(F.desc("confidence"), F.desc("size"), "cluster")
    kept = events.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most)
    order = Window.partitionBy("topic").orderBy("year", "date", "cluster")
    return kept.withColumn("event_id", F.format_string("%s_evt_%03d", "topic", F.row_number().over(order))).select("topic", "event_id", "date", "year", "event_type", "sentence", "sources", "size")


def ranked_timeline(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The ``most`` best events of each topic from ``candidates``, in order of time, type and rank.

    (topic, event_id, title, date, year, event_type, sentence, rank_score, sources, size, sentence_ids, doc_ids); the sentence
    with the best rank score speaks for its cluster.
    """
    best = F.struct("confidence", "event_probability", "date_confidence", "sentence_id")
    say = lambda c: F.max_by(c, best).alias(c)
    events = clusters(rows).groupBy(*GROUP, "cluster").agg(
        *(say(c) for c in ("sentence", "date", "event_probability", "date_confidence")), F.max("confidence").alias("rank_score"), F.countDistinct("doc_id").alias("sources"), F.count("*").alias("size"),
        F.array_sort(F.collect_set("sentence_id")).alias("sentence_ids"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"),
    )
    top = Window.partitionBy("topic").orderBy(F.desc("rank_score"), F.desc("event_probability"), F.desc("date_confidence"), "year", "date", "cluster")
    kept = events.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most)
    place = reduce(lambda x, t: x.when(F.col("event_type") == t[1], t[0]), enumerate(TITLES), F.when(F.lit(False), 99)).otherwise(99)
    kept = kept.withColumn("title", event_title(F.col("sentence"), F.col("event_type")))
    order = Window.partitionBy("topic").orderBy("year", "date", place, F.desc("rank_score"), "title", "cluster")
    numbered = kept.withColumn("event_id", F.format_string("%s_evt_%03d", "topic", F.row_number().over(order)))
    return numbered.select("topic", "event_id", "title", "date", "year", "event_type", "sentence", "rank_score", "sources", "size", "sentence_ids", "doc_ids")
