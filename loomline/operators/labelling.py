"""Choosing and checking sentences for labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import noise_markers, round6, strip, word_count
from loomline.operators.segments import global_numbers

# Verbs of events.
EVENT_VERBS = (
    "propose proposed proposes proposing introduce introduced introduces introducing release released releases releasing publish published publishes "
    "announce announced announces launch launched launches develop developed develops outperform outperformed outperforms evaluate evaluated evaluates "
    "benchmark benchmarks apply applied applies integrate integrated integrates deploy deployed deploys present presented presents"
).split()
# Names whose mention makes an event likely.
ENTITIES = (
    "BERT GPT LLM Transformer DistilBERT MobileBERT TinyBERT MiniLM AutoGPT BabyAGI AutoGen REALM DPR RETRO Atlas Self-RAG FLARE CRAG LangChain LangGraph "
    "LlamaIndex HotpotQA FEVER GLUE SQuAD TriviaQA MMLU GSM8k HumanEval"
).split()
# Dates that count as a sign of an event.
DATES = (r"\b(?:19|20)\d{2}\b", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? (?:19|20)\d{2}\b")
# Label sets.
EVENT_TYPES = ("method_proposed", "release", "benchmark", "trend_application", "none")
LENGTHS, DOC_SHARE, TOPIC_SHARE = (20, 500), 0.08, (0.3, 0.366)
LABEL_METHODS = ("human",)
LONG_SOURCES = ("paper", "survey", "blog", "docs", "github")


def event_score(c: Column) -> Column:
    """Two for each date, one for each event verb and each name of a sentence, in any case of letters."""
    count = lambda pattern: F.regexp_count(c, F.lit(f"(?i){pattern}"))
    words = [rf"\b(?:{'|'.join(w)})\b" for w in (EVENT_VERBS, ENTITIES)]
    return (2 * (count(DATES[0]) + count(DATES[1])) + count(words[0]) + count(words[1])).cast("bigint")


def bucket(score: Column) -> Column:
    return F.when(score >= 3, "high").when(score >= 1, "medium").otherwise("low")


def doc_budgets(sizes: DataFrame, group: str, doc: str, target: int, least: int = 10, cap: int = 100, small: int = 60) -> DataFrame:
    """(group, doc, budget): ``target`` rows of each group shared out among its docs (group, doc, n), round by round.

    Every doc gets min(n, least) first; then docs take one more each in the order of their ids, up to ``cap`` (all of a doc
    of at most ``small`` rows), until the target is reached. A doc's extra rows become slots, and the slots of all docs
    are taken by round and id. If the least ones alone are more than the target, each doc in the order of ids gives up one,
    until the target is met or all have.
    """
    floor = F.least("n", F.lit(least))
    most = F.when(F.col("n") <= small, F.col("n")).otherwise(F.least("n", F.lit(cap)))
    base = sizes.withColumn("floor", floor).withColumn("extra", F.greatest(most - floor, F.lit(0)))
    given = base.groupBy(group).agg((F.lit(target) - F.sum("floor")).alias("left"))
    # by round: how many docs still take part; rounds are few, so slots need no global sort
    rounds = base.where("extra > 0").select(group, F.explode(F.sequence(F.lit(1), F.col("extra").cast("int"))).alias("round")).groupBy(group, "round").agg(F.count("*").alias("docs"))
    before = Window.partitionBy(group).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    filled = rounds.withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0))).join(given, group)
    whole = filled.groupBy(group).agg(
        F.max(F.when(F.col("before") + F.col("docs") <= F.col("left"), F.col("round")).otherwise(0)).alias("full"),
        F.max(F.when((F.col("before") < F.col("left")) & (F.col("before") + F.col("docs") > F.col("left")), F.col("left") - F.col("before")).otherwise(0)).alias("rest"),
    )
    joined = base.join(whole, group, "left").fillna(0, ["full", "rest"])
    # of the round that is begun but not filled: the first docs, at most `target` of a group, which Spark knows beforehand
    turn = F.row_number().over(Window.partitionBy(group).orderBy(doc))
    begun = joined.where(F.col("extra") > F.col("full")).withColumn("turn", turn).where(F.col("turn") <= F.lit(target))
    one = begun.where(F.col("turn") <= F.col("rest")).select(group, doc, F.lit(1).alias("one"))
    # where the floors alone exceed the target: one less for each of the first docs, numbered range by range
    over = base.join(given.where("left < 0"), group).select(group, doc, "left", F.struct(group, doc).alias("_both"))
    numbered = global_numbers(over, "_both", [doc])
    begins = numbered.groupBy(group).agg(F.min("number").alias("_begin"))
    less = numbered.join(begins, group).where(F.col("number") - F.col("_begin") < -F.col("left")).select(group, doc, F.lit(1).alias("less"))
    budget = F.greatest(F.lit(0), F.col("floor") - F.coalesce("less", F.lit(0))) + F.least("extra", "full") + F.coalesce("one", F.lit(0))
    return joined.join(one, [group, doc], "left").join(less, [group, doc], "left").select(group, doc, budget.cast("bigint").alias("budget"))


def _broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows) of the rules that some row breaks, in one pass."""
    counts = rows.agg(*(F.count_if(r).alias(n) for n, r in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules))).alias("r")).select("r.rule", "r.rows").where("rows > 0")


def violations(rows: DataFrame, sentences: DataFrame | None = None, labelled: bool = True, shares: bool = False) -> DataFrame:
    """(rule, rows): how many rows break each rule for labels, for the rules that are broken.

    Before labelling (``labelled`` false) labels may be blank, and only those given are checked. With ``sentences``, ids must
    be among its sentence_id. Rules for label_method, annotator and topic count where there is such a column. With ``shares``
    a document has at most DOC_SHARE of all rows, and a topic a share within TOPIC_SHARE.
    """
    kind, event = F.lower(F.trim(F.coalesce("event_type", F.lit("")))), F.trim(F.coalesce("is_event", F.lit("")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    text, given = F.coalesce("sentence", F.lit("")), F.lit(True) if labelled else event != ""
    rules = {
        "missing_id": blank("sentence_id"),
        "empty_sentence": F.trim(text) == "",
        "length": (F.length(text) < LENGTHS[0]) | (F.length(text) > LENGTHS[1]),
        "is_event_value": given & ~event.isin("0", "1"),
        "event_type_value": ~kind.isin(*EVENT_TYPES) & (F.lit(labelled) | (kind != "")),
        "event_without_type": (event == "1") & (kind.isin("none", "") if labelled else kind == "none"),
        "type_without_event": (event == "0") & kind.isin(*EVENT_TYPES[:-1]),
        "no_document": blank("doc_id"),
    }
    if "label_method" in rows.columns:
        method = F.trim(F.coalesce("label_method", F.lit("")))
        rules["label_method_value"] = ~method.isin(*LABEL_METHODS) & (F.lit(labelled) | (method != ""))
    if labelled and "annotator" in rows.columns:
        rules["no_annotator"] = blank("annotator")
    found = _broken(rows, rules)
    again = rows.where("sentence_id is not null").groupBy("sentence_id").agg((F.count("*") - 1).alias("n"))
    whole = rows.agg(F.count("*").alias("total"))
    share = lambda c: rows.where(~blank(c)).groupBy(F.trim(c).alias("v")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("total"))  # noqa: E731  whole is one row
    sums = [("repeated_id", again, F.col("n") > 0)]
    if shares:
        sums.append(("document_share", share("doc_id"), F.col("share") > DOC_SHARE))
        sums.append(("topic_share", share("topic"), ~F.col("share").between(*TOPIC_SHARE)))
    if sentences is not None:
        unknown = rows.where(~blank("sentence_id")).join(sentences.select("sentence_id").distinct(), "sentence_id", "left_anti").select(F.lit(1).alias("n"))
        sums.append(("unknown_id", unknown, F.lit(True)))
    for name, counted, broken in sums:
        found = found.unionByName(counted.where(broken).agg(F.lit(name).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows")))
    return found.where("rows > 0")


def document_violations(docs: DataFrame) -> DataFrame:
    """(rule, rows) of the rules for documents that are broken: text, words, noise, fields."""
    words = word_count(F.col("text"))
    known = F.coalesce(F.lower(strip(F.col("source_type"))).isin(*LONG_SOURCES), F.lit(False))
    empty = F.coalesce(F.length(strip(F.col("text"))), F.lit(0)) == 0
    return _broken(docs, {
        "no_text": F.col("text").isNull(),
        "empty_text": F.col("text").isNotNull() & empty,
        "too_few_words": ~empty & (words < 100),
        "few_words": known & words.between(100, 499),
        "noise": F.col("text").isNotNull() & (F.size(noise_markers(F.col("text"))) > 0),
        "no_title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "no_year": F.col("year").isNull(),
    })


def sentence_violations(labels: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, rows) of labelled sentences that point to no registered document or no chunk."""
    given = lambda c: labels.where(F.col(c).isNotNull()).select(c)
    one = lambda name, rows: rows.agg(F.lit(name).alias("rule"), F.count("*").alias("rows"))
    return one("unknown_document", integrity(given("doc_id"), docs, "doc_id")).union(one("unknown_chunk", integrity(given("chunk_id"), chunks, "chunk_id"))).where("rows > 0")


def doc_shares(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents that hold more than DOC_SHARE of all rows: (doc, rows, share)."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.groupBy(doc).agg(F.count("*").alias("rows")).crossJoin(F.broadcast(total))  # total is one row
    return counts.where(F.col("rows") > F.col("total") * DOC_SHARE).select(doc, "rows", F.expr("floor(rows / total * 1e6 + 0.5) / 1e6").alias("share"))


def integrity(parts: DataFrame, wholes: DataFrame, key: str) -> DataFrame:
    """Rows of ``parts`` whose ``key`` is not among ``wholes``; null keys are not found either."""
    return parts.join(wholes.select(key).distinct(), key, "left_anti")


def agreement(rows: DataFrame, key: str, label: str, judge: str, first: str, second: str) -> DataFrame:
    """(truth, guess, rows): labels by judge ``second`` against those by ``first`` for the same key."""
    one = lambda j, n: rows.where(F.col(judge) == j).groupBy(key).agg(F.min(label).alias(n)).where(F.col(n).isNotNull())
    return one(first, "truth").join(one(second, "guess"), key).groupBy("truth", "guess").agg(F.count("*").alias("rows"))


def second_labels(rows: DataFrame, key: str, label: str, judge: str) -> DataFrame:
    """(truth, guess, rows): labels of other judges against those of the first judge of the same key, by name.

    A judge's several labels for a key count once, the least.
    """
    own = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(judge).isNotNull()).groupBy(key, judge).agg(F.min(label).alias("label"))
    first = own.groupBy(key).agg(F.min(F.struct(judge, "label")).alias("f")).select(key, F.col(f"f.{judge}").alias("_j"), F.col("f.label").alias("truth"))
    others = own.join(first, key).where(F.col(judge) != F.col("_j"))
    return others.groupBy("truth", F.col("label").alias("guess")).agg(F.count("*").alias("rows"))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from (truth, guess, rows); 0 where a share is not defined."""
    truth = confusion.groupBy(F.col("truth").alias("label")).agg(F.sum("rows").alias("support"))
    guess = confusion.groupBy(F.col("guess").alias("label")).agg(F.sum("rows").alias("guessed"))
    hits = confusion.where("truth = guess").select(F.col("truth").alias("label"), F.col("rows").alias("hits"))
    both = truth.join(guess, "label", "full").join(hits, "label", "left").fillna(0)
    p = F.coalesce(F.col("hits") / F.nullif("guessed", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("hits") / F.nullif(F.col("support") + F.col("guessed"), F.lit(0)), F.lit(0.0))
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    return both.select("label", "support", six(p).alias("precision"), six(r).alias("recall"), six(f1).alias("f1"))


def draw_by_bucket(scored: DataFrame, budgets: DataFrame, group: str, doc: str, key: str, shares: tuple[float, float] = (0.4, 0.3), seed: int = 42) -> DataFrame:
    """``budget`` rows of each doc: shares of high and medium ones, the rest low, in the order of a hash.

    ``scored`` has (group, doc, key, bucket). Where a bucket has too few rows, the rows beyond the other buckets' quotas
    fill up, high ones first. Spark keeps no more of a bucket than the greatest budget before it shuffles.
    """
    most = budgets.agg(F.max("budget")).first()[0] or 0
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    inside = Window.partitionBy(group, doc, "bucket").orderBy("_h", key)
    ranked = scored.withColumn("_h", order).withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= F.lit(most)).join(budgets, [group, doc]).where(F.col("_r") <= F.col("budget"))
    high, medium = (F.floor(F.col("budget") * s + 0.5) for s in shares)
    quota = F.when(F.col("bucket") == "high", high).when(F.col("bucket") == "medium", medium).otherwise(F.col("budget") - high - medium)
    place = F.when(F.col("bucket") == "high", 0).when(F.col("bucket") == "medium", 1).otherwise(2)
    whole = Window.partitionBy(group, doc).orderBy((F.col("_r") > quota).cast("int"), place, "_h", key)
    return ranked.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= F.col("budget")).select(group, doc, key, "bucket")


def chunk_violations(chunks: DataFrame, longest: int = 1000) -> DataFrame:
    """(rule, rows) of the rules for chunks that are broken: positions, lengths, numbers, missing fields."""
    n, start, end = F.length("text"), F.col("start_char"), F.col("end_char")
    rules = {
        "no_text": F.coalesce(F.length(strip(F.col("text"))), F.lit(0)) == 0,
        "no_position": start.isNull() | end.isNull(),
        "negative_start": start < 0,
        "end_before_start": end <= start,
        "length_differs": (end - start) != n,
        "too_long": n > longest,
        "number": F.coalesce(F.col("chunk_index"), F.lit(0)) < 1,
        "no_document": F.col("doc_id").isNull(),
    }
    return _broken(chunks, rules)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, times) of keys that occur more than once."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("times")).where("times > 1")
