"""The register of documents: projection, choice of candidates, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import strip, topic_key
from loomline.operators.segments import global_numbers


def year_of(*columns: str) -> Column:
    """The first year written in the columns."""
    found = (F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:19|20)\d{2}", 0), F.lit("")) for c in columns)
    return F.coalesce(*found).cast("int")


def title_key(c: Column) -> Column:
    """Letters and digits of a title in lower case, others as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def register(metadata: DataFrame) -> DataFrame:
    """One row a doc_id, the latest retrieved: doc_id, title, topic, year, authors (array), source_url."""
    latest = metadata.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.struct(F.coalesce("retrieved_at", F.lit("")).alias("r"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "topic", "year", "published_date", "authors", "source_url")))).alias("m")
    ).select("doc_id", "m.*")
    authors = F.filter(F.transform(F.split("authors", ";"), strip), lambda a: a != "")
    return latest.select("doc_id", strip(F.col("title")).alias("title"), topic_key(F.col("topic")).alias("topic"), year_of("year", "published_date").alias("year"), authors.alias("authors"), "source_url")


def new_candidates(candidates: DataFrame, metadata: DataFrame, first: int, last: int, per_topic: int) -> DataFrame:
    """The ``per_topic`` newest candidates of each topic, of the years given, whose title is not registered yet.

    One candidate a title of a topic, the newest; ties go to the lesser id.
    """
    known = metadata.select(title_key(F.col("title")).alias("k")).distinct()
    fresh = candidates.select("doc_id", topic_key(F.col("topic")).alias("topic"), "title", title_key(F.col("title")).alias("k"), year_of("year", "published_date").alias("year"))
    fresh = fresh.where(F.col("k") != "").where(F.col("year").between(first, last)).join(known, "k", "left_anti").distinct()
    # the best of a title by an aggregate, which is combined before the shuffle
    one = fresh.groupBy("topic", "k").agg(F.min(F.struct((-F.col("year")).alias("y"), "doc_id", "title")).alias("b")).select("topic", (-F.col("b.y")).alias("year"), "b.doc_id", "b.title")
    order = Window.partitionBy("topic").orderBy(F.desc("year"), "doc_id")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_topic)


def next_numbers(metadata: DataFrame) -> DataFrame:
    """(prefix, next): one more than the greatest number of each id prefix."""
    parts = metadata.select(F.regexp_extract("doc_id", r"^(.+)_(\d+)$", 1).alias("prefix"), F.regexp_extract("doc_id", r"^(.+)_(\d+)$", 2).alias("n"))
    return parts.where("prefix <> ''").groupBy("prefix").agg((F.max(F.col("n").cast("bigint")) + 1).alias("next"))


def hash_split(docs: DataFrame, doc: str, shares: tuple[tuple[str, float], ...] = (("train", 0.7), ("validation", 0.15), ("test", 0.15)), seed: int = 42) -> DataFrame:
    """``docs`` with a split by hash of the document, so that a document is in one split whatever the order of rows."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(doc).cast("string"))), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    upto, split = 0.0, F.lit(shares[-1][0])
    bounds = []
    for name, share in shares[:-1]:
        upto += share
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        split = F.when(u < bound, name).otherwise(split)
    return docs.withColumn("split", split)


def choose_split(rows: DataFrame, doc: str, group: str, label: str, seeds: range, shares: tuple[tuple[str, float], ...] = (("train", 0.7), ("validation", 0.15), ("test", 0.15))) -> DataFrame:
    """(seed, score): how well each seed's split by document covers groups and labels; the best first.

    A split loses 1000 (train) or 80 for each label it lacks and 20 for each group, and gains its share's closeness. Rows are
    counted by (doc, group, label) before the seeds are tried, so the work is documents times seeds.
    """
    counted = rows.groupBy(doc, group, label).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"), F.countDistinct(label).alias("labels"), F.countDistinct(group).alias("groups"))
    tried = counted.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    u = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col(doc).cast("string"))), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    train, validation = shares[0][1], shares[0][1] + shares[1][1]
    split = F.when(u < train, shares[0][0]).when(u < validation, shares[1][0]).otherwise(shares[2][0])
    by = tried.withColumn("split", split).groupBy("seed", "split").agg(F.sum("n").alias("n"), F.countDistinct(label).alias("l"), F.countDistinct(group).alias("g"))
    want = F.when(F.col("split") == shares[0][0], shares[0][1]).when(F.col("split") == shares[1][0], shares[1][1]).otherwise(shares[2][1])
    loss = F.when(F.col("split") == shares[0][0], 1000).otherwise(80) * (F.col("labels") - F.col("l")) + 20 * (F.col("groups") - F.col("g")) + 100 * F.abs(F.col("n") / F.col("total") - want)
    scored = by.crossJoin(F.broadcast(total)).groupBy("seed").agg(F.sum(loss).alias("loss"), F.count("*").alias("splits"))  # total is one row
    return scored.select("seed", (F.floor((-F.col("loss") - 10000 * (3 - F.col("splits"))) * 1e6 + 0.5) / 1e6).alias("score"))


def newest(docs: DataFrame, group, order: list, k: int) -> DataFrame:
    """The ``k`` first rows of each group in the given order, with their place."""
    return docs.withColumn("group_key", group).withColumn("place", F.row_number().over(Window.partitionBy("group_key").orderBy(*order))).where(F.col("place") <= k)


def with_titles(rows: DataFrame, registered: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``rows`` with the registered title and address of their document; both null where it is not registered."""
    known = registered.select(F.col("doc_id").alias(doc), F.col("title").alias("registered_title"), F.col("source_url").alias("registered_url"))
    return rows.join(known, doc, "left")


def loaded(registered: DataFrame, docs: DataFrame, ref: str = "ref_doc_id") -> DataFrame:
    """(doc_id, texts, status): how many texts were loaded for each registered document; ``missing`` where none."""
    counts = docs.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("doc_id")).agg(F.count("*").alias("texts"))
    both = registered.select("doc_id").join(counts, "doc_id", "left").withColumn("texts", F.coalesce("texts", F.lit(0).cast("bigint")))
    return both.withColumn("status", F.when(F.col("texts") > 0, "loaded").otherwise("missing"))


def renumbered(registered: DataFrame) -> DataFrame:
    """(doc_id, new_id): documents of each topic numbered anew in the order of their ids, ``<topic>_<number>``."""
    rows = registered.select("doc_id", "topic", F.struct("topic", "doc_id").alias("_both"))
    numbered = global_numbers(rows, "_both", ["doc_id"])
    begins = numbered.groupBy("topic").agg(F.min("number").alias("_begin"))
    place = (F.col("number") - F.col("_begin") + 1).cast("bigint")
    return numbered.join(begins, "topic").select("doc_id", F.format_string("%s_%04d", "topic", place).alias("new_id"))
