"""A sample that matches target proportions by category.

Rows are accepted independently by a hash of their id. The counts of the hash's bins, of the rows that the cap leaves, find
the bin in which a category's quota is reached; rows are accepted up to it and ranked in their bins, so none is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.splits import clean_doc

BINS = 4096


def clean_topic(c: Column) -> Column:
    """Trimmed, lower-cased, ``-`` and space as ``_``."""
    return F.translate(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "- ", "__")


def offers(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (topic, doc, sentence_id) of the rows whose cleaned topic has a target; null ids are left out."""
    known = F.broadcast(targets.select(clean_topic(F.col("topic")).alias("topic")).distinct())  # one row a category
    clean = rows.select(clean_topic(F.col("topic")).alias("topic"), clean_doc().alias("doc"), "sentence_id")
    return clean.where("sentence_id is not null").join(known, "topic", "left_semi").distinct()


def requirements(offered: DataFrame, targets: DataFrame, one_in: int = 5) -> DataFrame:
    """One row a topic: needed, offered, and max_per_doc; topics without any row offer 0."""
    n = offered.select("sentence_id").distinct().agg(F.floor(F.count("*") / one_in).alias("n"))
    wanted = targets.select(clean_topic(F.col("topic")).alias("topic"), "target_permille", "min_rows", "max_per_doc")
    per_doc = offered.groupBy("topic", "doc").agg(F.count("*").alias("have"))
    per_topic = (
        per_doc.join(F.broadcast(wanted.select("topic", "max_per_doc")), "topic")
        .groupBy("topic")
        .agg(F.sum(F.least("have", "max_per_doc")).cast("bigint").alias("offered"))
    )
    needed = F.greatest(F.col("min_rows"), F.ceil(F.col("n") * F.col("target_permille") / 1000)).cast("bigint")
    return (
        wanted.crossJoin(F.broadcast(n))  # n is one row
        .join(F.broadcast(per_topic), "topic", "left")  # one row a category
        .select("topic", "max_per_doc", needed.alias("needed"), F.coalesce("offered", F.lit(0).cast("bigint")).alias("offered"))
    )


def draw(rows: DataFrame, targets: DataFrame, one_in: int = 5, seed: int = 11) -> DataFrame:
    """(sentence_id, topic, doc): min(needed, available) rows a topic, at most max_per_doc of one doc.

    A sentence id that several topics or docs offer is drawn at most once, for the topic that offers least for its need and
    the doc with most room; that choice is made id by id, so a topic may still get fewer than it offers: see ``drawn``. Same rows in any
    order give the same sample. Empty rows give an empty sample.
    """
    offered = offers(rows, targets)
    need = requirements(offered, targets, one_in)
    # a shared id goes to the topic that offers least for its need, there to the doc with most room
    room = offered.groupBy("topic", "doc").agg(F.count("*").alias("have")).join(F.broadcast(need), "topic")
    room = room.select("topic", "doc", (F.col("offered") / F.greatest("needed", F.lit(1))).alias("ease"), (F.col("have") - F.col("max_per_doc")).alias("over"))
    placed_at = F.min(F.struct("ease", "over", "topic", "doc")).alias("at")
    once = offered.join(room, ["topic", "doc"]).groupBy("sentence_id").agg(placed_at).select("sentence_id", "at.topic", "at.doc")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("sentence_id")), 11) / F.lit(float(1 << 53))
    most = targets.agg(F.max("max_per_doc")).first()[0] or 0
    in_doc = Window.partitionBy("topic", "doc").orderBy("u", "sentence_id")
    # the constant bound lets Spark keep at most `most` rows of a doc before it shuffles
    capped = once.withColumn("u", u).withColumn("rn", F.row_number().over(in_doc)).where(F.col("rn") <= F.lit(most))
    capped = capped.join(F.broadcast(need), "topic").where("rn <= max_per_doc")
    # the cap keeps the lowest u of a doc, so ranks are compared on a fresh hash
    v = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("sentence_id")), 11) / F.lit(float(1 << 53))
    capped = capped.withColumn("v", v).withColumn("bin", F.floor(F.col("v") * BINS).cast("int"))
    # the counts of what the cap left, not of the offer, say up to which bin rows are accepted
    bins = capped.groupBy("topic", "bin").agg(F.count("*").alias("k"))
    before = Window.partitionBy("topic").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    bins = bins.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    placed = capped.join(F.broadcast(bins), ["topic", "bin"]).where("before < needed")  # BINS rows a category
    within = Window.partitionBy("topic", "bin").orderBy("v", "sentence_id")
    ranked = placed.withColumn("at", F.col("before") + F.row_number().over(within))
    return ranked.where("at <= needed").select("sentence_id", "topic", "doc")


def drawn(sample: DataFrame, rows: DataFrame, targets: DataFrame, one_in: int = 5) -> DataFrame:
    """One row a topic: needed, offered, drawn, and deficit (needed beyond what ``sample`` of ``draw`` holds)."""
    need = requirements(offers(rows, targets), targets, one_in)
    counts = sample.groupBy("topic").agg(F.count("*").alias("drawn"))
    both = need.join(F.broadcast(counts), "topic", "left").fillna(0, ["drawn"])  # one row a category
    return both.select("topic", "needed", "offered", "drawn", F.greatest(F.lit(0), F.col("needed") - F.col("drawn")).cast("bigint").alias("deficit"))


def shortfalls(rows: DataFrame, targets: DataFrame, one_in: int = 5) -> DataFrame:
    """One row a topic: needed, offered, missing (needed beyond the offer)."""
    need = requirements(offers(rows, targets), targets, one_in)
    return need.select("topic", "needed", "offered", F.greatest(F.lit(0), F.col("needed") - F.col("offered")).cast("bigint").alias("missing"))
