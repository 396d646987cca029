"""Queries of the training-data operators over whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.llm import abuse, bpe, garbled, leaks, matching, neardup, pieces, sampling, splits
from loomline.llm import sql as S
from loomline.plans.registry import Registry
from loomline.session import cut_lineage
from loomline.sources.tables import table, texts

REGISTRY = Registry()


@REGISTRY.query("p2_found", S.P2_FOUND)
def p2_found(spark, d):
    return neardup.near_duplicates(table(spark, d, "labeling_candidates_sample"))


@REGISTRY.query("p2_classes", S.P2_CLASSES)
def p2_classes(spark, d):
    return neardup.duplicate_classes(table(spark, d, "labeling_candidates_sample"))


@REGISTRY.query("p3_found", S.P3_FOUND)
def p3_found(spark, d):
    return pieces.split_oversized(texts(spark, d, "chunks")).select("chunk_id").distinct()


@REGISTRY.query("p3_pieces")
def p3_pieces(spark, d):
    return pieces.split_oversized(texts(spark, d, "chunks"))


@REGISTRY.query("p4_found", S.P4_FOUND)
def p4_found(spark, d):
    return splits.linked_pairs(splits.linked_docs(table(spark, d, "labeling_candidates_sample")))


@REGISTRY.query("p4_components", S.P4_COMPONENTS)
def p4_components(spark, d):
    """Each tied doc with the least doc of its component: the links of p4_found without all pairs."""
    labels = splits.linked_docs(table(spark, d, "labeling_candidates_sample"))
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select(F.col("node").alias("doc_id"), F.col("least").alias("component"))


@REGISTRY.query("p4_balanced", S.P4_BALANCED)
def p4_balanced(spark, d):
    """Splits of all rows whose share of rows is within a point of the target; what SQL knows without the splits."""
    rows = table(spark, d, "labeling_candidates_sample")
    assigned = splits.split_records(rows, table(spark, d, "split_targets"))
    counts = rows.join(assigned, "sentence_id").groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"))
    near = F.abs(F.col("n") / F.col("all") - F.col("target_permille") / 1000) <= 0.01
    return table(spark, d, "split_targets").join(counts, "split_name").crossJoin(F.broadcast(whole)).where(near).select("split_name", "target_permille")  # one row


@REGISTRY.query("p4_splits")
def p4_splits(spark, d):
    return splits.split_records(table(spark, d, "labeling_candidates_sample"), table(spark, d, "split_targets"))


@REGISTRY.query("p4_shares")
def p4_shares(spark, d):
    rows = table(spark, d, "labeling_candidates_sample")
    assigned = cut_lineage(splits.split_records(rows, table(spark, d, "split_targets")))
    return splits.split_shares(rows, assigned)


@REGISTRY.query("p5_found", S.P5_FOUND)
def p5_found(spark, d):
    report = sampling.shortfalls(table(spark, d, "labeling_candidates_sample"), table(spark, d, "sample_targets"))
    return report.where("missing > 0").select("topic")


@REGISTRY.query("p5_report", S.P5_REPORT)
def p5_report(spark, d):
    return sampling.shortfalls(table(spark, d, "labeling_candidates_sample"), table(spark, d, "sample_targets"))


@REGISTRY.query("p5_sample")
def p5_sample(spark, d):
    return sampling.draw(table(spark, d, "labeling_candidates_sample"), table(spark, d, "sample_targets"))


@REGISTRY.query("p8_found", S.P8_FOUND)
def p8_found(spark, d):
    return leaks.leaked(texts(spark, d, "documents"), table(spark, d, "eval_passages"))


@REGISTRY.query("p8_items", S.P8_ITEMS)
def p8_items(spark, d):
    passages = table(spark, d, "eval_passages")
    return leaks.leak_report(leaks.leaked(texts(spark, d, "documents"), passages), passages)


@REGISTRY.query("p7_ids")
def p7_ids(spark, d):
    return bpe.encode(texts(spark, d, "documents"))


@REGISTRY.query("p7_changed")
def p7_changed(spark, d):
    """Documents whose text is not what its ids decode to: none."""
    docs = texts(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = bpe.encode(docs)
    back = ids.select("doc_id", bpe.decode(ids).alias("back"))
    return docs.join(back, "doc_id").where("text <> back").select("doc_id")


def _texts(spark, d):
    return {"documents": (texts(spark, d, "documents"), "doc_id"), "chunks": (texts(spark, d, "chunks"), "chunk_id")}


@REGISTRY.query("p6_found")
def p6_found(spark, d):
    return garbled.garbled(_texts(spark, d)).select("table_name", "record_id").distinct()


@REGISTRY.query("p6_restored")
def p6_restored(spark, d):
    return garbled.garbled(_texts(spark, d))


@REGISTRY.query("p9_found")
def p9_found(spark, d):
    return abuse.score(texts(spark, d, "documents"), table(spark, d, "moderation_labels")).where("abusive").select("doc_id").distinct()


@REGISTRY.query("p9_scores")
def p9_scores(spark, d):
    return abuse.score(texts(spark, d, "documents"), table(spark, d, "moderation_labels"))


@REGISTRY.query("p9_rates")
def p9_rates(spark, d):
    return abuse.rates(abuse.score(texts(spark, d, "documents"), table(spark, d, "moderation_labels")))


@REGISTRY.query("p1_found")
def p1_found(spark, d):
    found = matching.matches(table(spark, d, "candidate_sources_p0"), table(spark, d, "metadata"))
    return found.select("candidate_doc_id", "metadata_doc_id")


@REGISTRY.query("p1_confidence")
def p1_confidence(spark, d):
    return matching.matches(table(spark, d, "candidate_sources_p0"), table(spark, d, "metadata"))
