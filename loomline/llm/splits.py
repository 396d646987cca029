"""Splits that keep related records together.

Records that share an entity, directly or through a chain of shared keys, form one component and get one split.
Components come from random-mate contraction: every round each vertex throws a coin, tails collapse into a neighbour
that threw heads, and the collapsed graph goes on until one task can hold its edges and joins what is left. Each round is
a few equi joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import cut_lineage

#: A component with more than these shares of all rows or of a kind's rows is placed one by one; a kind has RARE of all rows.
HEAVY_SHARE, HEAVY_KIND, RARE = 0.001, 0.005, 0.01
BINS = 1024
#: Edges that one task joins at once; more are contracted first. It decides the number of rounds, not what is connected.
AT_ONCE = 200_000


def ties_to_edges(ties: DataFrame, node: str, key: str) -> DataFrame:
    """Edges (u, v), u < v, that connect all nodes of each key through the key's least node.

    Null nodes or keys tie nothing. A key shared by m nodes gives m - 1 edges, never all pairs.
    """
    pairs = ties.select(F.col(node).alias("v"), F.col(key).alias("k")).where("v is not null and k is not null").distinct()
    hubs = pairs.groupBy("k").agg(F.min("v").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.join(hubs, "k").where("u <> v").select("u", "v").distinct()


def _united(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, to): every node of the edges but the least of its component, and that least node."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for u, v in zip(frame["u"], frame["v"], strict=True):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in list(parent)]
    yield pd.DataFrame([(x, y) for x, y in found if x != y], columns=["u", "to"])


def components(edges: DataFrame, seed: int = 7, max_rounds: int = 200, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); component is a node of the same component.

    Each round keeps who collapsed into whom, until ``at_once`` edges are left, which one task joins. Labels are unwound
    once, from the last round to the first, each round looking up those after it, so that all rounds together handle few more
    rows than the first and no plan grows by more than a scan a round. Repeated edges, loops and either direction are fine; no
    edges give no rows.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes, rounds = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct(), []
    while (left_over := edges.count()) > at_once:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"{max_rounds} rounds left edges")
        turn = len(rounds)
        both = edges.union(edges.select("v", "u"))
        heads = lambda c: F.xxhash64(F.lit(seed), F.lit(turn), c) % 2 == 0  # noqa: B023, E731
        # u threw tails, v heads; a hot head only receives, a hot tail is reduced by the partial min
        mates = cut_lineage(both.where(~heads(F.col("u")) & heads(F.col("v"))).groupBy("u").agg(F.min("v").alias("to")))
        rounds.append(mates)
        left, right = mates.select("u", F.col("to").alias("a")), mates.select(F.col("u").alias("v"), F.col("to").alias("b"))
        moved = edges.join(left, "u", "left").join(right, "v", "left")
        moved = moved.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v")
        edges = cut_lineage(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if left_over:
        kind = edges.schema["u"].dataType.simpleString()
        rounds.append(cut_lineage(edges.coalesce(1).mapInPandas(_united, f"u {kind}, to {kind}")))
    if not rounds:
        return nodes.withColumn("component", F.col("node"))
    ends = rounds.pop()
    for mates in reversed(rounds):
        after = ends.select(F.col("u").alias("to"), F.col("to").alias("end"))
        ends = ends.union(cut_lineage(mates.join(after, "to", "left").select("u", F.coalesce("end", "to").alias("to"))))
    ends = ends.select(F.col("u").alias("node"), F.col("to").alias("component"))
    return cut_lineage(nodes.join(ends, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def assign_splits(weights: DataFrame, targets: list[tuple[str, int]], seed: int = 7) -> DataFrame:
    """(component, split) from (component, kind, weight): rows, and rows of each kind, shared out in proportion to
    ``targets`` (name, share).

    Kinds below RARE of all rows count as one. Components above HEAVY_SHARE of all rows or HEAVY_KIND of a kind's go one by
    one to the split that lacks most of what they bring; there are at most 1 / HEAVY_SHARE + 1 / (RARE HEAVY_KIND) of them.
    The others follow in hash order within the kind of most of their rows: a running weight, summed bin by bin, decides the
    split by what each split still lacks of that kind, so no task sees all of them.
    """
    spark, schema = weights.sparkSession, "component string, split string"
    total = weights.agg(F.sum("weight")).first()[0] or 0
    whole = sum(t for _, t in targets)
    if not total or not whole:
        return spark.createDataFrame([], schema)
    by_kind = weights.groupBy("kind").agg(F.sum("weight").alias("of_kind"))
    common = by_kind.where(F.col("of_kind") >= total * RARE)  # 1 / RARE rows at most
    named = weights.join(F.broadcast(common.select("kind", F.lit(True).alias("common"))), "kind", "left")
    kinds = named.groupBy("component", F.when(F.col("common"), F.col("kind")).alias("kind")).agg(F.sum("weight").alias("weight"))
    kinds = cut_lineage(kinds.withColumn("kind", F.coalesce("kind", F.lit("(rare)"))))
    sums = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.sum("weight").alias("n")).collect()}
    shares = F.create_map(*(F.lit(x) for k, n in sums.items() for x in (k, float(n))))
    one = kinds.groupBy("component").agg(
        F.sum("weight").alias("weight"), F.max_by("kind", F.struct("weight", "kind")).alias("most"), F.max(F.col("weight") / shares[F.col("kind")]).alias("of_kind")
    )
    is_heavy = (F.col("weight") > total * HEAVY_SHARE) | ((F.col("of_kind") > HEAVY_KIND) & (F.col("weight") > 1))
    heavy: dict[str, dict[str, int]] = {}
    for r in kinds.join(one.where(is_heavy).select("component"), "component").collect():
        heavy.setdefault(r["component"], {})[r["kind"]] = r["weight"]
    share = {name: t / whole for name, t in targets}
    room = {name: {k: n * share[name] for k, n in sums.items()} for name in share}
    rows = {name: total * share[name] for name in share}
    placed = []
    for component, held in sorted(heavy.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(held.values())

        def lack(name: str) -> float:
            kind = sum(n / sums[k] * room[name][k] / sums[k] for k, n in held.items())  # noqa: B023
            return kind + size / total * rows[name] / total  # noqa: B023

        name = max((s for s in share if share[s]), key=lambda s: (lack(s), s))
        rows[name] -= size
        for k, n in held.items():
            room[name][k] -= n
        placed.append((component, name))
    big = spark.createDataFrame(placed, schema)
    light = one.where(~is_heavy).withColumn("h", F.xxhash64(F.lit(seed), "component")).withColumn("bin", F.pmod("h", F.lit(BINS)))
    bins = light.groupBy("most", "bin").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("most").orderBy("bin")  # BINS rows at most
    starts = bins.select("most", "bin", (F.sum("w").over(order) - F.col("w")).alias("start"), F.sum("w").over(Window.partitionBy("most")).alias("all"))
    inside = Window.partitionBy("most", "bin").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("start") + F.sum("weight").over(inside) - F.col("weight") / 2) / F.col("all")
    bounds = []
    for k in sums:
        free, upto = sum(max(room[s][k], 0) for s in share) or 1, 0.0
        for name in share:
            low, upto = upto, upto + max(room[name][k], 0) / free
            bounds.append((k, name, low, upto if name != targets[-1][0] else 2.0))
    listed = spark.createDataFrame(bounds, "most string, split string, low double, upto double")
    small = light.join(F.broadcast(starts), ["most", "bin"]).select("component", "most", at.alias("at"))  # BINS rows a kind
    small = small.join(F.broadcast(listed), "most").where("at >= low and at < upto").select("component", "split")  # a row a kind and split
    return big.union(small)


def clean_doc(doc: str = "doc_id", sentence: str = "sentence_id"):
    """doc_id trimmed and lower-cased; where null or blank, the part of the sentence id before its last ``_s``.

    A sentence id without ``_s`` stands for itself.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    own, left = clean(F.col(doc)), clean(F.regexp_extract(F.col(sentence), r"(?s)^(.*)_s", 1))
    return F.when(F.coalesce(own, F.lit("")) != "", own).when(left != "", left).otherwise(clean(F.col(sentence)))


def linked_docs(rows: DataFrame) -> DataFrame:
    """(node, component) of every doc that shares a sentence id with another doc."""
    ties = rows.select(clean_doc().alias("doc"), "sentence_id")
    return components(ties_to_edges(ties, "doc", "sentence_id"))


def linked_pairs(labels: DataFrame) -> DataFrame:
    """All pairs (doc_id_a, doc_id_b), a < b, of one component."""
    a = labels.select("component", F.col("node").alias("doc_id_a"))
    b = labels.select("component", F.col("node").alias("doc_id_b"))
    return a.join(b, "component").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def kind_of(c: str = "event_type") -> Column:
    """The event type trimmed and lower-cased, blank for none."""
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def split_records(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(sentence_id, component, split): one row for each distinct sentence id.

    ``targets`` has one row a split (split_name, target_permille) and is read on the driver; it must be small. Rows
    without a sentence id belong to their doc but give no output row. Other columns but event_type are ignored.
    """
    wanted = [(r[0], r[1]) for r in targets.select("split_name", "target_permille").orderBy(F.desc("target_permille"), "split_name").collect()]
    docs = rows.select("sentence_id", clean_doc().alias("node"), kind_of().alias("kind"))
    labels = linked_docs(rows)
    with_component = docs.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    with_component = cut_lineage(with_component.groupBy("sentence_id", "component", "kind").agg(F.count("*").alias("rows")))
    weights = with_component.where("component is not null").groupBy("component", "kind").agg(F.sum("rows").alias("weight"))
    chosen = assign_splits(weights, wanted)
    out = with_component.where("sentence_id is not null").select("sentence_id", "component").distinct()
    return out.join(chosen, "component").select("sentence_id", "component", "split")


def split_shares(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows and share of every (split, event_type), beside the split's share of all rows."""
    kinds = rows.select("sentence_id", kind_of().alias("event_type"))
    counts = kinds.join(assigned.select("sentence_id", "split"), "sentence_id").groupBy("split", "event_type").agg(F.count("*").alias("rows"))
    by_type, everything = Window.partitionBy("event_type"), Window.partitionBy(F.lit(0))
    by_split = Window.partitionBy("split")
    return counts.select(
        "split",
        "event_type",
        "rows",
        (F.col("rows") / F.sum("rows").over(by_type)).alias("share_of_type"),
        (F.sum("rows").over(by_split) / F.sum("rows").over(everything)).alias("share_of_rows"),
    )
