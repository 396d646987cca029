"""Chunks and sentences of texts, with running numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import strip
from loomline.session import cut_lineage

# A sentence ends at white space after a full stop or question mark, not within abbreviations.
SENTENCE_END = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


# Two or more pipe rows, one after the other.
TABLE = r"(?m)^[ \t]*\|[^\n]*\|[ \t]*$(?:\n[ \t]*\|[^\n]*\|[ \t]*$)++\n?"


def table_spans(text: Column) -> Column:
    """Places (start, end) of a text's tables, from 0, end exclusive and after the last row's line end."""
    both = F.zip_with(F.split(text, TABLE, -1), F.regexp_extract_all(text, F.lit(TABLE), 0), lambda p, t: F.struct(F.length(p).alias("p"), F.length(t).alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def take(state: Column, x: Column) -> Column:
        begin = state["at"] + x["p"]
        end = begin + x["t"]
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("spans"))

    return F.aggregate(F.filter(both, lambda x: x["t"].isNotNull()), start, take, lambda state: state["spans"])


def chunks(texts: DataFrame, key: str, text: str = "text", size: int = 1000, overlap: int = 200, whole_tables: bool = False) -> DataFrame:
    """(key, chunk_index from 1, start_char, end_char, text): windows of ``size`` characters every ``size - overlap``.

    The last window may be shorter. A text of at most ``size`` characters is one chunk; null and empty texts have none. With
    ``whole_tables`` a window that would end within a table ends after it.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step, n = size - overlap, F.length(text)
    kept = texts.where(n > 0).select(key, F.col(text).alias("_t"), *([table_spans(F.col(text)).alias("_s")] if whole_tables else []))
    cut = kept.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.length("_t") > size, F.ceil(F.length("_t") / step) - 1).otherwise(F.lit(0)).cast("int"))))
    start = F.col("i") * step
    end = F.least(start + size, F.length("_t"))
    if whole_tables:
        inside = F.filter("_s", lambda s: (s["start"] < start + size) & (start + size < s["end"]))
        end = F.greatest(end, F.coalesce(F.get(inside, F.lit(0))["end"], F.lit(0)))
    placed = cut.select(key, (F.col("i") + 1).alias("chunk_index"), start.alias("start_char"), end.alias("end_char"), "_t")
    return placed.select(key, "chunk_index", "start_char", "end_char", F.substring(F.col("_t"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("text"))


def sentences(texts: DataFrame, key: list[str], text: str = "text", least: int = 15) -> DataFrame:
    """(key..., sentence_index from 1, text): sentences of at least ``least`` characters, numbered before the short are dropped."""
    parts = F.filter(F.transform(F.split(F.col(text), SENTENCE_END), strip), lambda s: s != "")
    split = texts.select(*key, F.posexplode(parts).alias("p", "text"))
    return split.where(F.length("text") >= least).select(*key, (F.col("p") + 1).alias("sentence_index"), "text")


def global_numbers(rows: DataFrame, group: str, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with a running number over all groups in their order, from 0.

    Counts a group are summed over ranges of groups first, so that no task sees all rows or all groups.
    """
    spans = 256
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).repartitionByRange(spans, group).withColumn("_span", F.spark_partition_id())
    # the ranges are kept as written, since a second run could place them otherwise
    sizes = cut_lineage(sizes)
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("_span").agg(F.sum("_n").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0)))  # one row a span
    within = Window.partitionBy("_span").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(F.broadcast(totals), "_span").select(group, (F.col("_base") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_start"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_p", place).join(starts, group).withColumn(name, F.col("_start") + F.col("_p") - 1).drop("_p", "_start")


def table_blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, first_line, last_line, rows) of each run of two or more pipe rows; lines count from 0."""
    line = F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")
    rows = texts.select(key, line).where(F.col("line").rlike(r"^[ \t]*\|.*\|[ \t]*$"))
    island = F.col("at") - F.row_number().over(Window.partitionBy(key).orderBy("at"))
    runs = rows.withColumn("_island", island).groupBy(key, "_island").agg(F.min("at").alias("first_line"), F.max("at").alias("last_line"), F.count("*").alias("rows"))
    return runs.where("rows >= 2").drop("_island")
