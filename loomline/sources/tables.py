"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``: one parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``table``, spread over all cores where its files make fewer tasks than there are cores.

    Work on texts is bound by the CPU, and a small file of one row group would otherwise be one task. Larger tables are
    read as they lie, without a shuffle.
    """
    rows, cores = table(spark, folder, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted fields over several lines, all columns strings; a byte order mark is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("\ufeff"))


def read_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("txt", "md", "html", "htm")) -> DataFrame:
    """(path, suffix, length, modified, content) of the files of a folder and those under it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", suffix.alias("suffix"), "length", F.col("modificationTime").alias("modified"), "content").where(F.col("suffix").isin(*suffixes))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of sentences (sentence_id, doc_id, chunk_id, topic, year, source_url, text); ``sentence`` may stand for text.

    A row without sentence_id or without a text is an error, as is a malformed line.
    """
    rows = read_lines(spark, path, "sentence_id string, doc_id string, chunk_id string, topic string, year int, source_url string, text string, sentence string")
    need = lambda c, name: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"missing {name}")).cast("string"))
    text = need(F.coalesce("text", "sentence"), "text/sentence").alias("text")
    return rows.select(need(F.col("sentence_id"), "sentence_id").alias("sentence_id"), "doc_id", "chunk_id", "topic", "year", "source_url", text)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, null fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header that ``read_csv`` reads back, texts over several lines too."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
