"""Stages that are kept and reused while what they were made from is the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame) -> str:
    """A fingerprint of a table's schema and rows in any order, repeated rows counted; computed by Spark."""
    h = F.xxhash64(*(F.col(c) for c in sorted(rows.columns)))
    n, low, high = rows.select(h.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.shiftrightunsigned("h", 20))).first()
    return chained(rows.schema.jsonValue(), n, low, high)


def chained(*parts) -> str:
    """A fingerprint of values, of earlier fingerprints for instance."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file in whatever file system it names."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def stage(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame], parts: str | None = None, schema: str | None = None) -> DataFrame:
    """The table kept at ``path`` for ``key``; made and written first where there is none.

    With ``parts``, rows lie in a folder for each value of that column; a table that may be empty then needs its ``schema``,
    since no rows leave no file. Each key has its own folder, written as a whole, so that a lost job leaves nothing that looks complete.
    """
    folder = f"{path}/{key[:32]}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        write = make().write.mode("overwrite")
        (write.partitionBy(parts) if parts else write).parquet(folder)
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)
