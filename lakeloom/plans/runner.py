"""Runs dialect SQL over a folder of Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lakeloom import functions
from lakeloom.plans.dialect import Rewriter
from lakeloom.plans.registry import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_SCHEMAS: dict[tuple, StructType] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is looked up again only when its files have changed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query's plan; only the tables that it names are opened."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    functions.register(spark)
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)

    def types(text: str) -> list[str] | None:
        try:
            return [f.dataType.simpleString() for f in spark.sql(text).schema.fields]
        except Exception:
            return None

    def columns(text: str) -> list[str] | None:
        try:
            return spark.sql(text).columns
        except Exception:
            return None

    return spark.sql(Rewriter(types=types, columns=columns).sql(sql))


def query(name: str, sql: str, oracle: str | None = "") -> None:
    """Registers a query; its oracle is the same text unless another is given (None: there is none)."""
    register(name, lambda spark, sf_dir: run(spark, sf_dir, sql), sql if oracle == "" else oracle)
