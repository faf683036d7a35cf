"""External files: readers with the options of the table functions, and COPY TO."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FLAGS = {"true": True, "false": False, "1": True, "0": False}


def _flag(value) -> bool:
    return value if isinstance(value, bool) else _FLAGS[str(value).lower()]


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, header="true", delimiter=None, delim=None, sep=None, quote=None, escape=None, nullstr=None, compression=None, file_extension=None, **unknown) -> DataFrame:
    """Types are inferred; null strings and separators as given."""
    if unknown:
        raise ValueError(f"unknown option {sorted(unknown)[0]}")
    r = spark.read.option("header", _flag(header)).option("inferSchema", True).option("sep", delimiter or delim or sep or ",")
    for name, value in (("quote", quote), ("escape", escape), ("nullValue", nullstr), ("compression", compression)):
        if value is not None:
            r = r.option(name, value)
    if file_extension:
        r = r.option("pathGlobFilter", f"*{file_extension}")
    return r.csv(path)


def read_json(spark: SparkSession, path: str, format="auto", compression=None, **unknown) -> DataFrame:
    """Lines of JSON, or one array (format => 'array'); auto looks at the first character."""
    if unknown:
        raise ValueError(f"unknown option {sorted(unknown)[0]}")
    kind = str(format).lower()
    if kind == "auto":
        first = spark.read.text(path).limit(1).collect()
        kind = "array" if first and first[0][0].lstrip().startswith("[") else "newline_delimited"
    return spark.read.option("multiLine", kind == "array").json(path)


READERS = {"read_parquet": read_parquet, "parquet_scan": read_parquet, "read_csv": read_csv, "read_csv_auto": read_csv, "read_json": read_json, "read_json_auto": read_json}


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    name = path.lower().removesuffix(".gz").removesuffix(".bz2")
    for end, reader in ((".parquet", read_parquet), (".csv", read_csv), (".tsv", read_csv), (".json", read_json), (".ndjson", read_json), (".jsonl", read_json)):
        if name.endswith(end):
            return reader(spark, path, **({"sep": "\t"} if end == ".tsv" else {}))
    raise ValueError(f"no reader for {path}")


def copy_to(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] = (), header=True, delimiter=",", compression=None, overwrite=True) -> None:
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if compression:
        w = w.option("compression", compression)
    if format.lower() == "csv":
        w.option("header", _flag(header)).option("sep", delimiter).csv(path)
    elif format.lower() == "json":
        w.json(path)
    elif format.lower() == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {format}")
