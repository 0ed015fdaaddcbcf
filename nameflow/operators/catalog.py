"""Domain catalogs: the most frequent names of a record table, without disallowed ones."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import has_odd_label, normalized_name, suffixes

DEFAULT_TOP = 10_000


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header that has a column `name`; malformed rows are an error."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST")
    if "name" not in rows.columns:
        raise ValueError(f"{path} has no column `name`")
    return rows


def disallowed(name: Column, blocked: list[str] = (), substrings: list[str] = ()) -> Column:
    """A name with a blocked token - exact or behind a dot for tokens with a dot, anywhere for others - with one of
    the substrings, or with a machine-made label.  For long lists of dotted tokens see without_blocked()."""
    low = F.lower(name)
    found = has_odd_label(name)
    for t in blocked:
        t = t.lower()
        found = found | ((low == t) | F.endswith(low, F.lit("." + t)) if "." in t else F.contains(low, F.lit(t)))
    for t in substrings:
        found = found | F.contains(low, F.lit(t.lower()))
    return found


def without_blocked(rows: DataFrame, blocked: DataFrame, name_col: str = "name") -> DataFrame:
    """Rows whose name neither is nor lies under a token of blocked (token): an anti-join on dot suffixes."""
    tokens = blocked.select(F.lower("token").alias("_t")).distinct()
    names = rows.select(F.col(name_col).alias("_n")).distinct()
    hit = names.select("_n", F.explode(suffixes(F.col("_n"))).alias("_t")).join(tokens, "_t", "left_semi").select("_n").distinct()
    return rows.join(hit, F.col(name_col) == F.col("_n"), "left_anti")


def counted(rows: DataFrame, name_col: str = "name") -> DataFrame:
    """name and count of the non-empty normalised names"""
    name = normalized_name(F.col(name_col))
    return rows.where(name != "").groupBy(name.alias("name")).agg(F.count("*").alias("count"))


def top(rows: DataFrame, k: int = DEFAULT_TOP, name_col: str = "name", blocked: list[str] = (), substrings: list[str] = ()) -> DataFrame:
    """The k most frequent allowed names: count descending, then name."""
    if k <= 0:
        raise ValueError("the catalog's size must be positive")
    return counted(rows, name_col).where(~disallowed(F.col("name"), blocked, substrings)).orderBy(F.desc("count"), F.asc("name")).limit(k)


def summary(rows: DataFrame, k: int = DEFAULT_TOP, name_col: str = "name", blocked: list[str] = (), substrings: list[str] = ()) -> DataFrame:
    """rows_read, unique_domains, filtered_domains, emitted_domains"""
    names = counted(rows, name_col)
    bad = disallowed(F.col("name"), blocked, substrings)
    read = rows.agg(F.count("*").alias("rows_read"))
    found = names.agg(F.count("*").alias("unique_domains"), F.count_if(bad).alias("filtered_domains"))
    return read.crossJoin(found).withColumn("emitted_domains", F.least(F.lit(k).cast("bigint"), F.col("unique_domains") - F.col("filtered_domains")))  # a row each


def write_catalog(catalog: DataFrame, path: str) -> int:
    """Writes count<TAB>name lines in the catalog's order, complete or not at all.  A catalog has at most k rows."""
    folder = Path(path).resolve().parent
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=f".{Path(path).name}.")
    n = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            for r in catalog.toLocalIterator():
                f.write(f"{r['count']}\t{r['name']}\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    return n


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """weight and name of a catalog file; blank lines are skipped, malformed ones an error."""
    rows = spark.read.csv(path, sep="\t", schema="weight INT, name STRING", mode="FAILFAST", quote="", escape="")
    bad = rows.where("weight is null or weight <= 0 or name is null or trim(name) = ''").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: bad catalog row {tuple(bad[0])}")
    return rows
