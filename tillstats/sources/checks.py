"""Validation of inputs before anything is computed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptDataError, FileNotFoundOrEmptyError, SchemaValidationError


def require_nonempty(spark: SparkSession, path: str) -> None:
    """The path exists in its file system, wherever that is, and holds bytes."""
    try:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    except AnalysisException as e:
        raise FileNotFoundOrEmptyError(f"not found: {path}") from e
    if not size:
        raise FileNotFoundOrEmptyError(f"empty: {path}")


def require_columns(found: Iterable[str], expected: Iterable[str]) -> None:
    """All expected columns are there; more columns and any order are fine."""
    missing = sorted(set(expected) - set(found))
    if missing:
        raise SchemaValidationError(f"missing columns: {', '.join(missing)}")


def require_numeric(df: DataFrame, column: str) -> None:
    require_columns(df.columns, [column])
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise SchemaValidationError(f"{column} is not numeric but {df.schema[column].dataType.simpleString()}")


def infinite_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Infinite values of each column that exists; nulls count as finite."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return {}
    row = df.agg(*(F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(c) for c in present)).first()
    return {c: int(row[c]) for c in present}


def require_text(lines: Sequence[str]) -> None:
    if not lines or any("�" in x or "\0" in x for x in lines):
        raise CorruptDataError("not a readable text table")
