"""The delimited source: validation on a sample, then one declared, lazy scan.

Line policy: a line with more fields than the header is dropped, a shorter one is padded with nulls, separators
within quotes belong to the value. Values that don't parse become null, as do NaN and birth dates
that aren't plain dates.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract
from ..errors import CorruptDataError
from . import checks

SAMPLE_ROWS = 1_000
#: Distinct values that a column of levels may hold.
MOST_LEVELS = 10_000
_CORRUPT = "__corrupt"


@dataclass(frozen=True)
class Sample:
    header: tuple[str, ...]
    rows: int
    skipped: int


def read_sample(spark: SparkSession, path: str, rows: int = SAMPLE_ROWS) -> Sample:
    """Header, well-formed and skipped lines among the first ``rows``."""
    lines = [r[0] for r in spark.read.text(path).limit(rows + 1).collect()]
    checks.require_text(lines)
    parsed = list(csv.reader(lines, delimiter=contract.SEPARATOR, quotechar=contract.QUOTE))
    if not parsed or not parsed[0]:
        raise CorruptDataError("no header")
    good = [r for r in parsed[1:] if r and len(r) <= len(parsed[0])]
    if not good:
        raise CorruptDataError("no rows")
    return Sample(tuple(parsed[0]), len(good), len([r for r in parsed[1:] if r]) - len(good))


def _excess(record: Column, fields: int) -> Column:
    """Whether a raw line has more fields than the header."""
    bare = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    return F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(contract.SEPARATOR), F.lit(""))) >= fields, F.lit(False))


def scan(spark: SparkSession, path: str, header: tuple[str, ...]) -> DataFrame:
    """The standard columns of the file, typed as declared, nothing inferred."""
    kinds = {raw: kind for raw, _, kind in contract.CONTRACT}
    # birth dates are read as text: a strict format decides afterwards
    fields = [T.StructField(name, T.StringType() if isinstance(kinds.get(name), T.DateType) else kinds.get(name, T.StringType())) for name in header]
    reader = spark.read.schema(T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())]))
    raw = reader.csv(path, sep=contract.SEPARATOR, quote=contract.QUOTE, escape=contract.QUOTE, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, enforceSchema=True)
    raw = raw.where(~_excess(F.col(_CORRUPT), len(header)))

    def standard(source: str, kind: T.DataType) -> Column:
        value = F.col(f"`{source}`")
        if isinstance(kind, T.DateType):
            return F.expr(f"try_to_date(`{source}`, '{contract.BIRTH_FORMAT}')")
        return F.nanvl(value, F.lit(None)) if isinstance(kind, T.DoubleType) else value

    return raw.select(*(standard(source, kind).alias(name) for source, name, kind in contract.CONTRACT))


def channel_levels(df: DataFrame, column: str = contract.CHANNEL) -> list[str]:
    """The sorted distinct values, nulls left out; raises where they are no levels but free values."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} distinct values")
    return sorted(found)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Validates the file and returns its lazy table."""
    checks.require_nonempty(spark, path)
    sample = read_sample(spark, path)
    checks.require_columns(sample.header, contract.RAW_COLUMNS)
    return scan(spark, path, sample.header)
