"""The data model: columns, types, policies and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import types as T

# The raw header names of the source files, in file order, with the standard name and type of each.
CONTRACT: tuple[tuple[str, str, T.DataType], ...] = (
    ("FECHA", "FECHA", T.TimestampType()),
    ("CANAL", "CANAL", T.StringType()),
    ("SKU", "SKU", T.LongType()),
    ("PRODUCTO", "PRODUCTO", T.StringType()),
    ("UNIDADES", "UNIDADES", T.LongType()),
    ("PORCENTAJE DESCUENTO", "PORCENTAJE_DESCUENTO", T.DoubleType()),
    ("MONTO APLICADO", "MONTO_APLICADO", T.DoubleType()),
    ("BOLETA", "BOLETA", T.LongType()),
    ("LOCAL", "LOCAL", T.LongType()),
    ("CODIGO CLIENTE", "CODIGO_CLIENTE", T.StringType()),
    ("RUN CLIENTE", "RUN_CLIENTE", T.StringType()),
    ("NOMBRES", "NOMBRES", T.StringType()),
    ("APELLIDOS", "APELLIDOS", T.StringType()),
    ("FECHA NACIMIENTO", "FECHA_NACIMIENTO", T.DateType()),
    ("GENERO", "GENERO", T.LongType()),
)
RAW_COLUMNS = tuple(raw for raw, _, _ in CONTRACT)
COLUMNS = tuple(name for _, name, _ in CONTRACT)
RENAMES = {raw: name for raw, name, _ in CONTRACT if raw != name}
SCHEMA = T.StructType([T.StructField(name, kind) for _, name, kind in CONTRACT])
SEPARATOR, QUOTE, BIRTH_FORMAT = ";", '"', "yyyy-MM-dd"

AMOUNT, UNITS, DISCOUNT, AGE = "MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO", "EDAD"
CHANNEL, STORE, CUSTOMER, RECEIPT, GENDER = "CANAL", "LOCAL", "CODIGO_CLIENTE", "BOLETA", "GENERO"
DATE, BIRTH, FREQUENCY, UNIT_PRICE = "FECHA", "FECHA_NACIMIENTO", "FRECUENCIA_COMPRA", "MONTO_POR_UNIDAD"

#: Imputed by the exact median; probed against the amount first.
MEDIAN_COLUMNS = (DISCOUNT,)
#: Reported, never imputed.
NEVER_IMPUTED = (BIRTH,)
ALPHA = 0.05


def _whole(name: str, default: int, least: int | None = None) -> int:
    try:
        value = int(os.environ.get(name, ""))
    except ValueError:
        return default
    return default if least is not None and value < least else value


@dataclass(frozen=True)
class Settings:
    """Run-time settings; the environment overrides the defaults, unreadable values don't."""

    seed: int = field(default_factory=lambda: _whole("TILLSTATS_SEED", 42))
    jobs: int = field(default_factory=lambda: _whole("TILLSTATS_JOBS", os.cpu_count() or 1, 1))
    test_share: float = 0.30
    alpha: float = ALPHA
    silhouette_sample: int = 10_000
    normality_sample: int = 5_000
