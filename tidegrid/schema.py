"""Column layouts of the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("member", T.IntegerType()),
        T.StructField("month_idx", T.IntegerType(), False),
        T.StructField("lat_i", T.IntegerType(), False),
        T.StructField("lon_i", T.IntegerType(), False),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)

SERIES = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("month_idx", T.IntegerType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

ENCODINGS = T.StructType(
    [
        T.StructField("initialization", T.IntegerType(), False),
        T.StructField("split", T.IntegerType(), False),
        T.StructField("recursion", T.IntegerType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("member", T.IntegerType()),
        T.StructField("mode", T.StringType(), False),
        T.StructField("month_idx", T.IntegerType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)

# Source names met in the wild and the convention they are mapped to (fixed values).
COLUMN_ALIASES = {
    "latitude": "lat",
    "longitude": "lon",
    "ULAT": "lat",
    "ULONG": "lon",
    "time_counter": "time",
    "valid_time": "time",
    "date": "time",
    "depthu": "depth",
    "nVertLevels": "level",
    "__xarray_dataarray_variable__": "value",
}

# Scalar coordinates without meaning for a field (fixed values).
DROPPED_COORDS = ("number", "expver", "TLONG", "TLAT", "z_t")

# Latent dimensions, longest spectral peak first (fixed values).
MODE_LABELS = ("Decadal", "Interannual", "Quasibiennial", "HF1", "HF2")


def mode_labels(k: int) -> tuple[str, ...]:
    """Labels of ``k`` modes by rank; those beyond the named ones are numbered."""
    return (*MODE_LABELS[:k], *(f"mode{i}" for i in range(len(MODE_LABELS) + 1, k + 1)))


def normalize_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename source columns to the convention and drop scalar coordinates."""
    wanted = aliases or COLUMN_ALIASES
    return df.withColumnsRenamed({k: v for k, v in wanted.items() if k in df.columns}).drop(*DROPPED_COORDS)


def missing_to_null(value: Column, sentinel: float | None = -999.0) -> Column:
    """NaN and the sentinel become NULL, the only missing value inside the engine."""
    out = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return out if sentinel is None else F.nullif(out, F.lit(float(sentinel)))


def cell_id(n_lon: int, lat_i: str = "lat_i", lon_i: str = "lon_i") -> Column:
    """Integer surrogate of a grid node; joins never use floating coordinates."""
    return (F.col(lat_i) * F.lit(n_lon) + F.col(lon_i)).cast("int")
