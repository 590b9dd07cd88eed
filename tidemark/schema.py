"""Row layouts and the fixed list of segment features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("sampling", T.IntegerType()),
    T.StructField("anomaly", T.IntegerType()),
    T.StructField("segment", T.LongType()),
    T.StructField("train", T.IntegerType()),
])

FRAME = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("channel", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("segment_id", T.LongType()),
    T.StructField("sampling", T.IntegerType()),
])

# Names and order of the 18 segment features and of the columns that are not features.
FEATURES = [
    "duration", "len", "mean", "var", "std", "kurtosis", "skew",
    "n_peaks", "smooth10_n_peaks", "smooth20_n_peaks",
    "diff_peaks", "diff2_peaks", "diff_var", "diff2_var",
    "gaps_squared", "len_weighted", "var_div_duration", "var_div_len",
]
PEAK_FEATURES = ["n_peaks", "smooth10_n_peaks", "smooth20_n_peaks", "diff_peaks", "diff2_peaks"]
META = ["channel", "segment", "anomaly", "train", "sampling"]

INT_FEATURES = [
    "duration", "len", "n_peaks", "smooth10_n_peaks", "smooth20_n_peaks",
    "diff_peaks", "diff2_peaks", "gaps_squared", "len_weighted",
]

FEATURE_TABLE = T.StructType(
    [
        T.StructField("channel", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("anomaly", T.IntegerType()),
        T.StructField("train", T.IntegerType()),
        T.StructField("sampling", T.IntegerType()),
    ]
    + [
        T.StructField(c, T.LongType() if c in INT_FEATURES else T.DoubleType())
        for c in FEATURES
    ]
)

ALERT = T.StructType([
    T.StructField("segment", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("channel_label", T.StringType()),
    T.StructField("first_ts", T.DoubleType()),
    T.StructField("last_ts", T.DoubleType()),
    T.StructField("raw_score", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("hits", T.LongType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("summary", T.StringType()),
])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail before the job starts when an expected column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def feature_columns(df: DataFrame) -> list[str]:
    """All columns that are not meta columns, in table order."""
    return [c for c in df.columns if c not in META]
