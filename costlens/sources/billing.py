"""Raw billing scans: Parquet folders per provider, or one combined file."""

from __future__ import annotations

from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import constants as C, session
from costlens.operators import filters as flt
from costlens.schemas import RAW_BILLING


class Source(Protocol):
    """A source plug-in: rows of the raw schema for an inclusive date range."""

    cloud_provider: str

    def read(self, spark: SparkSession, start=None, end=None) -> DataFrame: ...

    def ready(self, spark: SparkSession) -> bool: ...


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Empty strings and NaN become NULL."""
    def clean(name: str, kind: str):
        c = F.col(name)
        if kind == "string":
            return F.nullif(c, F.lit("")).alias(name)
        if kind in ("double", "float"):
            return F.when(~F.isnan(c), c).alias(name)
        return c
    return df.select(*[clean(n, k) for n, k in df.dtypes])


def _load(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """One scan over the paths that exist; provider folders are concatenated."""
    found = [p for p in paths if session.exists(spark, p)]
    return spark.read.schema(RAW_BILLING).parquet(*found) if found else None


def read_billing(spark: SparkSession, path: str, cloud: str | None = None, start=None, end=None,
                 limit: int | None = None) -> DataFrame:
    """Raw rows of one provider, or of all of them.

    All providers come from the combined folder where there is one. Dates are
    ISO text on disk, so a text comparison reaches the Parquet statistics. A
    source without files gives an empty frame.
    """
    root = path.rstrip("/")
    if flt.is_given(cloud):
        df = _load(spark, [f"{root}/{cloud}"])
    else:
        df = _load(spark, [f"{root}/combined"])
        if df is None:
            df = _load(spark, [f"{root}/{c}" for c in C.CLOUD_PROVIDERS])
    if df is None:
        return spark.createDataFrame([], RAW_BILLING)
    if start is not None:
        df = df.where(F.col("usage_date") >= str(start))
    if end is not None:
        df = df.where(F.col("usage_date") <= str(end))
    return blanks_to_null(df if limit is None else df.limit(limit))


class ParquetSource:
    """Billing Parquet under one root folder."""

    cloud_provider = "all"

    def __init__(self, root: str):
        self.root = root

    def ready(self, spark: SparkSession) -> bool:
        try:
            return not read_billing(spark, self.root).isEmpty()
        except Exception:  # noqa: BLE001  a broken source is not ready
            return False

    def read(self, spark: SparkSession, start=None, end=None, cloud=None,
             account=None) -> DataFrame:
        rows = read_billing(spark, self.root, cloud, start, end)
        if not flt.is_given(account):
            return rows
        return flt.equals(rows, account_id=account).orderBy("usage_date", "record_id")

    def read_cloud(self, spark: SparkSession, cloud: str, start=None, end=None) -> DataFrame:
        return self.read(spark, start, end, cloud)

    def available_range(self, spark: SparkSession, cloud=None) -> DataFrame:
        return available_range(read_billing(spark, self.root, cloud))

    def read_windows(self, spark: SparkSession, start, end) -> DataFrame:
        return in_windows(self.read(spark, start, end), fetch_windows(spark, start, end))


def available_range(raw: DataFrame) -> DataFrame:
    return raw.agg(F.min("usage_date").alias("min_date"), F.max("usage_date").alias("max_date"))


def fetch_windows(spark: SparkSession, start, end) -> DataFrame:
    """Inclusive windows of start..start+30 days, the next one starting the day after."""
    first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    step = C.FETCH_WINDOW_DAYS + 1
    count = max(0, ((last - first).days // step) + 1)
    n = F.col("id").cast("int")
    begin = F.date_add(F.lit(first), n * step)
    return spark.range(count).select(
        n.alias("window_no"), begin.alias("window_start"),
        F.least(F.date_add(begin, C.FETCH_WINDOW_DAYS), F.lit(last)).alias("window_end"))


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows with the window they fall in; the window number is arithmetic on the
    date, so this is an equi join however many windows there are."""
    first = windows.agg(F.min("window_start")).scalar()
    day = F.col("usage_date").try_cast("date")
    number = F.floor(F.datediff(day, first) / (C.FETCH_WINDOW_DAYS + 1)).cast("int")
    return rows.withColumn("window_no", number).join(windows, "window_no")

