"""Registry of queries and of the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from costlens import session
from costlens.sources import testbed as tb

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def entry(name: str, sql: str | None = None):
    def register(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.configure(session.local_default(spark))
            return plain(fn(Bed(spark, sf_dir)))
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that both engines print them alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


class Bed:
    """The derived views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, view: str) -> DataFrame:
        return getattr(tb, view)(self.spark, self.sf_dir)

    def root(self, label: str) -> str:
        return session.run_path(self.spark, label)


def rounded(df: DataFrame, dp: int, *columns: str) -> DataFrame:
    """Sums, which lie on a decimal grid, free of the last float digits."""
    return df.withColumns({c: F.round(c, dp) for c in columns})


def f32(df: DataFrame, *columns: str) -> DataFrame:
    """Ratios and deviations at single precision: equal however they were summed."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def s32(expr: str) -> str:
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)"
