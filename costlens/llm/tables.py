"""Reading, staging and batch sizes shared by the operators here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from costlens import session

#: Rows and bytes per Arrow batch: texts may be long, so bytes bound a batch.
ARROW_ROWS, ARROW_BYTES = 2048, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that clashing extra ones cannot meet ours."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write once to the shared folder and read back: a lost executor re-reads it."""
    path = session.run_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in the session's number of shuffle partitions: a small file's rows that are
    about to multiply must not stay in the few tasks that read it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def spread(df: DataFrame, column: str = "text", target: int = 48 << 20) -> int:
    """Partitions that hold about `target` bytes of a column each."""
    size = df.agg(F.sum(F.octet_length(F.col(column).cast("binary")))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-int(size) // target))
