"""Parquet tables with natural keys: insert-if-absent, keyed merge, updates.

Dated tables are partitioned by the start of a week or month. A write computes
its batch once, into a staging path, and reads only the partitions the batch
touches: their few start dates become literals of the scan. Merged rows go to a
staging path in the shared folder and are then written over exactly those
partitions. A dynamic overwrite deletes a partition before it moves the new files
in, so a reader may meet a partition without rows while a write commits; a failed
write is repaired by repeating it.
"""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from costlens import session
from costlens.operators.dedup import first_wins
from costlens.operators.joins import salted_left_join
from costlens.schemas import TABLES

log = logging.getLogger(__name__)

PART = "part_date"
GRAIN = {"billing_records": "week"}
#: Columns that name single rows, by which an index finds a row's partition.
IDENTIFIERS = {"billing_records": ("fingerprint", "record_id")}
INDEX = "id_hash bigint, part_date date, bucket int"
INDEX_BUCKETS = 32


def path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _stored(table: str) -> T.StructType:
    schema, _, date_col = TABLES[table]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return nullable.add(PART, T.DateType()) if date_col else nullable


def bootstrap(spark: SparkSession, root: str) -> list[str]:
    """Create every table that does not exist yet, empty."""
    created = []
    for name in TABLES:
        if not _exists(spark, root, name):
            empty = spark.createDataFrame([], _stored(name))
            _writer(empty, name).mode("ignore").save(path(root, name))
            created.append(name)
    return created


def register(spark: SparkSession, root: str) -> None:
    """Catalog entries over the table paths, so SQL can name them."""
    for name in TABLES:
        scan(spark, root, name).createOrReplaceTempView(name)


def _exists(spark: SparkSession, root: str, table: str) -> bool:
    return session.exists(spark, path(root, table))


def _writer(df: DataFrame, table: str):
    writer = df.write.format("parquet")
    return writer.partitionBy(PART) if TABLES[table][2] else writer


def _with_part(df: DataFrame, table: str) -> DataFrame:
    date_col = TABLES[table][2]
    if not date_col:
        return df
    grain = GRAIN.get(table, "month")
    return df.withColumn(PART, F.date_trunc(grain, F.col(date_col)).cast("date"))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order and type; absent ones become NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in TABLES[table][0]])


def scan(spark: SparkSession, root: str, table: str, start=None, end=None) -> DataFrame:
    """Rows in a date range, reading only the partitions it covers."""
    schema, _, date_col = TABLES[table]
    if not _exists(spark, root, table):
        return spark.createDataFrame([], T.StructType(_stored(table).fields[:len(schema.fields)]))
    df = spark.read.schema(_stored(table)).parquet(path(root, table))
    if not date_col:
        return df
    grain = GRAIN.get(table, "month")
    if start is not None:
        day = F.lit(start).cast("date")
        df = df.where((F.col(PART) >= F.date_trunc(grain, day).cast("date"))
                      & (F.col(date_col) >= day))
    if end is not None:
        day = F.lit(end).cast("date")
        df = df.where((F.col(PART) <= day) & (F.col(date_col) <= day))
    return df.drop(PART)


def _parts(rows: DataFrame) -> list:
    """Partitions of staged rows: one date per week or month they cover."""
    return [r[PART] for r in rows.select(PART).distinct().toLocalIterator()]


def _touched(spark: SparkSession, root: str, table: str, incoming: DataFrame) -> DataFrame:
    """Stored rows of the partitions that the staged `incoming` has rows for.

    The partitions are named by literals, so files of others are not even listed.
    """
    stored = (spark.read.schema(_stored(table)).parquet(path(root, table))
              if _exists(spark, root, table) else spark.createDataFrame([], _stored(table)))
    if not TABLES[table][2]:
        return stored
    return stored.where(F.col(PART).isin(_parts(incoming)))


# --- identifier index --------------------------------------------------------

def _index_path(root: str, table: str) -> str:
    return path(root, f"_index/{table}")


def _write_index(rows: DataFrame, root: str, table: str, mode: str) -> None:
    hashes = F.explode(F.array(*[F.xxhash64(c) for c in IDENTIFIERS[table]]))
    entries = rows.select(hashes.alias("id_hash"), PART).distinct()
    entries = entries.withColumn("bucket", F.pmod("id_hash", F.lit(INDEX_BUCKETS)).cast("int"))
    (entries.hint("rebalance", "bucket").write.mode(mode)
     .option("partitionOverwriteMode", "static").partitionBy("bucket")
     .parquet(_index_path(root, table)))


def rebuild_index(spark: SparkSession, root: str, table: str) -> None:
    """Write a table's index anew from its stored rows, for one that has none yet or many
    small files."""
    stored = spark.read.schema(_stored(table)).parquet(path(root, table))
    _write_index(stored, root, table, "overwrite")


def _index(rows: DataFrame, root: str, table: str) -> None:
    """Note the partitions of rows that are about to be written.

    The index is written first, so it names every stored row whatever fails; it may name
    more, as it is not trimmed when a batch is repeated.
    """
    if table not in IDENTIFIERS:
        return
    spark = rows.sparkSession
    if _exists(spark, root, table) and not session.exists(spark, _index_path(root, table)):
        rebuild_index(spark, root, table)
    _write_index(rows, root, table, "append")


def holding(spark: SparkSession, root: str, table: str, ids: DataFrame) -> list:
    """Partitions that may hold a row with one of `ids.identifier`.

    Reads only the index buckets that the identifiers fall in, and no stored row.
    """
    if not session.exists(spark, _index_path(root, table)):
        rebuild_index(spark, root, table)
    return _parts(_index_entries(spark, root, table, ids))


def _index_entries(spark: SparkSession, root: str, table: str, ids: DataFrame) -> DataFrame:
    hashed = session.materialize(ids.select(F.xxhash64("identifier").alias("id_hash")).distinct(),
                                 "id-hashes")
    bucket = F.pmod("id_hash", F.lit(INDEX_BUCKETS)).cast("int")
    buckets = [r["b"] for r in hashed.select(bucket.alias("b")).distinct().toLocalIterator()]
    entries = spark.read.schema(INDEX).parquet(_index_path(root, table))
    return entries.where(F.col("bucket").isin(buckets)).join(hashed, "id_hash", "left_semi")


# --- writes ------------------------------------------------------------------

def _append(df: DataFrame, root: str, table: str) -> None:
    spread = df.hint("rebalance", PART) if TABLES[table][2] else df
    _writer(spread, table).mode("append").save(path(root, table))


def _overwrite(df: DataFrame, root: str, table: str, staged: bool = False) -> None:
    """Replace the partitions that `df` has rows for; it is staged first if it is not yet."""
    spark = df.sparkSession
    staged = df if staged else session.materialize(df, f"staging-{table}")
    spread = staged.hint("rebalance", PART) if TABLES[table][2] else staged
    (_writer(spread, table).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .save(path(root, table)))
    spark.catalog.refreshByPath(path(root, table))


def _observed(counter: Observation, rows: DataFrame) -> int:
    """The observed row count. Adaptive execution drops the counter from a plan that
    turns out to be empty; then the rows are counted, which raises what is wrong
    otherwise. To be called before the table's file listing is refreshed."""
    try:
        return counter.get["rows"]
    except Py4JJavaError:
        return rows.count()


def _by_value(df: DataFrame) -> list[Column]:
    """An order over whole rows, so that a retry picks the same one of a repeated key."""
    return [F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name)
            for f in df.schema]


def insert_if_absent(df: DataFrame, root: str, table: str,
                     order: list[str | Column] | None = None,
                     unique: bool = False) -> dict[str, int]:
    """Append the rows whose key is neither stored nor repeated earlier in the batch.

    `unique` says that the batch repeats no key, which saves its deduplication.
    """
    spark, key = df.sparkSession, TABLES[table][1]
    incoming = _with_part(conform(df, table), table)
    seen = Observation()
    once = incoming.observe(seen, F.count(F.lit(1)).alias("rows"))
    if not unique:
        first = [c for c in ("ingested_at", "record_id") if c in incoming.columns]
        once = first_wins(once, key, order or [*first, *_by_value(incoming)])
    batch = session.materialize(once, f"batch-{table}")
    stored = _touched(spark, root, table, batch).select(*key)
    _index(batch, root, table)
    added = Observation()
    new = batch.join(stored, key, "left_anti").observe(added, F.count(F.lit(1)).alias("rows"))
    _append(new.select(*batch.columns), root, table)
    inserted, total = _observed(added, new), _observed(seen, incoming)
    spark.catalog.refreshByPath(path(root, table))
    return {"inserted": inserted, "skipped": total - inserted, "total": total}


def new_rows(df: DataFrame, root: str, table: str) -> DataFrame:
    """The rows that `insert_if_absent` would append, in the table's columns, of a batch
    that repeats no key."""
    key = TABLES[table][1]
    once = _with_part(conform(df, table), table)
    batch = session.materialize(once, f"batch-{table}")
    stored = _touched(df.sparkSession, root, table, batch).select(*key)
    return batch.join(stored, key, "left_anti").select(*[f.name for f in TABLES[table][0]])


def append(rows: DataFrame, root: str, table: str) -> None:
    """Add rows whose keys are known not to be stored."""
    rows = _with_part(conform(rows, table), table)
    _index(rows, root, table)
    _append(rows, root, table)
    rows.sparkSession.catalog.refreshByPath(path(root, table))


def touched_with(incoming: DataFrame, root: str, table: str) -> DataFrame:
    """Stored rows of the partitions that the staged `incoming` falls in, and its own."""
    incoming = _with_part(conform(incoming, table), table)
    stored = _touched(incoming.sparkSession, root, table, incoming)
    return stored.unionByName(incoming).drop(PART)


def replace_partitions(staged: DataFrame, root: str, table: str) -> None:
    """Write staged rows over the partitions they fall in, which they hold whole."""
    _overwrite(_with_part(conform(staged, table), table), root, table, staged=True)


def merge(df: DataFrame, root: str, table: str, update: list[str] | None = None,
          order: list[str | Column] | None = None) -> None:
    """Keyed merge: new keys are inserted, existing ones take the `update` columns.

    `update` of None replaces every non-key column.
    """
    spark, key = df.sparkSession, TABLES[table][1]
    names = [f.name for f in TABLES[table][0]]
    replaced = set(names) - set(key) if update is None else set(update)
    incoming = _with_part(conform(df, table), table)
    incoming = first_wins(incoming, key, order or _by_value(incoming))
    incoming = session.materialize(incoming, f"batch-{table}")
    stored = _touched(spark, root, table, incoming)
    _index(incoming, root, table)
    part = [PART] if TABLES[table][2] else []
    old = stored.select(*key, *part, F.struct(*names).alias("_old"))
    new = incoming.select(*key, *part, F.struct(*names).alias("_new"))
    pairs = old.join(new, [*key, *part], "full_outer")

    def column(name: str) -> Column:
        if name in key:
            return F.col(name)
        o, n = F.col(f"_old.{name}"), F.col(f"_new.{name}")
        if name in replaced:
            return F.when(F.col("_new").isNotNull(), n).otherwise(o).alias(name)
        return F.when(F.col("_old").isNotNull(), o).otherwise(n).alias(name)

    _overwrite(pairs.select(*[column(n) for n in names], *part), root, table)


def flag_by_dimensions(billing: DataFrame, flagged: DataFrame) -> DataFrame:
    """Set flag and severity where (cloud, category, account, date) is flagged.

    Several severities for one tuple: the highest holds.
    """
    from costlens.functions.scoring import severity_rank
    keys = ["cloud_provider", "service_category", "account_id", "usage_date"]
    worst = flagged.groupBy(*keys).agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("_sev"))
    marked = salted_left_join(billing, worst, keys, ["fingerprint"])
    return _apply_flag(marked, billing.columns)


def flag_by_identifier(billing: DataFrame, flagged: DataFrame) -> DataFrame:
    """Set flag and severity where the fingerprint or the record id is listed.

    Both are unique per row, so neither join has a hot key.
    """
    from costlens.functions.scoring import severity_rank
    worst = flagged.groupBy("identifier").agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("_s"))
    a = worst.select(F.col("identifier").alias("fingerprint"), F.col("_s").alias("_s1"))
    b = worst.select(F.col("identifier").alias("record_id"), F.col("_s").alias("_s2"))
    marked = (billing.join(a, "fingerprint", "left").join(b, "record_id", "left")
              .withColumn("_sev", F.coalesce("_s1", "_s2")).drop("_s1", "_s2"))
    return _apply_flag(marked, billing.columns)


def _apply_flag(marked: DataFrame, columns: list[str]) -> DataFrame:
    hit = F.col("_sev").isNotNull()
    return marked.withColumns({
        "anomaly_flag": hit | F.col("anomaly_flag"),
        "anomaly_severity": F.coalesce("_sev", "anomaly_severity")}).select(*columns)


def update_flags(root: str, flagged: DataFrame) -> None:
    """Rewrite only the billing partitions that hold a flagged date."""
    spark = flagged.sparkSession
    flagged = session.materialize(flagged, "flagged")
    touched = _touched(spark, root, "billing_records", _with_part(flagged, "billing_records"))
    _overwrite(_with_part(flag_by_dimensions(touched.drop(PART), flagged), "billing_records"),
               root, "billing_records")


def _holding(root: str, table: str, spark: SparkSession, hit: Column, listed: DataFrame) -> DataFrame:
    """Stored rows of the partitions that hold a row `listed` names, found by keys alone."""
    stored = spark.read.schema(_stored(table)).parquet(path(root, table))
    found = stored.join(listed, hit, "left_semi").select(PART).distinct()
    return stored.where(F.col(PART).isin(_parts(found)))


def update_flags_by_identifier(root: str, flagged: DataFrame) -> None:
    """Flag stored rows by fingerprint or record id.

    The index says which partitions hold one; only those are read and rewritten.
    """
    spark, table = flagged.sparkSession, "billing_records"
    if not _exists(spark, root, table):
        return
    ids = session.materialize(flagged.select("identifier", "severity"), "flagged")
    stored = spark.read.schema(_stored(table)).parquet(path(root, table))
    touched = stored.where(F.col(PART).isin(sorted(holding(spark, root, table, ids))))
    _overwrite(_with_part(flag_by_identifier(touched.drop(PART), ids), table), root, table)


def resolve_stored(root: str, resolutions: DataFrame) -> int:
    """Close stored alerts; only partitions that hold one are rewritten. Returns how many."""
    spark = resolutions.sparkSession
    if not _exists(spark, root, "alerts"):
        return 0
    todo = session.materialize(resolutions.select("alert_id", "resolved_at"), "resolutions")
    ids = todo.select(F.col("alert_id").alias("_id"))
    touched = _holding(root, "alerts", spark, F.col("alert_id") == F.col("_id"), ids)
    done = session.materialize(resolve(touched, todo), "resolved")
    _overwrite(done.drop("changed"), root, "alerts")
    return done.where("changed").count()


def resolve(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Close the open alerts listed in `resolutions` (alert_id, resolved_at).

    `changed` tells whether a row was open before; closing twice changes nothing.
    """
    once = resolutions.groupBy("alert_id").agg(F.min("resolved_at").alias("_at"))
    changed = F.col("_at").isNotNull() & ~F.col("is_resolved")
    return (alerts.join(once, "alert_id", "left").withColumn("changed", changed)
            .withColumn("resolved_at", F.when(F.col("changed"), F.col("_at"))
                        .otherwise(F.col("resolved_at")))
            .withColumn("is_resolved", F.col("is_resolved") | F.col("changed")).drop("_at"))


def log_run(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Append audit rows; a failure to log does not fail the run, but is told."""
    try:
        _append(conform(rows, "ingestion_log"), root, "ingestion_log")
    except Exception:  # noqa: BLE001
        log.warning("the audit row could not be written to %s", root, exc_info=True)


# --- plain writers -----------------------------------------------------------

def write_dataset(df: DataFrame, target: str) -> None:
    """One folder per provider, files sorted by usage date."""
    (df.hint("rebalance", "cloud_provider").sortWithinPartitions("usage_date")
     .write.mode("overwrite").partitionBy("cloud_provider").parquet(target))


def write_csv(df: DataFrame, target: str) -> None:
    """Header, quotes only where needed and doubled inside, NULL as nothing."""
    text = df.select(*[F.col(c).cast("string").alias(c) if not isinstance(
        df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType))
        else F.to_json(c).alias(c) for c in df.columns])
    (text.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(target))


LABEL_COLUMNS = ("is_anomaly", "anomaly_type", "anomaly_severity", "is_duplicate", "is_backdated")


def write_unlabelled_csv(df: DataFrame, target: str) -> None:
    write_csv(df.drop(*LABEL_COLUMNS), target)


def write_manifest(summary: DataFrame, target: str) -> None:
    summary.write.mode("overwrite").json(target)


# --- model parameters --------------------------------------------------------

def save_params(params: DataFrame, root: str, model: str) -> None:
    params.write.mode("overwrite").parquet(f"{root.rstrip('/')}/models/{model}")


def load_params(spark: SparkSession, root: str, model: str) -> DataFrame | None:
    place = f"{root.rstrip('/')}/models/{model}"
    return spark.read.parquet(place) if session.exists(spark, place) else None


def merge_params(spark: SparkSession, root: str, model: str, fresh: DataFrame,
                 keys: list[str]) -> DataFrame:
    """Store parameters of the groups in `fresh`; those of other groups stay as they are."""
    fresh = session.materialize(fresh, f"fit-{model}")
    known = load_params(spark, root, model)
    merged = fresh if known is None else known.join(
        fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
    save_params(session.materialize(merged, f"registry-{model}"), root, model)
    return load_params(spark, root, model)


def groups_to_train(groups: DataFrame, known: DataFrame | None, keys: list[str],
                    force: bool = False) -> DataFrame:
    """Groups without stored parameters; all of them when forced."""
    if force or known is None:
        return groups
    return groups.join(known.select(*keys).distinct(), keys, "left_anti")
