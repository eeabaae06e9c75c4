"""Readers for the providers' own landed cost exports.

Each maps the export's published columns to the raw schema. A location that is
missing or unreadable gives an empty frame, and `ready` says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from costlens import session
from costlens.functions.identity import row_id
from costlens.functions.mapping import fx_rate
from costlens.schemas import RAW_BILLING


def _raw(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Raw-schema select; labels the exports do not carry are false or NULL."""
    fixed = {"is_anomaly": F.lit(False), "is_duplicate": F.lit(False),
             "is_backdated": F.lit(False)}
    have = fixed | columns
    return df.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in RAW_BILLING])


def from_aws(df: DataFrame) -> DataFrame:
    """Cost and usage report: `line_item_*`, `product_*` and `resource_tags_*` columns."""
    tags = [c for c in df.columns if c.startswith("resource_tags_user_")]
    tag_map = F.to_json(F.struct(*[F.col(c).alias(c.removeprefix("resource_tags_user_"))
                                   for c in tags])) if tags else F.lit("{}")
    cost, cur = F.col("line_item_unblended_cost"), F.col("line_item_currency_code")
    day = F.col("line_item_usage_start_date").try_cast("timestamp").cast("date")
    return _raw(df, {
        "record_id": F.coalesce(F.col("identity_line_item_id"),
                                row_id(F.col("line_item_resource_id"), day, cost)),
        "cloud_provider": F.lit("aws"), "account_id": F.col("line_item_usage_account_id"),
        "service": F.col("product_servicename"), "region": F.col("product_region"),
        "resource_id": F.col("line_item_resource_id"), "usage_date": day.cast("string"),
        "cost_usd": cost * fx_rate(cur), "original_cost": cost, "original_currency": cur,
        "exchange_rate": fx_rate(cur), "tags": tag_map,
        "ingested_at": F.col("bill_billing_period_end_date")})


def from_azure(df: DataFrame) -> DataFrame:
    """Cost details export: PascalCase columns, tags as a JSON object without braces."""
    cost, cur = F.col("CostInBillingCurrency"), F.col("BillingCurrency")
    day = F.col("Date").try_cast("date")
    text = F.trim("Tags")
    tags = (F.when(text.isNull() | (text == ""), "{}").when(text.startswith("{"), text)
            .otherwise(F.concat(F.lit("{"), text, F.lit("}"))))
    return _raw(df, {
        "record_id": row_id(F.col("SubscriptionId"), F.col("ResourceId"), F.col("MeterId"),
                            day, cost),
        "cloud_provider": F.lit("azure"), "account_id": F.col("SubscriptionId"),
        "service": F.col("ServiceName"), "region": F.col("ResourceLocation"),
        "resource_id": F.col("ResourceId"), "usage_date": day.cast("string"),
        "cost_usd": cost * fx_rate(cur), "original_cost": cost, "original_currency": cur,
        "exchange_rate": fx_rate(cur), "tags": tags,
        "ingested_at": F.col("Date").cast("string")})


def from_gcp(df: DataFrame) -> DataFrame:
    """Billing export: nested structs; labels are an array of key and value."""
    cost, cur = F.col("cost"), F.col("currency")
    day = F.col("usage_start_time").try_cast("timestamp").cast("date")
    keyed = F.filter("labels", lambda x: x["key"].isNotNull())
    # of a repeated key the last value holds
    last = F.filter(keyed, lambda x, i: ~F.exists(
        F.slice(keyed, i + 2, F.size(keyed)), lambda y: y["key"] == x["key"]))
    labels = F.to_json(F.map_from_entries(F.transform(
        last, lambda x: F.struct(x["key"], x["value"]))))
    return _raw(df, {
        "record_id": row_id(F.col("project.id"), F.col("service.description"),
                            F.col("usage_start_time"), cost),
        "cloud_provider": F.lit("gcp"), "account_id": F.col("project.id"),
        "service": F.col("service.description"), "region": F.col("location.region"),
        "resource_id": F.col("resource.name"), "usage_date": day.cast("string"),
        "cost_usd": cost * fx_rate(cur), "original_cost": cost, "original_currency": cur,
        "exchange_rate": fx_rate(cur), "tags": F.coalesce(labels, F.lit("{}")),
        "ingested_at": F.col("export_time").cast("string")})


#: The export's own column that the usage date is mapped from.
DAY_COLUMN = {"aws": "line_item_usage_start_date", "azure": "Date", "gcp": "usage_start_time"}


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows whose day lies in the inclusive range, by bounds on the raw column.

    Dates and times are compared as they are stored, so the bounds reach the file's
    statistics. Text is left to the test that follows the mapping: forms that are read
    as the same day do not order alike.
    """
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return df
    if start is not None:
        df = df.where(F.col(column) >= F.lit(str(start)).cast("date").cast(kind))
    if end is not None:
        after = F.date_add(F.lit(str(end)).cast("date"), 1)
        df = df.where(F.col(column) < after.cast(kind))
    return df


class ExportSource:
    """A landed export as a source plug-in."""

    MAPPERS = {"aws": from_aws, "azure": from_azure, "gcp": from_gcp}

    def __init__(self, cloud_provider: str, location: str | None, format: str = "parquet",
                 **options):
        self.cloud_provider, self.location = cloud_provider, location
        self.format, self.options = format, options

    def _load(self, spark: SparkSession) -> DataFrame | None:
        if not self.location or not session.exists(spark, self.location):
            return None
        try:
            return spark.read.format(self.format).options(**self.options).load(self.location)
        except AnalysisException:
            return None

    def ready(self, spark: SparkSession) -> bool:
        return self._load(spark) is not None

    def read(self, spark: SparkSession, start=None, end=None) -> DataFrame:
        df = self._load(spark)
        if df is None:
            return spark.createDataFrame([], RAW_BILLING)
        df = in_range(df, DAY_COLUMN[self.cloud_provider], start, end)
        rows = self.MAPPERS[self.cloud_provider](df)
        if start is not None:
            rows = rows.where(F.col("usage_date") >= str(start))
        if end is not None:
            rows = rows.where(F.col("usage_date") <= str(end))
        return rows
