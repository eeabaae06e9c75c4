"""Ordering, top-k and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MAX_PAGE_SIZE = 500


def newest(df: DataFrame, column: str, n: int, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_first(), *tiebreak).limit(n)


def top_n(df: DataFrame, by: Column, n: int, *tiebreak: str) -> DataFrame:
    return df.orderBy(by.desc_nulls_first(), *tiebreak).limit(n)


def page(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 50,
         max_size: int = MAX_PAGE_SIZE) -> DataFrame:
    """One page plus `total` and `has_next` on each of its rows.

    `order` should end in a unique column, or pages may overlap. The total is a
    scalar subquery, so the page itself stays a bounded top-k.
    """
    if page < 1 or not 1 <= page_size <= max_size:
        raise ValueError(f"page must be >= 1 and page_size within 1..{max_size}")
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return rows.withColumn("total", total).withColumn(
        "has_next", F.col("total") > F.lit(page * page_size))


def page_result(df: DataFrame, order: list[Column], number: int = 1, page_size: int = 50,
                max_size: int = MAX_PAGE_SIZE) -> DataFrame:
    """One row: `items` (the page's rows in order), `total`, `page`, `page_size`, `has_next`.

    A page behind the last one has no items but still the total.
    """
    rows = page(df, order, number, page_size, max_size)
    place = F.row_number().over(W.orderBy(*order))
    rows = rows.select(place.alias("_i"), F.struct(*df.columns).alias("item"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("_i", "item"))), lambda x: x["item"])
    total = df.agg(F.count(F.lit(1))).scalar()
    return rows.agg(items.alias("items")).withColumns({
        "total": total, "page": F.lit(number), "page_size": F.lit(page_size),
        "has_next": total > F.lit(number * page_size)})


def page_after(df: DataFrame, key: str, last_seen, page_size: int) -> DataFrame:
    """Keyset paging: cost does not grow with the page number."""
    rest = df if last_seen is None else df.where(F.col(key) > F.lit(last_seen))
    return rest.orderBy(key).limit(page_size)


def multi_key_order(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Order by (column, ascending) pairs; NULLs last ascending, first descending."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_first()
                        for c, asc in keys])
