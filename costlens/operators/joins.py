"""Joins whose probe side may be dominated by one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def salted_left_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: list[str],
                     salts: int = SALTS) -> DataFrame:
    """Left join that spreads every key of `big` over `salts` tasks.

    The salt is a hash of columns that vary within a key, so a retried task
    computes the same one. `small` holds one row per key and is repeated once
    per salt; when it is small at run time adaptive execution broadcasts it
    instead and the salt costs nothing.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.withColumn("_salt", F.col("_salt").cast("bigint"))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def null_safe_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose key is not in `right`; NULL equals NULL."""
    seen = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(seen, cond, "left_anti")


def semi_on_either(df: DataFrame, ids: DataFrame, first: str, second: str) -> DataFrame:
    """Rows whose `first` or `second` column is among `ids.identifier`.

    Two equi joins instead of one join with OR, which could only be a nested loop.
    """
    wanted = ids.select("identifier").distinct()
    by_first = df.join(wanted, F.col(first) == F.col("identifier"), "left_semi")
    rest = df.join(wanted, F.col(first) == F.col("identifier"), "left_anti")
    by_second = rest.join(wanted, F.col(second) == F.col("identifier"), "left_semi")
    return by_first.unionByName(by_second)
