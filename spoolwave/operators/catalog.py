"""Catalogs and the metadata overlay: lookups, upserts, layered defaults, checks, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolwave.operators.ranking import ranked


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (J01, J02): an aggregate, combined before the shuffle, not a sort of every key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted."""
    return rows.join(wanted.select(key), key, "left_semi")


def with_spec(rows: DataFrame, spec: DataFrame, key: str, inherited: list[str], own_only: list[str] = ()) -> DataFrame:
    """rows with the columns of their spec: own values over those of "*", some never inherited.

    The default is one row; own specs are joined by key.
    """
    own = spec.where(F.col(key) != "*").select(F.col(key).alias("_key"), *[F.col(c).alias(f"_own_{c}") for c in (*inherited, *own_only)])
    star = spec.where(F.col(key) == "*").groupBy().agg(*[F.first(c).alias(f"_star_{c}") for c in inherited])
    joined = rows.join(own, F.col(key) == F.col("_key"), "left").join(F.broadcast(star), how="left")
    return joined.select(*rows.columns, *[F.coalesce(f"_own_{c}", f"_star_{c}").alias(c) for c in inherited], *[F.col(f"_own_{c}").alias(c) for c in own_only])


def minimal_flags(rows: DataFrame, key: str, flag: str, default: Column) -> DataFrame:
    """Flags that have to be written because they differ from the default."""
    return rows.where(~F.col(flag).eqNullSafe(default)).select(key, flag)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unknown(rows: DataFrame, known: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct keys that the other table does not have."""
    return rows.select(left).where(F.col(left).isNotNull()).distinct().join(known.select(F.col(right).alias(left)).distinct(), left, "left_anti")


def upsert(present: DataFrame, declared: DataFrame, key: str, assign: str) -> DataFrame:
    """present with `assign` replaced where declared, and declared keys that were missing."""
    d = declared.select(F.col(key), F.col(assign).alias("_new"))
    kept = present.join(d, key, "left").withColumn(assign, F.coalesce("_new", assign)).drop("_new")
    missing = declared.select(key, assign).join(present.select(key), key, "left_anti")
    return kept.unionByName(missing, allowMissingColumns=True)


def replace_groups(reader: DataFrame, declared: DataFrame, key: str, keep: str) -> DataFrame:
    """Declared rows replace the reader's of the same name but keep its `keep` where they have none."""
    r = reader.select(F.col(key).alias("_rkey"), *[F.col(c).alias(f"_r_{c}") for c in reader.columns if c != key])
    both = declared.join(r, F.col(key) == F.col("_rkey"), "full_outer")
    out = [F.coalesce(key, "_rkey").alias(key)]
    for c in declared.columns:
        if c != key:
            out.append((F.coalesce(c, f"_r_{c}") if c == keep else F.when(F.col(key).isNull(), F.col(f"_r_{c}")).otherwise(F.col(c))).alias(c))
    return both.select(*out)


def ordered_union(parts: list[DataFrame], key: str, pos: str) -> DataFrame:
    """(key, rank): keys of the first list in order, then unseen ones of the next (U03); the rank is taken over ranges of the keys."""
    rows = parts[0].select(key, F.lit(0).alias("_part"), F.col(pos).alias("_pos"))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.select(key, F.lit(i).alias("_part"), F.col(pos).alias("_pos")))
    first = rows.groupBy(key).agg(F.min(F.struct("_part", "_pos")).alias("_at"))
    return ranked(first, [F.col("_at"), F.col(key)], "rank").select(key, "rank")


def numeric_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, numeric): whether every cell of a text column is a number (K14, A23); false for an empty table."""
    tests = [F.coalesce(F.bool_and(F.col(c).try_cast("double").isNotNull()), F.lit(False)).alias(c) for c in columns]
    return rows.agg(*tests).select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("name", "numeric"))


def last_measured(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value): the last value that is not negative."""
    good = F.col(value) >= 0
    return rows.groupBy(key).agg(F.max_by(F.when(good, F.col(value)), F.when(good, F.struct(*order))).alias(value))


def event_target(channels: Column) -> Column:
    """Where an event series goes: one value per event is a table, several a series."""
    return F.when(channels == 1, F.lit("table")).otherwise(F.lit("series"))


def as_issues(rows: DataFrame, level: str, message: Column, kind: str, name: Column) -> DataFrame:
    """Findings as (level, message, target_kind, target_name)."""
    return rows.select(F.lit(level).alias("level"), message.alias("message"), F.lit(kind).alias("target_kind"), name.cast("string").alias("target_name"))


def blocked_reason(issues: DataFrame, pos: str) -> DataFrame:
    """(reason): distinct targets of errors in the order first seen (V17); issues are few."""
    first = issues.where("level = 'error'").groupBy("target_name").agg(F.min(pos).alias("_pos"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "target_name"))), lambda s: s["target_name"]), ", ").alias("reason"))
