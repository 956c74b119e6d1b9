"""Constraints as queries that return what violates them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complexity_score(c: Column) -> Column:
    """The number of ingredients as a score from 1 to 5."""
    return F.when(c <= 7, 1).when(c <= 10, 2).when(c <= 14, 3).when(c <= 18, 4).otherwise(5)


def strict_boolean(c: Column) -> Column:
    """true and false in any case, with space around; null for anything else (see ``not_boolean``)."""
    said = F.lower(F.trim(c))
    return F.when(said == "true", True).when(said == "false", False)


def not_boolean(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & strict_boolean(F.col(column)).isNull())


def or_null(c: Column) -> Column:
    """Empty strings as nulls."""
    return F.nullif(c, F.lit(""))


def counted_children(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str = "n") -> DataFrame:
    """Every parent key with its number of children. Children are counted before they meet parents."""
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def count_mismatches(parents: DataFrame, children: DataFrame, key: str, foreign: str, declared: str) -> DataFrame:
    return counted_children(parents, children, key, foreign).filter(F.col(declared) != F.col("n"))


def child_count_range(parents: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """least, most, parents and childless."""
    counts = counted_children(parents.select(key), children, key, foreign)
    return counts.agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("parents"), F.count_if(F.col("n") == 0).alias("childless")
    )


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose foreign key isn't null and has no parent."""
    return child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def foreign_keys(keys: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(fk, violations) of (name, child, foreign key, parent, key)."""
    each = [
        orphans(child.select(foreign), foreign, parent, key).agg(F.count("*").alias("violations")).select(F.lit(name).alias("fk"), "violations")
        for name, child, foreign, parent, key in keys
    ]
    return reduce(DataFrame.unionByName, each)


def dependency_violations(df: DataFrame, key: Sequence[str], determined: Sequence[str]) -> DataFrame:
    """Keys with more than one combination of the columns that they should determine."""
    return df.groupBy(*key).agg(F.countDistinct(F.struct(*determined)).alias("variants")).filter("variants > 1")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def key_counts(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(tables, expected, actual, agrees): distinct keys against rows."""
    each = [
        df.agg(F.countDistinct(F.struct(*key)).alias("expected"), F.count("*").alias("actual")).select(
            F.lit(name).alias("tables"), "expected", "actual"
        )
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, each).withColumn("agrees", F.col("expected") == F.col("actual"))


def reconcile(expected: Mapping[str, int], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables whose number of rows isn't the expected one."""
    each = [
        tables[name].agg(F.count("*").alias("actual")).select(F.lit(name).alias("table"), F.lit(n).cast("long").alias("expected"), "actual")
        for name, n in expected.items()
    ]
    return reduce(DataFrame.unionByName, each).filter("expected <> actual")


def not_contiguous(df: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """Groups whose positions aren't 1, 2, ... n."""
    n, p = F.count("*"), F.col(position)
    stats = df.groupBy(*group).agg(n.alias("n"), F.min(p).alias("least"), F.max(p).alias("most"), F.countDistinct(p).alias("distinct"))
    return stats.filter("least <> 1 OR most <> n OR distinct <> n")


def outside(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def bad_urls(df: DataFrame, column: str) -> DataFrame:
    """Rows whose URL isn't http(s) with a host."""
    scheme, host = F.try_parse_url(F.col(column), F.lit("PROTOCOL")), F.try_parse_url(F.col(column), F.lit("HOST"))
    return df.filter(~F.coalesce(F.lower(scheme).isin("http", "https") & (F.length(host) > 0), F.lit(False)))


def wrong_digests(df: DataFrame, text: str, digest: str) -> DataFrame:
    return df.filter(~F.sha2(text, 256).eqNullSafe(F.col(digest)))


def first_appearance(df: DataFrame, group: Sequence[str], label: str, order: str) -> DataFrame:
    """Each group's labels with their rank by first place."""
    firsts = df.filter(F.col(label).isNotNull()).groupBy(*group, label).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_first"))
    return firsts.withColumn("rank", rank).drop("_first")
