"""Coverage, inventory, availability, balance and integrity reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.functions import scalars as S
from cambium.functions import stats


def with_total(frame: DataFrame, key: str, total: str, *aggregates: Column, also: Sequence[str] = ()) -> DataFrame:
    """Aggregates by key (and also) and, under the name total, over all keys. One pass: each row meets both groupings before the shuffle, in partial sums."""
    sets = [[F.col(key), *map(F.col, also)], [F.col(a) for a in also]]
    own = frame.groupingSets(sets, key, *also).agg(F.grouping(key).alias("_all"), *aggregates)
    return own.withColumn(key, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))).drop("_all")


def dense(grid: Sequence[DataFrame], facts: DataFrame, keys: Sequence[str], zeros: Sequence[str]) -> DataFrame:
    """Every combination of small dimensions, with the facts' numbers or 0. Dimensions are of checked size: their product is the size of the report."""
    out = grid[0]
    for d in grid[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out.join(facts, list(keys), "left").select(*keys, *[F.coalesce(F.col(z), F.lit(0)).cast("long").alias(z) for z in zeros])


def support(total: Column, contributors: Column, least_total: int, least_contributors: int) -> tuple[Column, Column]:
    """Status and reasons of a label's support."""
    reasons = S.rules(("insufficient_groups", total < least_total), ("insufficient_datasets", contributors < least_contributors))
    return F.when(F.size(reasons) == 0, "supported").otherwise("unsupported"), F.when(F.size(reasons) > 0, F.array_join(reasons, ";"))


def long_form(frame: DataFrame, keys: Sequence[str], dimensions: Mapping[str, Column]) -> DataFrame:
    """One row for each dimension's value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()])
    return frame.select(*keys, F.inline(pairs))


def availability(frame: DataFrame, by: str, unit: str, attributes: Mapping[str, Column], scopes: Mapping[str, Column]) -> DataFrame:
    """For each by and scope the distinct units, and those with each attribute told, as count and share."""
    out = None
    for scope, rows in scopes.items():
        own = frame.where(rows).groupBy(by).agg(F.count_distinct(unit).alias("units"), *[F.count_distinct(F.when(S.informative(c), F.col(unit))).alias(f"{n}_units") for n, c in attributes.items()])
        own = own.select(by, F.lit(scope).alias("scope"), "units", *[x for n in attributes for x in (F.col(f"{n}_units"), stats.fraction(F.col(f"{n}_units"), F.col("units")).alias(f"{n}_fraction"))])
        out = own if out is None else out.unionByName(own)
    return out


def balance(full: DataFrame, part: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts and shares of categories in all rows and in a part, and how far the shares are apart; categories of either."""
    a, b = (f.groupBy(*key).agg(F.count("*").alias(n)) for f, n in ((full, "full_count"), (part, "part_count")))
    sums = a.agg(F.sum("full_count").alias("_a")).crossJoin(b.agg(F.sum("part_count").alias("_b")))
    own = a.join(b, list(key), "full_outer").crossJoin(F.broadcast(sums))
    own = own.withColumn("full_count", F.coalesce("full_count", F.lit(0))).withColumn("part_count", F.coalesce("part_count", F.lit(0)))
    x, y = stats.ratio(F.col("full_count"), F.col("_a")), stats.ratio(F.col("part_count"), F.col("_b"))
    return own.select(*key, "full_count", "part_count", F.round(x, 6).alias("full_fraction"), F.round(y, 6).alias("part_fraction"), F.round(F.abs(x - y), 6).alias("difference"))


def overlaps(frame: DataFrame, split: str, unit: str, names: Sequence[str]) -> DataFrame:
    """For each two splits the units that are in both."""
    per = frame.groupBy(unit).agg(F.collect_set(split).alias("_s"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), (F.array_contains("_s", a) & F.array_contains("_s", b)).alias("both")) for a, b in pairs])
    return per.select(F.inline(each)).groupBy("left_split", "right_split").agg(F.count_if("both").alias("overlap"))


def checks(frame: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each rule, in one pass; a rule that can't be told counts as broken."""
    row = frame.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def unique(frame: DataFrame, *keys: str) -> DataFrame:
    """(rule, violations): keys that are there more than once."""
    return frame.groupBy(*keys).count().agg(F.lit("unique_" + "_".join(keys)).alias("rule"), F.count_if(F.col("count") > 1).alias("violations"))


def missing(left: DataFrame, right: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, violations): keys of left that right lacks."""
    return left.select(key).join(right.select(key), key, "left_anti").agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))


def crosstab(frame: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows by two columns, the second's values spread out, zeros filled in."""
    return frame.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def histogram(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Count of each given value, zeros too, and of all as total."""
    row = frame.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))
    names = [*values, "total"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias(column), F.col(n).alias("n")) for n in names])))
