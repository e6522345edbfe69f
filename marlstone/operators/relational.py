"""Projection, renaming, labelling, joins, unions and top-k; each function takes and returns a DataFrame or Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranged

#: Rows of a dimension up to which `recode` inlines it as a map literal.
MAX_LITERAL_MAP = 200


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns all at once: {a: b, b: c} does not cascade. Names that are absent are passed over."""
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New names for all columns, in order; another number of names raises."""
    return df.toDF(*names)


def rename_by(df: DataFrame, name: Callable[[str], str]) -> DataFrame:
    """New names as `name` makes them of the old ones, all at once; two columns of one name raise."""
    names = [name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns would share a name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)


def first_columns(df: DataFrame, n: int, drop: Sequence[str] = ()) -> DataFrame:
    """The first n columns, without those of `drop`."""
    return df.select(*[c for c in df.columns[:n] if c not in drop])


def matches_any(column: Column, patterns: Sequence[str]) -> Column:
    """True where one of the regular expressions is found; null stays null, so a filter drops it."""
    return column.rlike("|".join(f"(?:{p})" for p in patterns))


def label_by_rules(column: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the last rule (pattern, label) that is found in the column, as if each overwrote the one before; else null."""
    out = F.lit(None).cast("string")
    for pattern, label in rules:
        out = F.when(column.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def ratio(numerator: Column, denominator: Column) -> Column:
    """Percentage; null for a zero denominator (the array library gives infinity or NaN there)."""
    return F.try_divide(numerator, denominator) * 100


def total(*columns: Column) -> Column:
    """Sum of columns; null where one of them is."""
    return reduce(lambda a, b: a + b, columns)


def band(value: Column, limit: float, low: str = "low", high: str = "high") -> Column:
    """`high` from the limit on, `low` below; null and NaN are in neither."""
    return F.when(F.isnan(value), None).when(value >= limit, high).when(value < limit, low)


def null_if_nan(column: Column) -> Column:
    return F.when(F.isnan(column), None).otherwise(column)


def patch(df: DataFrame, key: str, column: str, values: Mapping[int, str]) -> DataFrame:
    """Overwrite single cells: `values` maps a row's key to the new value of `column`."""
    made = reduce(lambda out, kv: F.when(F.col(key) == kv[0], kv[1]).otherwise(out), values.items(), F.col(column))
    return df.withColumn(column, made)


def drop_keys(df: DataFrame, key: str, keys: Sequence[int]) -> DataFrame:
    """Without the rows of these keys; rows with a null key stay."""
    return df.where(~F.coalesce(F.col(key).isin(list(keys)), F.lit(False)))


def align_column(df: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """`column` of `other` beside the rows of `df` with the same key; null where there is none."""
    return df.drop(column).join(other.select(key, column), key, "left")


def join_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on keys of different names; both stay. null_safe lets null match null."""
    a, b = left[left_key], right[right_key]
    return left.join(right, a.eqNullSafe(b) if null_safe else a == b, how)


def union_outer(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column that a frame lacks is null there. Duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_row(df: DataFrame, **values) -> DataFrame:
    """One more row; columns that are not named are null."""
    row = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(row)


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`df` with the rows of `changes` by label: a label that is there is overwritten, one that is not is added.

    Columns that `changes` has are taken from it, nulls as well; those that it lacks stay, and are null in new rows.
    Labels of `changes` are unique, or the query raises; rows of `df` that share a label are all overwritten. A null label
    is found nowhere: it stays, or is added. One join; other columns of `changes` are not read.
    """
    changed = [c for c in changes.columns if c in df.columns and c != key]
    new = F.struct(F.lit(1).alias("_there"), *[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(f"_c{i}") for i, c in enumerate(changed)])
    own = changes.withColumn("_alone", F.when(F.col(f"`{key}`").isNull(), F.monotonically_increasing_id()))
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("label repeats in the changes: "), F.first(f"`{key}`").cast("string")))).otherwise(F.first("_new"))
    own = own.withColumn("_new", new).groupBy(F.col(f"`{key}`").cast(df.schema[key].dataType).alias("_key"), "_alone").agg(once.alias("_new"))
    made = df.withColumn("_old", F.lit(1)).join(own, F.col(f"`{key}`") == F.col("_key"), "full")
    there, old = F.col("_new._there").isNotNull(), F.col("_old").isNotNull()
    out = {key: F.when(old, F.col(f"`{key}`")).otherwise(F.col("_key"))}
    out |= {c: F.when(there, F.col(f"_new._c{i}")).otherwise(F.col(f"`{c}`")) for i, c in enumerate(changed)}
    return made.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def distinct_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """value: the distinct values of all the columns together, as texts, nulls left out; one pass, summed up where it is read.

    What is costly to look up is then looked up once a value, however many cells hold it.
    """
    cells = df.select(F.explode(F.array_distinct(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))).alias("value"))
    return cells.where("value is not null").distinct()


def recode_cells(df: DataFrame, columns: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """Replace values in several columns by one dictionary (value, replacement) of any size, in one pass, without cascading.

    The dictionary is cut to the values that occur before it is joined; a value that it lists more than once takes the
    least replacement, and a replacement that is null is taken. Values that are not listed stay, nulls too.
    """
    listed = dictionary.where("value is not null").groupBy("value").agg(F.min("replacement").alias("replacement"))
    used = distinct_cells(df, columns).join(listed, "value")
    out = df
    for i, c in enumerate(columns):
        known = used.select(F.col("value").alias(f"_v{i}"), F.col("replacement").alias(f"_r{i}"))
        out = out.join(known, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left")
    made = {c: F.when(F.col(f"_v{i}").isNotNull(), F.col(f"_r{i}")).otherwise(F.col(f"`{c}`").cast("string")) for i, c in enumerate(columns)}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in df.columns])


def recode(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace values in one pass, without cascading; values that are not mapped stay.

    A mapping of up to MAX_LITERAL_MAP entries is a literal. A larger one is a DataFrame (value, replacement), joined;
    Spark broadcasts it if its size allows.
    """
    if isinstance(mapping, DataFrame):
        known = mapping.select(F.col("value").alias(column), F.col("replacement").alias("_new"))
        made = df.join(known, column, "left").withColumn(column, F.coalesce("_new", column))
        return made.select(*df.columns)
    if len(mapping) > MAX_LITERAL_MAP:
        raise ValueError("give a large mapping as a DataFrame (value, replacement)")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order that is named: rows of a table have none of their own."""
    return df.orderBy(*order).limit(n)


def steps(df: DataFrame, every: int) -> DataFrame:
    """place: 0, every, 2 * every … below the number of rows of `df`; no rows give none."""
    n = df.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(every).cast("long"))).alias("place"))


def top_k(df: DataFrame, by: str, tie: str, k: int = 10) -> DataFrame:
    """The k rows with the least `by`, nulls last, ties by `tie`."""
    return df.orderBy(F.asc_nulls_last(by), tie).limit(k)


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows 1, n + 1, 2 n + 1 … in order, of a table of any size: see ranged.every_nth."""
    return ranged.every_nth(df, [order], n)
