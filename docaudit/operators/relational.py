"""The relational layer: lookups, row security, joins, guarded writes as DataFrame rewrites."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators.numbering import free_name, numbered


class NotFoundError(LookupError):
    """No row has the key."""


class TooManyRowsError(LookupError):
    """More than one row has a key that should be unique."""


def lookup(df: DataFrame, **keys: Any) -> DataFrame:
    """Rows whose columns have these values; a value None matches null."""
    out = df
    for name, value in keys.items():
        out = out.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    return out


def one(df: DataFrame):
    """The only row, or an error."""
    rows = df.limit(2).collect()
    if not rows:
        raise NotFoundError("no such row")
    if len(rows) > 1:
        raise TooManyRowsError("several rows")
    return rows[0]


def first_by(df: DataFrame, key: str) -> DataFrame:
    """The row with the least key: a first row that does not depend on the order of files."""
    return df.orderBy(key).limit(1)


def visible(df: DataFrame, user: Any, is_admin: bool, owner: str = "user_id") -> DataFrame:
    """Row security: all rows for an administrator, else the user's own."""
    return df if is_admin else df.filter(F.col(owner) == user)


def owned_through(rows: DataFrame, parents: DataFrame, key: str, user: Any, owner: str = "user_id") -> DataFrame:
    """Rows whose parent is the user's: a semi join with the parents filtered first."""
    return rows.join(parents.filter(F.col(owner) == user).select(key), key, "left_semi")


def owned_with_parent(rows: DataFrame, parents: DataFrame, key: str, user: Any, owner: str = "user_id", name: str = "parent") -> DataFrame:
    """Rows whose parent is the user's, with the parent as a struct: the parents are filtered first, and one join does what a join, an
    EXISTS and an eager load of the same parent do. A parent's key is unique."""
    own = parents.filter(F.col(owner) == user)
    return rows.join(own.select(key, F.struct(*parents.columns).alias(name)), key)


def user_stats(documents: DataFrame, user: str = "user_id", score: str = "score", time: str = "analysis_time") -> DataFrame:
    """Number of a user's documents, and averages of score and analysis time over those that have one."""
    return documents.groupBy(user).agg(F.count(F.lit(1)).alias("documents_count"), F.avg(score).alias("average_compliance"), F.avg(time).alias("average_time_minutes"))


def through_chain(rows: DataFrame, middle: DataFrame, top: DataFrame, to_middle: str, to_top: str, user: Any, owner: str = "user_id") -> DataFrame:
    """Rows whose parent's parent is the user's; both joins are to one row at most, so nothing is doubled."""
    return rows.join(middle.select(to_middle, to_top), to_middle).join(top.filter(F.col(owner) == user).select(to_top), to_top).select(*[c for c in rows.columns])


def with_lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: Any, name: str) -> DataFrame:
    """A looked-up value, or the default where there is none. Of several values of a key the greatest counts, so no row is doubled; a null
    key has the default."""
    own = table.groupBy(key).agg(F.max(value).alias(name))
    return rows.join(own, key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array, empty if none."""
    own = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    joined = parents.join(own, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def insertable(new: DataFrame, old: DataFrame, keys: list[str], bypass: Column | None = None) -> DataFrame:
    """New rows whose key is not taken, and of new rows with one key the first by all columns; null keys are equal.

    Rows for which bypass holds are let in unchecked.
    """
    free = new.filter(~bypass) if bypass is not None else new
    free = free.join(old.select(*keys).distinct(), null_safe(free, old, keys), "left_anti")
    window = Window.partitionBy(*keys).orderBy(*new.columns)
    place = free_name(free, "place")
    free = free.withColumn(place, F.row_number().over(window)).filter(F.col(place) == 1).drop(place)
    return free.unionByName(new.filter(bypass)) if bypass is not None else free


def rejected(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is taken."""
    return new.join(old.select(*keys).distinct(), null_safe(new, old, keys), "left_semi")


def append_unique(old: DataFrame, new: DataFrame, keys: list[str], bypass: Column | None = None) -> DataFrame:
    return old.unionByName(insertable(new, old, keys, bypass))


def get_or_create(table: DataFrame, wanted: DataFrame, key: str, id_col: str) -> DataFrame:
    """The table with a row for every wanted key; new ids follow the greatest in the order of the keys, without gaps.

    Missing keys are numbered by range partitions (see numbering.numbered), so neither table has to be small. A null key gets no
    row; wanted keys that repeat get one.
    """
    missing = wanted.select(key).dropna().distinct().join(table.select(key), key, "left_anti")
    top = table.agg(F.max(id_col)).first()[0]
    return table.unionByName(numbered(missing, [key], id_col, after=top or 0), allowMissingColumns=True)


def _with_changes(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, str]:
    """The table with a struct of these columns of its change, and the struct's name. Of several changes of a key the greatest counts, so
    no row is doubled."""
    new = free_name(table, "new")
    return table.join(changes.groupBy(key).agg(F.max(F.struct(*columns)).alias(new)), key, "left"), new


def update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with these columns of rows with a change replaced, nulls included.

    Rows of the table that repeat a key are all changed; of several changes of a key the greatest counts, and those of keys that the
    table lacks, or of null, do nothing.
    """
    joined, new = _with_changes(table, changes, key, columns)
    return joined.withColumns({c: F.when(F.col(new).isNotNull(), F.col(f"{new}.{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def update_sparse(table: DataFrame, changes: DataFrame, key: str, columns: list[str], mask: str = "set_columns") -> DataFrame:
    """As update, but of each change only the columns that its array `mask` names: null and not set differ."""
    joined, new = _with_changes(table, changes, key, [mask, *columns])
    chosen = lambda c: F.coalesce(F.array_contains(F.col(f"{new}.{mask}"), c), F.lit(False))
    return joined.withColumns({c: F.when(chosen(c), F.col(f"{new}.{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def set_where(table: DataFrame, column: str, value: Any, condition: Column) -> DataFrame:
    return table.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_cascading(children: DataFrame, parents: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children that are left once parents are deleted."""
    return children.join(parents.join(deleted.select(key), key, "left_semi").select(key), key, "left_anti")


def restricted(deleted: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Of keys to delete those that children still need."""
    return deleted.join(children.select(key), key, "left_semi")


def violations(df: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """Rows that break an expectation, with the names of those broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in expectations.items()]))
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def latest(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))
