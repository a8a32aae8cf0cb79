"""Dense numbers for the rows of large tables: by range partitions, without a window over all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.sources.workspace import new_folder

#: Rows of a partition that is numbered as one.
ROWS_PER_PART = 1 << 20
#: monotonically_increasing_id has the partition above this many bits, and the place in it below.
PLACE_BITS = 33


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def numbered(rows: DataFrame, order: list[str], name: str, after: int = 0, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """rows with the numbers after + 1, after + 2 and so on in the order of these columns, nulls first.

    Rows are dealt by ranges and sorted; each is written with its place in its partition, once, so a number is fixed whatever is computed
    again later. The counts of the partitions, a row each, give each partition's first number. Rows that are equal in all columns of
    the order share their numbers out among each other; many equal ones are one partition, so name columns that tell rows apart.
    """
    spark, place = rows.sparkSession, free_name(rows, "place")
    parts = max(1, math.ceil(rows.count() / rows_per_part))
    # the place is taken below the sort: it counts the rows of a partition as they come out of it
    placed = rows.repartitionByRange(max(parts, 2), *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    at = new_folder(spark, "numbered")
    placed.write.parquet(at)
    table = spark.read.schema(placed.schema).parquet(at)
    part = F.shiftright(place, PLACE_BITS)
    counts = table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as there are partitions
    first, starts = after, []
    for r in sorted(counts, key=lambda r: r.part):
        starts.append((r.part, first))
        first += r.n
    if not starts:
        return table.withColumn(name, F.lit(None).cast("long")).drop(place)
    own, begin = free_name(table, "part"), free_name(table, "begin")
    known = spark.createDataFrame(starts, f"`{own}` long, `{begin}` long")
    joined = table.withColumn(own, part).join(F.broadcast(known), own)
    return joined.withColumn(name, F.col(begin) + 1 + F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop(own, begin, place)
