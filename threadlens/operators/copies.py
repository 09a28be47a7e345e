"""One rule for rows that are there more than once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.storage import key_side, stored


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the one whose columns, in their order, are largest.

    The choice depends on the rows alone, never on their order or on tasks.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def each_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`one_of_each`, moving whole rows only where a key is repeated.

    The repeated keys are stored, so that they are looked for only once.
    """
    repeated = stored(rows.groupBy(*keys).count().filter(F.col("count") > 1).select(*keys), "repeated")
    if repeated.isEmpty():
        return rows
    repeated = key_side(repeated)
    single = rows.join(repeated, keys, "left_anti")
    return single.unionByName(one_of_each(rows.join(repeated, keys, "left_semi"), keys))
