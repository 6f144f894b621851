"""Checks that look only at what a batch touched.

As long as a table was right before, a batch can only break a rule for the keys of the rows it
adds or changes. These keys are joined to the table first, so that the checks behind see a part of the
table of about the size of the batch; their results are those of the full checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoload.operators import checks


def touched(rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur in the batch, NULL being equal to NULL."""
    wanted = batch.select(*[F.col(k).alias(f"_touched_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_touched_{k}"))
    return rows.join(wanted, same, "left_semi")


def duplicates(after: DataFrame, batch: DataFrame, keys: list[str], nulls_equal: bool = False) -> DataFrame:
    """M13 for the keys of added and changed rows; ``after`` is the table with the batch."""
    return checks.duplicates(touched(after, batch, keys), keys, nulls_equal)


def orphans(child_after: DataFrame, child_batch: DataFrame, child_key: str, parent_after: DataFrame, parent_key: str, parents_gone: DataFrame | None = None) -> DataFrame:
    """Rows without a parent, among those that refer to a key of the batch or to a parent that went.

    ``parents_gone`` are parent rows deleted, or with their old keys where these were changed.
    """
    wanted = child_batch.select(F.col(child_key).alias(child_key))
    if parents_gone is not None:
        wanted = wanted.unionByName(parents_gone.select(F.col(parent_key).alias(child_key)))
    return checks.orphans(touched(child_after, wanted, [child_key]), child_key, touched(parent_after, wanted.select(F.col(child_key).alias(parent_key)), [parent_key]), parent_key)


def region_conflicts(after: DataFrame, batch: DataFrame) -> DataFrame:
    """M11 for the countries of the batch: each rule is judged within one country."""
    return checks.region_conflicts(touched(after, batch, ["country_code"]))


def order_report(after: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """M12, W1 for the groups of the batch."""
    return checks.order_report(touched(after, batch, [key]), key, order)
