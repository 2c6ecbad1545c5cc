"""From links to the guarded two-way table."""

from pyspark.sql import DataFrame

from kinlink.operators.crosstab import (
    MIN_SIZE,
    group_totals,
    guarded_crosstab,
    matched_records,
)
from kinlink.session import materialise


def private_crosstab(
    records: DataFrame,
    links: DataFrame,
    min_size: int = MIN_SIZE,
    on_small: str = "merge",
    release_small_total: bool = False,
    skip_missing_payload: bool = False,
    keep_missing_category: bool = False,
    seed: str = "",
    labels: str = "text",
) -> DataFrame:
    """``(label, n, total, avg)`` over the distinct linked ``records(id, payload, category)``.

    The size rule does not stop someone from comparing two releases that differ by a few
    queries; it promises only that no small group is in this table.
    """
    totals = group_totals(
        matched_records(records, links), skip_missing_payload, keep_missing_category
    )
    # One row per category, read several times by the size gate and the merge.
    totals = materialise(totals, "totals")
    return guarded_crosstab(totals, min_size, on_small, release_small_total, seed, labels)
