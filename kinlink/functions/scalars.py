"""Column functions of the guarded cross-tab."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that counts as a number; anything else is treated as missing.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
UNKNOWN = "UNKNOWN"


def payload_value(text: Column) -> Column:
    """Numeric value of a payload; bad, missing and NaN values are null."""
    as_text = text.cast("string")
    number = F.when(as_text.rlike(NUMBER_PATTERN), F.trim(as_text).try_cast("double"))
    return F.nanvl(number, F.lit(None).cast("double"))


def payload_number(text: Column) -> Column:
    """Numeric value of a payload; bad, missing and NaN values become 0."""
    return F.coalesce(payload_value(text), F.lit(0.0))


def payload_or_zero(value: Column) -> Column:
    """Same rule for a column that already is numeric."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def category_flag(category: Column, value: str) -> Column:
    """1 where the record belongs to the category, else 0 (also for a missing category)."""
    return F.coalesce((category == F.lit(value)).cast("int"), F.lit(0))


def clip_score(score: Column, ceiling: float = 1.01) -> Column:
    """Scores no pair of unit vectors can reach are set to 0."""
    return F.when(score > ceiling, F.lit(0.0)).otherwise(score)


def cluster_flags(cluster_id: Column, clusters: list[int]) -> Column:
    """(cluster_id, flag) for each of the given ids, with a single flag 1 at the chosen one."""
    ids = F.array(*[F.lit(i) for i in clusters]).cast("array<int>")
    return F.transform(
        ids, lambda i: F.struct(i.alias("cluster_id"), (i == cluster_id).cast("int").alias("flag"))
    )


def safe_average(total: Column, n: Column) -> Column:
    return F.when(n != 0, total / n).otherwise(F.lit(0.0))


def size_deltas(n: Column, min_size: int) -> tuple[Column, Column]:
    """The two opposite differences that the size test looks at."""
    return n - min_size, F.lit(min_size) - n


def passes_size(n: Column, min_size: int) -> Column:
    """Strict: a group of exactly ``min_size`` does not pass."""
    above, below = size_deltas(n, min_size)
    return (above > 0) & (below < 0)


def hash_number(text: Column) -> Column:
    """First 32 bits of the MD5 of a text, as a bigint; the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def label_text(members: Column) -> Column:
    return F.array_join(F.array_sort(members), " OR ")
