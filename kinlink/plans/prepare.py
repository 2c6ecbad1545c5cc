"""Names to signature tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions.signatures import (
    LONG,
    MIDDLE,
    SHORT,
    name_text,
    signature,
    signature_prefix,
    unit_vector,
)
from kinlink.session import materialise, spread
from kinlink.sources.tables import insert_columns


def with_signature(records: DataFrame, name: str, length: int = LONG, place: int = 2) -> DataFrame:
    """``records`` with one signature column, e.g. ``sig50``; the first column is their key."""
    rows = spread(records, records.columns[0])
    return insert_columns(rows, place, **{f"sig{length}": signature(F.col(name), length)})


def prepare_records(records: DataFrame, name: str, place: int = 2) -> DataFrame:
    """``records`` with signatures of 200, 50 and 100 hashes and their unit vectors.

    The long signature is computed once and written down; the shorter ones are its prefixes.
    A null or too short name has null signatures and is not linkable.
    """
    rows = spread(records, records.columns[0])
    signed = rows.withColumn(name, name_text(F.col(name))).withColumn(
        "_sig", signature(F.col(name), LONG)
    )
    signed = materialise(signed, "signed")
    long = F.col("_sig")
    short, middle = signature_prefix(long, SHORT), signature_prefix(long, MIDDLE)
    return insert_columns(
        signed,
        place,
        sig200=long,
        unit200=unit_vector(long),
        sig50=short,
        unit50=unit_vector(short),
        sig100=middle,
        unit100=unit_vector(middle),
    ).drop("_sig")


def unlinkable(prepared: DataFrame, vec: str = "sig50") -> DataFrame:
    return prepared.where(F.col(vec).isNull())
