"""Queries on look-ups, categories, the size gate, merging and the guarded table."""

from pyspark.sql import functions as F

from kinlink.functions.scalars import category_flag, payload_number, safe_average, size_deltas
from kinlink.operators.crosstab import (
    MIN_SIZE,
    distinct_categories,
    group_totals,
    matched_records,
    merge_map,
    merged_groups,
    merged_members,
    merged_totals,
    size_gate,
)
from kinlink.operators.lookups import block_lookup, category_lookup, payload_lookup
from kinlink.plans.crosstab import private_crosstab
from kinlink.queries.data import block_links, document_records, nation_customer, table
from kinlink.queries.sql import MATCHED_TOTALS, NATION_TOTALS, merge
from kinlink.queries.sql import block_links as block_links_sql
from kinlink.session import materialise

def payloads(spark, sf_dir):
    """Balances as text, some missing and some spoilt, read back as numbers."""
    balance = F.col("c_acctbal")
    text = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("string")).when(
        balance < 0, F.lit("n/a")
    ).otherwise(F.concat(F.lit(" "), balance.cast("decimal(18,2)").cast("string")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.isNull().alias("missing"), payload_number(text).alias("payload")
    )


def one_hot(spark, sf_dir):
    """One column for each category that occurs."""
    documents = table(spark, sf_dir, "documents")
    found = distinct_categories(documents.withColumnRenamed("lang", "category")).collect()
    return documents.select(
        "doc_id", *[category_flag(F.col("lang"), r[0]).alias(f"is_{r[0]}") for r in sorted(found)]
    )


def categories(spark, sf_dir):
    return distinct_categories(document_records(spark, sf_dir))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")


def last_payload(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return payload_lookup(customers, _events(spark, sf_dir), "c_custkey", "value", "event_id")


def last_category(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return category_lookup(customers, _events(spark, sf_dir), "c_custkey", "event_type", "event_id")


def document_block(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    grades = table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string"))
    return block_lookup(documents, grades, "doc_id", "quality", "doc_id")


def _nation_totals(spark, sf_dir):
    return materialise(group_totals(nation_customer(spark, sf_dir)), "totals")


def gate(spark, sf_dir):
    return size_gate(_nation_totals(spark, sf_dir)).where("passing").select("category", "n")


def deltas(spark, sf_dir):
    above, below = size_deltas(F.col("n"), MIN_SIZE)
    return _nation_totals(spark, sf_dir).select(
        "category", above.alias("above"), below.alias("below")
    )


def mapping(spark, sf_dir):
    return merge_map(_nation_totals(spark, sf_dir))


def _money(column):
    return F.col(column).cast("double").alias(column)


def labels(spark, sf_dir):
    totals = _nation_totals(spark, sf_dir)
    merged = merged_totals(totals, merge_map(totals))
    return merged.select("label", "n", _money("total"))


def named_groups(spark, sf_dir):
    """Merged groups by name, with the number of their categories instead of a list."""
    totals = _nation_totals(spark, sf_dir)
    groups = merged_groups(totals, merge_map(totals))
    return groups.select("name", "categories", "n", _money("total"))


def group_members(spark, sf_dir):
    return merged_members(merge_map(_nation_totals(spark, sf_dir)))


def averages(spark, sf_dir):
    """Mean balance per category, 0 where no customer has one to count."""
    counted = nation_customer(spark, sf_dir).groupBy("category").agg(
        F.count_if(F.col("payload") > 9000).alias("n"),
        F.sum(F.when(F.col("payload") > 9000, F.col("payload"))).alias("total"),
    )
    average = safe_average(F.col("total").cast("double"), F.col("n"))
    return counted.select("category", "n", F.round(average, 6).alias("avg"))


def _matched_totals(spark, sf_dir):
    records, links = block_links(spark, sf_dir)
    return materialise(group_totals(matched_records(records, links)), "totals")


def masked(spark, sf_dir):
    return _matched_totals(spark, sf_dir)


def merged(spark, sf_dir):
    totals = _matched_totals(spark, sf_dir)
    return merged_totals(totals, merge_map(totals))


def guarded(spark, sf_dir):
    records, links = block_links(spark, sf_dir)
    return _rounded(private_crosstab(records, links))


def dropped(spark, sf_dir):
    records, links = block_links(spark, sf_dir)
    return _rounded(private_crosstab(records, links, on_small="drop"))


def _rounded(groups):
    return groups.select("label", "n", "total", F.round("avg", 6).alias("avg"))


QUERIES = {
    "payload_coerce": payloads,
    "category_one_hot": one_hot,
    "distinct_categories": categories,
    "payload_lookup": last_payload,
    "category_lookup": last_category,
    "block_lookup": document_block,
    "group_size_gate": gate,
    "size_deltas": deltas,
    "merge_map": mapping,
    "merged_labels": labels,
    "merged_groups": named_groups,
    "merged_members": group_members,
    "safe_average": averages,
    "masked_crosstab": masked,
    "merged_crosstab": merged,
    "private_crosstab": guarded,
    "private_crosstab_drop": dropped,
}


def _last(value):
    return (
        f"SELECT user_id AS c_custkey, arg_max({value}, event_id) AS x FROM events GROUP BY user_id"
    )


_MATCHED = f"WITH {block_links_sql()}, {MATCHED_TOTALS}"
_NATIONS = f"WITH {NATION_TOTALS}"
_FINAL = "SELECT label, n, total::BIGINT AS total, round(total / n, 6) AS avg FROM"

_NAME = " || '-' || ".join(
    f"bit_xor(('0x' || substr(md5(category), {at}, 15))::BIGINT)::VARCHAR" for at in (1, 16)
)

ORACLES = {
    "merged_groups": f"{_NATIONS}, {merge('t')} SELECT {_NAME} AS name, count(*) AS categories, sum(n)::BIGINT AS n, "
    "sum(total)::DOUBLE AS total FROM t JOIN mapping USING (category) GROUP BY target",
    "merged_members": f"{_NATIONS}, {merge('t')}, names AS (SELECT target, {_NAME} AS name FROM mapping GROUP BY target) "
    "SELECT name, category FROM mapping m JOIN names ON names.target IS NOT DISTINCT FROM m.target",
    "payload_coerce": "SELECT c_custkey, c_mktsegment = 'BUILDING' AS missing, CASE WHEN "
    "c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN 0 ELSE c_acctbal END AS payload FROM customer",
    "category_one_hot": "SELECT doc_id, "
    + ", ".join(f"coalesce((lang = '{v}')::INTEGER, 0) AS is_{v}" for v in ("de", "en", "es", "fr"))
    + " FROM documents",
    "distinct_categories": "SELECT DISTINCT source || '/' || lang AS category FROM documents",
    "payload_lookup": "SELECT c.c_custkey, coalesce(x, 0) AS payload FROM customer c "
    f"LEFT JOIN ({_last('value')}) e USING (c_custkey)",
    "category_lookup": "SELECT c.c_custkey, x AS category FROM customer c "
    f"LEFT JOIN ({_last('event_type')}) e USING (c_custkey)",
    "block_lookup": "SELECT d.doc_id, coalesce(quality::VARCHAR, 'UNKNOWN') AS block "
    "FROM documents d LEFT JOIN labels USING (doc_id)",
    "group_size_gate": f"{_NATIONS} SELECT category, n FROM t WHERE n > 5",
    "size_deltas": f"{_NATIONS} SELECT category, n - 5 AS above, 5 - n AS below FROM t",
    "merge_map": f"{_NATIONS}, {merge('t')} SELECT category, target FROM mapping",
    "merged_labels": f"{_NATIONS}, {merge('t')} SELECT label, n, total::DOUBLE AS total FROM merged",
    "safe_average": "SELECT category, n, CASE WHEN n <> 0 THEN round(total / n, 6) ELSE 0 END AS avg "
    "FROM (SELECT c_nationkey::VARCHAR || '/' || c_mktsegment AS category, "
    "count(*) FILTER (c_acctbal > 9000) AS n, "
    "sum(c_acctbal::DECIMAL(18,2)) FILTER (c_acctbal > 9000)::DOUBLE AS total "
    "FROM customer GROUP BY 1)",
    "masked_crosstab": f"{_MATCHED} SELECT category, n, total FROM t",
    "merged_crosstab": f"{_MATCHED}, {merge('t')} SELECT label, n, total::BIGINT AS total FROM merged",
    "private_crosstab": f"{_MATCHED}, {merge('t')} {_FINAL} merged WHERE n > 5",
    "private_crosstab_drop": f"{_MATCHED} {_FINAL} (SELECT category AS label, n, total FROM t) "
    "WHERE n > 5",
}
