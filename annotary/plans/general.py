"""Queries of the general data problems: repeated deliveries and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.operators.delivery import one_per_key
from annotary.operators.packed import unpack
from annotary.runtime import table

#: Which delivery of an article stays: the earliest, then the smallest number.
DELIVERY_ORDER = ("received_at", "delivery_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that an earlier one of the same pmid makes redundant."""
    return one_per_key(spark, f"{sf_dir}/articles.parquet", "pmid", DELIVERY_ORDER, deleted=True).select("delivery_id")


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles, whole, with one delivery of each pmid; rows without pmid stay."""
    return one_per_key(spark, f"{sf_dir}/articles.parquet", "pmid", DELIVERY_ORDER)


#: Table, key and field of the packed columns.
FIELDS = (("final_tiab_mappings", "map_id", "llm_dis_map"), ("gene2pubtator3", "mention_id", "entity_id"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (
        table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(k).cast("bigint").alias("row_key"), F.col(c).alias("raw"))
        for t, k, c in FIELDS
    )
    return a.unionByName(b)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each value of the two packed columns."""
    return unpack(_packed(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_kept": p4_kept, "p5_found": p5_found}

_RANKED = """SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY received_at ASC NULLS LAST, delivery_id) AS rn FROM articles"""

ORACLE = {
    "p4_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE pmid IS NOT NULL AND rn > 1",
    "p4_kept": f"""SELECT delivery_id, pmid, title, abstract, languages, pubdate, journal, source_file, received_at
        FROM ({_RANKED}) WHERE pmid IS NULL OR rn = 1""",
    # names hold a run of lower-case letters, all other values a digit; the operator learns what SQL is told here
    "p5_found": "WITH f AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS tab, CAST({k} AS BIGINT) AS row_key, {c} AS raw FROM {t} WHERE {c} IS NOT NULL" for t, k, c in FIELDS
    ) + r"""),
        v AS (SELECT tab, row_key, list_filter(regexp_extract_all(raw, '"(?:[^"]|"")*[a-z]{3}(?:[^"]|"")*"|[^\s;,|/&\[\](){}<>"\x27`“”‘’„«»]+'),
            lambda x: starts_with(x, '"') OR regexp_matches(x, '[0-9]')) AS items FROM f)
        SELECT tab, row_key, CAST(generate_subscripts(items, 1) AS INTEGER) AS pos,
            replace(regexp_replace(unnest(items), '^"|"$', '', 'g'), '""', '"') AS item FROM v""",
}
