"""Queries of the skew operators (problem 1)."""

from pyspark.sql import functions as F

from ..operators import skew
from ..sources.tables import table


def p1_found(spark, folder):
    found = skew.stale_counts(
        table(spark, folder, "entities"), "id", "mention_count", table(spark, folder, "mentions"), "entity_id", "id"
    )
    return found.select(F.col("owner").alias("entity_id"))


def p1_deliveries(spark, folder):
    out = skew.deliveries_per_key(table(spark, folder, "mentions"), "entity_id", "id", "loaded_at")
    return out.select("entity_id", "n_rows", "n_distinct", "n_resent", "first_at", "last_at")


QUERIES = {"p1_found": p1_found, "p1_deliveries": p1_deliveries}

SQL = {
    "p1_found": """
        SELECT e.id AS entity_id FROM entities e
        LEFT JOIN (SELECT entity_id, count(DISTINCT id) AS n FROM mentions GROUP BY entity_id) m ON m.entity_id = e.id
        WHERE e.mention_count IS DISTINCT FROM coalesce(m.n, 0)""",
    "p1_deliveries": """
        SELECT entity_id, count(*) AS n_rows, count(DISTINCT id) AS n_distinct, count(*) - count(DISTINCT id) AS n_resent,
               min(loaded_at) AS first_at, max(loaded_at) AS last_at
        FROM mentions WHERE entity_id IS NOT NULL AND id IS NOT NULL GROUP BY entity_id""",
}
