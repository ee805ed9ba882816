"""Schemas of the inventory's tables, and a way to create them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Tables and their columns.
SCHEMAS = {
    "datasets": "id long, name string, split string, path string, domain string",
    "texts": "id long, dataset_id long, row_idx long, source_id string, title string, original_text string, summary string, masked_text string, mask_count long",
    "entities": (
        "id long, surface_key string, surface string, heuristic_group string, heuristic_type string, context_policy string, mention_count long, "
        "observed_types_json string, domains_json string, datasets_json string"
    ),
    "mentions": "id long, entity_id long, text_id long, mask_idx long, observed_type string, short_context string, full_context string",
    "run_metadata": "key string, value string",
}


def create(spark: SparkSession, folder: str, reset: bool = False) -> dict[str, DataFrame]:
    """Empty tables of the inventory where they are missing, or everywhere with ``reset``; the frames by name."""
    from .files import is_there

    out = {}
    for name, schema in SCHEMAS.items():
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if reset or not is_there(spark, path):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        out[name] = spark.read.schema(schema).parquet(path)
    return out
