"""The catalogue of parquet tables of one store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.shipping import ship

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings graph_versions scan_runs "
    "cgdb_files cgdb_nodes functions edges toxicity_labels pack_plans"
).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def register(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Temporary views over the tables, for ``spark.sql``."""
    for name in names or TABLES:
        table(spark, root, name).createOrReplaceTempView(name)
