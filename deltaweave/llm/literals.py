"""Small fixed tables written into the query itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return repr(value)


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A local relation of literal rows; ``schema`` is "name type, name type"."""
    fields = [f.split() for f in schema.split(",")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in fields) + " WHERE false")
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")
