"""Where results go: partitioned tables, files for people, notices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by tenant, so that a tenant's reads touch its own files only."""
    df.write.mode(mode).partitionBy("workspace_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, json_col: str = "json") -> None:
    """One JSON text a line."""
    df.select(F.col(json_col).alias("value")).write.mode("overwrite").text(path)


def write_bundle(tables: dict[str, DataFrame], path: str, workspace: str) -> dict[str, DataFrame]:
    """A tenant's invoices as JSON, its sheets as CSV, each in a folder of the bundle; then the tables without the tenant.

    ``tables`` holds at least invoices, documents, vendors and line_items.
    """
    from leafmill.operators.reports import export_invoices, export_json, export_lines, tenant
    from leafmill.operators.state import purge

    own = tenant(tables["invoices"], workspace)
    write_json(export_json(own, tables["line_items"]), f"{path}/json")
    write_csv(export_invoices(own, tables["documents"], tables["vendors"]), f"{path}/invoices")
    write_csv(export_lines(own, tables["vendors"], tables["line_items"]), f"{path}/lines")
    return purge(tables, own.sparkSession.createDataFrame([(workspace,)], "workspace_id string"))


def notices(documents: DataFrame) -> DataFrame:
    """What a webhook says about documents that are complete or need review."""
    body = F.to_json(F.struct(F.col("id").alias("document_id"), "status", "needs_review", "review_reasons"))
    return documents.filter(F.col("status").isin("complete", "needs_review")).select("id", body.alias("body"))


def send(rows: DataFrame, post: Callable[[str], None]) -> DataFrame:
    """Send each ``body`` by ``post`` from the tasks; (id, error) says what failed, and nothing is raised."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for body in b["body"]:
                try:
                    post(body)
                    errors.append(None)
                except Exception as e:
                    errors.append(str(e))
            yield pd.DataFrame({"id": b["id"], "error": errors})

    return rows.mapInPandas(each, "id string, error string")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with counters of its rows by status, filled by the first action."""
    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "needs_review").alias("needs_review")), o
