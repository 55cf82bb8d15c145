"""Report files: JSON reports, trace and metrics CSV, batch summaries, profile snapshots. Writers fail loudly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.trace import batch_summary

#: Columns of a trace that are too long for a table, and the two that get a preview instead.
LONG = ("user_prompt", "output_data", "raw_output", "error_message")
PREVIEWED = ("output_data", "error_message")


def json_report(df: DataFrame, path: str, by: list[str] | None = None, mirror: str | None = None) -> None:
    """JSON lines, partitioned by the named columns; written a second time to `mirror` if one is given."""
    for target in filter(None, (path, mirror)):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).json(target)


def trace_table(trace: DataFrame) -> DataFrame:
    """A trace without its long texts, with previews of 100 characters."""
    previews = [F.left(F.col(c), F.lit(100)).alias(f"{c}_preview") for c in PREVIEWED]
    return trace.select(*[c for c in trace.columns if c not in LONG], *previews)


def trace_csv(trace: DataFrame, path: str) -> None:
    trace_table(trace).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def metrics_csv(metrics: DataFrame, path: str) -> None:
    """Structs flattened to parent_child columns; arrays joined by "; "."""
    flat = []
    for field in metrics.schema.fields:
        kind = field.dataType.typeName()
        if kind == "struct":
            flat += [F.col(f"{field.name}.{c}").alias(f"{field.name}_{c}") for c in field.dataType.names]
        else:
            flat.append(F.array_join(field.name, "; ").alias(field.name) if kind == "array" else F.col(field.name))
    metrics.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def batch_report(runs: DataFrame, path: str) -> None:
    """summary (one JSON row) and files (CSV: file_path, success, accuracy, errors joined by "; ") below a path."""
    batch_summary(runs).write.mode("overwrite").json(f"{path}/summary")
    rows = runs.select("file_path", "success", F.col("current_accuracy").alias("accuracy"), F.array_join("errors", "; ").alias("errors"))
    rows.write.mode("overwrite").csv(f"{path}/files", header=True, quote='"', escape='"')


def profile_snapshot(profiles: DataFrame, path: str, version: int) -> None:
    """Profiles as an immutable version: a batch is checked against version v and published as v + 1."""
    profiles.write.mode("errorifexists").parquet(f"{path}/version={version}")


def vector_index(embeddings: DataFrame, path: str) -> None:
    embeddings.write.mode("overwrite").parquet(path)
