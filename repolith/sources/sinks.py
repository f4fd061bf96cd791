"""Sinks: Markdown documents, JSON lines, pretty JSON, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.functions.scalar import bullet_text


def _part(title: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"\n#### {title}\n"), value))


def function_markdown() -> Column:
    """A function document: name, description, parameters, code_details, example."""
    return F.concat_ws("\n", F.concat(F.lit("### "), F.col("name")), _part("Description", F.col("description")), _part("Parameters", F.col("parameters")), _part("Code Details", F.col("code_details")), _part("Example", F.col("example")))


def class_markdown() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("### "), F.col("name")), _part("Description", F.col("description")), _part("Attributes", F.col("attributes")), _part("Code Details", F.col("code_details")))


def module_markdown() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("### "), F.col("name")), _part("Description", F.col("description")), _part("Functions", bullet_text("functions")), _part("Use Case", F.col("example")))


def repo_markdown() -> Column:
    lists = [_part(t, bullet_text(t.lower())) for t in ("Features", "Standards", "Scenarios")]
    return F.concat_ws("\n", F.concat(F.lit("# "), F.col("name")), _part("Description", F.col("description")), *lists)


def pretty(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def write_markdown(rows: DataFrame, path: str, file_column: str, text: Column) -> None:
    """Appends documents to one folder per file."""
    rows.select(F.col(file_column), text.alias("value")).write.mode("append").partitionBy(file_column).text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def contents(files: DataFrame, path: str = "path") -> DataFrame:
    """Lines of a table of contents: README first, then repo and modules, then the rest by lower-case path."""
    p = F.col(path)
    rank = F.when(F.lower(p).endswith("readme.md"), 0).when(p.endswith("repo.md"), 1).when(p.endswith("modules.md"), 2).otherwise(3)
    nth = F.row_number().over(Window.partitionBy().orderBy(rank, F.lower(p), p))
    return files.select(nth.alias("nth"), F.concat(F.lit("* ["), F.regexp_replace(p, r"\.md$", ""), F.lit("]("), p, F.lit(")")).alias("line"))


def deliver(url: str, payload: str, attempts: int = 5, wait: float = 1.0) -> int:
    """Posts JSON from the driver; errors and statuses from 400 on are tried again. The last status, 0 for none."""
    import time
    import urllib.error
    import urllib.request

    status = 0
    for i in range(attempts):
        try:
            request = urllib.request.Request(url, payload.encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=60) as answer:
                status = answer.status
        except urllib.error.HTTPError as error:
            status = error.code
        except OSError:
            status = 0
        if 0 < status < 400:
            break
        if i + 1 < attempts:
            time.sleep(wait)
    return status
