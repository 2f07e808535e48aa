"""Run a file of SQL statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Text that may hide a semicolon: quoted strings and names, line and block comments.
_HIDING = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;""", re.DOTALL
)


def split_statements(text: str) -> list[str]:
    """Statements between the semicolons that end them; blank and comment-only ones are dropped."""
    parts, start = [], 0
    for match in _HIDING.finditer(text):
        if match.group() == ";":
            parts.append(text[start : match.start()])
            start = match.end()
    parts.append(text[start:])
    bare = [re.sub(r"--[^\n]*|/\*.*?\*/", "", p, flags=re.DOTALL).strip() for p in parts]
    return [p.strip() for p, b in zip(parts, bare) if b]


def run_script(spark: SparkSession, text: str) -> list[tuple[str, DataFrame | None]]:
    """Run the statements in order; each comes with its result, or None when it has no columns."""
    done = []
    for statement in split_statements(text):
        result = spark.sql(statement)
        done.append((statement, result if result.columns else None))
    return done
