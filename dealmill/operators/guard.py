"""A read-only guard for SQL text, by Spark's own parser."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Parts of the names of logical plans by which a parsed statement changes something.
_FORBIDDEN = (
    "Command", "Insert", "Create", "Drop", "Delete", "Update", "Merge", "Alter", "Truncate", "LoadData", "Cache", "Refresh", "Rename", "Overwrite", "Append", "Replace", "SetCatalog", "SetNamespace",
)


def is_read_only(spark: SparkSession, statement: str) -> bool:
    """True if the statement parses, as a whole, to a query. Words inside literals don't matter."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        if "ParseException" in type(e).__name__ or "PARSE_SYNTAX_ERROR" in str(e):
            return False
        raise
    return not any(word in plan.nodeName() for word in _FORBIDDEN)


def run_read_only(spark: SparkSession, statement: str) -> DataFrame:
    if not is_read_only(spark, statement):
        raise ValueError("only queries are allowed")
    return spark.sql(statement)


def keeps_ids(statement: str, ids: list[int]) -> bool:
    """Whether a statement names every resolved id as a number of its own."""
    return all(re.search(rf"(?<![\w.]){i}(?![\w.])", statement) for i in ids)
