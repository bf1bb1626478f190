"""Sinks: CSV, calendar files, graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_ready(df: DataFrame) -> DataFrame:
    """Array cells joined with "; ", timestamps as ISO text."""
    cells = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind.startswith("array"):
            col = F.array_join(F.transform(col, lambda x: x.cast("string")), "; ")
        elif kind.startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        cells.append(col.alias(name))
    return df.select(*cells)


def write_csv(df: DataFrame, path: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", True).csv(path)


def _escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in (";", ","):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.regexp_replace(out, r"\r?\n", r"\\n")


def fold_line(line: str, octets: int = 75) -> str:
    """Folds one content line at 75 UTF-8 octets, never inside a character; further lines begin with a space."""
    out, own, size = [], "", 0
    for c in line:
        n = len(c.encode())
        if size + n > octets:
            out.append(own)
            own, size = " ", 1
        own, size = own + c, size + n
    return "\r\n".join([*out, own])


def calendar_events(df: DataFrame, uid: str, day: str, summary: str, description: str) -> DataFrame:
    """event: one all-day VEVENT for each row with a date, unfolded lines joined by line feeds."""
    date = F.date_format(F.to_date(day), "yyyyMMdd")
    after = F.date_format(F.date_add(F.to_date(day), 1), "yyyyMMdd")
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), date), F.concat(F.lit("DTEND;VALUE=DATE:"), after),
        F.concat(F.lit("SUMMARY:"), _escaped(F.col(summary))), F.concat(F.lit("DESCRIPTION:"), _escaped(F.col(description))), F.lit("END:VEVENT"),
    )
    return df.where(F.col(day).isNotNull()).select(F.array_join(lines, "\n").alias("event"))


def calendar_text(events: list[str], name: str) -> str:
    """A whole calendar of a page of events, lines folded and ended by CR LF."""
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{name}//EN", *[x for e in events for x in e.split("\n")], "END:VCALENDAR"]
    return "\r\n".join(fold_line(x) for x in lines) + "\r\n"


def graph_tables(roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: id, label; edges: src, dst, role) of deal roles, ready to be written as tables."""
    deal = F.concat(F.lit("D"), F.col("deal_id").cast("string"))
    vertices = roles.select(F.col("company").alias("id"), F.lit("Company").alias("label")).unionByName(roles.select(deal.alias("id"), F.lit("Deal").alias("label"))).distinct()
    return vertices, roles.select(F.col("company").alias("src"), deal.alias("dst"), "role").distinct()
