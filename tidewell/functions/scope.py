"""Predicates over scoped, bitemporal facts; absent scope parts are the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def admits(ws: str, sess: str | None = None, task: str | None = None) -> Column:
    """The workspace is equal, and so are session and task where given; absent ones admit all."""
    out = F.col("ws") == ws
    for name, value in (("sess", sess), ("task", task)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def exactly(ws: str, sess: str | None = None, task: str | None = None) -> Column:
    return (F.col("ws") == ws) & (F.coalesce(F.col("sess"), F.lit("")) == (sess or "")) & (F.coalesce(F.col("task"), F.lit("")) == (task or ""))


def is_current() -> Column:
    return F.col("superseded_by").isNull() & F.col("valid_to").isNull() & (F.col("trust_state") != "Rejected")


def stale(now: int, max_age: int, min_sessions: int) -> Column:
    """Old, and known from too few sessions."""
    sessions = F.size(F.array_distinct(F.transform(F.col("source_refs"), lambda r: r["session_id"])))
    return (F.lit(now) - F.col("created_at") > max_age) & (sessions < min_sessions)


def in_window(time: Column, since: int | None = None, until: int | None = None) -> Column:
    out = F.lit(True)
    if since is not None:
        out = out & (time >= since)
    if until is not None:
        out = out & (time <= until)
    return out
