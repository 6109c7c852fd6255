"""Query verbs over scored findings: filter, stable sort, grouping, paging, search. ``seq`` is the total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import SEVERITIES

PAGE, LARGEST_PAGE = 50, 500
SORT_KEYS = {"ruleId": "rule_id", "algorithmId": "algorithm_id"}
GROUP_KEYS = {"severity": "severity", "ruleId": "rule_id", "algorithmId": "algorithm_id", "file": "location"}


def filter_findings(scored: DataFrame, algorithm_id: str | None = None, rule_id: str | None = None, severity: str | None = None, hndl: bool | None = None) -> DataFrame:
    """Exact filters, each optional. An unscored finding matches no severity; an unknown name means Safe."""
    if algorithm_id is not None:
        scored = scored.where(F.col("algorithm_id") == algorithm_id)
    if rule_id is not None:
        scored = scored.where(F.col("rule_id") == rule_id)
    if severity is not None:
        known = {s.lower(): s for s, _ in SEVERITIES}
        scored = scored.where(F.col("severity") == known.get(severity.lower(), "Safe"))
    if hndl is not None:
        scored = scored.where(F.col("hndl_critical") == hndl)
    return scored


def sort_findings(scored: DataFrame, by: str | None) -> DataFrame:
    """Ascending by rule or algorithm, ties in scan order; any other key leaves scan order."""
    return scored.orderBy(*([F.col(SORT_KEYS[by])] if by in SORT_KEYS else []), "seq")


def group_findings(scored: DataFrame, by: str) -> DataFrame:
    """key, findings (the group's number), seq and id: a row for each member; an unknown key puts all into the group
    ``unknown``. A group stays rows, however large it is, and its scan order is that of seq."""
    key = F.coalesce(F.col(GROUP_KEYS[by]), F.lit("unscored" if by == "severity" else "unknown")) if by in GROUP_KEYS else F.lit("unknown")
    members = scored.select(key.alias("key"), "seq", "id")
    return members.join(members.groupBy("key").agg(F.count("*").alias("findings")), "key").select("key", "findings", "seq", "id")


def page(scored: DataFrame, offset: int = 0, size: int | None = None) -> DataFrame:
    """One page in scan order (rows ``offset`` up to ``offset + size``)."""
    n = min(LARGEST_PAGE, max(1, size or PAGE))
    return scored.orderBy("seq").offset(max(0, offset)).limit(n)


def page_after(scored: DataFrame, last_seq: int | None, size: int | None = None) -> DataFrame:
    """The page after a key: reads no rows of the pages before where ``seq`` is stored in order."""
    rest = scored if last_seq is None else scored.where(F.col("seq") > last_seq)
    return rest.orderBy("seq").limit(min(LARGEST_PAGE, max(1, size or PAGE)))


def encode_cursor(scan_id: str, offset: int) -> str:
    return f"{scan_id}:{offset}"


def decode_cursor(cursor: str) -> tuple[str, int]:
    scan_id, sep, offset = cursor.rpartition(":")
    if not sep or not offset.isdigit():
        raise ValueError(f"not a cursor: {cursor}")
    return scan_id, int(offset)


def _holds(columns: list[str], text: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in columns])


def search(scored: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search over rule, algorithm, path and message."""
    return scored.where(_holds(["rule_id", "algorithm_id", "location", "message"], text)) if text else scored


def toggled(scored: DataFrame, shown: list[str], unscored: bool, text: str = "") -> DataFrame:
    """Search with the severities that are switched on, and the unscored ones if asked for."""
    on = F.coalesce(F.col("severity").isin(shown), F.lit(False)) if shown else F.lit(False)
    return search(scored.where(on | (F.col("severity").isNull() & F.lit(unscored))), text)


def search_inventory(inventory: DataFrame, text: str) -> DataFrame:
    return inventory.where(_holds(["display_name", "algorithm_id", "family"], text)) if text else inventory


def of_algorithm(scored: DataFrame, algorithm_id: str) -> DataFrame:
    return scored.where(F.col("algorithm_id") == algorithm_id)
