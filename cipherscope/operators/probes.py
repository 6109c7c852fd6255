"""TLS probe observations to findings. There is no network in a job: observations come as a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import groups

#: Fixed value: the algorithm of a group that was never probed.
NOT_PROBED = "tls-group-not-probed"


def target(text: Column) -> tuple[Column, Column]:
    """(host, port) of ``host:port``, split at the last colon; the port is null unless it fits 16 bits."""
    port = F.regexp_extract(text, r":(\d{1,5})$", 1)
    number = F.when(port != "", port.cast("int"))
    return F.regexp_extract(text, r"^(.*):[^:]*$", 1), F.when(number <= 65535, number)


def findings(targets: DataFrame, observed: DataFrame) -> DataFrame:
    """A row for each target and group: rule_id and algorithm_id by outcome.

    targets: target; observed: target, group_name, outcome (handshake, failure, rejected), protocol, cipher. The group
    dimension has a dozen rows and is exploded onto the targets; observations are joined by target and group.
    """
    dim = groups(targets.sparkSession).collect()
    every = F.explode(F.array(*[F.struct(F.lit(g.group_name).alias("group_name"), F.lit(g.algorithm_id).alias("algorithm_id"), F.lit(g.legacy).alias("legacy")) for g in dim])).alias("g")
    rows = targets.select("target", every).select("target", "g.*").join(observed, ["target", "group_name"], "left")
    handshake = F.col("outcome") == "handshake"
    rule = F.when(handshake & F.col("legacy"), "NET-100").when(handshake, "NET-001").when(F.col("outcome") == "failure", "NET-002").when(F.col("outcome") == "rejected", "NET-003").otherwise("NET-900")
    return rows.select(
        "target", "group_name", rule.alias("rule_id"),
        F.when(rule == "NET-900", NOT_PROBED).otherwise(F.col("algorithm_id")).alias("algorithm_id"),
        F.when(handshake, "key_establishment_ephemeral").otherwise("unknown").alias("usage_context"),
        F.when(rule.isin("NET-001", "NET-100", "NET-003"), "literal_arg").otherwise("unknown").alias("confidence"),
        F.lit("public_internet").alias("exposure"), F.lit("short").alias("shelf_life_bucket"),
    )
