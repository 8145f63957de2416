"""Names and ids of nodes: aliases, and the ids that a session sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registered(aliases: DataFrame) -> DataFrame:
    """(alias, id): the last registration of each alias; aliases(alias, id, seq). An alias is matched exactly."""
    return aliases.where("alias is not null").groupBy("alias").agg(F.max_by("id", "seq").alias("id"))


def resolve(names: DataFrame, aliases: DataFrame, column: str = "alias") -> DataFrame:
    """names with the id of their alias, null without one."""
    known = registered(aliases).withColumnRenamed("alias", "_alias")
    return names.join(known, names[column] == known["_alias"], "left").drop("_alias")


def node_ids(nodes: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """The sorted ids of the nodes and of the session's, each once."""
    ids = nodes.select("id")
    return (ids if session is None else ids.union(session.select("id"))).distinct().orderBy("id")
