"""Temporal list join: dated list entries become validity intervals; captures meet those active at fetch time.

An entry names a host or a parent domain and is dated 'add' or 'remove'. Per entry the changes, in
order of date, become intervals [from, to): an add opens one, the next change closes it. A capture
looks up its host and each parent domain of no more labels than the list's longest name has; the entries
active at its fetch time with the longest name decide. 'deny' entries block, 'allow' entries exempt.

The join is an equality on the name with a range on the time: intervals of one name are disjoint, so
a capture meets at most one per name, and a host with a third of all captures stays one list row.

Cases: a null or blank url, or one without a host, has a null host and is kept; so is a capture
without a fetch time. Two changes of one entry at the same instant: 'remove' comes last. Names compare in lower case without
a port, user part or trailing dot. Repeated captures and repeated list rows change nothing. An empty
list keeps everything. Other columns of either table are ignored. Empty captures give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL: without scheme, user part, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def validity_intervals(changes: DataFrame) -> DataFrame:
    """changes(name, kind, action, at) -> (name, kind, valid_from, valid_to): when each entry was active."""
    rows = changes.where("name is not null and at is not null").select(F.lower("name").alias("name"), "kind", "action", "at").distinct()
    at = rows.groupBy("name", "kind", "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    following = F.lead("at").over(Window.partitionBy("name", "kind").orderBy("at"))
    return at.withColumn("valid_to", following).where("off = 0").select("name", "kind", F.col("at").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, changes: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """capture_id, url, fetched_at, host, matched_name, matched_kind, valid_from, kept for every capture."""
    base = captures.select(captures[id_col].alias("capture_id"), captures[url_col].alias("url"), captures[time_col].cast("timestamp").alias("fetched_at"))
    base = base.withColumn("host", host_of(F.col("url")))
    labels = F.split("host", r"\.")
    # The host's last k labels for each k: the host itself and its parent domains.
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.col("most"))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    names = F.array_union(F.array("host"), parents)
    lists = validity_intervals(changes)
    most = lists.agg(F.coalesce(F.max(F.size(F.split("name", r"\."))), F.lit(1)).alias("most"))
    asked = base.where("host is not null").select("host", "fetched_at").distinct().crossJoin(F.broadcast(most)).select("host", "fetched_at", F.explode(names).alias("name"))
    active = asked.join(lists, "name").where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    # The longest name decides; of one name, an exemption goes before a block.
    best = F.max(F.struct(F.length("name").alias("n"), (F.col("kind") == "allow").alias("allow"), "name", "kind", "valid_from")).alias("m")
    verdict = active.groupBy("host", "fetched_at").agg(best).select("host", "fetched_at", F.col("m.name").alias("matched_name"), F.col("m.kind").alias("matched_kind"), F.col("m.valid_from").alias("valid_from"))
    out = base.join(verdict, ["host", "fetched_at"], "left")
    return out.select("capture_id", "url", "fetched_at", "host", "matched_name", "matched_kind", "valid_from", F.coalesce(F.col("matched_kind") != "deny", F.lit(True)).alias("kept"))
