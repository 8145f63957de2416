"""The data model: property-graph nodes and edges, the change log, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "id bigint, embedding array<float>, data string, metadata map<string,string>"
EDGE = "source bigint, target bigint, relation string, weight float, metadata map<string,string>, seq bigint"
CHANGE = f"lsn bigint, op_idx int, op string, node struct<{NODE.replace(' ', ':').replace(',:', ',')}>, edge struct<source:bigint,target:bigint,relation:string,weight:float,metadata:map<string,string>>, node_id bigint, idem struct<key:string,ids:array<bigint>>"
SUMMARY = "level int, community_id int, top_nodes array<bigint>, summary string, lsn_from bigint, lsn_to bigint"


def with_reserved(nodes: DataFrame) -> DataFrame:
    """Reserved metadata keys as columns, so that Catalyst can prune and push down on them."""
    m = F.col("metadata")
    return nodes.withColumns({
        "source_of": m["source"], "entity_type": m["entity_type"], "tenant": m["tenant"],
        "event_date": F.try_to_date(m["timestamp"], "yyyy-MM-dd"),
        "confidence": F.expr("try_cast(metadata['confidence'] as double)"),
        "retention_until": F.expr("try_cast(metadata['retention_until_unix'] as bigint)"),
    })
