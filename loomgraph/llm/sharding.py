"""K-d tree partitioning of documents into shards of near equal bytes, in DataFrame operations.

The tree splits a node along the metadata dimension in which its rows spread most (as a share of
that dimension's spread over the whole table) at a weighted median: at every level one aggregate
finds all nodes' spreads, and histograms that narrow around the cut find all medians. Leaves are
the shards, so a node of L leaves splits its bytes floor(L/2) : ceil(L/2).

Rows compare by (dimension, crc of the text, doc_id, place in the stored table), which no two rows share:
equal texts of one dimension value are neighbours. A cut may miss its median by TOLERANCE of a shard for
each leaf on its smaller side; if the edge of a group of equal texts lies so near, it takes it, and else
cuts inside the group. A leaf therefore differs from the target by no more than TOLERANCE for each
level (5 levels at 24 shards: 1 %), but for single rows that are larger. What reaches the driver is a
histogram of BINS cells for each node.

Cases: a null text has no bytes and counts 8, as an empty one does; a null in a dimension sorts
first; null doc_ids come first among equals. Repeated rows are rows of their own and each get a slot. With
fewer rows than shards some shards stay empty. Texts of any length count whole. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise

BINS = 512
#: Share of a shard that a cut may miss its median by, for each leaf on its smaller side.
TOLERANCE = 0.002
#: Rows numbered by one task when slots are given out.
SLOT_ROWS = 100_000
KEYS = ("crc", "id", "place")


def _slim(docs: DataFrame, id_col: str, text_col: str, dims: dict[str, Column]) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    cols = [docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    return docs.select(*cols, *[c.cast("double").alias(f"dim_{k}") for k, c in dims.items()], F.monotonically_increasing_id().alias("place"))


def _split(rows: DataFrame, nodes: dict[int, int], dims: list[str], spread: dict[str, float], target: float) -> dict[int, tuple]:
    """For each node (id -> leaves) the cut (key columns, bounds): rows below it go left."""
    stats = {r.node: r for r in rows.where(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims], *[f(k).alias(f"{n}_{k}") for k in KEYS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    open_: dict[int, dict] = {}
    done: dict[int, tuple] = {}
    for node, s in stats.items():
        wide = max(dims, key=lambda d: ((s[f"hi_{d}"] - s[f"lo_{d}"]) / spread[d] if spread[d] else 0.0, d))
        want = s.bytes * (nodes[node] // 2) / nodes[node]
        open_[node] = {"keys": (wide, *KEYS), "k": 0, "lo": s[f"lo_{wide}"], "hi": s[f"hi_{wide}"], "fixed": [], "want": want, "stats": s}
    while open_:
        # One histogram job for all open nodes: rows inside the node's current range of its current key.
        cell = F.lit(None).cast("int")
        for node, o in open_.items():
            inside = F.col("node") == node
            for name, value in zip(o["keys"], o["fixed"], strict=False):
                inside = inside & (F.col(name) == F.lit(value))
            key = F.col(o["keys"][o["k"]]).cast("double")
            step = (o["hi"] - o["lo"]) / BINS
            place = F.least(F.floor((key - o["lo"]) / step).cast("int"), F.lit(BINS - 1)) if step else F.lit(0)
            o["step"] = step
            cell = F.when(inside & (key >= o["lo"]) & (key <= o["hi"]), place).otherwise(cell)
        names = {o["keys"][o["k"]] for o in open_.values()}
        key = F.coalesce(*[F.when(F.col("node").isin([n for n, o in open_.items() if o["keys"][o["k"]] == name]), F.col(name).cast("double")) for name in sorted(names)])
        binned = rows.where(F.col("node").isin(list(open_))).select("node", "size", cell.alias("cell"), key.alias("key")).where("cell is not null")
        hist: dict[int, list] = {n: [] for n in open_}
        for r in binned.groupBy("node", "cell").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("node", "cell").collect():
            hist[r.node].append(r)
        for node in list(open_):
            o = open_[node]
            left, at = 0, None
            for at in hist[node]:
                if left + at.bytes >= o["want"]:
                    break
                left += at.bytes
            if at is None:
                del open_[node]
                continue
            below, above = o["want"] - left, left + at.bytes - o["want"]
            keys, fixed = o["keys"][: o["k"] + 1], o["fixed"]
            allowed = TOLERANCE * target * (nodes[node] // 2)
            if min(below, above) <= allowed or (at.lo == at.hi and o["k"] == len(KEYS)):
                done[node] = (keys, fixed, at.lo if below <= above else at.hi, below <= above)
                del open_[node]
            elif at.lo == at.hi:
                s = o["stats"]
                o["fixed"] = [*fixed, at.lo]
                o["k"] += 1
                name = o["keys"][o["k"]]
                o |= {"lo": float(s[f"lo_{name}"]), "hi": float(s[f"hi_{name}"]), "want": o["want"] - left}
            else:
                o |= {"lo": at.lo, "hi": at.hi, "want": o["want"] - left}
    return done


def _goes_left(cut: tuple) -> Column:
    """Lexicographic comparison with the cut: below it, or up to and with it."""
    keys, fixed, value, before = cut
    last = F.col(keys[-1]).cast("double")
    test = last < value if before else last <= value
    for name, v in reversed(list(zip(keys[:-1], fixed, strict=True))):
        test = (F.col(name) < v) | ((F.col(name) == v) & test)
    return test


def kd_shards(docs: DataFrame, dims: dict[str, Column], shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; dims: numeric metadata columns to split along."""
    slim = materialise(_slim(docs, id_col, text_col, dims), "slim")
    names = [f"dim_{k}" for k in dims]
    least = F.lit(float("-1"))
    rows = slim.withColumns({n: F.coalesce(F.col(n), least) for n in names} | {"crc": F.col("text_crc32"), "id": F.coalesce(F.col("doc_id"), F.lit(-1)), "node": F.lit(1)})
    whole = rows.agg(F.sum("size").alias("bytes"), *[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names], F.count("*").alias("n")).first()
    target = (whole.bytes or 0) / shards
    spread = {n: (whole[f"hi_{n}"] or 0.0) - (whole[f"lo_{n}"] or 0.0) for n in names}
    leaves, final = {1: shards}, {}
    while leaves and whole.n:
        final |= {n: x for n, x in leaves.items() if x == 1}
        leaves = {n: x for n, x in leaves.items() if x > 1}
        if not leaves:
            break
        cuts = _split(rows, leaves, names, spread, target)
        node = F.col("node")
        for n in leaves:
            if n in cuts:
                node = F.when(F.col("node") == n, F.when(_goes_left(cuts[n]), F.lit(2 * n)).otherwise(F.lit(2 * n + 1))).otherwise(node)
            else:
                node = F.when(F.col("node") == n, F.lit(2 * n + 1)).otherwise(node)
        rows = materialise(rows.withColumn("node", node), "level")
        leaves = {c: y for n, x in leaves.items() for c, y in ((2 * n, x // 2), (2 * n + 1, x - x // 2))}
    order = sorted(final or {1: 1}, key=lambda n: n / (1 << (n.bit_length() - 1)))
    shard = F.lit(None).cast("int")
    for i, n in enumerate(order):
        shard = F.when(F.col("node") == n, F.lit(i)).otherwise(shard)
    # Slots: rows number themselves within (shard, part), and a small table of counts gives each part its start.
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), "place")
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    placed = placed.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(most // SLOT_ROWS + 1)).cast("int"))
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "place")) - 1
    return placed.withColumn("number", number).join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"))
