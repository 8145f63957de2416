"""Query metrics: rates, percentiles over the last queries, read quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.numbering import running

LAST = 1000


def last_queries(log: DataFrame, n: int = LAST) -> DataFrame:
    return log.orderBy(F.desc("at"), F.desc("id")).limit(n)


def nearest_rank(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def snapshot(log: DataFrame, n: int = LAST) -> DataFrame:
    """Totals over the whole log, percentiles over the last n; log(id, at, latency, hit, confidence, failed)."""
    totals = log.agg(F.count("*").alias("total"), F.sum(F.col("failed").cast("int")).alias("failed"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("confidence").alias("avg_confidence"))
    recent = last_queries(log, n).agg(*[nearest_rank("latency", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])
    return totals.crossJoin(recent)  # one row each


def index_percentiles(values: DataFrame, column: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at place round((n - 1) * p) of the sorted values, for each p; by group of `column` counts, not a full sort in one task."""
    counts = values.groupBy(column).agg(F.count("*").alias("c"))
    placed = running(counts, [column], "c", "before").withColumn("upto", F.col("before") + F.col("c"))
    placed = placed.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))  # one row
    return placed.agg(*[F.min(F.when(F.col("upto") > F.round((F.col("n") - 1) * p), F.col(column))).alias(f"p{round(100 * p)}") for p in ps])


def latency_split(log: DataFrame) -> DataFrame:
    """One row: count and percentiles of the writes and of the reads of log(is_write, latency)."""
    of = lambda write: F.when(F.col("is_write") == write, F.col("latency"))
    sides = log.select(of(True).alias("write"), of(False).alias("read"))
    return sides.agg(*[f for side in ("write", "read") for f in (F.count(side).alias(f"{side}_n"), *[nearest_rank(side, p).alias(f"{side}_p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])])


def to_ms(ns: Column) -> Column:
    return ns / 1_000_000.0


def rounded(x: Column, places: int) -> Column:
    """A double rounded as SQL engines do it, by a product and a quotient, halves away from zero.

    `F.round` goes by the shortest decimal, which for large values can be another double.
    """
    y = x * F.lit(float(10**places))
    even = F.rint(y)
    return F.when(F.abs(y - even) == 0.5, y + F.signum(y) * 0.5).otherwise(even) / F.lit(float(10**places))


def two_decimals(x: Column) -> Column:
    """printf's %.2f of a double of at least 1: its exact binary value to hundredths, halves to even.

    Java's formatter and `bround` decide by the shortest decimal of the double, which can be a half where the double isn't.
    """
    whole, bits = x.cast("bigint"), 1 << 52
    parts = (x - whole.cast("double")) * F.lit(float(bits))  # a whole number, as x has 52 bits below its point at most
    scaled = parts.cast("bigint") * 100
    down, rest = F.shiftright(scaled, 52), scaled.bitwiseAND(F.lit(bits - 1))
    up = (rest > bits // 2) | ((rest == bits // 2) & (down % 2 == 1))
    cents = down + up.cast("bigint")
    return F.concat((whole + (cents == 100).cast("bigint")).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def format_ns(ns: Column, real: Column | None = None) -> Column:
    """A duration in the largest unit of ns, us, ms and s that leaves 1 or more, with two decimals above ns.

    `real` is ns as a double, for callers whose ns is a whole decimal: the conversion is slow and needed several times.
    """
    real = ns.cast("double") if real is None else real
    unit = lambda *u: F.when(real < 1_000_000, u[0]).when(real < 1_000_000_000, u[1]).otherwise(u[2])
    above = F.concat(two_decimals(real / unit(1e3, 1e6, 1e9)), unit("us", "ms", "s"))  # formatted in one place: three make code too long to be compiled
    return F.when(real < 1_000, F.concat(ns.cast("decimal(38,0)").cast("string"), F.lit("ns"))).otherwise(above)


def read_quality(reads: DataFrame) -> DataFrame:
    """Rates over reads(is_answer, n_evidence, n_citations, hit, groundedness)."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    answers = F.when(F.col("is_answer"), F.when(F.col("n_evidence") > 0, 1.0).otherwise(0.0))
    cited = F.when(F.col("is_answer"), F.when(F.col("n_citations") > 0, 1.0).otherwise(0.0))
    return reads.agg(F.count("*").alias("reads"), rate(F.col("n_evidence") > 0).alias("evidence_rate"), F.avg(answers).alias("answer_evidence_rate"), F.avg(cited).alias("answer_citation_rate"), rate(F.col("hit")).alias("hit_rate"), F.avg("groundedness").alias("groundedness"))
