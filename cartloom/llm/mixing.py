"""Sources mixed to target weights by Poisson replication.

A document of a source whose mean repetition rate is r gets k copies, where k
inverts the Poisson distribution of mean r at a uniform number hashed from the
seed and the document. Counts are independent between documents, need no state
and are the same on every run. Rates follow from the bytes of each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.registry import fresh, llm_query, read, written

BROADCAST_BYTES = 32 << 20
"""A rate table of at most so many bytes, distributions included, is broadcast; a larger one is joined by shuffle."""
LEAST_SKIPPED = 100
"""Fewer terms than these are summed from 0; from here on the series is right to 13 digits."""
SEED = 20240607
TEMPERATURE = 0.5


def _key(seed: int, *parts: Column) -> Column:
    """md5 of seed and parts; nulls count as empty."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def unit(key: Column) -> Column:
    """The first 52 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)


def poisson_cdf(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... to where the rest is below 2^-53.

    Terms are kept as logarithms, so a large rate does not underflow. What lies
    12 deviations and more below the mean is below 2^-53 as well and taken as 0,
    so the sums that are built up grow with the square root of the rate.
    """
    reach = 12 * F.sqrt(rate) + 30
    low, last = F.floor(rate - reach).cast("int"), F.ceil(rate + reach).cast("int")
    low = F.when(low >= LEAST_SKIPPED, low).otherwise(0)
    # Stirling's series of the factorial, whose large terms cancel against the rate's.
    n = low.cast("double")
    factorial = F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)
    first = F.when(n > 0, n * F.log(rate / n) + n - rate - factorial).otherwise(-rate)
    steps = F.transform(F.sequence(low + 1, last), lambda k: k.cast("double"))
    start = F.struct(first.alias("log"), F.array(F.exp(first)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k)
        return F.struct(log.alias("log"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + F.exp(log))).alias("sums"))

    sums = F.concat(F.array_repeat(F.lit(0.0), low), F.aggregate(steps, start, step, lambda s: s["sums"]))
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, targets: dict[str | None, float] | None = None, temperature: float = TEMPERATURE,
                 budget: float | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """(source, rate, cdf): the mean number of copies of each source's documents.

    ``targets`` gives weights by source, those not named get none; without it a
    source weighs its bytes to the power of ``temperature``. ``budget`` is the
    wanted number of bytes, that of the input unless given. A source with no
    bytes at all keeps rate 1. Null is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).alias("bytes"))
    if targets is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, share in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    # Written once: sources are far fewer than documents, and totals come from it.
    weighed = written(sizes.withColumn("weight", F.when(F.col("bytes") > 0, weight).otherwise(0.0)))
    total = weighed.agg(F.sum("weight").alias("w"), F.sum("bytes").alias("b")).first()
    wanted = float(budget if budget is not None else total.b or 0)
    rate = F.when(F.col("bytes") == 0, 1.0).otherwise(
        F.lit(wanted) * F.col("weight") / F.lit(total.w or 1.0) / F.col("bytes").cast("double"))
    rates = weighed.select("source", rate.alias("rate"))
    return written(rates.withColumn("cdf", poisson_cdf(F.col("rate"))))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
              source: str = "source") -> DataFrame:
    """Every document as often as its Poisson count says, in shuffled order.

    Adds rate, n_copies, copy (1 to n_copies) and order_key, replacing columns
    of these names: rows are dealt over all partitions and sorted within each
    by order_key, a hash. Repeated rows get equal counts; rows of null id are
    told apart by their text. An empty table stays empty.
    """
    held = rates.agg(F.sum(8 * F.size("cdf") + F.octet_length(F.coalesce("source", F.lit(""))) + 64).cast("long")).first()[0] or 0
    few = held <= BROADCAST_BYTES
    own_source, own_rate, own_cdf, own_u = (fresh(docs.columns, name) for name in ("source", "rate", "cdf", "u"))
    table = rates.select(F.col("source").alias(own_source), F.col("rate").alias(own_rate), F.col("cdf").alias(own_cdf))
    joined = docs.join(F.broadcast(table) if few else table, F.col(source).eqNullSafe(F.col(own_source)))
    u = unit(_key(seed, F.col(doc_id), F.col(text)))
    counted = joined.withColumns({own_u: u}).withColumns({
        "rate": F.col(own_rate), "n_copies": F.size(F.filter(F.col(own_cdf), lambda c: c <= F.col(own_u)))})
    copies = counted.filter(F.col("n_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("order_key", _key(seed + 1, F.col(doc_id), F.col(text), F.col("copy")))
    return keyed.drop(own_source, own_rate, own_cdf, own_u).repartition("order_key").sortWithinPartitions("order_key")


SQL = f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY source),
total AS (
  SELECT sum(bytes) AS b, sum(pow(bytes::DOUBLE, {TEMPERATURE})) AS w FROM sizes WHERE bytes > 0),
rates AS (
  SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE b::DOUBLE * pow(bytes::DOUBLE, {TEMPERATURE}) / w / bytes::DOUBLE END AS rate
  FROM sizes, total),
terms AS (
  SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k)),
cdf AS (
  SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
doc AS (
  SELECT doc_id, text, source, CAST(('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13)) AS BIGINT)::DOUBLE / pow(2, 52) AS u
  FROM documents),
counted AS (
  SELECT doc_id, text, d.source, r.rate, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS n
  FROM doc d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, text, CAST(n AS INT) AS n_copies, CAST(k AS INT) AS copy, round(rate, 9) AS rate,
       md5('{SEED + 1}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '') || ':' || k::VARCHAR) AS order_key
FROM counted, LATERAL (SELECT unnest(range(1, n + 1)) AS k)
"""


@llm_query("op10_mixing", SQL)
def op10_mixing(spark, folder):
    """Documents replicated so that sources weigh the square root of their bytes."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = replicate(docs, source_rates(docs))
    return mixed.select("doc_id", "source", "text", "n_copies", "copy", F.round("rate", 9).alias("rate"), "order_key")
