"""Feature maps kept in buckets of their key, and attached without moving them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.operators import ordered
from cartloom.operators.joins import attach
from cartloom.runtime import cut_lineage, plan_bytes, scratch_folder

LEAST_BUCKETS, BUCKET_ROWS = 8, 4_000_000
SMALL_MAP = 10 << 20
"""Bytes up to which a map is left to Spark's own broadcast."""
MANY_HOT = 1_000
"""Hot keys at most, whose lines of the maps are broadcast; where more are hot, only those of larger groups count."""


class KeyedMaps:
    """Maps with one line per key, written in the same buckets of that key.

    A log that is brought into these buckets once takes any number of the maps
    without a further shuffle of the log or of a map; a log kept by ``keep`` is
    not moved either. ``rows`` is the number of lines that the largest map is to
    hold in the end: one task reads and sorts a bucket, which is made for
    BUCKET_ROWS of them. The number of buckets is fixed with the folder.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], path: str | None = None, rows: int = 0, buckets: int | None = None):
        self.spark, self.keys = spark, list(keys)
        self.path = path or scratch_folder(spark)
        self.buckets = buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))

    def keep(self, name: str, table: DataFrame) -> DataFrame:
        """Write the table in buckets, a sorted file each, and open it; a name written again replaces its files."""
        by_bucket = table.repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys)
        written = by_bucket.write.format("parquet").mode("overwrite").option("path", f"{self.path}/{name}")
        spot = f"keyed_{uuid.uuid4().hex}"
        written.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(spot)
        return self.spark.table(spot)

    def open(self, name: str) -> DataFrame:
        """A map written earlier, also by another session whose catalog is gone."""
        path = f"{self.path}/{name}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
        by, spot = ", ".join(f"`{k}`" for k in self.keys), f"keyed_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {spot} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(spot)

    def attach(self, log: DataFrame, maps: Sequence[DataFrame], fills: dict | None = None, arranged: bool = False,
               small: int = SMALL_MAP, hot_rows: int | None = None) -> DataFrame:
        """The log with the columns of all maps; keys that a map lacks, and null keys, get nulls or the fills.

        Keys and map keys are of the same types. ``arranged`` says that the log
        itself was kept here. Otherwise its hot keys (told from a sample, as in
        ``ordered_windows``) do not go into one bucket: their rows stay where
        they are and their lines of the maps, one per hot key, come to them.
        """
        if all(plan_bytes(m) <= small for m in maps):
            for one in maps:
                log = attach(log, one, self.keys)
            return log.fillna(fills) if fills else log
        out = self._merged(log, maps) if arranged else self._beside_hot(log, maps, hot_rows)
        return out.fillna(fills) if fills else out

    def _merged(self, log: DataFrame, maps: Sequence[DataFrame]) -> DataFrame:
        for one in maps:
            log = attach(log, one.hint("merge"), self.keys)
        return log

    def _beside_hot(self, log, maps, hot_rows) -> DataFrame:
        limit = ordered.HOT_ROWS if hot_rows is None else hot_rows
        # Null keys match nothing; among the rest they would all meet in one bucket.
        named = log.dropna(subset=self.keys)
        hot = cut_lineage(ordered.hot_groups(named, self.keys, limit))
        while hot.count() > MANY_HOT:
            limit *= 10
            hot = cut_lineage(ordered.hot_groups(named, self.keys, limit))
        has_null = ~F.expr(" and ".join(f"`{k}` is not null" for k in self.keys))
        added = {f.name: F.lit(None).cast(f.dataType) for m in maps for f in m.schema if f.name not in self.keys}
        aside = log.filter(has_null).withColumns(added)
        if hot.isEmpty():
            moved = named
        else:
            moved = named.join(F.broadcast(hot), self.keys, "left_anti")
            still = named.join(F.broadcast(hot), self.keys, "left_semi")
            for one in maps:
                still = attach(still, F.broadcast(one.join(F.broadcast(hot), self.keys, "left_semi")), self.keys)
            aside = aside.unionByName(still)
        return self._merged(moved.repartition(self.buckets, *self.keys), maps).unionByName(aside)
