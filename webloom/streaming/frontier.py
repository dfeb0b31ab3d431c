"""The frontier as a stream: discovered URLs arrive, each key of a site is let through once, within the site's budget.

Deduplication is Spark's own stateful operator, one small state row a (site, key), so a large site spreads over all
partitions. The state grows with the keys seen, as a visited set does; there is no event time that could prune it. The
budget keeps one counter a site. Delivery is at least once: after a failure Spark replays from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls


def first_seen(discovered: DataFrame) -> DataFrame:
    """Stream of (site, url, ...) → the first address that arrives of each (site, key), with its key."""
    return discovered.withColumn("key", urls.checksum(urls.relative_key(F.col("url")))).dropDuplicates(["site", "key"])


def within_budget(stream: DataFrame, budget: int) -> DataFrame:
    """Stream of (site, url, key) → its first ``budget`` rows of each site, numbered from 1."""

    def count(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for part in rows:
            taken = part.head(max(0, budget - used))[["site", "url", "key"]]
            if len(taken):
                yield taken.assign(nth=range(used + 1, used + 1 + len(taken)))
                used += len(taken)
        state.update((used,))

    return stream.select("site", "url", "key").groupBy("site").applyInPandasWithState(count, "site string, url string, key string, nth long", "used long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is there, write it as Parquet, and read it back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
