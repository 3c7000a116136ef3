"""Linkage of a stream of entities against static targets, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators.scoring import with_stand_ins
from ..plans.linkage import link


def link_batches(
    s1: DataFrame, targets: DataFrame, folder: str, checkpoint: str, config: Config = DEFAULT, scorer: Callable[[DataFrame], DataFrame] = with_stand_ins
) -> StreamingQuery:
    """Links each batch of the stream s1 and writes folder/candidates and folder/matches, partitioned by batch.

    Entities are independent of each other, so batches are too. A batch that is run again replaces what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        found = link(batch, targets, config, scorer)
        for name, lists in (("candidates", found.candidate_lists), ("matches", found.match_lists)):
            lists.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return s1.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
