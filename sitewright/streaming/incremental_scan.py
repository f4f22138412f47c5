"""Resumable scan: new design files stream in, states not yet in the score store are scored and appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import EDITS, SIGNAL, Scorer, score_pending


def start_scan(
    spark: SparkSession,
    design_path: str,
    regions: DataFrame,
    store_path: str,
    checkpoint_path: str,
    scorer: Scorer,
    *,
    by: Sequence[str],
    sequence: str,
    outputs: str = SIGNAL,
    batch_size: int = 64,
    prefix: int = 1,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Score everything that has arrived and stop. Design files hold by..., key and edits; ``regions`` has the sequences.
    Finished keys live in the score store, not in streaming state, so state does not grow and a replayed micro-batch
    scores nothing twice; a micro-batch reads only the shards of the store that its keys can lie in."""
    kinds = [f"{name} {regions.schema[name].dataType.simpleString()}" for name in by]
    designs = (
        spark.readStream.schema(", ".join([*kinds, "key string", f"edits {EDITS}"]))
        .option("maxFilesPerTrigger", str(files_per_trigger))
        .parquet(design_path)
    )

    def score_new(batch: DataFrame, _: int) -> None:
        score_pending(
            batch.sparkSession, batch, regions, by, store_path, scorer,
            sequence=sequence, outputs=outputs, batch_size=batch_size, prefix=prefix, prune=True,
        )

    return (
        designs.writeStream.foreachBatch(score_new)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
