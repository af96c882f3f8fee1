"""The prediction log fed by streams: each micro-batch is appended once and settled later."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.operators import store
from touchline.sources import sinks


def append_stream(predictions: DataFrame, path: str, checkpoint: str, key: Sequence[str] = store.KEY) -> StreamingQuery:
    """Append what the log lacks, for all that has arrived; a repeated micro-batch adds nothing."""
    return predictions.writeStream.foreachBatch(lambda batch, _: sinks.append_predictions(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle_stream(results: DataFrame, path: str, checkpoint: str, on: Sequence[str]) -> StreamingQuery:
    """Fill blanks of the log from results as they arrive; settled rows never change."""

    def settle(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sinks.settle_log(path, batch, on)

    return results.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recompute_on_change(source: DataFrame, run: Callable[[DataFrame], None], read_stamp: Callable[[], str | None], write_stamp: Callable[[str], None], date: str = "Date") -> bool:
    """Run a job only if the source's count or latest date differs from the stamp of the last run; whether it ran."""
    row = source.agg(F.count(F.lit(1)).alias("n"), F.max(date).alias("latest")).first()
    stamp = f"{row['n']}:{row['latest']}"
    if read_stamp() == stamp:
        return False
    run(source)
    write_stamp(stamp)
    return True
