"""Change streams: rows (key, op or delta, ..) with retractions, in processing order. There is no event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.ordered import bag_swap

CHANGE = "key string, seq long, delta int"
EDGE = "key string, seq long, op string, n long"


def _edges(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """First and last instances of one key; the count is the state."""
    n = state.get[0] if state.exists else 0
    rows = []
    whole = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
    for seq, delta in zip(whole["seq"], whole["delta"], strict=True):
        n += int(delta)
        if n == 1 and delta == 1:
            rows.append((key[0], int(seq), "add", n))
        elif n == 0 and delta == -1:
            rows.append((key[0], int(seq), "remove", n))
    state.update((n,))
    yield pd.DataFrame(rows, columns=["key", "seq", "op", "n"])


def instance_edges(changes: DataFrame) -> DataFrame:
    """A stream (key, seq, delta) of instances that come (+1) and go (-1) -> the changes that add a key's first or remove
    its last instance. One number of state a key; keys are spread by hash, a key's rows are its own order."""
    keyed = changes.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("delta").cast("int").alias("delta"))
    return keyed.groupBy("key").applyInPandasWithState(_edges, EDGE, "n long", "append", GroupStateTimeout.NoTimeout)


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = []
    whole = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
    for seq, status in zip(whole["seq"], whole["status"], strict=True):
        if last is None or int(status) != last:
            rows.append((key[0], int(seq), int(status)))
            last = int(status)
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(rows, columns=["key", "seq", "status"])


def status_stream(statuses: DataFrame) -> DataFrame:
    """A stream (key, seq, status) -> only the rows whose status isn't that of the key's row before."""
    keyed = statuses.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("status").cast("int").alias("status"))
    return keyed.groupBy("key").applyInPandasWithState(_changed, "key string, seq long, status int", "status int", "append", GroupStateTimeout.NoTimeout)


def tracked_stream(changes: DataFrame, requests: DataFrame, key: str = "file_id") -> DataFrame:
    """A stream of occurrence changes (.., key, kind, op) -> those of tracked files or entities and kinds (key, mask): a
    join of the stream with the table of requests. Masks of several requests for one key add up."""
    want = requests.groupBy(key).agg(F.bit_or(F.col("mask").cast("long")).alias("mask"))
    # the requests are hashed, so a task sorts no changes, however many it has
    j = changes.join(want.hint("shuffle_hash"), key)
    return j.where(F.expr("bit_get(mask, kind) = 1")).drop("mask")


def wake_stream(new_paths: DataFrame, missing: DataFrame) -> DataFrame:
    """A stream of new paths (path) -> units (unit_id, header, path) whose missing header one of them ends with."""
    from skein.operators.lookups import missing_header_matches

    return missing_header_matches(missing, new_paths)


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, debounce: str = "500 milliseconds"):
    """Start a query that hands each micro-batch's net changes to the sink, adds before removes are the sink's to order.

    Changes that follow within `debounce` come together in one batch. folder: the checkpoint's place.
    """
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", folder).trigger(processingTime=debounce).start()


def swap_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a batch publishes when a unit's results replace its old ones: instances to add and remove, as bags."""
    return bag_swap(old, new)


def run_once(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """Process what is there, and return all output as a table (small outputs, tests)."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", folder).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
