"""A stream of records appended to an index, a batch of the index for each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandmill.operators import index
from strandmill.plans.config import Config


def append_batch(batch: DataFrame, epoch: int, config: Config, source: str, fan: int | None = None) -> None:
    """One micro-batch: builds the index or appends to it, once for each (source, epoch) however often it is called.

    ``fan``: then merges as many adjacent batches of a level as that into one of the next.
    """
    if batch.isEmpty():
        return
    token = f"{source}#{epoch}"
    if index.index_exists(batch.sparkSession, config.index_path):
        index.update(batch, config, token)
    else:
        index.build(batch, config, token)
    if fan:
        index.compact(batch.sparkSession, config, fan)


def whole_samples(records: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """(sample_id, seq) of a stream of (sample_id, seq, last), given once a sample is whole.

    The records of a sample that has not ended are kept as its state, over as many micro-batches as it takes: until
    one comes with ``last``, or for ``timeout_ms``, if given, of processing time after its latest; then they go on
    together, and later ones are another sample. A record without a sequence can carry ``last``; those without a sample_id go.
    """

    def gathered(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        ended = state.hasTimedOut
        for part in parts:
            held += [s for s in part["seq"] if s is not None]
            ended |= bool(part["last"].fillna(False).any())
        if ended:
            if state.exists:
                state.remove()
            if held:
                yield pd.DataFrame({"sample_id": key[0], "seq": held})
        else:
            state.update((held,))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    keyed = records.select("sample_id", "seq", "last").where("sample_id IS NOT NULL").groupBy("sample_id")
    return keyed.applyInPandasWithState(gathered, "sample_id string, seq string", "seqs array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def append_stream(records: DataFrame, config: Config, checkpoint: str, *, timeout_ms: int | None = None, fan: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that builds the index from a stream of (sample_id, seq), or appends to it.

    With a further column ``last``, a sample's records may come in several micro-batches (``whole_samples``); without
    it they must arrive in one, as with files of whole samples. A micro-batch that is replayed after a failure is not
    appended again: its epoch is kept with the index's batch. ``fan``: see ``append_batch``. ``trigger``: all that is
    there by default, and then the end; ``timeout_ms`` needs another, as time passes only in a query that goes on.
    """
    if timeout_ms and not trigger:
        raise ValueError("a time-out needs a trigger that goes on")
    if "last" in records.columns:
        records = whole_samples(records, timeout_ms)
    writer = records.writeStream.foreachBatch(lambda batch, epoch: append_batch(batch, epoch, config, checkpoint, fan)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
