"""Tracking as a stream: the batch kernel, its state kept per sequence by the state store."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..grid import Grid, TrackOptions
from ..operators.lineage import TAGGED, Lineage, emit


def track_stream(rows: DataFrame, options: TrackOptions, grid: Grid | None = None) -> DataFrame:
    """Tagged rows (nodes, edges, events, candidates) of a stream of ``lineage.frame_rows`` rows.

    Frames of a batch are put in order of time; one that comes late, or leaves a gap in time, is an error
    and isn't dropped, as a lost hour would change all that follows. Dormant objects leave the state after
    ``max_gap`` frames. Families are read from the state rows: the kernel's state after each batch.
    """

    def run(key: tuple[Any, ...], parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Lineage(options, json.loads(state.get[0]) if state.exists else None, key[0], grid)
        frames = pd.concat(list(parts)).sort_values("t", kind="stable")
        out: list[tuple] = []
        for t, objects in zip(frames.t.tolist(), frames.objects.tolist()):
            out += [(key[0], *x) for x in emit(held, t, [dict(o) for o in json.loads(objects)])]
        text = json.dumps(held.state, sort_keys=True)
        state.update((text,))
        out.append((key[0], "state", held.state["last_time"], json.dumps({"state": text})))
        yield pd.DataFrame(out, columns=["sequence_id", "kind", "n", "row"])

    packed = rows.select("sequence_id", "t", F.to_json("objects").alias("objects"))
    return packed.groupBy("sequence_id").applyInPandasWithState(run, TAGGED, "state string", "append", GroupStateTimeout.NoTimeout)


def run_to_end(rows: DataFrame, options: TrackOptions, output: str, checkpoint: str, grid: Grid | None = None) -> None:
    """Track all that there is now (a fixed plan of input, not a watch) and stop; called again, it goes on."""
    query = track_stream(rows, options, grid).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
