"""The growing key set as a stateful stream: one key store per sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decoding import GROUP

SCORES = "seq_id bigint, round int, pos bigint, score bigint"


class KeyStore(StatefulProcessor):
    """Keeps the keys of a sequence by slot; each round overwrites the slot of its group.

    State is bounded by the length of a sequence; rows may arrive in any order within a micro-batch.
    """

    def __init__(self, past: int):
        self.past = past

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "slot int", "key array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {s[0]: np.array(k[0]) for s, k in self.keys.iterator()} if self.keys.exists() else {}
        out, frames = [], [f for f in rows if len(f)]   # what a micro-batch has of the sequence
        if frames:
            for r in pd.concat(frames).sort_values("at").itertuples():
                slot = int(r.at) if r.at < self.past else self.past + (int(r.at) - self.past) // GROUP
                held[slot] = np.asarray(r.k, np.float64)
                self.keys.updateValue((slot,), (held[slot].tolist(),))
                if r.at >= self.past:
                    seen = np.stack([held[s] for s in range(slot + 1)])
                    scores = (seen @ np.asarray(r.q, np.float64)).astype(np.int64)
                    out.append(pd.DataFrame({"seq_id": key[0], "round": np.int32(r.at - self.past),
                                             "pos": np.arange(slot + 1, dtype=np.int64), "score": scores}))
        if out:
            yield pd.concat(out)

    def close(self) -> None:
        pass


def growing_scores(stream: DataFrame, past: int) -> DataFrame:
    """Scores of each round as it arrives; ``stream``: (seq_id, at, q, k)."""
    return stream.groupBy("seq_id").transformWithStateInPandas(
        statefulProcessor=KeyStore(past), outputStructType=SCORES, outputMode="Append", timeMode="None")
