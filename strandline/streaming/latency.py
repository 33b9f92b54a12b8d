"""Running latency over a stream of tokens: an extension, as the engine's own metrics are of whole documents.

A document's state is three numbers (tokens before its cut, their sum of delays, whether it is cut), so it is small however
long the document gets; late documents are forgotten with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "doc_id string, tokens long, mean_delay double, closed boolean"


def running_delay(tokens: DataFrame, forget: str = "1 hour") -> DataFrame:
    """After each batch: a document's tokens before its recording's end and their mean delay.

    tokens: doc_id string, ts timestamp, delay double, recording_end double; in order of time in each document."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, total, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], n, total / n if n else None, True)], columns=["doc_id", "tokens", "mean_delay", "closed"])
            return
        n, total, cut = state.get if state.exists else (0, 0.0, False)
        latest = 0
        for pdf in parts:
            pdf = pdf.sort_values("ts", kind="stable")
            latest = max(latest, int(pdf["ts"].max().timestamp() * 1000))
            over = (pdf["delay"] >= pdf["recording_end"]).to_numpy()
            if not cut:
                k = int(over.argmax()) if over.any() else len(pdf)
                n, total, cut = n + k, total + float(pdf["delay"].iloc[:k].sum()), bool(over.any())
        state.update((n, total, cut))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame([(key[0], n, total / n if n else None, cut)], columns=["doc_id", "tokens", "mean_delay", "closed"])

    return tokens.withWatermark("ts", forget).groupBy("doc_id").applyInPandasWithState(step, SCHEMA, "n long, total double, cut boolean", "update", GroupStateTimeout.EventTimeTimeout)
