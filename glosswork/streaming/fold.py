"""Streamed responses folded to their content as their lines arrive, with state for each response."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def folded(lines: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """lines: stream_id, line_no (from 0), value (NDJSON), a stream. stream_id and content, once a response, when its line that is done has come.

    A response's lines come in the order of line_no from batch to batch, in any order inside one. Blank lines don't count; lines that
    come again, or behind the end, are ignored. The text is held until the end; then only a mark stays. With `keep_ms`, for streams that go
    on (a run over what is there would wait for ever), state is dropped when no line has come for that processing time, and a response that
    hasn't ended by then gives what it has.
    """
    kind = lines.schema["stream_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        content, last, done = state.get if state.exists else ("", -1, False)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame({"stream_id": [key[0]], "content": [content]})
            return
        rows = sorted((n, v) for b in batches for n, v in zip(b["line_no"].tolist(), b["value"].tolist(), strict=True) if v and v.strip(" "))
        parts, ended = [], False
        for n, value in rows:
            if done or n <= last:
                continue
            line, last = json.loads(value), n
            parts.append((line.get("message") or {}).get("content") or "")
            done = ended = bool(line.get("done"))
        content += "".join(parts)
        state.update(("" if done else content, last, done))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        if ended:
            yield pd.DataFrame({"stream_id": [key[0]], "content": [content]})

    rows = lines.select("stream_id", F.col("line_no").cast("long").alias("line_no"), "value")
    return rows.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {kind}, content string", "content string, last long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout)
