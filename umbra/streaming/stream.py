"""Streams. Masking of single texts needs no state and is the batch expression as it stands; session identity keeps a
session's numbers in state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import model
from ..functions.model import Policy
from ..functions.rules import Detection
from ..operators.mask import mask

__all__ = ["mask_stream", "session_stream"]

mask_stream = mask  # the same expressions on a streaming DataFrame


def session_stream(df: DataFrame, session: str = "session_id", order: str = "turn", column: str = "text", d: Detection = Detection(), p: Policy = Policy(), ttl_ms: int = 3_600_000) -> DataFrame:
    """session_id, turn, masked_text with tokens kept over micro-batches; a session that is quiet for ttl_ms is forgotten.

    State: the issued entries of a session as JSON, so it grows with a session's distinct values only. Rows of a session
    within a micro-batch are taken by order.
    """
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = df.schema[session].dataType.simpleString()
    turn = df.schema[order].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = model.Session(d, p, None)
        if state.exists:
            held = json.loads(state.get[0])
            s.counts, s.taken = held["counts"], set(held["taken"])
            s.entries = {tuple(k): (put, model.Entry(*e)) for k, put, e in held["entries"]}
        rows = pd.concat(list(batches)).sort_values("turn")
        out = pd.DataFrame({"session_id": key[0], "turn": rows["turn"], "masked_text": [None if t is None else s.mask(t) for t in rows["text"]]})
        state.update((json.dumps({"counts": s.counts, "taken": sorted(s.taken), "entries": [[list(k), put, [e.token, e.entity_type, e.strategy, e.reversible, e.original]] for k, (put, e) in s.entries.items()]}),))
        state.setTimeoutDuration(ttl_ms)
        yield out

    rows = df.selectExpr(f"`{session}` as session_id", f"`{order}` as turn", f"`{column}` as text")
    return rows.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, turn {turn}, masked_text string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)
