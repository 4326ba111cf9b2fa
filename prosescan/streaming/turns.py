"""Conversations as streams: scanning is stateless; replies are paired with the turn before them by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosescan.operators import detectors

PAIR = "conversation string, position long, text string, user_turn string"


def scanned(stream: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Raw findings of a stream of texts; every text is scanned by itself, so nothing is held."""
    return detectors.findings(detectors.prepared(stream, doc_id, text))


def paired_turns(stream: DataFrame, keep: str = "1 hour") -> DataFrame:
    """(conversation, position, text, user_turn) of assistant turns, from turns (conversation, position, role, text, at).

    One text is held per conversation: the last turn, if a user wrote it. It is dropped when the
    watermark passes the conversation's last turn by ``keep``. Turns of one batch are taken by
    position; a turn that comes after a later one was paired is paired with what is held then.
    """
    seconds = int(pd.Timedelta(keep).total_seconds() * 1000)

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        turns = pd.concat(list(batches)).sort_values("position", kind="stable")
        out = []
        for position, role, text in turns[["position", "role", "text"]].itertuples(index=False):
            if role == "assistant":
                out.append((key[0], position, text, held))
            held = text if role == "user" else None
        state.update((held,))
        state.setTimeoutTimestamp(max(int(turns["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + seconds)
        yield pd.DataFrame(out, columns=["conversation", "position", "text", "user_turn"])

    timed = stream.withWatermark("at", keep)
    return timed.groupBy("conversation").applyInPandasWithState(pair, PAIR, "held string", "append", GroupStateTimeout.EventTimeTimeout)
