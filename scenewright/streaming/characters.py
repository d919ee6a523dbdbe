"""Character states over a stream of scenes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import lexicons as lx

OUTPUT = "key string, emotion string, turn_count long, stress_index double"
STATE = "emotion string, turn_count long, tenths int"


def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Folds a key's new rows, in order within the micro-batch, into its state."""
    emotion, turns, tenths = state.get if state.exists else ("neutral", 0, 0)
    rows = pd.concat(list(batches)).sort_values("order")
    for trigger in rows["trigger"]:
        emotion = trigger if isinstance(trigger, str) else emotion
        turns += 1
        tenths = min(10, max(0, tenths + lx.STRESS_TENTHS.get(emotion, 0)))
    state.update((emotion, turns, tenths))
    yield pd.DataFrame({"key": [key[0]], "emotion": [emotion], "turn_count": [turns], "stress_index": [tenths / 10]})


def stream_states(rows: DataFrame) -> DataFrame:
    """Emotion, turns and stress per key after each micro-batch of rows (key, order, trigger).

    Rows must come in order across micro-batches.
    """
    return rows.groupBy("key").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")
