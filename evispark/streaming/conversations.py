"""Live conversations: state per conversation and statistics per session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import intents

TTL = "60 minutes"   # fixed value: how long a silent conversation is kept
OUT = ("conv_id long, ts timestamp, age int, symptom_bits long, duration string, turns long, "
       "decision string, state string, expired boolean")


class ConversationState(StatefulProcessor):
    """Keeps what a conversation has stated; emits a row per user turn, and one when it expires.

    Facts of a single turn are computed by Spark columns before this operator; here
    they are only merged, in time order, into bounded state.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "age int, bits long, duration string, turns long, last_ms long")

    def _load(self) -> dict[str, Any]:
        if not self.known.exists():
            return {"age": None, "bits": 0, "duration": None, "turns": 0, "last_ms": 0}
        age, bits, duration, turns, last_ms = self.known.get()
        return {"age": age, "bits": bits, "duration": duration, "turns": turns, "last_ms": last_ms}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        k = self._load()
        # The turns of one conversation in one micro-batch, merged column by column.
        turns = pd.concat(list(rows)).sort_values(["ts", "turn"]).reset_index(drop=True)
        adds = (turns["role"] == "user") & ~turns["context_question"].fillna(False).astype(bool)

        def newest(name: str, before: Any) -> list:
            """What is known after each turn: the place of the last stated value, looked up."""
            stated = (adds & turns[name].notna()).to_numpy()
            at = np.maximum.accumulate(np.where(stated, np.arange(1, len(turns) + 1), 0))
            values = [before, *turns[name].tolist()]
            return [values[i] for i in at]
        age, duration = newest("stated_age", k["age"]), newest("stated_duration", k["duration"])
        bits = np.bitwise_or.accumulate(np.r_[k["bits"], np.where(adds, turns["symptom_bits"].fillna(0).astype("int64"), 0)])[1:]
        count = k["turns"] + np.arange(1, len(turns) + 1)
        asked, known = turns["wants_assessment"].fillna(False).astype(bool), bits != 0
        full = known & [a is not None and d is not None for a, d in zip(age, duration)]
        decision = np.select([turns["context_question"].fillna(False).astype(bool), asked & known, asked, full],
                             ["answer_context", "assess", "ask_missing", "confirm"], "ask_missing")
        states = {"assess": "complete", "confirm": "clarifying", "ask_missing": "gathering"}
        out = [(key[0], ts, None if a is None else int(a), int(b), d, int(n), x, states.get(x), False) for ts, a, b, d, n, x, user in zip(
            turns["ts"], age, bits, duration, count, decision, turns["role"] == "user") if user]
        last = int(turns["ts"].max().timestamp() * 1000)
        k = {"age": None if age[-1] is None else int(age[-1]), "bits": int(bits[-1]), "duration": duration[-1],
             "turns": int(count[-1]), "last_ms": max(k["last_ms"], last)}
        self.known.update((k["age"], k["bits"], k["duration"], k["turns"], k["last_ms"]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(k["last_ms"] + self.ttl_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        k = self._load()
        self.known.clear()
        ts = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield self._frame([(key[0], ts, k["age"], k["bits"], k["duration"], k["turns"], "expire", "greeting", True)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in OUT.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"age": "Int32"})

    def close(self) -> None:
        pass


def live_state(turns: DataFrame, ttl_minutes: int = 60) -> DataFrame:
    """Running state of a stream of turns (``conv_id, turn, role, text, ts``).

    Facts are read from each user turn on its own.  State is one small row per
    conversation; a conversation silent for the TTL expires with the watermark.
    """
    low = F.lower("text")
    facts = turns.withWatermark("ts", f"{ttl_minutes} minutes").select(
        "conv_id", "turn", "role", "ts", intents.stated_age(low).alias("stated_age"),
        intents.symptom_mask(low).alias("symptom_bits"), intents.stated_duration(low).alias("stated_duration"),
        intents.asks_about_context(F.col("text")).alias("context_question"),
        intents.wants_assessment(F.col("text")).alias("wants_assessment"))
    return facts.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=ConversationState(ttl_minutes * 60_000), outputStructType=OUT,
        outputMode="append", timeMode="EventTime")


def session_statistics(turns: DataFrame, gap: str = TTL, watermark: str = TTL) -> DataFrame:
    """Turns per conversation session; a session ends after ``gap`` without a turn."""
    w = F.session_window("ts", gap)
    return (turns.withWatermark("ts", watermark).groupBy("conv_id", w.alias("session"))
            .agg(F.count(F.lit(1)).alias("turns"), F.sum((F.col("role") == "user").cast("int")).alias("user_turns"))
            .select("conv_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                    "turns", "user_turns"))
