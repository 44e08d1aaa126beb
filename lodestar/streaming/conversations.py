"""Per-conversation state of a simulated user over a stream of agent messages.

The transition is the one of ``functions.dialogue``: messages are classified by built-in functions before they reach the
stateful operator, which holds a turn count, the areas already told and whether the contradiction was used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dialogue

STATE = "turn int, provided string, contradiction_used boolean"
OUTPUT = "conv_id long, turn int, plan string, provided string, kind string"


def answer(requested: list[str], provided: list[str]) -> list[str]:
    """The areas of one reply; the same rule as ``dialogue.slot_group``."""
    hit = [g for g in dialogue.SLOTS if set(g) - set(provided) and set(g) & set(requested)]
    if len(hit) > 1:
        return [a for g in hit for a in g if a not in provided]
    return list(hit[0]) if hit else list(dict.fromkeys(requested))


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turn, provided, used = state.get if state.exists else (1, "service", False)
    told = provided.split(",")
    rows = []
    for r in pd.concat(list(frames)).sort_values(["turn", "requested"]).itertuples():
        plan = answer(r.requested.split(",") if r.requested else ["service"], told)
        contrary = r.behavior == "self_contradictory"
        now = contrary and not used and bool(r.contradiction_area) and r.contradiction_area in plan
        turn, used = turn + 1, used or now
        told = list(dict.fromkeys([*told, *plan]))
        kind = "impatience" if r.behavior == "impatience" else "contradiction" if now else "resolved" if contrary else "reply"
        rows.append((key[0], turn, ",".join(plan), ",".join(told), kind))
    state.update((turn, ",".join(told), used))
    yield pd.DataFrame(rows, columns=["conv_id", "turn", "plan", "provided", "kind"])


def track(messages: DataFrame) -> DataFrame:
    """``messages``: a stream of conv_id, turn, text (of the agent), behavior, contradiction_area."""
    asked = messages.select("conv_id", "turn", F.array_join(dialogue.requested_areas(F.col("text")), ",").alias("requested"), "behavior", F.coalesce("contradiction_area", F.lit("")).alias("contradiction_area"))
    return asked.groupBy("conv_id").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
