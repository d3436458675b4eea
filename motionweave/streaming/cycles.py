"""Gait cycles over a live stream of contacts.

State per trial is two frames: the pending right contacts and the lefts seen since, which
is bounded because a right contact is closed by the second left after it.  Contacts of a
trial must arrive in frame order within a micro-batch's trial rows (they are sorted) and
across batches; late contacts (before the last one handled) are dropped, as a watermark
would do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "trial {t}, start long, stop long"
_STATE = "rights array<long>, lefts array<long>, last long"


def advance(rights: list[int], lefts: list[int], frame: int, side: str) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """One contact: new pending rights, lefts seen since the oldest, and closed cycles.

    A right contact may open a cycle only once another right follows it (the last right of a
    trial never does), so cycles come out when both the second left and a later right are
    known.
    """
    if side == "R":
        rights = [*rights, frame]
    else:
        lefts = [*lefts, frame]
    done, left_open = [], []
    for k, r in enumerate(rights):
        after = [x for x in lefts if x > r]
        if k + 1 < len(rights) and len(after) >= 2:
            done.append((r, after[1]))
        else:
            left_open.append(r)
    oldest = left_open[0] if left_open else frame
    return left_open, [x for x in lefts if x > oldest], done


def stream_cycles(contacts: DataFrame, trial: str = "user_id") -> DataFrame:
    """(trial, start, stop) of every closed cycle of a streaming (trial, frame, side) table."""
    kind = contacts.schema[trial].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rights, lefts, last = ([*x] if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in state.get) if state.exists else ([], [], -1)
        rows = pd.concat(batches).sort_values(["frame", "side"])
        out: list[tuple[int, int]] = []
        for frame, side in zip(rows["frame"].tolist(), rows["side"].tolist()):
            if frame < last:
                continue
            last = frame
            rights, lefts, done = advance([int(x) for x in rights], [int(x) for x in lefts], int(frame), side)
            out += done
        state.update(([int(x) for x in rights], [int(x) for x in lefts], int(last)))
        yield pd.DataFrame({"trial": [key[0]] * len(out), "start": [o[0] for o in out], "stop": [o[1] for o in out]})

    return contacts.groupBy(trial).applyInPandasWithState(step, _OUT.format(t=kind), _STATE, "append", GroupStateTimeout.NoTimeout).withColumnRenamed("trial", trial)
