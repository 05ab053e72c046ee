"""The compliance job as a stateful stream (T14, S13, S14): one step for each tick of a job's clock.

A tick brings what the provider answered in it. Without an open job a tick creates one and
uploads the ids; an upload without an answer is taken up again by the next tick, until its
window closes; an uploaded job is polled until it is complete, which collects its results,
or fails, or its results' window closes. The next tick then begins a new one. A tick that comes
again, after a replay, does nothing: its number is not above the job's last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPLOAD_SECONDS, DOWNLOAD_SECONDS = 15 * 60, 40 * 60
STEPS = "job string, tick long, step string, state string"
_STATE = "state string, tick long, upload_until double, download_until double"


def advance(state: str | None, answer: str | None, now: float, upload_until: float, download_until: float) -> tuple[str, str, float, float]:
    """(step, state, and the ends of both windows) after one tick."""
    if state not in ("created", "in_progress"):
        step, upload_until, download_until = "create", now + UPLOAD_SECONDS, now + DOWNLOAD_SECONDS
    elif state == "created":
        step = "expire" if upload_until < now else "upload"
    else:
        step = "expire" if download_until < now else "poll"
    if step == "expire":
        after = "expired"
    elif step == "poll":
        after = {"complete": "collected", "failed": "failed"}.get(answer or "", "in_progress")
        step = "collect" if after == "collected" else step
    else:
        after = {"accepted": "in_progress", "rejected": "failed"}.get(answer or "", "created")
    return step, after, upload_until, download_until


def steps(ticks: DataFrame) -> DataFrame:
    """job, tick, step, state from a stream of ticks (job, tick, at, answer), numbered from 1 a job. Ticks of
    one batch are taken in order."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last, upload, download = held.get if held.exists else (None, 0, 0.0, 0.0)
        rows = sorted((int(r.tick), r.at.timestamp(), r.answer) for batch in batches for r in batch.itertuples())
        out = []
        for tick, now, answer in rows:
            if tick > last:
                step, state, upload, download = advance(state, answer, now, upload, download)
                last = tick
                out.append((key[0], tick, step, state))
        held.update((state, last, upload, download))
        yield pd.DataFrame(out, columns=["job", "tick", "step", "state"])

    return ticks.select("job", "tick", "at", "answer").groupBy("job").applyInPandasWithState(run, STEPS, _STATE, "append", GroupStateTimeout.NoTimeout)
