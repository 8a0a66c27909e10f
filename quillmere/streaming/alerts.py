"""The states of alerts over a stream of windows, with a timer for silence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

#: Starts of the windows that still count, in seconds, and whether each held.
STATE = "starts array<bigint>, held array<boolean>"


def step(starts: list[int], held: list[bool], at: int, holds: bool, wait: int) -> tuple[list[int], list[bool], str]:
    """The windows that still count at a new one, and the state that follows."""
    kept = [(s, h) for s, h in zip(starts, held, strict=True) if s >= at - wait] + [(at, holds)]
    state = "inactive" if not holds else "firing" if all(h for _, h in kept) else "pending"
    return [s for s, _ in kept], [h for _, h in kept], state


def follow(silence: int, names: list[str]) -> Callable:
    """The function of applyInPandasWithState: rows (names..., start, holds, wait) of one key."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        starts, held = map(list, state.get) if state.exists else ([], [])
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((pd.Timestamp(starts[-1] + silence, unit="s"), "expired"))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("start")
            for start, holds, wait in zip(rows["start"], rows["holds"], rows["wait"], strict=True):
                at = int(start.value // 10**9)
                if starts and at - starts[-1] > silence:  # within one batch, where no timer runs
                    out.append((pd.Timestamp(starts[-1] + silence, unit="s"), "expired"))
                    starts, held = [], []
                starts, held, now = step(starts, held, at, bool(holds), int(wait))
                out.append((start, now))
            state.update((starts, held))
            state.setTimeoutTimestamp(max(1000 * (starts[-1] + silence), state.getCurrentWatermarkMs() + 1))
        made = pd.DataFrame(out, columns=["start", "state"])
        for k, name in enumerate(names):
            made.insert(k, name, key[k])
        yield made

    return run
