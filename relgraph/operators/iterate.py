"""Fixed-count and convergent loops whose state is cut from its lineage every few rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import cut


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, every: int = 4, progress: Callable[[int], None] | None = None) -> DataFrame:
    """``step`` applied ``rounds`` times; ``progress`` is told of the rounds after which the state was computed."""
    for k in range(1, rounds + 1):
        state = step(state)
        if k % every == 0 and k < rounds:
            state = cut(state)
            if progress is not None:
                progress(k)
    return state


def iterate_and_accumulate(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """The bag of all deltas: ``start``, and what each of ``rounds`` steps makes of the delta before it."""
    delta, parts = start, [start]
    for _ in range(rounds):
        delta = cut(step(delta))
        parts.append(delta)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def until(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object], most: int = 100, progress: Callable[[int, object], None] | None = None) -> DataFrame:
    """``step`` applied until ``measure`` of the state no longer changes; ``progress`` is told of each round and its measure."""
    state = cut(state)
    was = measure(state)
    for k in range(1, most + 1):
        state = cut(step(state))
        now = measure(state)
        if progress is not None:
            progress(k, now)
        if now == was:
            return state
        was = now
    raise RuntimeError(f"no fixed point after {most} rounds")
