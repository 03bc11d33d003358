"""Reproducible bootstrap draws: one xorshift32 sequence, read at any point.

A step of the generator is linear over GF(2), so n steps are one 32x32 bit matrix. Replicates
therefore start at their own place in the sequence and are drawn side by side.
"""

from __future__ import annotations

import numpy as np

# Generator seed, its three shifts and the number of replicates.
SEED = 1337
SHIFTS = (13, 17, 5)
REPLICATES = 1000


def step(state: np.ndarray) -> np.ndarray:
    """One generator step on an array of uint32 states."""
    left, right, last = SHIFTS
    state = state ^ (state << np.uint32(left))
    state = state ^ (state >> np.uint32(right))
    return state ^ (state << np.uint32(last))


def _apply(columns: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for bit in range(32):
        out ^= np.where((states >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0)).astype(np.uint32)
    return out


def jump_matrix(steps: int) -> np.ndarray:
    """Images of the 32 unit states after ``steps`` steps."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    result, power = unit, step(unit)
    while steps:
        if steps & 1:
            result = _apply(power, result)
        power = _apply(power, power)
        steps >>= 1
    return result


def replicate_states(draws_each: int, first: int, count: int, seed: int = SEED) -> np.ndarray:
    """Generator states before the first draw of replicates first .. first+count-1."""
    start = _apply(jump_matrix(draws_each * first), np.array([max(seed, 1)], dtype=np.uint32))
    hop = jump_matrix(draws_each)
    states = start
    while len(states) < count:
        states = np.concatenate([states, _apply(hop, states)])
        hop = _apply(hop, hop)
    return states[:count]


def next_starts(states: np.ndarray, max_start: int) -> tuple[np.ndarray, np.ndarray]:
    """(new states, block starts 0..max_start)."""
    states = step(states)
    unit = states.astype(np.float64) / float(2**32 - 1)
    return states, np.minimum((unit * (max_start + 1.0)).astype(np.int64), max_start)
