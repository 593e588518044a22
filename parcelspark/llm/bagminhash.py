"""BagMinHash signatures of many multisets at once.

A shingle with count c owns the levels [0, c) of a half-plane of levels and times. Random points fall on it at a rate
of one per register and level; register r of a set keeps the earliest of its points. Two sets agree in a register with
the probability of their weighted Jaccard similarity, because a point at level x belongs to both sets exactly if both
counts exceed x.

The levels are discretised and split in a hierarchy: [0, 1), [1, 2), [2, 4), [4, 8), ... Each part has a Poisson process
of its own, seeded by shingle and part, so a set only walks through the parts its counts reach, and in its last part
drops the points above its count. All registers share one process per part; points come in order of time and the walk
ends when they are later than the latest register, after about one point per shingle instead of one per register.
"""

from __future__ import annotations

import numpy as np

from parcelspark.llm.wordhash import mix

GAMMA = np.uint64(0x9E3779B97F4A7C15)


def times_gamma(n: int) -> np.uint64:
    return np.uint64(n * int(GAMMA) & 0xFFFFFFFFFFFFFFFF)


def signatures(shingles: np.ndarray, counts: np.ndarray, sets: np.ndarray, n_sets: int, registers: int) -> np.ndarray:
    """n_sets x registers arrival times; `sets` gives the set of each distinct shingle. Empty sets stay at infinity."""
    sig = np.full(n_sets * registers, np.inf)
    key, low, width, limit, owner = [], [], [], [], []
    part, begin = 0, 0
    reach = np.arange(len(shingles))
    while len(reach):
        span = max(1, begin)
        key.append(mix(shingles[reach] + times_gamma(part)))
        low.append(np.full(len(reach), begin))
        width.append(np.full(len(reach), span))
        limit.append(counts[reach])
        owner.append(sets[reach])
        begin += span
        part += 1
        reach = reach[counts[reach] > begin]
    if not key:
        return sig.reshape(n_sets, registers)
    key, low, width, limit, owner = (np.concatenate(x) for x in (key, low, width, limit, owner))

    time = np.zeros(len(key))
    step = 0
    with np.errstate(over="ignore"):
        while len(key):
            step += 1
            drawn = mix(key + times_gamma(step))
            time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * width)
            where = mix(drawn ^ GAMMA)
            register = ((where >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            level = low + ((where & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
            falls = level < limit
            np.minimum.at(sig, owner[falls] * registers + register[falls], time[falls])
            latest = sig.reshape(n_sets, registers).max(axis=1)
            on = time < latest[owner]
            key, low, width, limit, owner, time = (x[on] for x in (key, low, width, limit, owner, time))
    return sig.reshape(n_sets, registers)


def short_form(sig: np.ndarray) -> np.ndarray:
    """32 bits for each arrival time; equal times have equal ones."""
    return (mix(sig.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_keys(short: np.ndarray, rows: int) -> np.ndarray:
    """n_sets x bands keys, each from `rows` registers and the band's number."""
    n, m = short.shape
    bands = short.reshape(n, m // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * GAMMA, (n, m // rows)).copy()
    for i in range(rows):
        out = mix(out ^ (bands[:, :, i] + times_gamma(i)))
    return out
