"""Keccak-256 (the original padding, not SHA-3's) as an Arrow-batched UDF: no built-in has it.

All values of a batch with the same number of blocks go through the permutation together, as columns of a 25-lane
state, so the work in Python is per batch and not per value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shipping import ship

ship(__name__)

RATE = 136


def _constants() -> list[np.uint64]:
    """The 24 round constants, from the degree-8 shift register that defines them."""
    register, found = 1, []
    for _ in range(24):
        constant = 0
        for j in range(7):
            if register & 1:
                constant |= 1 << ((1 << j) - 1)
            register = register << 1 ^ (0x171 if register & 0x80 else 0)
        found.append(np.uint64(constant))
    return found


def _offsets() -> dict[tuple[int, int], int]:
    """How far each lane turns: triangular numbers along the walk that starts at (1, 0)."""
    x, y, found = 1, 0, {(0, 0): 0}
    for t in range(24):
        found[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return found


_ROUNDS, _TURNS = _constants(), _offsets()


def _turn(lane: np.ndarray, by: int) -> np.ndarray:
    return lane if by == 0 else lane << np.uint64(by) | lane >> np.uint64(64 - by)


def _permute(a: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    for constant in _ROUNDS:
        parity = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(5)]
        mixed = [parity[x - 1] ^ _turn(parity[(x + 1) % 5], 1) for x in range(5)]
        b = {(y, (2 * x + 3 * y) % 5): _turn(a[x, y] ^ mixed[x], _TURNS[x, y]) for x in range(5) for y in range(5)}
        a = {(x, y): b[x, y] ^ (~b[(x + 1) % 5, y] & b[(x + 2) % 5, y]) for x in range(5) for y in range(5)}
        a[0, 0] = a[0, 0] ^ constant
    return a


def keccak256(values: list[bytes | None]) -> list[bytes | None]:
    out: list[bytes | None] = [None] * len(values)
    groups: dict[int, list[int]] = {}
    for i, value in enumerate(values):
        if value is not None:
            groups.setdefault(len(value) // RATE + 1, []).append(i)
    for blocks, at in groups.items():
        data = np.zeros((len(at), blocks * RATE), np.uint8)
        for row, i in enumerate(at):
            data[row, : len(values[i])] = np.frombuffer(values[i], np.uint8)
            data[row, len(values[i])] ^= 0x01
        data[:, -1] ^= 0x80
        lanes = data.view("<u8").reshape(len(at), blocks, RATE // 8)
        state = {(x, y): np.zeros(len(at), np.uint64) for x in range(5) for y in range(5)}
        for block in range(blocks):
            for lane in range(RATE // 8):
                state[lane % 5, lane // 5] = state[lane % 5, lane // 5] ^ lanes[:, block, lane]
            state = _permute(state)
        digests = np.stack([state[x, 0] for x in range(4)], axis=1).astype("<u8")
        for row, i in enumerate(at):
            out[i] = digests[row].tobytes()
    return out


@F.pandas_udf(T.BinaryType())
def keccak_of(values: pd.Series) -> pd.Series:
    return pd.Series(keccak256([None if v is None else bytes(v) for v in values]), dtype=object)


EMPTY_CODE = keccak256([b""])[0]
