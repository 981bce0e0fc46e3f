"""Seeded draws from MD5 digests: the same numbers in any engine that has MD5, so that sampled results can be checked."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str, seed: int) -> Column:
    """A whole number below 2^60: the first 15 hex digits of MD5 over the parts and the seed, joined by colons."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def poisson_steps() -> list[int]:
    """A 32-bit number is a Poisson(1) draw of as many as there are steps at most as large."""
    steps, below, term = [], 0.0, math.exp(-1)
    for k in range(1, 13):
        below += term
        term /= k
        steps.append(math.floor(below * 2**32))
    return steps


def poisson_weights(block: str, draws: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of a block: four to an MD5 over block, number and seed."""
    digests = b"".join(hashlib.md5(f"{block}:{j}:{seed}".encode()).digest() for j in range(-(-draws // 4)))
    return np.searchsorted(poisson_steps(), np.frombuffer(digests, ">u4")[:draws], side="right")
