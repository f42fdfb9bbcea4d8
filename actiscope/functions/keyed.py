"""Randomness that depends only on a key.

Nothing here uses ``rand``: a value is a function of the seed and of ids in the
row, so retries, re-partitioning and other engines give the same answer.

``row_hash`` orders rows (sampling, splitting, shuffling). ``key_words`` and
``normals`` make one stream of normal deviates per key: the two key words come
from md5, each position is mixed with them by a 32-bit integer finaliser, and
pairs of uniforms become pairs of normals by the Box-Muller formula. The stream
exists twice, as SQL text (``normals``) and as NumPy code for Arrow batches
(``normals_flat``); both give the same numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from actiscope.functions.vectors import let

# Multipliers of a published 32-bit integer hash (hash-prospector collection).
MULTIPLIER_1 = 0x21F0AAAD
MULTIPLIER_2 = 0x735A2D97
MASK = 0xFFFFFFFF
TWO_PI = 6.283185307179586


def row_hash(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def key_words(seed: int, ids: tuple[str, ...], label: int) -> str:
    """Struct of the first two 32-bit words of md5 over seed, ids and label."""
    digest = f"md5(concat_ws('|', '{seed}', {', '.join(ids)}, '{label}'))"
    word = "cast(conv(substr(kw_h, {start}, 8), 16, 10) as bigint)"
    return let("kw_h", digest, f"struct({word.format(start=1)} as a, {word.format(start=9)} as b)")


def _mixed(words: str) -> str:
    """Integer finaliser over an array; one pass per step keeps each step's
    input bound to a lambda variable, so nothing is computed twice."""
    once = f"transform({words}, mx_x -> ((mx_x ^ shiftright(mx_x, 16)) * {MULTIPLIER_1}L) & {MASK}L)"
    twice = f"transform({once}, mx_x -> ((mx_x ^ shiftright(mx_x, 15)) * {MULTIPLIER_2}L) & {MASK}L)"
    return f"transform({twice}, mx_x -> mx_x ^ shiftright(mx_x, 15))"


def _uniforms(size: str, key: str, offset: int) -> str:
    """Uniforms of positions offset, offset + 2, offset + 4, ... below ``size`` rounded up to even."""
    pairs = f"sequence(0L, cast((({size}) + 1) div 2 - 1 as bigint))"
    words = f"transform({pairs}, un_p -> ({key}.a + un_p * 2 + {offset}) & {MASK}L)"
    keyed = f"transform({_mixed(words)}, un_x -> un_x ^ {key}.b)"
    return f"transform({_mixed(keyed)}, un_x -> (un_x + 0.5D) / 4294967296D)"


def normals(size: str, key: str) -> str:
    """``size`` standard normal deviates for one key struct, as array<double>."""
    radius = f"transform({_uniforms(size, 'nm_k', 0)}, nm_u -> sqrt(-2D * ln(nm_u)))"
    angle = f"transform({_uniforms(size, 'nm_k', 1)}, nm_u -> {TWO_PI!r}D * nm_u)"
    pairs = f"zip_with({radius}, {angle}, (nm_r, nm_t) -> array(nm_r * cos(nm_t), nm_r * sin(nm_t)))"
    return f"slice(flatten({let('nm_k', key, pairs)}), 1, {size})"


def _mixed_words(x: np.ndarray) -> np.ndarray:
    """The same finaliser; uint32 products wrap where the SQL text masks."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(MULTIPLIER_1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(MULTIPLIER_2)
    x ^= x >> np.uint32(15)
    return x


def normals_flat(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Deviates of many keys, laid end to end: ``sizes[r]`` of them for key r."""
    even = sizes + (sizes & 1)
    starts = np.concatenate(([0], np.cumsum(even)))
    position = np.arange(starts[-1], dtype=np.uint32) - np.repeat(starts[:-1].astype(np.uint32), even)
    words = np.repeat(a.astype(np.uint32), even) + position
    words = _mixed_words(words) ^ np.repeat(b.astype(np.uint32), even)
    uniform = (_mixed_words(words) + 0.5) / 4294967296.0
    pairs = uniform.reshape(-1, 2)
    radius = np.sqrt(-2.0 * np.log(pairs[:, 0]))
    angle = TWO_PI * pairs[:, 1]
    out = np.empty_like(uniform)
    out[0::2] = radius * np.cos(angle)
    out[1::2] = radius * np.sin(angle)
    return out if even.sum() == sizes.sum() else out[position < np.repeat(sizes, even)]
