"""Random numbers that depend on row identity and seed only.

``rand()`` depends on the partition a row happens to sit in; a re-run on another
cluster or a retried task gives other numbers. Here every draw is a digest of (seed, id,
draw number), computed inside the JVM, and plain SQL can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

HEX_DIGITS = 12
SPACE = 16**HEX_DIGITS


def mix(*parts: Column | int, seed: int) -> Column:
    """An integer in [0, 2^48) drawn from integer parts."""
    cols = [F.lit(str(seed)), *[F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts]]
    digest = F.md5(F.concat_ws("-", *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(*parts: Column | int, seed: int) -> Column:
    return mix(*parts, seed=seed) / F.lit(float(SPACE))


def below(n: int, *parts: Column | int, seed: int) -> Column:
    """An integer in [0, n)."""
    return mix(*parts, seed=seed) % F.lit(n).cast("bigint")


def gaussian(*parts: Column | int, seed: int) -> Column:
    """A standard normal draw (Box-Muller on two uniforms)."""
    u = uniform(*parts, 1, seed=seed)
    v = uniform(*parts, 2, seed=seed)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(v * (2 * math.pi))


def weighted_pick(draw: Column, choices: dict) -> Column:
    """Pick a value from ``{value: probability}`` by cumulative probability."""
    *early, last = choices
    out, edge = None, 0.0
    for value in early:
        edge += choices[value]
        out = (F if out is None else out).when(draw < edge, F.lit(value))
    return F.lit(last) if out is None else out.otherwise(F.lit(last))


def mix_sql(*parts: str, seed: int) -> str:
    """The SQL text of :func:`mix`, for oracles."""
    return f"CAST(('0x' || substr(md5(concat_ws('-', {', '.join([str(seed), *parts])})), 1, {HEX_DIGITS})) AS BIGINT)"


def uniform_sql(*parts: str, seed: int) -> str:
    return f"({mix_sql(*parts, seed=seed)} / CAST({SPACE} AS DOUBLE))"


def gaussian_sql(*parts: str, seed: int) -> str:
    u = uniform_sql(*parts, "1", seed=seed)
    v = uniform_sql(*parts, "2", seed=seed)
    return f"(sqrt(-2.0 * ln(1.0 - {u})) * cos({v} * {2 * math.pi!r}))"
