"""Column functions: reproducible uniforms, exact ceilings, divergences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, step: int, tag: str, *keys: Column) -> Column:
    """In [0, 1), from the md5 of seed, step, tag and keys; the same in any engine and on any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), F.lit(tag), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ceil3(a: Column, b: int) -> Column:
    """a / b rounded up to thousandths, in integers; 0 where b is 0."""
    if not b:
        return F.lit(0.0)
    return F.floor((a.cast("long") * 1000 + (b - 1)) / F.lit(b).cast("decimal(20,0)")).cast("double") / 1000.0


def entropy_term(p: Column, q: Column) -> Column:
    """p ln(p / q), 0 where p is 0."""
    return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
