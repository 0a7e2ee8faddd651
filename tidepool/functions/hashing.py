"""Uniform numbers from hashes, so that splits and samples are the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_uniform(seed: int | str, group: Column | str, key: Column) -> Column:
    """In [0, 1): the first four bytes, little-endian, of md5("seed|group|key"), over 2**32."""
    group = F.lit(group) if isinstance(group, str) else group
    m = F.md5(F.concat_ws("|", F.lit(str(seed)), group, key.cast("string")).cast("binary"))
    word = F.concat(*(F.substring(m, k, 2) for k in (7, 5, 3, 1)))
    return F.conv(word, 16, 10).cast("double") / F.lit(4294967296.0)
