"""Draws that depend on the row and a seed only, so that samples survive any partitioning and rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column | str) -> Column:
    """A number below 2^60 from the first 15 hex digits of the MD5 of ``part:…:seed``."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")
