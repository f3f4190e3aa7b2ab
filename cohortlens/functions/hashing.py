"""Row hashes for sampling and splitting that do not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 52)


def unit_hash(key: Sequence[str], salt: str, method: str = "xxhash64") -> Column:
    """A number in [0, 1) that depends only on the key columns and the salt.

    ``xxhash64`` is the fast choice; ``md5`` gives the same number in any other engine.
    """
    if method == "xxhash64":
        h = F.xxhash64(F.lit(salt), *[F.col(k) for k in key])
        return F.shiftrightunsigned(h, 12).cast("double") / F.lit(_SPAN)
    if method == "md5":
        joined = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in key])
        digits = F.substring(F.md5(joined), 1, 13)
        return F.conv(digits, 16, 10).cast("double") / F.lit(_SPAN)
    raise ValueError(f"unknown hash method: {method!r}")
