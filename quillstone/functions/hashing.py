"""Hashes and cuts that need bytes: Arrow functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def xxh64_hex(values: pa.Array) -> pa.Array:
    """XXH64 with seed 0 of the UTF-8 bytes, as 16 lower-case digits."""
    import xxhash

    return pa.array([None if v is None else xxhash.xxh64_hexdigest(v) for v in values.cast(pa.binary()).to_pylist()], pa.string())


def cut_bytes(text: str | None, most: int) -> str | None:
    """The longest beginning of at most `most` bytes that ends between characters."""
    if text is None:
        return None
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def truncate_utf8(most: int):
    @F.arrow_udf("string")
    def cut(values: pa.Array) -> pa.Array:
        return pa.array([cut_bytes(v, most) for v in values.to_pylist()], pa.string())

    return cut
