"""Scratch tables in the shared folder and joins with sides of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import Scratch, hot_rows, join_hot, new_path, stored as materialize  # noqa: F401


def local_path(path: str) -> str:
    """A path for ``open``/``mmap`` of a shared POSIX folder; other file systems need a mount."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped files need a shared folder that is mounted on every machine")
    return path


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df``, marked for broadcast only if it is counted as small enough; it should be cheap to count."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def semi_join(big: DataFrame, keys: DataFrame, key: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``keys``; the keys are broadcast only if they are counted as few enough."""
    return big.join(broadcast_if_small(keys.select(key).distinct(), broadcast_rows), key, "left_semi")


def broadcast_if_light(df: DataFrame, row_bytes, most_bytes: int = 64 << 20) -> DataFrame:
    """``df``, marked for broadcast only if ``row_bytes`` (a column) sums to no more than ``most_bytes``; it should be cheap to scan."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= most_bytes else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a prefix that makes them differ from every column of ``df``."""
    taken, prefix = [c.lower() for c in df.columns], "q_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]


def row_key(id_col: str, text_col: str = "text"):
    """A hash of a row's id and text, for tables whose ids may repeat: equal rows share it, rows of one id with different texts don't."""
    from pyspark.sql import functions as F

    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
