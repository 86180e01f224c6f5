"""Shared plumbing: cutting lineage, streaming sorted groups, Arrow batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder of the session: as set, else that of ``spark.checkpoint.dir``.

    Where neither is set, a temporary folder serves a session on one machine (tests); on a cluster it raises, as
    executors would not see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def sorted_groups(
    frames: Iterator[pd.DataFrame], keys: list[str], smallest: int = 1
) -> Iterator[pd.DataFrame]:
    """Groups of equal ``keys`` from frames that arrive sorted by them; groups under ``smallest`` rows are skipped.

    Holds one frame and one group at a time, so the caller bounds memory by bounding its groups.
    """
    held: list[pd.DataFrame] = []  # the group that may go on, joined once it has ended
    rows = 0
    last = None
    for frame in frames:
        if not len(frame):
            continue
        new = np.ones(len(frame), dtype=bool)
        new[0] = last is None or any(frame[key].iat[0] != last[key] for key in keys)
        new[1:] = False
        for key in keys:
            column = frame[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        bounds = [0, *starts.tolist(), len(frame)] if not new[0] else [*starts.tolist(), len(frame)]
        for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if (i or new[0]) and held:
                if rows >= smallest:
                    yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held, rows = [], 0
            if i < len(bounds) - 2 and not held:
                if high - low >= smallest:
                    yield frame.iloc[low:high]
                continue
            held.append(frame.iloc[low:high])
            rows += high - low
        last = {key: frame[key].iat[-1] for key in keys}
    if held and rows >= smallest:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def spanning_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph whose boolean adjacency matrix is ``linked``."""
    n = len(linked)
    unseen = np.ones(n, dtype=bool)
    edges = []
    for start in range(n):
        if not unseen[start]:
            continue
        unseen[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            found = np.flatnonzero(linked[i] & unseen)
            if len(found):
                unseen[found] = False
                edges += [(i, int(j)) for j in found]
                stack += found.tolist()
    return edges


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that other executors must read, in the cluster's shared folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, compressed, safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
