"""State over streams of scans and signals: whether a tree changed since its last sweep, and signals that outlive their time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

_SCAN = "root string, scanned timestamp, newest timestamp, unreadable boolean"


def _summed(batches):
    """A row for each scan of a root in a task's rows, so that a root of very many files is few rows where its state is."""
    for pdf in batches:
        g = pdf.groupby(["root", "scanned"], sort=False)
        out = g["modified"].max().rename("newest").reset_index()
        out["unreadable"] = g["modified"].apply(lambda m: bool(m.isna().any())).to_numpy() if len(out) else []
        yield out[["root", "scanned", "newest", "unreadable"]]


def probe(scans: DataFrame, own: str = ".kb/", delay: str = "1 hour") -> DataFrame:
    """(root, scanned, changed) for each scan in a stream of (root, path, modified, scanned), a row a file seen.

    A tree changed if a file is newer than the scan that last found a change; its first scan counts as one, and so does a file
    whose time cannot be read (null): better one sweep too many. What lies below `own` does not count. Scans of one batch
    are taken in order of time; one that comes later than `delay` behind the newest is left out, one that is older than the
    root's last sweep finds nothing new unless a file says so. State is a time for each root.
    """
    seen = scans.withColumn("modified", F.when(F.col("path").startswith(own), F.lit("1970-01-01 00:00:00").cast("timestamp")).otherwise(F.col("modified")))
    rows = seen.select("root", "scanned", "modified").mapInPandas(_summed, _SCAN).withWatermark("scanned", delay)

    def step(key, chunks, state):
        scan: dict = {}
        for pdf in chunks:
            for at, newest, bad in zip(pdf["scanned"], pdf["newest"], pdf["unreadable"], strict=True):
                best, any_ = scan.get(at, (pd.NaT, False))
                scan[at] = (newest if pd.isna(best) or newest > best else best, any_ or bool(bad))
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for at in sorted(scan):
            newest, bad = scan[at]
            changed = last is None or bad or (not pd.isna(newest) and newest > last)
            if changed and (last is None or at > last):
                last = at
            out.append((key[0], at, changed))
        state.update((int(last.value // 1000),))
        yield pd.DataFrame(out, columns=["root", "scanned", "changed"])

    return rows.groupBy("root").applyInPandasWithState(step, "root string, scanned timestamp, changed boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def expiring(signals: DataFrame, ttl_hours: float = 72, delay: str = "1 hour") -> DataFrame:
    """(directory, created, why) of signals that run out, from a stream of (directory, created, deleted, seen).

    The last row of a directory by `seen` counts: it starts its time anew, or ends it where it is deleted. A signal expires once
    the stream's time (the newest `seen`, less delay) is ttl_hours past its creation; one without a readable time at once.
    State is a row for each directory with a signal, held by a timer; nothing is read again.
    """
    rows = signals.select("directory", "created", F.coalesce("deleted", F.lit(False)).alias("deleted"), "seen").withWatermark("seen", delay)
    ttl = int(ttl_hours * 3_600_000)
    columns = ["directory", "created", "why"]

    def step(key, chunks, state):
        if state.hasTimedOut:
            created = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(created, unit="ms"), "expired")], columns=columns)
            return
        last = None
        for pdf in chunks:
            for seen, created, deleted in zip(pdf["seen"], pdf["created"], pdf["deleted"], strict=True):
                if last is None or seen >= last[0]:
                    last = (seen, created, deleted)
        seen, created, deleted = last
        if deleted or pd.isna(created):
            if state.exists:
                state.remove()
            yield pd.DataFrame([] if deleted else [(key[0], pd.NaT, "unreadable")], columns=columns)
            return
        at = int(created.value // 1_000_000)
        if at + ttl <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], created, "expired")], columns=columns)
            return
        state.update((at,))
        state.setTimeoutTimestamp(at + ttl)
        yield pd.DataFrame([], columns=columns)

    return rows.groupBy("directory").applyInPandasWithState(step, "directory string, created timestamp, why string", "created long", "append", GroupStateTimeout.EventTimeTimeout)
