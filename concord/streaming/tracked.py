"""Keyed state over a stream, kept in Spark's own state store: each record's versions are decided in order of their stamps, however they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept for a group of keys: of each key its last version decided; and the versions that wait until no earlier one can come, each with the place of its key.
STATE = "keys array<string>, fingerprints array<string>, revisions array<int>, documents array<array<string>>, last array<bigint>, waiting array<int>, stamps array<bigint>, prints array<string>, gone array<boolean>"
#: Groups of keys. A call of Python and a row of the state store cost the same for one key as for hundreds.
GROUPS = 1024
ITEMS = "record_key string, stamp timestamp, decision string, revision int, documents array<string>, fingerprint string"


def decided(key: str, held: tuple, fingerprint: str | None, removed: bool) -> tuple[str, tuple]:
    """(decision, what is held then) of one version; held is (fingerprint, revision, documents). As state.decide has it without a rule."""
    print_, revision, documents = held
    if removed:
        decision, after = ("reverse", []) if documents else ("skip", documents)
    elif not documents:
        decision, after = "create", [f"{key}-{revision + 1}"]
    elif fingerprint == print_:
        return "skip", held
    else:
        decision, after = "replace", [f"{key}-{revision + 1}"]
    changed = fingerprint != print_ or after != documents
    return decision, (fingerprint, revision + changed, after)


def _versions(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    keys, prints, revisions, documents, last, of, stamps, waiting_prints, gone = state.getOption or [[]] * 9
    held = {k: ((p, r, list(d)), at) for k, p, r, d, at in zip(keys, prints, revisions, documents, last)}
    waiting = {(keys[k], at, p, g) for k, at, p, g in zip(of, stamps, waiting_prints, gone)}  # a version that comes twice is one
    none, out = ((None, 0, []), None), []
    item = lambda key, at, decision, what: out.append((key, at, decision, what[1], what[2], what[0]))
    if not state.hasTimedOut:
        for part in parts:
            for key, at, print_, removed in zip(*(part[c].tolist() for c in ("record_key", "_at", "fingerprint", "removed"))):
                what, decided_at = held.get(key, none)
                if decided_at is not None and at <= decided_at:
                    item(key, at, "late", what)
                else:
                    waiting.add((key, at, print_, bool(removed)))
    now = state.getCurrentWatermarkMs() * 1000
    for key, at, print_, removed in sorted((w for w in waiting if w[1] <= now), key=lambda w: (w[0], w[1], w[2] or "", w[3])):
        decision, what = decided(key, held.get(key, none)[0], print_, removed)
        held[key] = what, at
        item(key, at, decision, what)
    waiting = [w for w in waiting if w[1] > now]
    for w in waiting:
        held.setdefault(w[0], none)
    place = {key: k for k, key in enumerate(held)}
    known = [list(c) for c in zip(*((key, *what, at) for key, (what, at) in held.items()))] or [[]] * 5
    state.update((*known, *([list(c) for c in zip(*((place[key], *rest) for key, *rest in waiting))] or [[]] * 4)))
    if waiting:
        state.setTimeoutTimestamp(max(min(w[1] for w in waiting) // 1000, now // 1000 + 1))
    if out:
        yield pd.DataFrame(out, columns=["record_key", "_at", "decision", "revision", "documents", "fingerprint"])


def tracked_stream(records: DataFrame, wait: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """A stream of decisions (see ITEMS) over a stream of records (record_key, fingerprint, removed, stamp).

    A version waits until the watermark, which is wait behind the latest stamp seen, has passed it; then the versions of a key are decided in order of
    their stamps, so that rows that come out of order give what rows in order give. A version that is not later than one decided is "late" and changes nothing, and
    one that comes twice counts once. What a key holds (fingerprint, revision, documents, waiting versions) is in the query's state store and
    checkpoint, with which a query that is started again goes on. Keys are held in groups by their hash, of which a batch writes those that it touches; a query
    that is started again must have as many groups as before. Rows with a null key or stamp are left out.
    """
    own = records.where("record_key is not null and stamp is not null").select("record_key", "fingerprint", "removed", "stamp").withWatermark("stamp", wait)
    own = own.withColumns({"_at": F.unix_micros(F.col("stamp").cast("timestamp")), "_group": F.pmod(F.xxhash64("record_key"), F.lit(groups))})
    out = own.groupBy("_group").applyInPandasWithState(_versions, ITEMS.replace("stamp timestamp", "_at long"), STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("record_key", F.timestamp_micros("_at").alias("stamp"), "decision", "revision", "documents", "fingerprint")
