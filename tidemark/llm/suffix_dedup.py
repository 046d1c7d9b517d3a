"""Exact removal of repeated 100-byte windows by a depth-limited, distributed radix sort of suffixes.

Suffixes matter only through their first WINDOW bytes, and equal groups of such windows are exactly the repeats. Sorting
by most significant digits needs a first digit that deals windows out to tasks, and far fewer rows than one a window:

1. First digit. In each window the GRAM-byte string with the least hash (the leftmost of equals) is its anchor. Equal windows have equal
   anchors at equal places. Neighbouring windows share anchors, so one row stands for a run of windows (about 39 on prose).
2. Runs whose windows are all equal (the same bytes from the run's first to its last) need no further digit: all but the
   first such run, by document and start, are removed. Maps do this before the shuffle, so that a passage that a third of
   all documents share reaches its task as one row from each megabyte of input.
3. Where an anchor has different runs, the windows themselves are sorted, eight bytes a pass, groups of one dropping out
   after each pass. What is still in a group after all WINDOW bytes is repeated: all but its first window are removed.
4. A byte is removed if a removed window covers it.

Order is by doc_id and then by start. Rows that repeat a doc_id count as further documents right after it, in the order of their
texts' hashes; null ids come last. A null text counts as empty; texts shorter than a window lose nothing. Runs meet by
64-bit hashes of anchor and bytes; step 3 compares the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed, text_slices, utf8

WINDOW = 100
GRAM = 24
#: Places in a window where an anchor can begin.
PLACES = WINDOW - GRAM + 1
#: Bytes that are hashed together; below 2^20, as places take the 20 low bits of what is minimised.
PIECE = 1_000_000
_PLACE_BITS = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1

_letters = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_power_cache: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _power_cache:
        _power_cache.extend([_powers(_BASE, PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), PIECE + 1)])
    return _power_cache


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts end to end (bounds: where each begins, and the end): text, first window, windows, anchor's place in the first window, anchor hash, hash of the run's bytes and place."""
    n = len(data)
    none = np.zeros(0, np.int64)
    lengths = np.diff(bounds)
    if n < WINDOW or lengths.max(initial=0) < WINDOW:
        return none, none, none, none, none, none
    forth, back = _tables()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters[data] * forth[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * back[: n - GRAM + 1])
    least = (grams & ~_PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
    starts = np.flatnonzero(np.repeat(bounds[1:] - WINDOW, lengths)[: len(least)] >= np.arange(len(least)))
    anchor = (least[starts] & _PLACE_BITS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    at = anchor[new]
    text = np.searchsorted(bounds, first, "right") - 1
    whole = mixed((sums[last + WINDOW] - sums[first]) * back[first] + (at - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return text, first - bounds[text], last - first + 1, at - first, grams[at].view(np.int64), whole.view(np.int64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, copies, offsets, bytes, bounds: texts end to end, up to PIECE bytes; a longer text is cut into parts that overlap by a window less one byte."""
    for part in text_slices(batches, limit=PIECE):
        held: list[tuple[int, int, int, bytes]] = []
        for key, copy, data in zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), utf8(part), strict=True):
            for at in range(0, max(1, len(data) - WINDOW + 1), PIECE - WINDOW + 1):
                held.append((key, copy, at, data[at : at + PIECE]))
        while held:
            n, size = 0, 0
            while n < len(held) and (n == 0 or size + len(held[n][3]) <= PIECE):
                size += len(held[n][3])
                n += 1
            now, held = held[:n], held[n:]
            ids, copies, offsets = (np.array([x[k] for x in now], np.int64) for k in range(3))
            yield ids, copies, offsets, np.frombuffer(b"".join(x[3] for x in now), np.uint8), np.concatenate([[0], np.cumsum([len(x[3]) for x in now])]).astype(np.int64)


_RUN = pa.struct([("doc_id", pa.int64()), ("copy", pa.int32()), ("lo", pa.int64()), ("n", pa.int32())])
_RUNS = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("lo", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("others", pa.list_(_RUN))])
_RUNS_DDL = "anchor bigint, whole bigint, doc_id bigint, copy int, lo bigint, n int, place int, others array<struct<doc_id:bigint,copy:int,lo:bigint,n:int>>"


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, and step 2 within each piece: equal runs' later ones ride along with the first."""
    for ids, copies, offsets, data, bounds in pieces(batches):
        text, lo, n, place, anchor, whole = runs_of(data, bounds)
        if not len(text):
            continue
        doc, copy, lo = ids[text], copies[text], lo + offsets[text]
        order = np.lexsort((lo, copy, doc, whole, anchor))
        doc, copy, lo, n, place, anchor, whole = (x[order] for x in (doc, copy, lo, n, place, anchor, whole))
        lead = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])])
        follow = ~lead
        begins = np.flatnonzero(lead)
        sizes = np.diff(np.concatenate([begins, [len(lead)]])) - 1
        others = pa.StructArray.from_arrays([pa.array(doc[follow]), pa.array(copy[follow], pa.int32()), pa.array(lo[follow]), pa.array(n[follow], pa.int32())], fields=list(_RUN))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), others)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[begins]), pa.array(whole[begins]), pa.array(doc[begins]), pa.array(copy[begins], pa.int32()), pa.array(lo[begins]), pa.array(n[begins], pa.int32()), pa.array(place[begins], pa.int32()), lists.cast(_RUNS.field("others").type)], schema=_RUNS)


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """Batches sorted by column, joined to tables of at least so many rows, if there are as many, that end where a group ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= least:
            keys = batch.column(column).to_numpy()
            last = held[-1].column(column)[-1].as_py()
            differs = np.flatnonzero(keys != last)
            if len(differs):
                if differs[0]:
                    held.append(batch.slice(0, int(differs[0])))
                yield pa.Table.from_batches(held)
                held, rows, batch = [], 0, batch.slice(int(differs[0]))
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


_MARKS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("lo", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("place", pa.int32())])
_MARKS_DDL = "doc_id bigint, copy int, lo bigint, n int, anchor bigint, place int"


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 across pieces. Rows without an anchor are removed runs; rows with one are runs that step 3 must look into."""
    for rows in _whole_groups(batches, "anchor", 100_000):
        anchor, whole, doc, copy, lo, n, place = (rows.column(c).to_numpy() for c in _RUNS.names[:7])
        order = np.lexsort((lo, copy, doc, whole, anchor))
        anchor, whole, doc, copy, lo, n, place = (x[order] for x in (anchor, whole, doc, copy, lo, n, place))
        lead = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])])
        gone = ~lead
        # Of the leads, those whose anchor has another lead.
        kept = np.flatnonzero(lead)
        group = np.cumsum(np.concatenate([[True], anchor[kept][1:] != anchor[kept][:-1]])) - 1
        open_ = kept[np.bincount(group)[group] > 1]
        others = rows.column("others").combine_chunks().flatten()
        removed = [np.concatenate([x[gone], others.field(k).to_numpy()]) for k, x in enumerate((doc, copy, lo, n))]
        m, k = len(removed[0]), len(open_)
        columns = [np.concatenate([r, x[open_]]) for r, x in zip(removed, (doc, copy, lo, n), strict=True)]
        none = np.concatenate([np.ones(m, bool), np.zeros(k, bool)])
        for at in range(0, m + k, 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[cut], f.type) for c, f in zip(columns, _MARKS, strict=False)] + [pa.array(np.concatenate([np.zeros(m, np.int64), x[open_]])[cut], t, mask=none[cut]) for x, t in ((anchor, pa.int64()), (place, pa.int32()))], schema=_MARKS
            )


_CONTEXTS = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("lo", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])
_CONTEXTS_DDL = "anchor bigint, place int, doc_id bigint, copy int, lo bigint, n int, bytes binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that step 3 looks into."""
    for part in text_slices(batches):
        out: dict[str, list] = {c: [] for c in _CONTEXTS.names}
        for key, copy, data, runs in zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), utf8(part), part.column("runs").to_pylist(), strict=True):
            for r in runs:
                for c, v in (("anchor", r["anchor"]), ("place", r["place"]), ("doc_id", key), ("copy", copy), ("lo", r["lo"]), ("n", r["n"]), ("bytes", data[r["lo"] : r["lo"] + r["n"] - 1 + WINDOW])):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _CONTEXTS], schema=_CONTEXTS)


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Numbers of the windows that equal another of their group with a smaller rank: radix passes of eight bytes, most significant first; groups of one leave after each pass."""
    alive = np.arange(len(starts))
    digits = [*range(0, WINDOW - 7, 8)] + ([WINDOW - 8] if WINDOW % 8 else [])
    for pass_, at in enumerate([None, *digits]):
        if not len(alive):
            return alive
        if at is None:
            order = np.argsort(group[alive], kind="stable")
            alive = alive[order]
            now = group[alive]
            new = np.concatenate([[True], now[1:] != now[:-1]])
        else:
            digit = data[(starts[alive] + at)[:, None] + np.arange(8)].view(np.uint64).reshape(-1)
            order = np.lexsort((digit, current))
            alive, now, digit = alive[order], current[order], digit[order]
            new = np.concatenate([[True], (now[1:] != now[:-1]) | (digit[1:] != digit[:-1])])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        alive, current = alive[many], number[many]
    order = np.lexsort((rank[alive], current))
    alive, current = alive[order], current[order]
    return alive[np.concatenate([[False], current[1:] == current[:-1]])] if len(alive) else alive


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 for whole groups of an anchor; neighbouring removed windows come out as one run."""
    for rows in _whole_groups(batches, "anchor", 4_000):
        anchor, place, doc, copy, lo, n = (rows.column(c).to_numpy() for c in _CONTEXTS.names[:6])
        column = rows.column("bytes").combine_chunks()
        text = b"".join(column.to_pylist())
        begins = np.concatenate([[0], np.cumsum(n.astype(np.int64) - 1 + WINDOW)[:-1]])
        run = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((lo, copy, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Windows are equal only if their anchors are at equal places.
        _, name = np.unique(anchor, return_inverse=True)
        group = name.reshape(-1)[run] * (2 * WINDOW) + (place[run] - step) + WINDOW
        gone = np.sort(repeated_windows(np.frombuffer(text, np.uint8), begins[run] + step, group, rank[run] * (1 << 20) + step))
        if not len(gone):
            continue
        new = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (run[gone[1:]] != run[gone[:-1]])]))
        first, count = gone[new], np.diff(np.concatenate([new, [len(gone)]]))
        r = run[first]
        none = np.ones(len(r), bool)
        yield pa.RecordBatch.from_arrays([pa.array(doc[r], pa.int64()), pa.array(copy[r], pa.int32()), pa.array(lo[r] + step[first], pa.int64()), pa.array(count, pa.int32()), pa.array(r, pa.int64(), mask=none), pa.array(r, pa.int32(), mask=none)], schema=_MARKS)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_KEPT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def merged(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal removed runs of bytes that windows lo .. lo + n - 1 cover."""
    if not len(lo):
        return lo, lo
    order = np.argsort(lo, kind="stable")
    begin, end = lo[order], np.maximum.accumulate((lo + n - 1 + WINDOW)[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return begin[new], end[np.concatenate([new[1:], [len(end)]]) - 1]


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        out: dict[str, list] = {c: [] for c in _KEPT.names}
        runs = part.column("runs")
        for i, (key, data) in enumerate(zip(part.column("doc_id").to_pylist(), utf8(part), strict=True)):
            own = runs[i].values
            lo, n = (own.field(k).to_numpy().astype(np.int64) for k in (0, 1)) if own is not None else (np.zeros(0, np.int64),) * 2
            begin, end = merged(lo, n)
            spans = list(zip(begin.tolist(), end.tolist(), strict=True))
            at, kept = 0, []
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            for c, v in (("doc_id", key), ("n_bytes", len(data)), ("n_removed", int((end - begin).sum())), ("n_spans", len(spans)), ("spans", [{"start": a, "end": b} for a, b in spans]), ("kept", b"".join(kept))):
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _KEPT], schema=_KEPT)


_LAST = (1 << 63) - 1


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed bytes, end exclusive) and kept (the remaining bytes), one row for each row of docs."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc_id"), "text")
    # Ids are compared by count first, without their texts.
    if texts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))).cast("int"))
    else:
        texts = texts.withColumn("copy", F.lit(0))
    runs = texts.mapInArrow(_find_runs, _RUNS_DDL)
    marks = checkpointed(runs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_settle_runs, _MARKS_DDL))
    open_ = marks.where("anchor is not null").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("lo", "n", "anchor", "place")).alias("runs"))
    contexts = texts.join(open_.hint("shuffle_hash"), ["doc_id", "copy"]).select("doc_id", "copy", "text", "runs").mapInArrow(_cut_contexts, _CONTEXTS_DDL)
    more = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_windows, _MARKS_DDL)
    every = marks.where("anchor is null").unionByName(more).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    kept = texts.join(every.hint("shuffle_hash"), ["doc_id", "copy"], "left").select("doc_id", "text", "runs").mapInArrow(_cut_texts, _KEPT_DDL)
    return kept.withColumn("doc_id", F.when(F.col("doc_id") == _LAST, F.lit(None)).otherwise(F.col("doc_id")))


def repeats_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """What repeats_digest() must give, by a set of all windows; for tests."""
    seen: set[bytes] = set()
    out = {}
    for key, data in sorted(texts):
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - WINDOW + 1):
            w = data[i : i + WINDOW]
            if w in seen:
                gone[i : i + WINDOW] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out[key] = (len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest())
    return out
