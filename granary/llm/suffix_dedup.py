"""Removal of long byte strings that an earlier document already has: depth-limited radix sort of suffixes.

Every position that starts a string of ``depth`` bytes is a suffix, cut off at that depth.  Equal groups of the
fully sorted suffixes are exactly the repeated windows.  They are found by most-significant-digit passes, where a suffix leaves as soon as
its group is settled:

1. First digit: the smallest hash of the ``gram``-byte substrings of the window (its minimizer).  It depends on the
   window's bytes only, so equal windows share it; and neighbouring windows mostly share theirs, so a run of
   windows moves as one record instead of one for each byte.  Runs alone in their bucket leave here.
2. Second digit: the hash of the whole run.  Runs equal in all bytes are settled together: all but those of the smallest
   document are repeats.  Runs whose bucket holds nothing else leave here.
3. Last digits: the few runs that share a bucket with different runs travel once more, with their bytes, and are
   opened where they meet; their windows are sorted by their bytes, eight a pass, and a window that is alone in its group leaves
   (:func:`radix_groups`).  Windows of crowded buckets travel each on its own instead, so that no bucket grows with the
   input; these are grouped by two independent 64-bit hashes of all their bytes.

Records of equal runs are settled within a chunk of the map task first, so a passage that a third of
all documents share sends a few records from each chunk, not one from each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_POWER = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at once, and runs settled at once; both bound a task's memory.
PIECE = 1 << 19
RUNS = 1 << 19
#: Rows of a batch looked at in one go, and bytes of opened runs sorted at once.
BATCH_ROWS, OPENED_BYTES = 512, 1 << 21
#: A bucket with more different runs than this within one chunk is opened at once.
CROWDED = 64

#: What a record is: a run, a crowded bucket or one of its windows, repeated windows, a run to open.
RUN, CROWD, REPEAT, OPEN = 0, 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of each ``size``-byte substring, put together from substrings of power-of-two sizes."""
    level, n, at, out, mod = buf.astype(np.uint64) + np.uint64(1), 1, 0, None, 1 << 64
    while True:
        if size & n:
            part = level if at == 0 else level[at:]
            m = len(buf) - at - n + 1
            part = part[: max(m, 0)]
            if out is None:
                out = part
            else:
                m = min(len(out), len(part))
                out = out[:m] * np.uint64(pow(_BASE, n, mod)) + part[:m]
            at += n
        if n * 2 > size:
            return _mix(out[: max(0, len(buf) - size + 1)])
        level = level[:-n] * np.uint64(pow(_BASE, n, mod)) + level[n:]
        n *= 2


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def runs_of(buf: np.ndarray, ends: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their minimizer: (minimizer, run hash, first window, windows).

    ``buf`` holds texts one after the other, ``ends`` their ends; no window crosses an end.
    """
    n = len(buf) - depth + 1
    none = np.empty(0, np.uint64)
    if n <= 0:
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    h = _rolling(buf, gram)
    low = _window_min(h, depth - gram + 1)
    valid = np.ones(len(buf) + 1, bool)
    for k in range(1, depth):
        at = ends - k
        valid[at[at >= 0]] = False
    valid[n:] = False
    valid = valid[:n]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= ~valid[:-1]
    start = np.flatnonzero(new & valid)
    if not len(start):
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    stop_at = np.flatnonzero(new | ~valid)
    nxt = np.searchsorted(stop_at, start, side="right")
    stop = np.append(stop_at, n)[nxt]
    powers = np.cumprod(np.full(len(h) + 1, _POWER, np.uint64))
    back = np.uint64(pow(int(_POWER), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)])])
    inverse = np.cumprod(np.full(len(h) + 1, back, np.uint64))[start]
    size = stop - start
    whole = _mix((sums[stop + depth - gram] - sums[start]) * inverse + size.astype(np.uint64))
    return low[start], whole, start, size


def _merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join window runs of a document that touch or overlap."""
    if not len(doc):
        return doc, start, size
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], (start + size)[o]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(first) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * span) - group * span
    cut = first.copy()
    cut[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - start[at]


# A record packs kind, first window and number of windows in one integer, which keeps the shuffle small.
_SCHEMA = "key bigint, whole bigint, doc bigint, at bigint"
_OPENED = "key bigint, whole bigint, doc bigint, at bigint, content binary"
_MARKS = "doc bigint, kind int, start bigint, size bigint, key bigint"


def _records(kind: int, key: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    if len(size) and int(size.max()) > PIECE:
        # Joined repeats can be longer than the field for their size.
        n = -(-size // PIECE)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key, whole, doc, start, size = (np.repeat(x, n) for x in (key, whole, doc, start, size))
        start, size = start + nth * PIECE, np.minimum(PIECE, size - nth * PIECE)
    at = (start << 22) | (size << 2) | kind
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(at)], ["key", "whole", "doc", "at"])


def _marks(kind: int | np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int32), len(doc))
    keys = np.zeros(len(doc), np.int64) if key is None else key.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(kinds), pa.array(start), pa.array(size), pa.array(keys)], ["doc", "kind", "start", "size", "key"])


def settle(key: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, shift: int = 0) -> dict[str, np.ndarray]:
    """Split records into repeats (a smaller document has the same run) and leaders, with the number of different runs in each leader's bucket.

    Documents compare by ``doc >> shift``; all runs of the smallest one lead.
    """
    o = np.lexsort((start, doc, whole, key))
    key, whole, doc, start, size = key[o], whole[o], doc[o], start[o], size[o]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_run = new_key.copy()
    new_run[1:] |= whole[1:] != whole[:-1]
    run_at = np.flatnonzero(new_run)
    least = doc[run_at][np.cumsum(new_run) - 1]
    bucket = np.cumsum(new_key) - 1
    runs = np.add.reduceat(new_run.astype(np.int64), np.flatnonzero(new_key))[bucket]
    return {"key": key, "whole": whole, "doc": doc, "start": start, "size": size, "repeat": (doc >> shift) > (least >> shift), "runs": runs, "first": new_key}


def _doc_key(doc: np.ndarray) -> np.ndarray:
    return _mix(doc.view(np.uint64) + np.uint64(_BASE))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of BATCH_ROWS rows at most: texts take several times their size in Python."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def map_runs(batches: Iterator[pa.RecordBatch], depth: int, gram: int, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """First pass in a map task: (doc_id, text) to records, settled chunk by chunk."""
    held: list[tuple[np.ndarray, ...]] = []
    held_runs = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, held_runs
        if not held:
            return
        s = settle(*(np.concatenate(c) for c in zip(*held)), shift)
        held, held_runs = [], 0
        r = s["repeat"]
        doc, start, size = _merged(s["doc"][r], s["start"][r], s["size"][r])
        zero = np.zeros(len(doc), np.uint64)
        yield _records(REPEAT, _doc_key(doc), zero, doc, start, size)
        crowded = s["runs"] > CROWDED
        a = ~r & ~crowded
        yield _records(RUN, *(s[k][a] for k in ("key", "whole", "doc", "start", "size")))
        a = ~r & crowded
        yield _records(OPEN, _doc_key(s["doc"][a]), s["whole"][a], s["doc"][a], s["start"][a], s["size"][a])
        a = crowded & s["first"]
        yield _records(CROWD, *(s[k][a] for k in ("key", "whole", "doc", "start", "size")))

    def hashed(parts: list[bytes], owner: list[int], offset: list[int]) -> None:
        nonlocal held_runs
        ends = np.cumsum([len(p) for p in parts])
        low, whole, start, size = runs_of(np.frombuffer(b"".join(parts), np.uint8), ends, depth, gram)
        which = np.searchsorted(ends, start, side="right")
        begin = np.concatenate([[0], ends[:-1]])[which]
        held.append((low, whole, np.array(owner, np.int64)[which], start - begin + np.array(offset, np.int64)[which], size))
        held_runs += len(low)

    parts: list[bytes] = []
    owner: list[int] = []
    offset: list[int] = []
    total = 0
    for b in _portions(batches):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text is None or doc is None or len(text) < depth:
                continue
            for at in range(0, len(text) - depth + 1, PIECE):
                parts.append(text[at : at + PIECE + depth - 1])
                owner.append(doc)
                offset.append(at)
                total += len(parts[-1])
                if total >= PIECE:
                    hashed(parts, owner, offset)
                    parts, owner, offset, total = [], [], [], 0
                    if held_runs >= RUNS:
                        yield from flush()
    if parts:
        hashed(parts, owner, offset)
    yield from flush()


def _by_bucket(batches: Iterator[pa.RecordBatch], at_once: int, weight: Callable[[pa.Table], np.ndarray] | None = None) -> Iterator[pa.Table]:
    """Records sorted by key, in portions of whole buckets of a weight of about ``at_once`` (of each record: 1); only the last bucket is held between portions."""
    waiting: list[pa.Table] = []
    held = 0
    for whole in batches:
        step = max(1, whole.num_rows) if weight is None else BATCH_ROWS
        for at in range(0, whole.num_rows, step):
            t = pa.Table.from_batches([whole.slice(at, step)])
            waiting.append(t)
            held += len(t) if weight is None else int(weight(t).sum())
            if held < at_once or t.column(0)[-1] == waiting[0].column(0)[0]:
                continue
            t = pa.concat_tables(waiting)
            key = t.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            waiting = [t.slice(cut)]
            held = len(key) - cut if weight is None else int(weight(waiting[0]).sum())
            if cut:
                yield t.slice(0, cut)
    if waiting:
        yield pa.concat_tables(waiting)


def _unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
    """key, whole, doc, kind, start, size."""
    key, whole, doc, at = (t.column(i).to_numpy() for i in range(4))
    return key.view(np.uint64), whole.view(np.uint64), doc, at & 3, at >> 22, (at >> 2) & ((1 << 20) - 1)


def reduce_runs(batches: Iterator[pa.RecordBatch], shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Second pass: records sorted by key to repeats and runs to open, with their bucket and whether it is crowded."""
    for t in _by_bucket(batches, 200_000):
        key, whole, doc, kind, start, size = _unpacked(t)
        p = kind == REPEAT
        yield _marks(REPEAT, doc[p], start[p], size[p])
        p = kind == OPEN
        yield _marks(CROWD, doc[p], start[p], size[p])
        crowd = np.unique(key[kind == CROWD])
        p = kind == RUN
        if not p.any():
            continue
        s = settle(key[p], whole[p], doc[p], start[p], size[p], shift)
        r = s["repeat"]
        yield _marks(REPEAT, *_merged(s["doc"][r], s["start"][r], s["size"][r]))
        crowded = np.isin(s["key"], crowd)
        o = ~r & ((s["runs"] > 1) | crowded)
        yield _marks(np.where(crowded[o], CROWD, OPEN), s["doc"][o], s["start"][o], s["size"][o], s["key"][o])


def _places(parts: list[bytes], owner: np.ndarray, offset: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """The parts one after the other, and of each of their windows its place there, its part, document and first byte."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size) - size
    count = size - depth + 1
    which = np.repeat(np.arange(len(parts)), count)
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + begin[which]
    return buf, at, which, owner[which], at - begin[which] + offset[which]


def radix_groups(buf: np.ndarray, at: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth-limited radix sort of the windows at ``at``: those that are not alone in their group, in the order of bucket and bytes, and the groups.

    Each pass takes the next eight bytes, most significant first, sorts what is left by group and digit, and lets the windows go
    whose group has become one.  Windows of a group that is left after ``depth`` bytes are equal in all of them.
    """
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(buf) + 1, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(eight)]
    left, group = np.arange(len(at)), np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    for d in range(0, depth, 8):
        digit = eight[at[left] + d] >> np.uint64(8 * max(0, 8 - (depth - d)))
        o = np.lexsort((digit, group))
        left, group, digit = left[o], group[o], digit[o]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        stays = np.bincount(group, minlength=1)[group] > 1
        left, group = left[stays], group[stays]
    return left, group


def repeated_windows(parts: list[bytes], bucket: np.ndarray, owner: np.ndarray, offset: np.ndarray, depth: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, first byte) of the windows that a smaller document of the same bucket has too."""
    buf, at, which, doc, start = _places(parts, owner, offset, depth)
    left, group = radix_groups(buf, at, bucket[which], depth)
    if not len(left):
        return doc[:0], start[:0]
    own = doc[left] >> shift
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(group))))
    return doc[left][own > least], start[left][own > least]


def _windows(parts: list[bytes], owner: np.ndarray, offset: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """One record for each window of the parts: two hashes of its bytes, document, first byte, 1."""
    buf, at, _, doc, start = _places(parts, owner, offset, depth)
    key, h = _rolling(buf, depth)[at], _rolling(buf, gram)
    # The second hash is made of substrings that cover the window.
    whole = h[at]
    for k in [*range(gram, depth - gram, gram), depth - gram]:
        whole = _mix(whole * _M2 + h[at + k])
    return key, whole, doc, start, np.ones(len(at), np.int64)


def map_opened(batches: Iterator[pa.RecordBatch], depth: int, gram: int, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Third pass, in a map task: (doc, text, runs to open) to the runs with their bytes, or the windows of crowded ones."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def with_content(batch: pa.RecordBatch, content: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary())], [*batch.schema.names, "content"])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        s = settle(*(np.concatenate(c) for c in zip(*held)), shift)
        held, rows = [], 0
        r = s["repeat"]
        d, a, n = _merged(s["doc"][r], s["start"][r], s["size"][r])
        for batch in (_records(REPEAT, _doc_key(d), np.zeros(len(d), np.uint64), d, a, n), _records(CROWD, *(s[k][~r] for k in ("key", "whole", "doc", "start", "size")))):
            yield with_content(batch, [None] * batch.num_rows)

    for b in _portions(batches):
        docs, texts, opened = b.column(0).to_pylist(), b.column(1), b.column(2)
        ends = np.concatenate([[0], np.cumsum(opened.value_lengths().to_numpy(zero_copy_only=False))])
        each = opened.flatten()
        start, size, key, kind = (each.field(k).to_numpy(zero_copy_only=False) for k in ("start", "size", "key", "kind"))
        parts: list[bytes] = []
        for i in range(len(docs)):
            text = texts[i].as_py()
            parts += [text[x : x + n + depth - 1] for x, n in zip(start[ends[i] : ends[i + 1]].tolist(), size[ends[i] : ends[i + 1]].tolist())]
        owner = np.repeat(np.array(docs, np.int64), np.diff(ends))
        p = np.flatnonzero(kind == OPEN)
        yield with_content(_records(RUN, key[p].view(np.uint64), np.zeros(len(p), np.uint64), owner[p], start[p], size[p]), [parts[i] for i in p.tolist()])
        todo = np.flatnonzero(kind == CROWD)
        while len(todo):
            # As many runs at once as one piece holds, one at least.
            some = todo[: max(1, int(np.searchsorted(np.cumsum(size[todo] + depth), PIECE)))]
            todo = todo[len(some) :]
            held.append(_windows([parts[i] for i in some.tolist()], owner[some], start[some], depth, gram))
            rows += len(held[-1][0])
            if rows >= RUNS:
                yield from flush()
    if held:
        yield from flush()


def reduce_opened(batches: Iterator[pa.RecordBatch], depth: int, shift: int = 0) -> Iterator[pa.RecordBatch]:
    """Last pass: runs are opened where those of their bucket meet, and their windows sorted by bytes; single windows are grouped by their hashes."""
    for t in _by_bucket(batches, OPENED_BYTES, lambda t: pc.fill_null(pc.binary_length(t.column(4)), 16).to_numpy()):
        key, whole, doc, kind, start, size = _unpacked(t)
        p = kind == REPEAT
        yield _marks(REPEAT, doc[p], start[p], size[p])
        p = kind == CROWD
        if p.any():
            s = settle(key[p], whole[p], doc[p], start[p], size[p], shift)
            r = s["repeat"]
            yield _marks(REPEAT, *_merged(s["doc"][r], s["start"][r], s["size"][r]))
        p = np.flatnonzero(kind == RUN)
        if len(p):
            found, at = repeated_windows(t.column(4).take(pa.array(p)).to_pylist(), key[p], doc[p], start[p], depth, shift)
            yield _marks(REPEAT, *_merged(found, at, np.ones(len(at), np.int64)))


def cut_repeats(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(doc, text, repeated windows) to the removed spans and the bytes that stay."""
    for b in _portions(batches):
        spans, kept = [], []
        for text, runs in zip(b.column(1), b.column(2)):
            data = text.as_py()
            own: list[dict[str, int]] = []
            for start, end in sorted((x["start"], x["start"] + x["size"] + depth - 1) for x in runs.as_py() or ()):
                if own and start <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], end)
                else:
                    own.append({"start": start, "end": end})
            at, left = 0, []
            for x in own:
                left.append(data[at : x["start"]])
                at = x["end"]
            left.append(data[at:])
            spans.append(own)
            kept.append(b"".join(left))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(t) for t in b.column(1).to_pylist()], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc, id, text`` and a shift: rows of equal id and text share ``doc``, ids compare as ``doc >> shift`` do.

    Where ids are unique they are the numbers.  Else different ids, and the different texts of an id, are numbered in order on the cluster: by their place in
    a sorted partition, and the sizes of the partitions before it, of which the driver sees one number each.
    """
    known = docs.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if known.filter("n > 1").isEmpty():
        return docs.select(F.col("id").alias("doc"), "id", "text"), 0
    text = F.xxhash64("text", F.length("text"))

    def places(df: DataFrame, *order: str) -> DataFrame:
        held = materialize(df.distinct().repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "places")
        sizes = sorted((r["p"], r["n"]) for r in held.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())
        before = {p: sum(n for q, n in sizes if q < p) for p, _ in sizes}
        offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.col("p").cast("long")) if before else F.lit(0)
        return held.withColumn("at", F.col("at") + offset).drop("p")

    pairs = places(docs.filter("id IS NOT NULL").select("id", text.alias("h")), "id", "h")
    firsts = pairs.groupBy("id").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ranks = places(firsts.select("id"), "id").withColumnRenamed("at", "rank")
    most, ids = firsts.agg(F.max(F.col("last") - F.col("first")), F.count(F.lit(1))).first()
    shift = max(1, int(most).bit_length())
    if shift + int(ids).bit_length() > 62:
        raise OverflowError("too many rows share an id")
    doc = F.shiftleft("rank", shift).bitwiseOR(F.col("at") - F.col("first"))
    numbers = materialize(pairs.join(firsts, "id").join(ranks, "id").select("id", "h", doc.alias("doc")), "numbers")
    return docs.withColumn("h", text).join(numbers, ["id", "h"], "left").select("doc", "id", "text"), shift


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, gram: int = 16) -> DataFrame:
    """``doc_id, n_bytes, spans: array<struct<start, end>>, kept: binary`` for every row.

    A byte goes if a ``depth``-byte string that covers it also starts in a document with a smaller id; strings are
    judged on the input.  Texts are UTF-8 bytes, null counts as empty, matches never cross documents; texts shorter than ``depth`` stay whole.
    Rows that repeat an id don't take bytes from each other.  Rows with a null id neither take nor lose bytes.
    An empty table gives an empty result; extra columns don't matter.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    base, shift = numbered(base)
    long = base.filter((F.length("text") >= depth) & F.col("doc").isNotNull()).select("doc", "text")

    runs = long.mapInArrow(lambda x: map_runs(x, depth, gram, shift), _SCHEMA).repartition("key").sortWithinPartitions("key")
    marks = materialize(runs.mapInArrow(lambda x: reduce_runs(x, shift), _MARKS), "runs")
    opened = marks.filter(F.col("kind") != REPEAT).groupBy("doc").agg(F.collect_list(F.struct("start", "size", "key", "kind")).alias("runs"))
    again = long.join(opened, "doc").mapInArrow(lambda x: map_opened(x, depth, gram, shift), _OPENED).repartition("key").sortWithinPartitions("key")
    more = materialize(again.mapInArrow(lambda x: reduce_opened(x, depth, shift), _MARKS), "opened")
    found = marks.filter(F.col("kind") == REPEAT).unionByName(more).groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    cut = base.join(found, "doc", "left").select("id", "text", "runs").mapInArrow(lambda x: cut_repeats(x, depth), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return cut.select("doc_id", "n_bytes", "spans", "kept")
