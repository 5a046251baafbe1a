"""Removal of repeated byte strings with a Burrows-Wheeler transform, bounded by a least length.

A byte goes if some string of LENGTH bytes over it also starts in a document with a smaller id.

1. Every window of LENGTH bytes names an anchor, the least of its 20-byte strings by hash; equal
   windows name equal anchors. Consecutive windows with one anchor are a segment (about 65 bytes).
   Segments are dealt to buckets by anchor, so all places of a string meet, as packed columns.
2. In a bucket, segments equal to one of a smaller document go whole (pre-aggregation of copies).
   Of anchors with different segments, one copy of each segment is fetched from its document. An anchor
   of more than HOT different segments (a common string in many surroundings) does not stay together:
   its windows are dealt anew by the anchor and CONTEXT bytes after it, or before it where a window has
   fewer after it, so that equal windows still meet, but not all surroundings. An anchor of more than
   HOTTEST different segments may lie in a longer string that is as common. Its windows are dealt one by
   one, by all their LENGTH bytes, and compared as bytes; a task sends one copy of each. So what is
   indexed together for the sake of one anchor has a fixed bound.
3. All other segments are joined to one text and indexed: suffixes are sorted to a depth of 64 by
   doubling, which gives the Burrows-Wheeler transform. Common prefixes follow by increasing value:
   starting from the boundaries between first letters, each step extends all intervals backwards by
   one letter through the transform, which sets exactly the boundaries with the next value, and
   stops at LENGTH. Boundaries not set by then lie between suffixes with LENGTH bytes in common, so
   what is left are the intervals of equal windows; the smallest document of each decides.
4. Each document's spans are merged and cut from its bytes.

Texts travel once, dealt by document; both steps that need them share that exchange. A hot anchor
costs a bucket one row (some 30 bytes) per task and distinct segment, not one per document, as tasks drop copies of
a segment before sending. Numbers of buckets follow the input's size.

Segments count as equal if 96 bits of hash of their bytes and anchor agree.

Edge cases: null text counts as empty; texts shorter than LENGTH keep all bytes; rows with a null
id remove nothing and lose nothing; rows with one id do not remove each other's bytes, whether their
texts are equal or not; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import utf8, write_shared
from lexiloom.llm.hashing import Rolling, sliding_least, window_hashes

LENGTH, ANCHOR = 50, 20
DEPTH = 64
#: Different segments of an anchor that are indexed together, and the bytes by which those of others are dealt.
HOT, CONTEXT = 512, 15
#: Different segments of an anchor beyond which its windows are dealt one by one.
HOTTEST = 16 * HOT
#: Bytes of text for each bucket up to 1 GB of input; beyond, buckets grow with its cube root, so that pieces stay of useful size.
BUCKET_BYTES = 4 << 20
#: Bytes hashed at once (a longer text is cut into overlapping pieces), and bytes whose segments are sent together.
PIECE, BATCH = 1 << 20, 8 << 20
_BLOB = "kind int, place long, data binary"
SEGMENTS, SPANS, NEEDS, TEXTS, WINDOWS = 0, 1, 2, 3, 4
#: In place of a bucket: the segment's windows are dealt by their surroundings, or one by one.
BY_CONTEXT, BY_WINDOW = -1, -2


# ---- packed columns


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    table = pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blobs) -> dict[str, np.ndarray]:
    """All rows of packed tables of one kind."""
    tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
    whole = pa.concat_tables(tables)
    return {c: whole.column(c).to_numpy() if c != "bytes" else whole.column(c) for c in whole.column_names}


def _dealt(kind: int, place: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Rows of (kind, place, packed columns), one for each place."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    place = place[order]
    cuts = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
    columns = {k: v[order] for k, v in columns.items()}
    for a, b in zip(cuts, [*cuts[1:], len(place)]):
        yield kind, int(place[a]), _pack({k: v[a:b] for k, v in columns.items()})


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, places, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array(data, pa.binary())], ["kind", "place", "data"])


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


# ---- segments


def segments(raws: list[bytes]) -> dict[str, np.ndarray]:
    """All segments of texts: text number, start, number of windows, anchor hash, content hash."""
    out: dict[str, list] = {k: [] for k in ("text", "start", "windows", "anchor", "content")}
    todo: list[tuple[int, int, bytes]] = []
    waiting = 0

    def flush() -> None:
        if not todo:
            return
        data = np.frombuffer(b"".join(p for _, _, p in todo), np.uint8)
        sizes = np.array([len(p) for _, _, p in todo])
        ends = np.cumsum(sizes)
        rolling = Rolling(data)
        hashes = window_hashes(rolling, ANCHOR)
        low = np.uint64((1 << 24) - 1)
        least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), LENGTH - ANCHOR + 1)
        anchors = (least & low).astype(np.int32)
        piece = np.repeat(np.arange(len(todo), dtype=np.int32), sizes)[: len(anchors)]
        windows = np.flatnonzero(np.arange(len(anchors)) + LENGTH <= ends[piece])
        first = np.flatnonzero((np.diff(anchors[windows], prepend=-1) != 0) | (np.diff(piece[windows], prepend=-1) != 0))
        counts = np.diff(first, append=len(windows))
        start = windows[first]
        of = piece[start]
        offset = np.array([o for _, o, _ in todo]) - (ends - sizes)
        out["text"].append(np.array([i for i, _, _ in todo], np.int64)[of])
        out["start"].append(start + offset[of])
        out["windows"].append(counts.astype(np.uint8))
        out["anchor"].append(hashes[anchors[start]])
        out["content"].append(rolling.of(start, start + counts + LENGTH - 1))
        todo.clear()

    for i, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
            part = raw[at : at + PIECE + LENGTH - 1] if len(raw) > PIECE else raw
            todo.append((i, at, part))
            waiting += len(part)
            if waiting >= PIECE:
                flush()
                waiting = 0
    flush()
    kinds = {"text": np.int64, "start": np.int64, "windows": np.uint8, "anchor": np.uint64, "content": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


def _place(ids: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    """The place of a document among n."""
    return (ids ^ tags) % np.int64(n)


def _first_of_groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows, in sorted order, begin a group of equal keys."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return new


def _known(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows by (anchor, content, id); returns the order and, in it, whether a smaller id has the same segment."""
    order = np.lexsort((rows["id"], rows["content"], rows["anchor"]))
    new = _first_of_groups(order, rows["anchor"], rows["content"])
    least = rows["id"][order][new][np.cumsum(new) - 1]
    return order, rows["id"][order] > least


def _spans_of(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"id": rows["id"], "tag": rows["tag"], "start": rows["start"], "end": rows["start"] + rows["windows"] + LENGTH - 1}


def _cut(n: int):
    """Texts (id, tag, raw) to packed segments by bucket, and spans that copies in the same task already settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, raws, waiting = [], [], [], 0

        def send() -> pa.RecordBatch:
            found = segments(raws)
            text = found.pop("text")
            rows = found | {"id": np.array(ids, np.int64)[text], "tag": np.array(tags, np.int64)[text]}
            order, known = _known(rows)
            rows = {k: v[order] for k, v in rows.items()}
            gone, kept = ({k: v[m] for k, v in rows.items()} for m in (known, ~known))
            place = (kept["anchor"] % np.uint64(n)).astype(np.int64)
            again = np.lexsort((kept["start"], kept["id"]))
            kept = {k: v[again] for k, v in kept.items()}
            kept["anchor"] = (kept["anchor"] >> np.uint64(32)).astype(np.uint32)
            out = list(_dealt(SEGMENTS, place[again], kept))
            spans = _spans_of(gone)
            out += _dealt(SPANS, _place(spans["id"], spans["tag"], n), spans)
            return _batch(out)

        for batch in batches:
            for i, tag, raw in zip(*(batch.column(k) for k in range(3))):
                raw = raw.as_py()
                ids.append(i.as_py())
                tags.append(tag.as_py())
                raws.append(raw)
                waiting += len(raw)
                if waiting >= BATCH:
                    yield send()
                    ids, tags, raws, waiting = [], [], [], 0
        if raws:
            yield send()

    return run


def _settle(n: int):
    """A bucket's segments to spans of copies and needs for the index; spans pass."""

    def run(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())
        data = table.column("data")
        out = [(SPANS, table.column("place")[int(i)].as_py(), data[int(i)].as_py()) for i in np.flatnonzero(kinds == SPANS)]
        mine = np.flatnonzero(kinds == SEGMENTS)
        if len(mine):
            rows = _unpack(data[int(i)].as_py() for i in mine)
            order, known = _known(rows)
            rows = {k: v[order] for k, v in rows.items()}
            everything = np.arange(len(order))
            by_anchor = _first_of_groups(everything, rows["anchor"])
            group = np.cumsum(by_anchor) - 1
            contents = np.bincount(group, _first_of_groups(everything, rows["anchor"], rows["content"]))
            starts = np.flatnonzero(by_anchor)
            shared = np.minimum.reduceat(rows["id"], starts) < np.maximum.reduceat(rows["id"], starts)
            index = ~known & ((contents > 1) & shared)[group]
            different = contents[group][index]
            spans = _spans_of({k: v[known] for k, v in rows.items()})
            out += _dealt(SPANS, _place(spans["id"], spans["tag"], n), spans)
            needs = {k: rows[k][index] for k in ("id", "tag", "start", "windows")}
            bucket = table.column("bucket")[0].as_py()
            needs["bucket"] = np.select([different > HOTTEST, different > HOT], [BY_WINDOW, BY_CONTEXT], bucket).astype(np.int64)
            out += _dealt(NEEDS, _place(needs["id"], needs["tag"], n), needs)
        return _table(out)

    return run


def _halves(rows: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Deals the segments of hot anchors by what surrounds the anchor: their windows with CONTEXT bytes after it, and the others."""
    hot = np.flatnonzero(rows["bucket"] == BY_CONTEXT)
    if not len(hot):
        return rows
    parts: dict[str, list] = {k: [] for k in rows}
    for i in hot.tolist():
        raw, windows = rows["bytes"][i], int(rows["windows"][i])
        hashes = window_hashes(Rolling(np.frombuffer(raw, np.uint8)), ANCHOR)
        at = int((hashes >> np.uint64(24)).argmin())  # as segments() chose it
        cut = min(max(0, at - CONTEXT), windows)
        for side, first, last in ((b"before", 0, cut), (b"after", cut, windows)):
            if first < last:
                near = raw[at - CONTEXT : at + ANCHOR] if side == b"before" else raw[at : at + ANCHOR + CONTEXT]
                bucket = int.from_bytes(hashlib.blake2b(near, digest_size=7, person=side).digest(), "little") % n
                for k, x in (("id", rows["id"][i]), ("tag", rows["tag"][i]), ("start", rows["start"][i] + first), ("windows", last - first), ("bucket", bucket), ("bytes", raw[first : last + LENGTH - 1])):
                    parts[k].append(x)
    cold = np.flatnonzero(rows["bucket"] >= 0)
    return {k: np.concatenate([v[cold], np.array(parts[k], v.dtype)]) for k, v in rows.items()}


def _runs(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of windows, consecutive ones together."""
    order = np.lexsort((rows["start"], rows["tag"], rows["id"]))
    new = _first_of_groups(order, rows["id"], rows["tag"])
    start = rows["start"][order]
    new[1:] |= start[1:] != start[:-1] + 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order))[: len(first)] - 1
    return {"id": rows["id"][order][first], "tag": rows["tag"][order][first], "start": start[first], "end": start[last] + LENGTH}


def _one_by_one(rows: dict[str, np.ndarray], n: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The windows of segments, with their buckets, one copy of each; and the spans of those that a smaller document here has."""
    data = np.frombuffer(b"".join(rows["bytes"].tolist()), np.uint8)
    windows = rows["windows"].astype(np.int64)
    begins = np.cumsum(windows + LENGTH - 1) - windows - LENGTH + 1
    row = np.repeat(np.arange(len(windows)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[row] + offset
    hashes = window_hashes(Rolling(data), LENGTH)[at]
    order = np.lexsort((rows["id"][row], hashes))
    row, offset, at, hashes = row[order], offset[order], at[order], hashes[order]
    content = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    new = np.diff(hashes, prepend=~hashes[:1]) != 0
    same = np.flatnonzero(~new)
    new[same] = (content[at[same]] != content[at[same - 1]]).any(1)
    found = {"id": rows["id"][row], "tag": rows["tag"][row], "start": rows["start"][row] + offset}
    gone = found["id"] > found["id"][new][np.cumsum(new) - 1]
    kept = {k: v[~gone] for k, v in found.items()} | {"bucket": (hashes[~gone] % np.uint64(n)).astype(np.int64)}
    kept["bytes"] = np.ascontiguousarray(content[at[~gone]]).view(f"V{LENGTH}").ravel()
    return kept, _runs({k: v[gone] for k, v in found.items()})


def _fetch(n: int):
    """Takes the needed segments' bytes from the texts of one place."""

    def run(texts: pa.Table, needs: pa.Table) -> pa.Table:
        return _fetched(texts, needs, n)

    return run


def _fetched(texts: pa.Table, needs: pa.Table, n: int) -> pa.Table:
    if not texts.num_rows or not needs.num_rows:
        return _table([])
    rows = _unpack(x.as_py() for x in needs.column("data"))
    order = np.lexsort((rows["start"], rows["tag"], rows["id"]))
    rows = {k: v[order] for k, v in rows.items()}
    new = np.flatnonzero(_first_of_groups(np.arange(len(order)), rows["id"], rows["tag"]))
    at = {(int(rows["id"][a]), int(rows["tag"][a])): (a, b) for a, b in zip(new, [*new[1:], len(order)])}
    chosen, parts = [], []
    for i, tag, raw in zip(*(texts.column(c) for c in ("id", "tag", "raw"))):
        span = at.pop((i.as_py(), tag.as_py()), None)
        if span:
            raw = raw.as_py()
            chosen.append(np.arange(*span))
            for s, w in zip(rows["start"][slice(*span)].tolist(), rows["windows"][slice(*span)].tolist()):
                parts.append(raw[s : s + w + LENGTH - 1])
    if not chosen:
        return _table([])
    chosen = np.concatenate(chosen)
    held = np.empty(len(parts), object)
    held[:] = parts
    rows = {k: v[chosen] for k, v in rows.items()} | {"bytes": held}
    out = []
    single = rows["bucket"] == BY_WINDOW
    if single.any():
        windows, spans = _one_by_one({k: v[single] for k, v in rows.items()}, n)
        windows["bytes"] = np.array(windows["bytes"].tolist(), object)
        out += _dealt(WINDOWS, windows.pop("bucket"), windows)
        out += _dealt(SPANS, _place(spans["id"], spans["tag"], n), spans)
    rows = _halves({k: v[~single] for k, v in rows.items()}, n)
    out += _dealt(TEXTS, rows.pop("bucket"), rows)
    return _table(out)


# ---- the index


def bounded_suffixes(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Rotations sorted by their first `depth` bytes (a power of 2, at least 8), ties by position."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.roll(text, -k)
    have = 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0).astype(np.uint64)
        if have >= depth:
            return order
        key = rank << np.uint64(32) | np.roll(rank, -have)
        have *= 2


def equal_windows(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of the text in order, and the number of each one's interval of equal first `length` bytes.

    Row j's letter of the transform is the one before order[j]; entry j of the prefix table lies between rows j-1
    and j. If both rows begin with letter c, they are the backward extensions by c of two rows p < q whose letter is
    c, with no such row between, and their common prefix is one more than the least entry in (p, q]. So the entries
    of value l + 1 are those, not yet set, whose (p, q] holds an entry of value l.
    """
    n = len(text)
    order = bounded_suffixes(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    transform = text[order - 1]
    row_of = np.empty(n, np.int64)  # which row's backward extension each row is
    row_of[rank[order - 1]] = np.arange(n)
    letters = transform[row_of]
    closed = np.ones(n, bool)
    closed[1:] = letters[1:] != letters[:-1]
    todo = np.flatnonzero(~closed)
    low, high = np.minimum(row_of[todo - 1], row_of[todo]), np.maximum(row_of[todo - 1], row_of[todo])
    for _ in range(1, length):
        count = np.cumsum(closed, dtype=np.int32)
        found = count[high] > count[low]
        if not found.any():
            break
        closed[todo[found]] = True
        rest = ~found
        todo, low, high = todo[rest], low[rest], high[rest]
    return order, np.cumsum(closed) - 1


def _equal(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of windows, all of LENGTH bytes, that a smaller document has."""
    content = rows.pop("bytes").combine_chunks().dictionary_encode().indices.to_numpy()
    least = np.full(content.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, content, rows["id"])
    gone = rows["id"] > least[content]
    return _runs({k: v[gone] for k, v in rows.items()})


def _index(n: int):
    """A bucket's segments and windows to spans: what a smaller document has; spans pass."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        places, data = table.column("place"), table.column("data")
        of = lambda kind: np.flatnonzero(kinds == kind).tolist()
        out = [(SPANS, places[i].as_py(), data[i].as_py()) for i in of(SPANS)]
        if of(WINDOWS):
            spans = _equal(_unpack(data[i].as_py() for i in of(WINDOWS)))
            out += _dealt(SPANS, _place(spans["id"], spans["tag"], n), spans)
        if of(TEXTS):
            spans = indexed(_unpack(data[i].as_py() for i in of(TEXTS)))
            out += _dealt(SPANS, _place(spans["id"], spans["tag"], n), spans)
        return _table(out)

    def indexed(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        numbers: dict[bytes, int] = {}
        content = np.array([numbers.setdefault(x, len(numbers)) for x in rows.pop("bytes").to_pylist()], np.int64)
        parts = list(numbers)
        sizes = np.array([len(x) for x in parts])
        ids = np.full(len(parts), np.iinfo(np.int64).max)
        np.minimum.at(ids, content, rows["id"])
        # Parts of segments that differ may be equal: all but the smallest document's go whole.
        again = rows["id"] > ids[content]
        whole = {k: rows[k][again] for k in ("id", "tag", "start")} | {"end": (rows["start"] + sizes[content])[again]}
        rows, content = {k: v[~again] for k, v in rows.items()}, content[~again]
        text = np.frombuffer(b"\0".join(parts), np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        order, interval = equal_windows(text)
        owner = np.repeat(np.arange(len(parts)), sizes + 1)[: len(text)]
        place = np.arange(len(text)) - starts[owner]
        valid = place + LENGTH <= sizes[owner]
        holder = np.where(valid, ids[owner], np.iinfo(np.int64).max)[order]
        least = np.minimum.reduceat(holder, np.flatnonzero(np.diff(interval, prepend=-1)))[interval]
        gone = np.zeros(len(text) + 2, bool)
        gone[1 + order] = least < holder  # only valid windows have a holder to compare with
        gone[1:-1] &= valid
        edge = np.flatnonzero(np.diff(gone.astype(np.int8)))
        first, last = edge[::2], edge[1::2]  # runs of windows [first, last) of the text
        run_of = owner[first]
        runs = np.bincount(run_of, minlength=len(parts))
        repeat = runs[content]
        row = np.repeat(np.arange(len(content)), repeat)
        begins = np.cumsum(runs) - runs
        k = np.repeat(begins[content], repeat) + np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        shift = rows["start"][row] - starts[content[row]]
        spans = {"id": rows["id"][row], "tag": rows["tag"][row], "start": first[k] + shift, "end": last[k] + shift + LENGTH - 1}
        return {k: np.concatenate([whole[k], v]) for k, v in spans.items()}

    return run


# ---- the result

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"


def merge_spans(spans: dict[str, np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Maximal runs by document: starts and ends."""
    order = np.lexsort((spans["start"], spans["tag"], spans["id"]))
    rows = {k: v[order] for k, v in spans.items()}
    new = _first_of_groups(np.arange(len(order)), rows["id"], rows["tag"])
    group = np.cumsum(new) - 1
    width = np.int64(rows["end"].max(initial=0) + 1)
    reach = np.maximum.accumulate(rows["end"] + group * width) - group * width
    head = new.copy()
    head[1:] |= rows["start"][1:] > reach[:-1]
    first = np.flatnonzero(head)
    start, end, group = rows["start"][first], reach[np.append(first[1:], len(order)) - 1], group[first]
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    heads = first[cuts]
    return {(int(rows["id"][h]), int(rows["tag"][h])): (start[a:b], end[a:b]) for h, a, b in zip(heads, cuts, [*cuts[1:], len(group)])}


def _apply(whole: bool):
    """Cuts the spans of one place from its texts."""

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        merged = merge_spans(_unpack(x.as_py() for x in spans.column("data"))) if spans.num_rows and texts.num_rows else {}
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans")}
        for i, tag, raw in zip(*(texts.column(c) for c in ("id", "tag", "raw"))):
            i, raw = i.as_py(), raw.as_py() or b""
            start, end = merged.get((i, tag.as_py()), ((), ())) if i is not None else ((), ())
            at, parts = 0, []
            for a, b in zip(start, end):
                parts.append(raw[at:a])
                at = b
            kept = b"".join([*parts, raw[at:]])
            for k, v in zip(out, (i, len(raw), len(raw) - len(kept), len(start), kept if whole else hashlib.sha256(kept).hexdigest().encode(), [int(x) for s in zip(start, end) for x in s] if whole else [])):
                out[k].append(v)
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = True) -> DataFrame:
    """Per document: id, bytes, removed bytes, removed runs; and the kept bytes and the runs' bounds, or (not whole) a digest of the kept bytes."""
    raw = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(utf8(docs[text]), F.lit(b"")).alias("raw")).withColumn("tag", F.xxhash64("raw"))
    total = raw.agg(F.sum(F.length("raw").cast("long"))).first()[0] or 0
    bucket = BUCKET_BYTES * max(1.0, total / 1e9) ** (1 / 3)
    n = max(1, math.ceil(total / bucket))
    cut = raw.where(F.col("id").isNotNull() & (F.length("raw") >= LENGTH)).select("id", "tag", "raw").mapInArrow(_cut(n), _BLOB)
    dealt = cut.withColumn("bucket", F.col("place"))
    settled, _ = write_shared(dealt.groupBy("bucket").applyInArrow(_settle(n), _BLOB), "spans")
    ours = raw.where(F.col("id").isNotNull())
    texts = ours.select("id", "tag", "raw", F.pmod(F.col("id").bitwiseXOR(F.col("tag")), F.lit(n)).alias("place"))  # as in _place()
    grouped = texts.groupBy("place")
    fetched = grouped.cogroup(settled.where(F.col("kind") == NEEDS).groupBy("place")).applyInArrow(_fetch(n), _BLOB)
    indexed = fetched.groupBy("place").applyInArrow(_index(n), _BLOB)
    spans = settled.where(F.col("kind") == SPANS).unionByName(indexed)
    done = grouped.cogroup(spans.groupBy("place")).applyInArrow(_apply(whole), RESULT)
    kept = F.col("raw") if whole else F.sha2("raw", 256).cast("binary")
    none = F.lit(0).cast("long")
    rest = raw.where(F.col("id").isNull()).select(
        F.col("id").alias("doc_id"), F.length("raw").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        kept.alias("kept"), F.array().cast("array<long>").alias("spans"),
    )
    return done.unionByName(rest)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the digest of the remaining bytes."""
    found = remove_repeats(docs.select("doc_id", "text"), whole=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
