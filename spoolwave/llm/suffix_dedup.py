"""Exact substring dedup: Burrows-Wheeler transforms of shards are merged by iterative interleave refinement.

A document loses every byte covered by a WINDOW-byte string that also starts in a document of smaller id. Whether two such
strings are equal is decided by merged transforms. What is brought together is chosen by content alone: the least hash of the
K-grams inside a window is the same wherever the window occurs, so windows are dealt by it, as runs of neighbouring windows
that share it ("pieces"). A first exchange of these hashes alone finds those that more than one document has; only their
pieces travel, each text once per batch of documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolwave.llm.common import plain, text_col

WINDOW = 50
K = 20
#: Windows in a piece at most; a longer run (periodic text) is several pieces.
MOST_RUN = 64
#: Bytes of text in a batch of documents, and of text behind one bucket of an exchange.
BATCH_BYTES = 16 << 20
LEAST_BATCH = 1 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 24
#: Occurrences from which a hash counts as hot: its windows are then dealt one by one, by their whole content.
HOT = 20_000
#: Bytes in a shard, and of the pieces whose spans are merged at once (whole groups of pieces that share a hash; their spans take
#: about a quarter). A smaller merge is cut into LEAST_SHARDS shards too, so that order and intervals come from merging at every size.
SHARD = 1 << 18
MERGE = 1 << 21
LEAST_SHARDS = 4
SECTION = 1 << 20
END = 255  # the terminator: no byte of UTF-8
NO_DOC = np.iinfo(np.int64).max
_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _power(e: int) -> np.uint64:
    return np.uint64(pow(_BASE, e, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-byte string in a, by doubling: h(x + y) = h(x) * base^|y| + h(y)."""
    cur, size = a.astype(np.uint64) * np.uint64(0xD6E8FEB8_6659FD93) + np.uint64(7), 1
    out, have = (cur, 1) if k & 1 else (None, 0)
    while size * 2 <= k:
        cur = cur[:-size] * _power(size) + cur[size:]
        size *= 2
        if k & size:
            if out is None:
                out, have = cur, size
            else:
                n = len(a) - have - size + 1
                out, have = out[:n] * _power(size) + cur[have : have + n], have + size
    return _mix(out)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    cur, size = h, 1
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = width - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def runs(a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, number of windows) of the runs of windows that share their least gram hash, within documents.

    starts holds each document's first byte, in order. Works in sections, so memory follows the section and not the text.
    """
    vs, ps, ns = [], [], []
    total = len(a) - WINDOW + 1
    ends = np.append(starts[1:], len(a))
    last = ends - WINDOW  # last window of each document
    for lo in range(0, max(total, 0), SECTION):
        hi = min(total, lo + SECTION)
        m = _window_min(gram_hashes(a[lo : hi + WINDOW - 1], K), WINDOW - K + 1)
        cut = np.empty(hi - lo, bool)
        cut[0], cut[1:] = True, m[1:] != m[:-1]
        first, stop = starts[(starts >= lo) & (starts < hi)], last[(last + 1 >= lo) & (last + 1 < hi)] + 1
        cut[first - lo] = True
        cut[stop - lo] = True
        at = np.flatnonzero(cut)
        n = np.diff(np.append(at, hi - lo))
        if n.max() > MOST_RUN:
            parts = -(-n // MOST_RUN)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at = np.repeat(at, parts) + inner * MOST_RUN
            n = np.minimum(np.repeat(n, parts) - inner * MOST_RUN, MOST_RUN)
        doc = np.searchsorted(starts, at + lo, side="right") - 1
        ok = at + lo <= last[doc]
        vs.append(m[at[ok]])
        ps.append(at[ok] + lo)
        ns.append(n[ok])
    if not vs:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(vs), np.concatenate(ps), np.concatenate(ns)


class Batch:
    """Documents of one group in order of id and text, laid end to end."""

    def __init__(self, t: pa.Table) -> None:
        ids = t.column("id").to_pylist()
        raw = [x.encode("utf-8") for x in t.column("text").to_pylist()]
        # texts break ties: the order must not follow that in which rows arrive, which a retry may change
        order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        raw = [raw[i] for i in order]
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.buf = b"".join(raw)
        del raw
        self.bytes = np.frombuffer(self.buf, np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        some = self.lengths > 0
        self.v, self.pos, self.run = runs(self.bytes, self.starts[:-1][some])
        self.doc = np.flatnonzero(some)[np.searchsorted(self.starts[:-1][some], self.pos, side="right") - 1]


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: names and sizes in front."""
    body = b"".join(a.tobytes() for a in arrays.values())
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    plain = len(head).to_bytes(4, "little") + head + body
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(plain, asbytes=True)


def _unpack(value: bytes) -> dict[str, np.ndarray]:
    plain = pa.Codec("zstd").decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True)
    at = 4 + int.from_bytes(plain[:4], "little")
    out = {}
    for item in plain[4:at].decode().split(";"):
        name, kind, n = item.split(",")
        out[name] = np.frombuffer(plain, kind, int(n), at)
        at += out[name].nbytes
    return out


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    keys, at = np.unique(bucket[order], return_index=True)
    return list(zip(keys.tolist(), np.split(order, at[1:])))


# First exchange: which hashes does more than one document have?


def _offer(t: pa.Table, buckets: int) -> pa.Table:
    """(g, bucket, value): a batch's distinct hashes, 40 bits each, with their number of runs and whether two ids have them."""
    b = Batch(t)
    order = np.argsort(b.v, kind="quicksort")
    v = b.v[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.empty(0, np.int64)
    ids = b.ids[b.doc[order]]
    rows = []
    if len(v):
        many = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        count = np.diff(np.append(first, len(v)))
        code = (np.minimum(127, np.floor(8 * np.log2(count))).astype(np.uint8)) | (many.astype(np.uint8) << 7)
        x = _mix(v[first])
        for bucket, own in _by_bucket((x % np.uint64(buckets)).astype(np.int64)):
            key = x[own] >> np.uint64(24)
            rows.append((bucket, _pack(low=(key & np.uint64(0xFFFFFFFF)).astype(np.uint32), high=(key >> np.uint64(32)).astype(np.uint8), code=code[own])))
    return _rows(t.column("g")[0].as_py(), rows)


def _rows(g: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"g": pa.array([g] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int64()), "value": pa.array([r[1] for r in rows], pa.binary())})


def _settle(t: pa.Table) -> pa.Table:
    """For each offer the state of its hashes: 0 one document only, 1 shared, 2 shared and hot."""
    parts = [_unpack(x) for x in t.column("value").to_pylist()]
    key = np.concatenate([p["high"].astype(np.uint64) << np.uint64(32) | p["low"] for p in parts])
    code = np.concatenate([p["code"] for p in parts])
    order = np.argsort(key, kind="quicksort")
    k = key[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(first, len(k)))
    times = np.add.reduceat(np.exp2((code[order] & 127) / 8.0), first)
    many = np.maximum.reduceat(code[order] >> 7, first)
    group = np.where((size > 1) | (many > 0), np.where(times >= HOT, 2, 1), 0).astype(np.uint8)
    state = np.empty(len(key), np.uint8)
    state[order] = np.repeat(group, size)
    cuts = np.cumsum([len(p["code"]) for p in parts])[:-1]
    return pa.table({"g": t.column("g"), "bucket": t.column("bucket"), "value": pa.array([_pack(state=s) for s in np.split(state, cuts)], pa.binary())})


def _states(b: Batch, answers: pa.Table, buckets: int) -> np.ndarray:
    """State of each run of a batch, from the answers to its offers."""
    distinct, inverse = np.unique(b.v, return_inverse=True)
    state = np.zeros(len(distinct), np.uint8)
    got = dict(zip(answers.column("bucket").to_pylist(), answers.column("value").to_pylist()))
    for bucket, own in _by_bucket((_mix(distinct) % np.uint64(buckets)).astype(np.int64)):
        state[own] = _unpack(got[bucket])["state"]
    return state[inverse]


# Second exchange: the pieces of shared hashes.


class Pieces:
    """A batch's pieces in a fixed order: runs of shared hashes, then the single windows of hot ones.

    text holds each distinct piece once, in order of first occurrence, which is that of the least document id.
    """

    def __init__(self, b: Batch, shared: np.ndarray, hot: np.ndarray) -> None:
        n = b.run[hot]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        single = np.repeat(b.pos[hot], n) + inner
        self.pos = np.concatenate([b.pos[shared], single])
        self.run = np.concatenate([b.run[shared], np.ones(len(single), np.int64)])
        self.doc = np.concatenate([b.doc[shared], np.repeat(b.doc[hot], n)])
        v = np.concatenate([b.v[shared], np.repeat(b.v[hot], n)])
        is_hot = np.zeros(len(v), bool)
        is_hot[len(shared) :] = True
        seen: dict[tuple[bytes, bool] | bytes, int] = {}
        buf, tail, index = b.buf, WINDOW - 1, seen.setdefault
        cut = len(shared)
        spans = list(zip(self.pos.tolist(), (self.pos + self.run + tail).tolist()))
        of = [index(buf[s:e], len(seen)) for s, e in spans[:cut]]
        of += [index((buf[s:e], True), len(seen)) for s, e in spans[cut:]]
        self.of = np.array(of, np.int64)
        self.text = [k if isinstance(k, bytes) else k[0] for k in seen]
        first = np.full(len(self.text), len(v), np.int64)
        np.minimum.at(first, self.of, np.arange(len(v)))
        self.first, self.v, self.hot = first, v[first] if len(first) else v[:0], is_hot[first] if len(first) else is_hot[:0]
        self.key = self.v.copy()
        if self.hot.any():
            whole = np.frombuffer(b"".join(t for t, h in zip(self.text, self.hot) if h), np.uint8).reshape(-1, WINDOW)
            weight = np.array([_power(WINDOW - 1 - i) for i in range(WINDOW)], np.uint64)
            self.key[self.hot] = _mix((whole.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64))

    def buckets(self, n: int) -> list[tuple[int, np.ndarray]]:
        return _by_bucket((_mix(self.key) % np.uint64(n)).astype(np.int64))


def _send(docs: pa.Table, answers: pa.Table, offers: int, buckets: int) -> pa.Table:
    """(g, bucket, value): the distinct pieces of a batch with the least id that has them."""
    if not docs.num_rows or not answers.num_rows:
        return _rows(0, [])
    b = Batch(docs)
    state = _states(b, answers, offers)
    p = Pieces(b, np.flatnonzero(state == 1), np.flatnonzero(state == 2))
    rows = []
    least = b.ids[p.doc[p.first]] if len(p.first) else np.empty(0, np.int64)
    for bucket, own in p.buckets(buckets):
        text = np.frombuffer(b"".join([p.text[i] for i in own.tolist()]), np.uint8)
        rows.append((bucket, _pack(key=p.key[own], v=p.v[own], hot=p.hot[own].astype(np.uint8), run=p.run[p.first[own]].astype(np.uint16), doc=least[own], text=text)))
    return _rows(docs.column("g")[0].as_py(), rows)


def shard_transform(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of strings that each end with END; equal suffixes go by position.

    left holds the number of bytes up to the terminator. Prefix doubling from 8 to 128 bytes, more than a piece has.
    """
    n = len(text)
    padded = np.concatenate([text, np.full(8, END, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(left >= k, padded[k : k + n], END).astype(np.uint64)
    size = 8
    while True:
        order = np.argsort(key, kind="quicksort")
        k = key[order]
        rank = np.empty(n, np.uint64)
        step = np.empty(n, np.uint32)
        step[0], step[1:] = 0, k[1:] != k[:-1]
        rank[order] = np.cumsum(step, dtype=np.uint64)
        if size > MOST_RUN + WINDOW:
            break
        ahead = np.full(n, 0xFFFFFFFF, np.uint64)
        inside = np.flatnonzero(left >= size)
        ahead[inside] = rank[inside + size]
        key = (rank << np.uint64(32)) | ahead
        size *= 2
    order = np.argsort((rank << np.uint64(32)) | np.arange(n, dtype=np.uint64), kind="quicksort")
    before = text[order - 1]
    before[(order == 0) | (text[order - 1] == END)] = END
    return order, before


def merge_transforms(shards: list[np.ndarray], strings: list[int], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rows by their first `depth` bytes, and where intervals of equal prefixes of that length begin.

    Nothing but the transforms is read. Start with all rows of the first shard, then of the second, and so on. In each round
    every row's preceding byte is put, stably, into that byte's bucket: rows interleaved by h bytes become rows interleaved by
    h + 1 bytes. Rows of one interval stay in one interval as long as their bytes and their intervals before agree, so
    intervals of common prefixes come along; rows that begin with a terminator keep the order of the shards.
    """
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), strings)
    chars = np.concatenate(shards)
    begins = np.zeros(len(z), bool)
    begins[0] = True
    merged = np.empty_like(chars)
    for _ in range(depth):
        merged[np.concatenate([np.flatnonzero(z == i) for i in range(len(shards))]) if len(shards) <= 8 else np.argsort(z, kind="stable")] = chars
        order = np.argsort(merged, kind="stable")
        interval = np.cumsum(begins, dtype=np.int32)[order]
        byte = merged[order]
        begins[1:] = (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1])
        z = z[order]
        z[len(z) - len(ends) :] = ends
        begins[len(z) - len(ends) :] = True
    return z, begins


def shared_spans(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each piece whose hash another window of the pieces has too; a piece without one gives (0, -1).

    Equal windows have equal hashes, so what lies outside a span equals nothing else. What lies inside is left to the merge.
    """
    size = np.array([len(x) for x in pieces], np.int64)
    n, start = size - WINDOW + 1, np.cumsum(size) - size
    at = _ragged(start, n)
    h = gram_hashes(np.frombuffer(b"".join(pieces), np.uint8), WINDOW)[at]
    order = np.argsort(h, kind="quicksort")
    same = h[order[1:]] == h[order[:-1]]
    many = np.zeros(len(h), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1)
    found = np.flatnonzero(many)
    if len(found):
        piece = np.repeat(np.arange(len(pieces)), n)[found]
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        last = np.append(first[1:], len(piece)) - 1
        low[piece[first]] = at[found[first]] - start[piece[first]]
        high[piece[first]] = at[found[last]] - start[piece[first]]
    return low, high


def group_docs(pieces: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `window_docs`, for whole groups of pieces that share a hash: only the spans that may have an equal are merged.

    A window outside every span has its own piece's id. Spans of one text go through the merge once, under their least id.
    """
    n = np.array([len(x) - WINDOW + 1 for x in pieces], np.int64)
    out = np.repeat(docs, n)
    low, high = shared_spans(pieces)
    own = np.flatnonzero(high >= low)
    spans: dict[bytes, int] = {}
    index = spans.setdefault
    of = np.array([index(pieces[i][a : b + WINDOW], len(spans)) for i, a, b in zip(own.tolist(), low[own].tolist(), high[own].tolist())], np.int64)
    text, least = list(spans), np.full(len(spans), NO_DOC)
    np.minimum.at(least, of, docs[own])
    if text:
        found, number = window_docs(text, least)
        begin = np.cumsum(number) - number
        start = np.cumsum(n) - n
        out[_ragged(start[own] + low[own], number[of])] = found[_ragged(begin[of], number[of])]
    return out, n


def window_docs(pieces: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id over all pieces for each window of each piece, and each piece's number of windows."""
    size = np.array([len(x) + 1 for x in pieces], np.int64)
    text = np.frombuffer(bytes([END]).join(pieces) + bytes([END]), np.uint8)
    stop = np.cumsum(size)
    start = stop - size
    left = np.repeat(stop - 1, size) - np.arange(len(text))
    step = min(SHARD, -(-len(text) // LEAST_SHARDS))
    cuts = np.unique(np.searchsorted(stop, np.arange(step, len(text) + step, step)).clip(max=len(pieces) - 1)) + 1
    arrays, transforms, strings, at = [], [], [], 0
    for upto in cuts.tolist():
        lo, hi = start[at], stop[upto - 1]
        order, before = shard_transform(text[lo:hi], left[lo:hi])
        arrays.append(order + lo)
        transforms.append(before)
        strings.append(upto - at)
        at = upto
    z, begins = merge_transforms(transforms, strings)
    interval = np.cumsum(begins, dtype=np.int64) - 1
    place = np.empty(len(text), np.int64)
    place[np.concatenate(arrays)] = interval[np.argsort(z, kind="stable")]
    n = size - WINDOW  # windows of a piece: its length less WINDOW - 1
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    least = np.full(int(interval[-1]) + 1, NO_DOC)
    np.minimum.at(least, place[at], np.repeat(docs, n))
    return least[place[at]], n


def _merge(t: pa.Table) -> pa.Table:
    """For each batch's pieces the least id of every window, as runs; hashes whose pieces are all equal need no merge, nor do windows
    whose hash no other piece of theirs has."""
    parts = [_unpack(x) for x in t.column("value").to_pylist()]
    seen: dict[tuple[int, bytes], int] = {}
    uids = []
    for p in parts:
        stop = np.cumsum(p["run"].astype(np.int64) + (WINDOW - 1))
        buf = p["text"].tobytes()
        index = seen.setdefault
        uids.append(np.array([index((k, buf[s:e]), len(seen)) for k, s, e in zip(p["key"].tolist(), [0, *stop[:-1].tolist()], stop.tolist())], np.int64))
    uid = np.concatenate(uids)
    least = np.full(len(seen), NO_DOC)
    np.minimum.at(least, uid, np.concatenate([p["doc"] for p in parts]))
    key = np.array([k for k, _ in seen], np.uint64)
    text = [x for _, x in seen]
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(first, len(k)))
    # runs of equal ids: one for a piece on its own, replaced below for the others
    values: list[np.ndarray] = [least]
    lengths: list[np.ndarray] = [np.array([len(x) - WINDOW + 1 for x in text], np.int64)]
    begin, number, filled = np.arange(len(seen)), np.ones(len(seen), np.int64), len(seen)
    block: list[np.ndarray] = []
    held = 0
    shared = [order[a : a + n] for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist())]
    for i, own in enumerate(shared):
        block.append(own)
        held += sum(len(text[u]) + 1 for u in own.tolist())
        if held >= MERGE or i == len(shared) - 1:
            own = np.concatenate(block)
            docs, n = group_docs([text[u] for u in own.tolist()], least[own])
            change = np.append(True, docs[1:] != docs[:-1])
            starts = np.cumsum(n) - n
            change[starts] = True
            at = np.flatnonzero(change)
            values.append(docs[at])
            lengths.append(np.diff(np.append(at, len(docs))))
            ahead = np.concatenate(([0], np.cumsum(change)))
            begin[own] = filled + ahead[starts]
            number[own] = ahead[starts + n] - ahead[starts]
            filled += len(at)
            block, held = [], 0
    value, length = np.concatenate(values), np.concatenate(lengths)
    answers = []
    for p, u in zip(parts, uids):
        at = _ragged(begin[u], number[u])
        answers.append(_pack(v=p["v"], hot=p["hot"], number=number[u].astype(np.uint16), length=length[at].astype(np.uint16), doc=value[at]))
    return pa.table({"g": t.column("g"), "bucket": t.column("bucket"), "value": pa.array(answers, pa.binary())})


def _ragged(begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())


def _finish(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Per document: bytes, removed bytes, removed runs, digest of what is left."""
    if not docs.num_rows:
        return pa.table({k: pa.array([], t) for k, t in _OUT})
    covered, b = removed_bytes(docs, answers, buckets)
    s, e = b.starts[:-1], b.starts[1:]
    removed = _between(covered, s, e)
    opens = covered.copy()
    opens[1:] &= ~covered[:-1]
    inner = s[b.lengths > 0]
    opens[inner] = covered[inner]
    spans = _between(opens, s, e)
    del opens
    digest = [hashlib.sha256(b.buf[i:j] if not r else b.bytes[i:j][~covered[i:j]].tobytes()).hexdigest() for i, j, r in zip(s.tolist(), e.tolist(), removed.tolist())]
    ids = pa.array(b.ids, pa.int64(), mask=b.ids == NO_DOC)
    return pa.table({"doc_id": ids, "n_bytes": b.lengths, "n_removed": removed, "n_spans": spans, "kept_sha256": digest})


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of set flags in each [start, end)."""
    ahead = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=ahead[1:])
    return (ahead[end] - ahead[start]).astype(np.int64)


_OUT = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))


def removed_bytes(docs: pa.Table, answers: pa.Table, buckets: int) -> tuple[np.ndarray, Batch]:
    b = Batch(docs)
    covered = np.zeros(len(b.buf), bool)
    got = {k: _unpack(x) for k, x in zip(answers.column("bucket").to_pylist(), answers.column("value").to_pylist())}
    if got:
        v, hot = np.concatenate([a["v"] for a in got.values()]), np.concatenate([a["hot"] for a in got.values()]).astype(bool)
        known_shared, known_hot = np.unique(v[~hot]), np.unique(v[hot])
        p = Pieces(b, np.flatnonzero(np.isin(b.v, known_shared)), np.flatnonzero(np.isin(b.v, known_hot)))
        number, begin = np.zeros(len(p.text), np.int64), np.zeros(len(p.text), np.int64)
        lengths, values, filled = [], [], 0
        for bucket, own in p.buckets(buckets):
            a = got[bucket]
            n = a["number"].astype(np.int64)
            number[own], begin[own] = n, filled + np.cumsum(n) - n
            lengths.append(a["length"].astype(np.int64))
            values.append(a["doc"])
            filled += len(a["doc"])
        length, value = np.concatenate(lengths), np.concatenate(values)
        n = number[p.of]
        at = _ragged(begin[p.of], n)
        size = length[at]
        ahead = np.cumsum(size) - size  # windows before, over all runs
        first = np.cumsum(n) - n
        start = np.repeat(p.pos - ahead[first], n) + ahead
        hit = value[at] < np.repeat(b.ids[p.doc], n)
        depth = np.zeros(len(b.buf) + 1, np.int32)
        depth[start[hit]] += 1
        depth[(start + size)[hit] + WINDOW - 1] -= 1
        np.cumsum(depth, out=depth)
        covered = depth[:-1] > 0
    return covered, b


def _exchange(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Documents by batch, answers by batch and bucket, and the number of buckets. Batches are chosen by the rows' content."""
    docs = plain(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length(text_col()).cast("bigint"))).first()[0] or 0
    # small inputs are dealt to all cores; tasks follow the bytes of text, whatever the session's number of shuffle partitions
    cores = min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BATCH))
    batches, buckets = max(1, cores, -(-size // BATCH_BYTES)), max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_DOC))).alias("id"), text_col().alias("text"))
    own = own.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(batches))).repartition(batches, "g")
    message = "g bigint, bucket bigint, value binary"
    offers = own.groupBy("g").applyInArrow(lambda t: _offer(t, buckets), message)
    states = offers.groupBy("bucket").applyInArrow(_settle, message)
    sent = own.groupBy("g").cogroup(states.groupBy("g")).applyInArrow(lambda d, a: _send(d, a, buckets, buckets), message)
    return own, sent.groupBy("bucket").applyInArrow(_merge, message), buckets


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row, over whole texts as UTF-8.

    Null text is empty. A null doc_id is larger than any other, and no smaller than another null. Rows of one doc_id take
    nothing from each other. Texts under WINDOW bytes lose nothing. A batch, a bucket and a merge are bounded in bytes (a text
    longer than a batch is a batch of its own). An empty table gives an empty result.
    """
    own, answers, buckets = _exchange(docs)
    return own.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(lambda d, a: _finish(d, a, buckets), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, kept binary): what is left of every text, as bytes, since a cut can fall inside a character."""
    own, answers, buckets = _exchange(docs)

    def run(d: pa.Table, a: pa.Table) -> pa.Table:
        if not d.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        covered, b = removed_bytes(d, a, buckets)
        kept = [b.bytes[i:j][~covered[i:j]].tobytes() for i, j in zip(b.starts[:-1].tolist(), b.starts[1:].tolist())]
        return pa.table({"doc_id": pa.array(b.ids, pa.int64(), mask=b.ids == NO_DOC), "kept": pa.array(kept, pa.binary())})

    return own.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, "doc_id bigint, kept binary")
