"""Removal of long repeated substrings by a sparse suffix array, compared through prefix hashes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Texts are packed into blocks. In every string of ``length`` bytes the ``GRAM``-byte substring of least hash is an
   anchor, so equal strings have equal anchors at equal places. About one byte in 17 is an anchor.
2. A block sends the hashes of its anchors, 5 bytes each and by hash range, to owner tasks, which answer with a bit
   for each: does it occur in two documents. Only these anchors go on, with the bytes around them; equal surroundings
   in a block go as one, with their smallest id. Of anchors in more than ``hot_blocks`` blocks, whose surroundings would
   meet in one task, the block sends its strings of ``length`` bytes as 128-bit hashes instead, each to the owner of
   its hash and with the block's smallest id; owners answer with the smallest id of all blocks.
3. Owners sort the suffixes that start at the anchors, and the reversed prefixes before them: a mergesort in which the
   common extension of two strings is found by binary search over prefix polynomial hashes. The extensions of
   neighbours are then checked byte by byte; a sort that a hash collision misled is done again on the bytes.
4. A string that starts o bytes before its anchor is shared by those whose prefixes agree on o bytes and whose
   suffixes agree on ``length`` - o: runs in the two sorted orders. The smallest id of each run pair decides.
5. Blocks collect the answers and cut their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import drop_shared, write_shared

GRAM = 17
#: Owners of surroundings to an owner of hashes: surroundings are larger, hashes are many.
FINE = 4
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_INVERSE = pow(_P, -1, 1 << 64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Stands for a null id, which is larger than all others.
LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in concatenated documents; ``ends`` has each byte's document end."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    power = _powers(_P, n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    h = (prefix[GRAM:] - prefix[:-GRAM]) * _powers(_INVERSE, n)[: n - GRAM + 1]
    h = _mix(h)
    place = np.arange(len(h))
    h[place + GRAM > ends[: len(h)]] = _NONE
    low = _sliding(h, width, np.minimum)
    low[np.arange(len(low)) + length > ends[: len(low)]] = 0
    pad = np.zeros(width - 1, np.uint64)
    high = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)[: len(h)]
    at = np.flatnonzero((high == h) & (h != _NONE))
    return at, h[at]


def suffix_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte strings, and for each in that order how many bytes it shares with the one before."""
    n, width = rows.shape
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : min(8, width)] = rows[:, :8]
    key = wide.view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    size = np.bincount(group)
    if size.max() > 1:
        order = _merged(rows, order, np.repeat(np.cumsum(size) - size, size), np.repeat(size, size))
    lcp = np.zeros(n, np.int64)
    for k in range(1, n, 65_536):
        a, b = rows[order[k - 1 : k + 65_535]], rows[order[k : k + 65_536]]
        a = a[: len(b)]
        differ = a != b
        lcp[k : k + len(b)] = np.where(differ.any(1), differ.argmax(1), width)
        first = np.minimum(lcp[k : k + len(b)], width - 1)
        r = np.arange(len(b))
        if (a[r, first] > b[r, first]).any():  # a hash collision misled the sort
            order = np.lexsort(rows.T[::-1])
            return order, np.concatenate([[0], [int((d := rows[x] != rows[y]).argmax()) if (d := rows[x] != rows[y]).any() else width for x, y in zip(order[:-1], order[1:])]]).astype(np.int64)
    return order, lcp


def _merged(rows: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mergesort inside groups (``start`` and ``size`` of each place's group), all merges of a level at once."""
    n, width = rows.shape
    live = np.flatnonzero(size > 1)
    of = np.empty(n, np.int64)
    need = order[live]
    of[need] = np.arange(len(need))
    prefix = np.zeros((len(need), width + 1), np.uint64)
    for k in range(width):
        prefix[:, k + 1] = prefix[:, k] * np.uint64(_P) + rows[need, k] + np.uint64(1)

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """x < y, or x <= y where ``ties``."""
        a, b = of[x], of[y]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), width)
        while True:
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high + 1) // 2
            same = prefix[a, mid] == prefix[b, mid]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        at = np.minimum(low, width - 1)
        return np.where(low == width, ties, rows[x, at] < rows[y, at])

    run, largest = 1, int(size.max())
    while run < largest:
        at = live[size[live] > run]
        inside = at - start[at]
        pair = inside // (2 * run) * (2 * run)
        left = inside < pair + run
        other = start[at] + np.where(left, pair + run, pair)
        other_end = start[at] + np.minimum(np.where(left, pair + 2 * run, pair + run), size[at])
        low, high = np.minimum(other, other_end), other_end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            # Members of the right run come after equal ones of the left run.
            less = before(order[mid], order[at[open_]], ~left[open_])
            low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
        ahead = low - np.minimum(other, other_end)
        own = inside - pair - np.where(left, 0, run)
        order[start[at] + pair + own + ahead] = order[at].copy()
        run *= 2
    return order


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _pack(block_bytes: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, ids, texts, total = TaskContext.get().partitionId() << 24, [], [], 0

        def out() -> pa.RecordBatch:
            lens = np.array([len(t) for t in texts])
            data = np.frombuffer(b"".join(texts), np.uint8)
            mask = np.zeros(len(data), np.uint8)
            mask[anchors(data, np.repeat(np.cumsum(lens), lens), length)[0]] = 1
            row = ([serial], [ids], [lens.tolist()], [total], [_zip(data)], [_zip(np.packbits(mask))])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["block", "ids", "lens", "n", "data", "mask"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                total += len(texts[-1])
                if total >= block_bytes or len(ids) >= 20_000:
                    yield out()
                    serial, ids, texts, total = serial + 1, [], [], 0
        if ids:
            yield out()

    return run


class _Block:
    """A block's texts and anchors; ``keys`` are the distinct anchor hashes in order, by shard."""

    def __init__(self, batch: pa.RecordBatch, r: int, shards: int):
        get = lambda name: batch.column(name)[r].as_py()
        self.block, self.raw_ids = get("block"), get("ids")
        self.ids = np.array([LAST if i is None else i for i in self.raw_ids])
        self.lens = np.array(get("lens"), np.int64)
        self.data = _unzip(get("data"), np.uint8)
        n = len(self.data)
        self.at = np.flatnonzero(np.unpackbits(_unzip(get("mask"), np.uint8), count=n)) if n else np.empty(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)[self.at]
        self.ends = np.cumsum(self.lens)
        if len(self.at):
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_P, n))])
            h = _mix((prefix[self.at + GRAM] - prefix[self.at]) * _powers(_INVERSE, n)[self.at])
            h = _mix(h ^ np.uint64(0x5851F42D4C957F2D))  # least hashes are no even spread
        else:
            h = np.empty(0, np.uint64)
        shard = ((h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
        short = h & np.uint64((1 << 40) - 1)
        self.keys, self.number = np.unique((shard.astype(np.uint64) << np.uint64(40)) | short, return_inverse=True)
        self.shards = np.searchsorted(self.keys >> np.uint64(40), np.arange(shards + 1, dtype=np.uint64))

    def owners(self, key: np.ndarray) -> np.ndarray:
        """The owner of the surroundings of keys; it grows with the key."""
        x = self.keys[key]
        return ((x >> np.uint64(40)) * np.uint64(FINE) + ((x & np.uint64((1 << 40) - 1)) * np.uint64(FINE) >> np.uint64(40))).astype(np.int64)

    def shared_inside(self) -> np.ndarray:
        """Keys that stand in two documents of this block."""
        first, last = np.full(len(self.keys), LAST), np.full(len(self.keys), -LAST)
        ids = self.ids[self.doc]
        np.minimum.at(first, self.number, ids)
        np.maximum.at(last, self.number, ids)
        return first != last

    def windows(self, hot: np.ndarray, length: int, owners: int) -> tuple[np.ndarray, ...]:
        """Where strings of ``length`` bytes around hot anchors start, and their classes by 128-bit hashes in order of owner: class of each, and of each class owner, hash and least id; also each start's id."""
        take = np.flatnonzero(hot[self.number]) if len(self.keys) else np.empty(0, np.int64)
        at, doc = self.at[take], self.doc[take]
        low, high = np.maximum(at - (length - GRAM), self.ends[doc] - self.lens[doc]), np.minimum(at, self.ends[doc] - length)
        n = np.maximum(high - low + 1, 0)
        start = np.unique(np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n))
        ids = self.ids[np.searchsorted(self.ends, start, "right")]
        size, h = len(self.data), []
        for base in (_P, _Q):
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(base, size))])
            h.append(_mix((prefix[start + length] - prefix[start]) * _powers(pow(base, -1, 1 << 64), size)[start]) if size else np.empty(0, np.uint64))
        owner = (h[0] % np.uint64(owners)).astype(np.int64)
        order = np.lexsort((h[1], h[0], owner))
        new = np.ones(len(order), bool)
        new[1:] = (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = order[new]
        least = np.full(len(first), LAST)
        np.minimum.at(least, kind, ids)
        return start, ids, kind, owner[first], np.stack([h[0][first], h[1][first]], 1), least

    def contexts(self, bits: np.ndarray, length: int):
        """Of the occurrences of marked keys: which, their surroundings' class, and of each class bytes, lengths, key and least id."""
        take = np.flatnonzero(bits[self.number]) if len(self.keys) else np.empty(0, np.int64)
        at, doc, left = self.at[take], self.doc[take], length - GRAM
        end, begin = self.ends[doc], self.ends[doc] - self.lens[doc]
        after, ahead = np.minimum(end - at, length), np.minimum(at - begin, left)
        n = len(self.data)
        rows = np.zeros((len(at), length + left + 2), np.uint8)
        for k in range(length):
            rows[:, k] = np.where(k < after, self.data[np.minimum(at + k, n - 1)], 0) if n else 0
        for k in range(left):
            rows[:, length + k] = np.where(k < ahead, self.data[np.maximum(at - 1 - k, 0)], 0) if n else 0
        rows[:, -2], rows[:, -1] = after, ahead
        kind, first = classes_of(rows)
        least = np.full(len(first), LAST)
        np.minimum.at(least, kind, self.ids[doc])
        return take, kind, rows[first], self.number[take][first] if len(take) else take, least


def classes_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each row among equal rows, and one row of each class; by hashes that the bytes confirm."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * np.uint64(_P) + rows[:, k] + np.uint64(1)
    _, first, kind = np.unique(_mix(h), return_index=True, return_inverse=True)
    for k in range(0, len(rows), 65_536):
        if (rows[k : k + 65_536] != rows[first[kind[k : k + 65_536]]]).any():
            _, first, kind = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
            break
    return kind, first


def _send_keys(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                b = _Block(batch, r, shards)
                inside = b.shared_inside()
                out = [(s, b.keys[x:y].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.packbits(inside[x:y]).tobytes()) for s, (x, y) in enumerate(zip(b.shards[:-1], b.shards[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([b.block] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["shard", "block", "keys", "inside"])

    return run


def _answer_keys(hot_blocks: int):
    """For each block's keys of a shard, bits that mark those in two documents, and those of them in many blocks."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys, inside = [], []
        for k, i in zip(part["keys"], part["inside"]):
            x = np.zeros((len(k) // 5, 8), np.uint8)
            x[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
            keys.append(x.view(np.uint64).ravel())
            inside.append(np.unpackbits(np.frombuffer(i, np.uint8), count=len(keys[-1])))
        _, number, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        marked, cut = np.bincount(number, np.concatenate(inside)) + (n > 1) > 0, np.cumsum([len(k) for k in keys])[:-1]
        split = lambda x: [_zip(np.packbits(b)) for b in np.split(x[number], cut)]
        return pd.DataFrame({"shard": part["shard"], "block": part["block"], "bits": split(marked), "hot": split(n > hot_blocks)})

    return run


def _marked(b: _Block, answers: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Keys in two documents but the hot ones, and hot ones."""
    out = np.zeros((2, len(b.keys)), bool)
    for x in answers.as_py() or []:
        low, high = b.shards[x["shard"]], b.shards[x["shard"] + 1]
        for k, name in enumerate(("bits", "hot")):
            out[k, low:high] = np.unpackbits(_unzip(x[name], np.uint8), count=high - low)
    return out[0] & ~out[1], out[1]


def _send_contexts(shards: int, length: int):
    """Surroundings by owner from 0 on, and hashes of strings around hot anchors by owner from -1 down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                b = _Block(batch, r, shards)
                marked, hot = _marked(b, batch.column("answers")[r])
                _, _, rows, key, least = b.contexts(marked, length)
                sent = [(x, rows[p], least[p]) for x, p in _by_owner(b.owners(key))]
                if hot.any():
                    *_, owner, hashes, least = b.windows(hot, length, shards * FINE)
                    sent += [(-1 - x, hashes[p], least[p]) for x, p in _by_owner(owner)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int32()), pa.array([b.block] * len(sent), pa.int64()), pa.array([_zip(x[1]) for x in sent], pa.binary()), pa.array([_zip(x[2]) for x in sent], pa.binary())], ["shard", "block", "rows", "least"])

    return run


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(owner, kind="stable")
    found, cut = np.unique(owner[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, cut[1:]) if len(order) else [])


def windows_seen(rows: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For distinct surroundings with their least ids: bit o is set if the string from o bytes before the anchor stands in a document with a smaller id."""
    left = length - GRAM
    seen = np.zeros(len(rows), np.uint64)
    (right_order, right), (left_order, back) = suffix_sort(rows[:, :length]), suffix_sort(rows[:, length : length + left])
    after, ahead, a, b = rows[:, -2].astype(int), rows[:, -1].astype(int), np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for o in range(left + 1):
        fit = np.flatnonzero((ahead >= o) & (after >= length - o))
        if not len(fit):
            continue
        a[right_order], b[left_order] = np.cumsum(right < length - o), np.cumsum(back < o)
        key = a[fit] * (len(rows) + 1) + b[fit]
        order = np.argsort(key, kind="stable")
        key, of = key[order], fit[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low = np.repeat(np.minimum.reduceat(least[of], cut), np.diff(np.append(cut, len(of))))
        seen[of[low < least[of]]] |= np.uint64(1 << o)
    return seen


def hashes_answered(part: pd.DataFrame) -> pd.DataFrame:
    """The least id of each hash."""
    hashes, least = [_unzip(x, np.uint64).reshape(-1, 2) for x in part["rows"]], [_unzip(x, np.int64) for x in part["least"]]
    at, h, least = np.cumsum([len(x) for x in least])[:-1], np.concatenate(hashes), np.concatenate(least)
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]).any(1)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    low = np.full(int(new.sum()), LAST)
    np.minimum.at(low, kind, least)
    return pd.DataFrame({"shard": part["shard"], "block": part["block"], "low": [_zip(x) for x in np.split(low[kind], at)], "seen": [b""] * len(part)})


def _answer_contexts(length: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        if part["shard"].iloc[0] < 0:
            return hashes_answered(part)
        width = 2 * length - GRAM + 2
        rows, least = [_unzip(x, np.uint8).reshape(-1, width) for x in part["rows"]], [_unzip(x, np.int64) for x in part["least"]]
        at = np.cumsum([len(x) for x in least])[:-1]
        rows, least = np.concatenate(rows), np.concatenate(least)
        kind, first = classes_of(rows)
        low = np.full(len(first), LAST)
        np.minimum.at(low, kind, least)
        seen = windows_seen(rows[first], low, length)
        return pd.DataFrame({"shard": part["shard"], "block": part["block"], "low": [_zip(x) for x in np.split(low[kind], at)], "seen": [_zip(x) for x in np.split(seen[kind], at)]})

    return run


def _cut(shards: int, length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                b = _Block(batch, r, shards)
                marked, hot = _marked(b, batch.column("answers")[r])
                take, kind, rows, key, _ = b.contexts(marked, length)
                order = np.argsort(b.owners(key), kind="stable")
                low, seen = np.empty(len(rows), np.int64), np.empty(len(rows), np.uint64)
                all_back = batch.column("cuts")[r].as_py() or []
                back, hot_back = (sorted((x for x in all_back if (x["shard"] < 0) == of_hot), key=lambda x: abs(x["shard"])) for of_hot in (False, True))
                if back:
                    low[order] = np.concatenate([_unzip(x["low"], np.int64) for x in back])
                    seen[order] = np.concatenate([_unzip(x["seen"], np.uint64) for x in back])
                cover = np.zeros(len(b.data) + 1, np.int32)
                at, later = b.at[take], b.ids[b.doc[take]] > low[kind]
                after, ahead = rows[kind, -2].astype(int), rows[kind, -1].astype(int)
                for o in range(length - GRAM + 1):
                    hit = (ahead >= o) & (after >= length - o) & (later | ((seen[kind] >> np.uint64(o)) & np.uint64(1)).astype(bool))
                    start = at[hit] - o
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length, -1)
                if hot_back:
                    start, ids, kind, *_ = b.windows(hot, length, shards * FINE)
                    start = start[ids > np.concatenate([_unzip(x["low"], np.int64) for x in hot_back])[kind]]
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                out = []
                for end, n in zip(b.ends, b.lens):
                    g, text = gone[end - n : end], b.data[end - n : end]
                    left = text[~g].tobytes()
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
                    out.append((int(n), int(g.sum()), spans, hashlib.sha256(left).hexdigest(), left if texts else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(b.raw_ids, pa.int64()), *[pa.array([x[k] for x in out], kind_) for k, kind_ in enumerate(kinds)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 2_000_000, shard_bytes: int = 16_000_000, hot_blocks: int = 256, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left; null unless ``texts``).

    Strings never cross texts, and are judged on the input, not on what is left. Null and empty texts have no bytes.
    Rows that repeat an id count as one document: their strings don't remove each other. A null id is larger than
    all others and equal to other null ids. Other columns are ignored, whatever their names. No rows give no rows.

    An owner of hashes gets those of ``shard_bytes`` of text. A block sends each owner one row, so rows grow with blocks
    times owners until a row holds a single hash, and with the text from there on.
    """
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be from {GRAM + 1} to {GRAM + 63}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    blocks, _ = write_shared(rows.mapInArrow(_pack(block_bytes, length), "block long, ids array<long>, lens array<long>, n long, data binary, mask binary"), "blocks")
    shards = max(1, (blocks.agg(F.sum("n")).first()[0] or 0) // shard_bytes)

    keys = blocks.mapInArrow(_send_keys(shards), "shard int, block long, keys binary, inside binary")
    bits = keys.groupBy("shard").applyInPandas(_answer_keys(hot_blocks), "shard int, block long, bits binary, hot binary")
    answers = bits.groupBy("block").agg(F.collect_list(F.struct("shard", "bits", "hot")).alias("answers"))
    answers, _ = write_shared(answers, "answers")

    asked = blocks.join(answers, "block", "left")
    contexts = asked.mapInArrow(_send_contexts(shards, length), "shard int, block long, rows binary, least binary")
    found = contexts.groupBy("shard").applyInPandas(_answer_contexts(length), "shard int, block long, low binary, seen binary")
    cuts, cuts_path = write_shared(found.groupBy("block").agg(F.collect_list(F.struct("shard", "low", "seen")).alias("cuts")), "cuts")
    out = asked.join(cuts, "block", "left").mapInArrow(_cut(shards, length, texts), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
