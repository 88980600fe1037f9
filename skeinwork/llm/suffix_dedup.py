"""Operator 1, suffix-array dedup: bytes under a 50-byte string that an earlier document holds, by two-stage suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, NULL_ID, Scratch, arrow_type, durable, mix, pack, partitions, read_block, small_batches, table, text_blocks, unpack

#: Length of a repeated string, and of the grams whose smallest hash routes it (a string has GRAM - KEY + 1 of them).
GRAM, KEY = 50, 24
#: Bytes of text in one block of documents, and start positions hashed at once.
BLOCK_BYTES, CHUNK = 4 << 20, 1 << 16
#: Bytes of pieces that a task sorts at once; equal strings are in the same share, as their hash says.
SHARE_BYTES = 2 << 20
#: Bits of a routing hash that travel beside its bucket; one more tells that a block has it in two rows.
BITS = 39


def _smallest(data: np.ndarray) -> np.ndarray:
    """For each 50-byte string of data the smallest hash of its KEY-byte grams: equal strings have equal ones."""
    h, size, by_size = data.astype(np.uint64) + np.uint64(1), 1, {}

    def power(n: int) -> np.uint64:
        return np.uint64(pow(int(_BASE), n, 1 << 64))

    while size < 16:
        h = h[:-size] * power(size) + h[size:]
        size *= 2
        by_size[size] = h
    rest = KEY - 16
    scale = power(rest)
    tail = by_size[rest][16:]
    h = mix(h[: len(tail)] * scale + tail)
    window, n = GRAM - KEY + 1, 1
    while 2 * n <= window:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (window - n)], h[window - n :])


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, hash): runs of 50-byte strings that begin at successive bytes of one document and share the hash."""
    valid = np.ones(len(data), bool)
    bad = (offsets[1:, None] - np.arange(1, GRAM)).ravel()
    valid[bad[bad >= 0]] = False
    out = []
    for a in range(0, max(len(data) - GRAM + 1, 0), CHUNK):
        key = _smallest(data[a : a + CHUNK + GRAM - 1])
        on = valid[a : a + len(key)]
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = (key[1:] != key[:-1]) | ~on[:-1] | ~on[1:]
        edge = np.flatnonzero(new)
        begin, n = edge[:-1], np.diff(edge)
        keep = on[begin]
        out.append((begin[keep] + a, n[keep], key[begin[keep]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _coded(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high bits, BITS bits of the hash below."""
    n = np.uint64(buckets)
    return ((key % n) << np.uint64(BITS)) | ((key // n) & np.uint64((1 << BITS) - 1))


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds, as binaries."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values.view(np.uint8))])


def _joined(column: pd.Series, kind) -> tuple[np.ndarray, np.ndarray]:
    """All of a column's arrays in one, and each one's length."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column), kind), np.array([len(x) // size for x in column], np.int64)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] of them, then the same for the others."""
    return np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket the distinct routing hashes, and digests of the documents."""
    schema = "bucket int, block long, low binary, high binary, digests binary, ids binary, rows binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets, data = read_block(r)
                start, _, key = _runs(data, offsets)
                row = np.searchsorted(offsets, start, "right") - 1
                code = _coded(key, buckets)
                order = np.argsort(code)
                code, row = code[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
                twice = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first) if len(first) else np.zeros(0, bool)
                code = code[first]
                digest = np.frombuffer(b"".join(hashlib.blake2b(data[a:b].data, digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64).reshape(-1, 2)
                long = np.flatnonzero(np.diff(offsets) >= GRAM)
                place = (digest[long, 0] % np.uint64(buckets)).astype(np.int64)
                long, place = long[np.argsort(place, kind="stable")], np.sort(place)
                every = np.arange(buckets + 1)
                cut, cut_rows = np.searchsorted((code >> np.uint64(BITS)).astype(np.int64), every), np.searchsorted(place, every)
                low = code & np.uint64((1 << 32) - 1)
                high = ((code >> np.uint64(32)) & np.uint64((1 << (BITS - 32)) - 1)) | (twice.astype(np.uint64) << np.uint64(BITS - 32))
                columns = [pa.array(every[:-1].astype(np.int32)), pa.array(np.full(buckets, r["block"], np.int64)), _binary(low.astype(np.uint32), cut), _binary(high.astype(np.uint8), cut)]
                columns += [_binary(digest[long].ravel(), 2 * cut_rows), _binary(ids[long], cut_rows), _binary(long.astype(np.int32), cut_rows)]
                some = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_rows) > 0))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_type(schema)).take(pa.array(some))

    return blocks.mapInArrow(run, schema)


def _shared(keys: DataFrame) -> DataFrame:
    """What of a block's hashes another document has too, and which of its rows repeat a whole earlier document."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low, n = _joined(group["low"], np.uint32)
        high, _ = _joined(group["high"], np.uint8)
        flag = high >> np.uint8(BITS - 32)
        value = ((high.astype(np.uint64) & np.uint64((1 << (BITS - 32)) - 1)) << np.uint64(32)) | low
        order = np.argsort(value)
        new = np.concatenate([[True], value[order][1:] != value[order][:-1]])[: len(order)]
        member = np.cumsum(new) - 1
        both = (np.bincount(member) > 1) | (np.bincount(member, flag[order]) > 0) if len(order) else np.zeros(0, bool)
        keep = np.zeros(len(value), bool)
        keep[order] = both[member] if len(order) else False
        digest, m = _joined(group["digests"], np.uint64)
        digest, ids, rows = digest.reshape(-1, 2), _joined(group["ids"], np.int64)[0], _joined(group["rows"], np.int32)[0]
        later = np.zeros(len(ids), bool)
        if len(ids):
            order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
            d = digest[order]
            new = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)])
            least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            later[order] = ids[order] > least
        out, at, at_rows = [], 0, 0
        for bucket, block, a, b in zip(group["bucket"], group["block"], n, m // 2, strict=True):
            on, off = keep[at : at + a], later[at_rows : at_rows + b]
            if on.any() or off.any():
                out.append((block, bucket, value[at : at + a][on].tobytes(), rows[at_rows : at_rows + b][off].tobytes()))
            at, at_rows = at + a, at_rows + b
        return pd.DataFrame(out, columns=["block", "bucket", "values", "later"])

    return keys.groupBy("bucket").applyInPandas(run, "block long, bucket int, values binary, later binary")


def _portions(size: np.ndarray, limit: int = 1 << 20) -> Iterator[slice]:
    """Successive runs of pieces with about limit bytes, so that working arrays stay small."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield slice(a, b)
        a = b


def _piece_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()), _BASE)]))
    out = np.zeros(len(size), np.uint64)
    for part in _portions(size):
        first = np.cumsum(size[part]) - size[part]
        at = _spread(start[part], size[part])
        within = np.arange(len(at)) - np.repeat(first, size[part])
        out[part] = mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[within], first) + mix(size[part].astype(np.uint64)))
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces at a and b of the same sizes are equal."""
    out = np.zeros(len(size), bool)
    for p in _portions(size):
        out[p] = np.logical_and.reduceat(data[_spread(a[p], size[p])] == data[_spread(b[p], size[p])], np.cumsum(size[p]) - size[p])
    return out


def _pieces(blocks: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket the distinct pieces of text under shared hashes, and where each stands.

    Rows that repeat a whole earlier document are left out here: all their strings stand in that document.
    """
    schema = "bucket int, block long, body binary, counts binary, places binary"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["bucket", "block", "body", "counts", "places"])
        if not len(left) or not len(right):
            return none
        ids, offsets, data = read_block(left.iloc[0])
        values, n = _joined(right["values"], np.uint64)
        wanted = np.sort((np.repeat(right["bucket"].to_numpy().astype(np.uint64), n) << np.uint64(BITS)) | values)
        later = np.zeros(len(ids), bool)
        later[_joined(right["later"], np.int32)[0]] = True
        start, count, key = _runs(data, offsets)
        code = _coded(key, buckets)
        row = np.searchsorted(offsets, start, "right") - 1
        at = np.minimum(np.searchsorted(wanted, code), max(len(wanted) - 1, 0))
        keep = np.flatnonzero((wanted[at] == code) & ~later[row]) if len(wanted) else np.zeros(0, np.int64)
        if not len(keep):
            return none
        start, count, row, bucket = start[keep], count[keep], row[keep], (code[keep] >> np.uint64(BITS)).astype(np.int64)
        share = (code[keep] & np.uint64(0xFFFF)).astype(np.uint16)
        size = count + GRAM - 1
        same = _piece_hashes(data, start, size)
        order = np.lexsort((start, same, bucket))
        start, count, row, bucket, size, same, share = (x[order] for x in (start, count, row, bucket, size, same, share))
        new = np.concatenate([[True], (same[1:] != same[:-1]) | (bucket[1:] != bucket[:-1])])
        model = np.flatnonzero(new)[np.cumsum(new) - 1]
        # equal hashes are held against the text; a piece that only collides stands for itself
        rest = np.flatnonzero(~new)
        if len(rest):
            differ = size[rest] != size[model[rest]]
            able = rest[~differ]
            if len(able):
                differ[~differ] = ~_equal(data, start[able], start[model[able]], size[able])
            if differ.any():
                model[rest[differ]] = rest[differ]
                order = np.argsort(model, kind="stable")
                start, count, row, bucket, size, share, model = (x[order] for x in (start, count, row, bucket, size, share, model))
                new = np.concatenate([[True], model[1:] != model[:-1]])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(start)))
        cut = np.searchsorted(bucket[first], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(cut)):
            mine = first[cut[b] : cut[b + 1]]
            body = data[_spread(start[mine], size[mine])]
            low, high = first[cut[b]], first[cut[b + 1]] if cut[b + 1] < len(first) else len(start)
            out.append((b, left["block"].iloc[0], pack(body), pack(count[mine].astype(np.int32), times[cut[b] : cut[b + 1]].astype(np.int32), share[mine]), pack(ids[row[low:high]], start[low:high])))
        return pd.DataFrame(out, columns=none.columns)

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(run, schema)


def _words(data: np.ndarray, at: np.ndarray, end: np.ndarray, most: int = 8) -> np.ndarray:
    """The next 8 bytes (or `most` of them) as one number that orders like them; bytes from `end` on count as 0."""
    rest = np.clip(end - at, 0, most)
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    word = np.ascontiguousarray(view[np.minimum(at, len(view) - 1)]).view(">u8").ravel().astype(np.uint64)
    shift = ((8 - rest) * 8).astype(np.uint64)
    return np.where(rest > 0, (word >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0))


def suffix_order(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, counts: np.ndarray, depth: int = GRAM) -> np.ndarray:
    """The first `counts` suffixes of each piece of data, sorted by their first `depth` bytes at least.

    Two stages. A suffix smaller than its successor (the next byte that differs is larger) is sorted directly, eight bytes a
    round, among the suffixes still tied. Every other suffix is induced: a scan of the buckets in order of the first byte, and
    of how often that byte repeats, places it by the rank its successor has by then. data has 8 spare bytes at its end.
    """
    end = np.repeat(begins + sizes, sizes)
    n = len(end)
    text = data[:n].astype(np.int16) + 1
    following = np.append(text[1:], 0)
    following[begins + sizes - 1] = 0
    rise = np.sign(following - text)
    place = np.where(rise != 0, np.arange(n), n)
    differs = np.minimum.accumulate(place[::-1])[::-1]  # where the run of the same byte ends
    smaller = rise[differs] > 0
    level = np.minimum(differs - np.arange(n), depth + 14)
    # a suffix is needed if it is asked for, or if one that is induced needs its rank
    stop = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    last = np.minimum(stop[begins + counts - 1], begins + sizes - 1)
    need = _spread(begins, last - begins + 1)
    direct = need[smaller[need]]
    key = _words(data, direct, end[direct])
    order = np.argsort(key)
    direct, key = direct[order], key[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])[: len(key)])
    for at in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        some = direct[tied]
        key = _words(data, some + at, end[some])
        order = np.lexsort((key, group[tied]))
        direct[tied], key = some[order], key[order]
        whole = np.zeros(len(direct), np.uint64)
        whole[tied] = key
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (whole[1:] != whole[:-1])])[: len(group)])
    rank = np.full(n + 1, -1, np.int64)
    closing = np.zeros(n, bool)
    closing[begins + sizes - 1] = True
    induced = need[~smaller[need]]
    step = depth + 16
    bucket = text[induced].astype(np.int64) * step + level[induced]
    induced = induced[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    edge = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)]), len(bucket))
    parts, done = [], 0
    direct_byte = text[direct]
    scan = [(int(bucket[a]), induced[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    scan += [(int(c) * step + step - 1, direct[np.searchsorted(direct_byte, c) : np.searchsorted(direct_byte, c, "right")]) for c in np.unique(direct_byte)]
    for b, found in sorted(scan, key=lambda x: x[0]):
        if b % step != step - 1:
            successor = np.where(closing[found], -1, rank[np.minimum(found + 1, n)])
            found = found[np.argsort(successor, kind="stable")]
        rank[found] = done + np.arange(len(found))
        done += len(found)
        parts.append(found)
    sorted_all = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    asked = np.zeros(n, bool)
    asked[_spread(begins, counts)] = True
    return sorted_all[asked[sorted_all]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int = GRAM) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, no more than depth; each has depth bytes."""
    out = np.zeros(len(order), np.int64)
    pairs = np.arange(1, len(order))
    far = np.full(len(order), len(data))
    for at in range(0, depth, 8):
        most = min(8, depth - at)
        a, b = _words(data, order[pairs - 1] + at, far[: len(pairs)], most), _words(data, order[pairs] + at, far[: len(pairs)], most)
        same = a == b
        out[pairs[same]] += most
        pairs = pairs[same]
    return out


def _covers(pieces: DataFrame) -> DataFrame:
    """Per block the stretches that a string of an earlier document covers."""

    def sort(data: np.ndarray, count: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """For each byte of data where a wanted string begins, the smallest doc_id that has the string."""
        size = count + GRAM - 1
        begin = np.cumsum(size) - size
        order = suffix_order(data, begin, size, count)
        new = common_prefixes(data, order) < GRAM
        new[:1] = True
        piece = np.repeat(np.arange(len(count), dtype=np.int32), size)
        least = np.full(len(data), NULL_ID)
        least[order] = np.minimum.reduceat(least_id[piece[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
        return least

    def run(group: pd.DataFrame) -> pd.DataFrame:
        body = np.concatenate([unpack(x, np.uint8)[0] for x in group["body"]])
        counts = [unpack(x, np.int32, np.int32, np.uint16) for x in group["counts"]]
        places = [unpack(x, np.int64, np.int64) for x in group["places"]]
        count_all, times_all, share = (np.concatenate([c[i] for c in counts]).astype(np.int64) for i in (0, 1, 2))
        ids_all, start_all = (np.concatenate([p[i] for p in places]) for i in (0, 1))
        block_all = np.repeat(np.arange(len(group), dtype=np.int32), [len(p[0]) for p in places])
        size_all = count_all + GRAM - 1
        begin_all, occurs_all = np.cumsum(size_all) - size_all, np.cumsum(times_all) - times_all
        share %= len(body) // SHARE_BYTES + 1
        found: list[list[tuple]] = [[] for _ in range(len(group))]
        for x in np.unique(share):
            mine = np.flatnonzero(share == x)
            count, times, size = count_all[mine], times_all[mine], size_all[mine]
            occurs = _spread(occurs_all[mine], times)
            ids, start, block = ids_all[occurs], start_all[occurs], block_all[occurs]
            data = np.concatenate([body[_spread(begin_all[mine], size)], np.zeros(8, np.uint8)])
            least = sort(data, count, np.minimum.reduceat(ids, np.cumsum(times) - times))
            begin = np.cumsum(size) - size
            # each place of a piece, about a million strings at once: which of its strings an earlier document holds
            owner = np.repeat(np.arange(len(count)), times)
            for part in _portions(count[owner]):
                own = owner[part]
                n = count[own]
                string = _spread(begin[own], n)
                earlier = least[string] < np.repeat(ids[part], n)
                first = np.zeros(len(string), bool)
                first[np.cumsum(n) - n] = True
                opens = np.flatnonzero(earlier & (first | ~np.concatenate([[False], earlier[:-1]])))
                closes = np.flatnonzero(earlier & np.concatenate([first[1:] | ~earlier[1:], [True]]))
                place = np.repeat(np.arange(len(n)), n)[opens]
                at = start[part][place] + (string[opens] - begin[own[place]])
                length, where = closes - opens + GRAM, block[part][place]
                cut = np.argsort(where, kind="stable")
                at, length, where = at[cut], length[cut], where[cut]
                edge = np.append(np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])[: len(where)]), len(where))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    found[where[a]].append((at[a:b].astype(np.int32), length[a:b].astype(np.int32)))
        rows = [(block, pack(*(np.concatenate(c) for c in zip(*got, strict=True)))) for block, got in zip(group["block"], found, strict=True) if got]
        return pd.DataFrame(rows, columns=["block", "covers"])

    return pieces.groupBy("bucket").applyInPandas(run, "block long, covers binary")


def _removed(blocks: DataFrame, shared: DataFrame, covers: DataFrame, texts: bool) -> DataFrame:
    """Rows of documents with what is left of each."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        ids, offsets, data = read_block(left.iloc[0])
        change = np.zeros(len(data) + 1, np.int32)
        for blob in right["covers"].dropna():
            at, length = unpack(blob, np.int32, np.int32)
            for a, step in ((at, 1), (at + length, -1)):
                place, n = np.unique(a, return_counts=True)
                change[place] += step * n.astype(np.int32)
        gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
        for blob in right["later"].dropna():
            for row in np.frombuffer(blob, np.int32):
                gone[offsets[row] : offsets[row + 1]] = True
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])[offsets].astype(np.int64)
        n_removed = np.diff(total)
        out = []
        for i, n in enumerate(n_removed):
            a, b = offsets[i], offsets[i + 1]
            kept, spans = data[a:b], 0
            if n:
                part = gone[a:b]
                spans = int(part[0]) + int((part[1:] & ~part[:-1]).sum())
                kept = kept[~part]
            out.append((b - a, n, spans, hashlib.sha256(kept.tobytes()).hexdigest(), *[kept.tobytes()] * texts))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")][1:])
        frame.insert(0, "doc_id", pd.Series(ids, dtype="Int64").mask(ids == NULL_ID))
        return frame

    done = covers.selectExpr("block", "covers", "cast(null as binary) later").unionByName(shared.filter(F.length("later") > 0).selectExpr("block", "cast(null as binary) covers", "later"))
    return blocks.groupBy("block").cogroup(done.groupBy("block")).applyInPandas(run, schema)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with texts also the bytes kept.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Equal strings share the smallest
    hash of their 24-byte grams, so a bucket of such hashes has every copy of its strings. First the hashes that two documents
    have are found; only the text under those is sent to the buckets, each distinct piece of a block once, where suffix
    sorting and adjacent common prefixes find the equal strings and the smallest doc_id of each. A document that repeats a
    whole earlier one needs no sorting: all of it goes if it has 50 bytes.

    Null text is empty; a null doc_id counts as smaller than all others; rows with the same doc_id are no earlier documents
    for each other; an empty table gives no rows; other columns are ignored. A text longer than a block is a block of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions(spark)
    scratch = Scratch(spark, "suffix")
    blocks = scratch.write(text_blocks(docs, BLOCK_BYTES), "blocks")
    shared = scratch.write(_shared(_keys(blocks, buckets)), "shared")
    out = durable(_removed(blocks, shared, _covers(_pieces(blocks, shared, buckets)), texts), "suffix-removed")
    scratch.drop()
    return out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
