"""Operator 2, n-gram Jaccard join: sets of word shingles, linked from token-combination prefixes and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, NULL_ID, Scratch, arrow_type, cut, durable, mix, pack, partitions, read_block, small_batches, table, text_blocks, unpack, word_hashes, word_spans
from .components import connected

SHINGLE = 5
#: Two sets link from this share of their union on, in hundredths.
SHARE = 75
#: Bytes of text in one block of documents, of which the distinct shingles are counted together.
BLOCK_BYTES = 16 << 20
#: A shingle in so many sets at most is rare: a key by itself. The classes of frequent ones make keys in pairs.
RARE = 64
#: Shingles and sets of one block of a candidate cluster: what a task compares at once with another such block.
CLUSTER_SHINGLES, CLUSTER_SETS = 2_000_000, 4_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Fewer words than SHINGLE are one shingle; no word is an empty set."""
    for _, part, bounds_of in cut(data, offsets):
        starts, ends, bounds = word_spans(part, bounds_of)
        words = word_hashes(part, starts, ends)
        n = max(len(words) - SHINGLE + 1, 0)
        h = words[:n].copy()
        for i in range(1, SHINGLE):
            h = h * _BASE + words[i : n + i]
        h = mix(h)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(h[a : b - SHINGLE + 1])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    whole = whole * _BASE + w
                yield mix(mix(whole))
            else:
                yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    """64-bit digest of a set: documents with equal sets are one node of the join. 0 is the empty set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) or 1 if len(shingles) else 0


def _block_sets(row) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(doc_ids, sets, set ids, rows of the first document of each set that can link) of a block."""
    ids, offsets, data = read_block(row)
    sets = list(shingle_sets(data, offsets))
    sids = np.array([set_id(s) for s in sets], np.int64)
    _, first = np.unique(sids, return_index=True)
    return ids, sets, sids, np.sort(first[[len(sets[i]) > 1 for i in first]]) if len(first) else first


def _codes(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """Bucket in the high half, 32 bits of the hash in the low half: a shingle's print."""
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return ((h % np.uint64(buckets)) << np.uint64(32)) | ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF))


def _prints(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket the distinct prints, sorted, and in how many of the block's distinct sets each is.

    The block's documents (doc_id, size, set id) ride with the bucket of the block's number.
    """
    schema = "bucket int, block long, prints binary, docs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, sets, sids, first = _block_sets(r)
                code, times = np.unique(_codes([sets[i] for i in first], buckets), return_counts=True)
                low, edge = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(code, np.arange(buckets + 1).astype(np.uint64) << np.uint64(32))
                mine = r["block"] % buckets
                docs = pack(ids, np.array([len(s) for s in sets], np.int64), sids)
                out = []
                for b in range(buckets):
                    part, n = low[edge[b] : edge[b + 1]], np.minimum(times[edge[b] : edge[b + 1]], 0xFFFF)
                    if len(part) or b == mine:
                        step = np.diff(part, prepend=np.uint32(0))  # small where the block has many; its bytes by weight compress
                        out.append((b, r["block"], pack(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).ravel(), n.astype(np.uint16)), docs if b == mine else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow_type(schema).types, strict=True)], schema=arrow_type(schema))

    return blocks.mapInArrow(run, schema)


def _classes(prints: DataFrame) -> DataFrame:
    """Per block and bucket the classes of its prints in their order: 0 for a print in one set of the corpus, else by its count's logarithm."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values, counts = [], []
        for blob in group["prints"]:
            planes, n = unpack(blob, np.uint8, np.uint16)
            values.append(np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32))
            counts.append(n)
        value, n = np.concatenate(values), np.concatenate(counts).astype(np.int64)
        order = np.argsort(value)
        new = np.concatenate([[True], value[order][1:] != value[order][:-1]])[: len(order)]
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order], first) if len(first) else n
        kind = np.where(total > 1, 1 + np.floor(2 * np.log2(np.maximum(total, 2))), 0).astype(np.uint8)
        out = np.zeros(len(value), np.uint8)
        out[order] = kind[np.cumsum(new) - 1] if len(first) else out
        edge = np.cumsum([0, *map(len, values)])
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "classes": [pack(out[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], "docs": group["docs"]})

    return prints.groupBy("bucket").applyInPandas(run, "block long, bucket int, classes binary, docs binary")


def _documents(classes: DataFrame) -> DataFrame:
    """(doc_id, n, sid, block, row) of every document; sid is null for an empty set."""
    schema = "doc_id long, n long, sid long, block long, row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, n, sid = unpack(r["docs"], np.int64, np.int64, np.int64)
                rows = [pa.array(ids, mask=ids == NULL_ID), pa.array(n), pa.array(sid, mask=sid == 0), pa.array(np.full(len(ids), r["block"])), pa.array(np.arange(len(ids)))]
                yield pa.RecordBatch.from_arrays(rows, schema=arrow_type(schema))

    return classes.filter("docs is not null").select("block", "docs").mapInArrow(run, schema)


def prefix_keys(shingles: np.ndarray, kind: np.ndarray, rare: int) -> np.ndarray:
    """Index keys of a set, kind being its shingles' classes: two sets that link share one at least.

    Shingles are ordered from rare to frequent classes, then by hash. With x of them, no more than x - o may be missing from a
    partner, o = ceil(0.75 x); so the first x - o + 1 include a shared one. Where those are all rare, each is a key, but for
    those of class 0, which no other set has. Otherwise the frequent ones are split by hash into groups, and the prefix is
    extended by one shingle a group: then a partner that shares no rare one shares two of one group, so the pairs within the
    groups are keys. The number of groups follows the size's power of two; a set has keys for its own power and the next, as a
    smaller partner may be one power below.
    """
    x = len(shingles)
    need = x - -(-SHARE * x // 100) + 1
    order = np.lexsort((shingles, kind))
    shingles, kind = shingles[order], kind[order]
    n_rare = int(np.searchsorted(kind, rare, "right"))
    first = int(np.searchsorted(kind, 0, "right"))
    keys = [mix(shingles[first : max(first, min(need, n_rare))])]
    if n_rare < need:
        often = shingles[n_rare:]
        for power in (x.bit_length() - 1, x.bit_length()):
            groups = max(1, (1 << power) // 4)
            group = (mix(often + np.uint64(power)) % np.uint64(groups)).astype(np.int64)
            by = np.lexsort((often, group))
            g, h = group[by], often[by]
            gains = np.concatenate([[False], g[1:] == g[:-1]])
            end = int(np.searchsorted(np.cumsum(gains), need - n_rare)) + 1
            g, h = g[:end], h[:end]
            for step in range(1, int(np.bincount(g).max(initial=1))):
                same = np.flatnonzero(g[step:] == g[:-step])
                if not len(same):
                    break
                keys.append(mix(mix(h[same] * _BASE + h[same + step]) + np.uint64(power)))
    return np.concatenate(keys)


def _postings(blocks: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket the keys (40 bits), set ids and sizes."""
    schema = "bucket int, low binary, high binary, sids binary, sizes binary"
    rare = 1 + int(2 * np.log2(RARE))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        if not len(left):
            return none
        _, sets, sids, first = _block_sets(left.iloc[0])
        if not len(first):
            return none
        right = right.sort_values("bucket")
        kind = np.concatenate([unpack(x, np.uint8)[0] for x in right["classes"]])
        kind = kind[np.unique(_codes([sets[i] for i in first], buckets), return_inverse=True)[1]]
        size = np.array([len(sets[i]) for i in first], np.int64)
        begin = np.cumsum(size) - size
        alone = np.add.reduceat(kind == 0, begin, dtype=np.int64)
        held = []
        for k in np.flatnonzero(alone < size - -(-SHARE * size // 100) + 1):
            key = prefix_keys(sets[first[k]], kind[begin[k] : begin[k] + size[k]], rare)
            held.append((key, sids[first[k]], size[k]))
        if not held:
            return none
        key, count = np.concatenate([k for k, _, _ in held]), [len(k) for k, _, _ in held]
        sid, size = np.repeat(np.array([s for _, s, _ in held], np.int64), count), np.repeat(np.array([z for _, _, z in held], np.int32), count)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        value = (key // np.uint64(buckets))[order]
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        columns = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint8), sid[order], size[order]
        return pd.DataFrame([(b, *(v[edge[b] : edge[b + 1]].tobytes() for v in columns)) for b in np.flatnonzero(np.diff(edge))], columns=none.columns)

    return blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInPandas(run, schema)


def _candidates(postings: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets of a key's list whose sizes allow a link.

    A list is sorted by size and parted where the next size is too large for the one before. A bucket joins the runs of all its
    lists that have a set in common, and gives each set's edge to the smallest set id: no more edges than it has sets.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        value = np.frombuffer(b"".join(group["low"]), np.uint32).astype(np.uint64) | (np.frombuffer(b"".join(group["high"]), np.uint8).astype(np.uint64) << np.uint64(32))
        sid, size = np.frombuffer(b"".join(group["sids"]), np.int64), np.frombuffer(b"".join(group["sizes"]), np.int32).astype(np.int64)
        order = np.lexsort((size, value))
        value, sid, size = value[order], sid[order], size[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (SHARE * size[1:] > 100 * size[:-1])])
        run_of = np.cumsum(new) - 1
        least = np.minimum.reduceat(sid, np.flatnonzero(new))[run_of]
        on = sid != least
        nodes, ends = np.unique(np.concatenate([least[on], sid[on]]), return_inverse=True)
        a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
        low, before = np.arange(len(nodes)), None
        while before is None or (low != before).any():
            before, m = low.copy(), np.minimum(low[a], low[b])
            np.minimum.at(low, a, m)
            np.minimum.at(low, b, m)
            low = low[low]
        joined = np.flatnonzero(low != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[low[joined]], "b": nodes[joined]})

    return postings.groupBy("bucket").applyInPandas(run, "a long, b long").distinct()


def spanning_links(sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Positions of linked pairs that connect all sets which links connect: as many as sets less components.

    With two sides only pairs across them count, as those of one side are compared elsewhere. A hub's shingles are marked in a
    table of the shingles that two sets have, and counted in all sets of other components that fit its size.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, sides = size[order], sides[order]
    _, code, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[code]
    count = np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64)
    code = (np.cumsum(shared) - 1)[code[keep]].astype(np.int32)
    edge = np.concatenate([[0], np.cumsum(count)])
    both = sides.min() != sides.max()
    root, on, found = np.arange(len(sets)), np.zeros(int(shared.sum()), np.uint8), []
    fits = np.searchsorted(size, 100 * size // SHARE, "right")
    for hub in range(len(sets) - 1):
        other = np.arange(hub + 1, fits[hub])
        other = other[(root[other] != root[hub]) & ((100 + SHARE) * np.minimum(count[other], count[hub]) >= SHARE * (size[other] + size[hub]))]
        if both:
            other = other[sides[other] != sides[hub]]
        if not len(other):
            continue
        mine = code[edge[hub] : edge[hub + 1]]
        on[mine] = 1
        n = count[other]
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(edge[other] - begin, n) if len(other) < other[-1] - other[0] + 1 else slice(edge[other[0]], edge[other[-1] + 1])
        common = np.add.reduceat(on[code[at]], begin, dtype=np.int64)
        on[mine] = 0
        linked = other[(100 + SHARE) * common >= SHARE * (size[other] + size[hub])]
        if len(linked):
            roots, one = np.unique(root[linked], return_index=True)
            found += [(int(order[hub]), int(order[t])) for t in linked[one]]
            root[np.isin(root, np.append(roots, root[hub]))] = min(int(roots[0]), int(root[hub]))
    return found


def _tasks(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, block, row, cluster, i, j, side): where each set of a cluster is compared.

    A cluster within the bounds is one block of its own (i = j = 0). A larger one is dealt to blocks by a hash, and every pair
    of its blocks is a task of its own, whatever the cluster's size.
    """
    placed = clusters.withColumnRenamed("node", "sid").join(sets, "sid")
    total = placed.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / CLUSTER_SHINGLES, F.count("*") / CLUSTER_SETS)).alias("blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    rows = placed.join(total, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("sid", "block", "row", F.col("component").alias("cluster"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _texts(blocks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(cluster, i, j, side, sid, body): the texts of the tasks' sets."""
    schema = "cluster long, i long, j long, side int, sid long, body binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        _, offsets, data = read_block(left.iloc[0])
        row = right["row"].to_numpy()
        return right.assign(body=[data[a:b].tobytes() for a, b in zip(offsets[row], offsets[row + 1], strict=True)])[names]

    return blocks.groupBy("block").cogroup(tasks.groupBy("block")).applyInPandas(run, schema)


def _links(texts: DataFrame, width: int) -> DataFrame:
    """(a, b): linked sets, enough of them to connect what links connect within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sids, sides, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            found = spanning_links(sets, np.array(sides)) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([sids[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("cluster", "i", "j", "side", "sid")), strict=True)
            for (*key, side, sid), body in zip(keys, batch["body"], strict=True):
                if key != at:
                    if sets:
                        yield done()
                    at, sids, sides, sets = key, [], [], []
                data = np.frombuffer(body.as_buffer(), np.uint8) if len(body.as_buffer()) else np.zeros(0, np.uint8)
                sids.append(sid)
                sides.append(side)
                sets.append(next(shingle_sets(data, np.array([0, len(data)]))))
        if sets:
            yield done()

    dealt = texts.repartition(width, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def link(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n and set id of every document, and enough verified links between sets to give all components.

    First every shingle's number of sets is counted, so that a set's prefix begins with the shingles that no other has. Sets
    that share a key are candidates; a cluster that candidates connect is compared where its texts meet, exactly, and gives
    spanning links alone, never its pairs. The texts are stored in buckets of their block, so they stay where they are when
    what is known of a block is brought to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions(spark)
    blocks = scratch.write_bucketed(text_blocks(docs, BLOCK_BYTES), "blocks", "block", 2 * buckets)
    classes = scratch.write(_classes(_prints(blocks, buckets)), "classes")
    documents = scratch.write(_documents(classes), "documents")
    candidates = scratch.write(_candidates(_postings(blocks, classes, buckets)), "candidates")
    clusters = connected(candidates, scratch, "clusters")
    first = documents.groupBy("sid").agg(F.min(F.struct("block", "row", "n")).alias("at")).select("sid", "at.*")
    links = scratch.write(_links(_texts(blocks, _tasks(clusters, first)), buckets), "links")
    return documents, links


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every document.

    Null or empty text has an empty set and links with nothing; equal sets are linked; repeated rows are rows each; rows with a
    null doc_id link like others but never name a component; an empty table gives no rows. Extra columns, of whatever name, stay
    out; very long texts are cut in shingles slice by slice, and no shingle is left out.
    """
    scratch = Scratch(docs.sparkSession, "join")
    rows, links = link(docs, scratch)
    named = rows.filter(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("first"))
    placed = named.join(connected(links, scratch, "linked").withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = scratch.write(placed, "placed")
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_set = placed.join(lowest, "component").select("sid", "component_id")
    out = durable(rows.join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "join-components")
    scratch.drop()
    return out


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
