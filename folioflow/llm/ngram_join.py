"""N-gram Jaccard join: documents grouped by links of their shingle sets, by a blocked sparse product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folioflow.llm.common import checkpointed, release, shuffle_width
from folioflow.llm.components import components
from folioflow.llm.shingles import SKETCHES, set_key, shingle_sets, sketch

CHUNK = 1_000_000
BLOCK_CHARS = 800_000
KEY_BITS = 48
COMMON = 8
MANY = (1 << 16) - 1
COLUMNS = 64
ROWS = 4096
BATCH = 256
SEGMENTS = 4
TILE = 1024
SLICE = 256
SHARED_SALTS = 32
BROADCAST_IDS = 1_000_000
SKETCH_NAMES = [f"sketch{words}" for words, _ in SKETCHES]


def _runs(ids: list, texts: list, limit: int = CHUNK):
    """Slices of a batch whose texts have about `limit` characters together, and less than MANY rows."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= limit or i + 2 - start >= MANY:
            yield ids[start : i + 1], texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.array([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(values.view(np.int64)))


def _bytes(arrays) -> pa.Array:
    return pa.array([None if a is None else np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def _rows(batches):
    """The rows of batches as tuples; few are held as Python values at a time, for a batch of blocks can be large."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns))
        del batch
        pa.default_memory_pool().release_unused()


def _groups(batches, keys: int):
    """Consecutive rows with equal first `keys` columns, as (key, rows)."""
    key, held = None, []
    for row in _rows(batches):
        if row[:keys] != key:
            if held:
                yield key, held
            key, held = row[:keys], []
        held.append(row[keys:])
    if held:
        yield key, held


def describe_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and set_key of every row."""

    def run(batches):
        for batch in batches:
            for ids, texts in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets = shingle_sets(texts, k)
                columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "set_key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary")


def _incidence(docs: DataFrame, k: int, shard_bits: int) -> DataFrame:
    """The document by shingle matrix in blocks of some documents and one shard of the shingles: (shard, block, words, counts).

    A word holds KEY_BITS of the shingle's hash below those that number the shard, and the document's place in its block. A
    shingle that COMMON or more documents of the block have is one word, with their number in counts, so that a shingle
    with a third of all documents is as many words as there are blocks. One more row of each block, with a negative
    shard, has its documents (ids, sizes) and which of them have such a shingle (owners)."""
    shards = 1 << shard_bits

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist(), BLOCK_CHARS):
                found = [(i, s) for some, part in _runs(ids, texts) for i, s in zip(some, shingle_sets(part, k)) if len(s)]
                if not found:
                    continue
                serial += 1
                sizes = np.array([len(s) for _, s in found], np.int64)
                flat = np.concatenate([s for _, s in found])
                order = np.argsort(flat, kind="stable")
                keys = flat[order] >> np.uint64(64 - KEY_BITS - shard_bits)
                owners = np.repeat(np.arange(len(found)), sizes)[order].astype(np.uint64)
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                counts = np.diff(np.concatenate((first, [len(keys)])))
                common = counts >= COMMON
                of_common = np.repeat(common, counts)
                put = np.repeat(counts, counts)
                keep = ~of_common
                keep[first[common]] = True
                places = np.where(of_common, np.uint64(MANY), owners)
                words = ((keys << np.uint64(16)) | places)[keep]
                number = np.where(of_common, put, 1)[keep].astype(np.int32)
                at = np.searchsorted(keys[keep], np.arange(shards + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
                full = np.flatnonzero(np.diff(at))
                none = [None] * len(full)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([-1 - serial % shards, *full.tolist()], pa.int64()), pa.array([serial] * (len(full) + 1), pa.int64()),
                        _bytes([keys[first[common]], *[words[at[s] : at[s + 1]] for s in full]]),
                        _bytes([counts[common].astype(np.int32), *[number[at[s] : at[s + 1]] for s in full]]),
                        _bytes([np.array([i for i, _ in found], np.int64), *none]), _bytes([sizes, *none]), _bytes([owners[of_common].astype(np.uint16), *none]),
                    ],
                    names=["shard", "block", "words", "counts", "ids", "sizes", "owners"],
                )

    return docs.mapInArrow(run, "shard long, block long, words binary, counts binary, ids binary, sizes binary, owners binary")


def _column_counts(incidence: DataFrame) -> DataFrame:
    """In how many documents each shingle of a shard stands; (block, shard, words, counts) returns to the blocks the shingles
    of two documents or more, with that number. Rows with the blocks' documents pass through."""

    def run(batches):
        names = ["block", "shard", "words", "counts", "ids", "sizes", "owners"]
        for (shard,), rows in _groups(batches, 1):
            if shard < 0:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))], names=names
                )
                continue
            words = np.frombuffer(b"".join(r[1] for r in rows), np.uint64)
            counts = np.frombuffer(b"".join(r[2] for r in rows), np.int32)
            keys = words >> np.uint64(16)
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
            total = np.add.reduceat(counts[order].astype(np.int64), first)
            having = np.empty(len(keys), np.int32)
            having[order] = np.repeat(np.minimum(total, (1 << 31) - 1), np.diff(np.concatenate((first, [len(keys)]))))
            ends = np.cumsum([len(r[1]) // 8 for r in rows])
            out = []
            for r, a, b in zip(rows, [0, *ends.tolist()], ends.tolist()):
                at = a + np.flatnonzero(having[a:b] > 1)
                if len(at):
                    out.append((r[0], words[at], having[at]))
            if out:
                none = [None] * len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([shard] * len(out), pa.int64()), *(_bytes([o[i] for o in out]) for i in (1, 2)), *[_bytes(none)] * 3], names=names
                )

    dealt = incidence.repartition("shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, "block long, shard long, words binary, counts binary, ids binary, sizes binary, owners binary")


def index_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of the matrix without columns of one document: doc_id, n (size of the set), alone (shingles of no other
    document), grams (the others, sorted), lead (the first of them in order of document frequency) and parity sketches of grams.

    A set with n shingles overlaps any similar one in percent n / 100 or more, so that two similar sets share one of
    the first n - that + 1 shingles of both in any common order. Ordered by frequency these are the rarest; documents whose
    first ones are all in no other document are left out, for they link with nothing."""
    shard_bits = min(15, (4 * shuffle_width(docs.sparkSession) - 1).bit_length())
    counted = _column_counts(_incidence(docs, k, shard_bits)).repartition("block").sortWithinPartitions("block", "shard")

    def run(batches):
        for _, rows in _groups(batches, 1):
            _, keys, counts, ids, sizes, owners = rows[0]
            own_keys, own_counts, ids, sizes = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
            own_places, own_at = np.frombuffer(owners, np.uint16), np.concatenate(([0], np.cumsum(own_counts)))
            if len(rows) == 1:
                continue
            words = np.frombuffer(b"".join(r[1] for r in rows[1:]), np.uint64)
            shard = np.repeat(np.array([r[0] for r in rows[1:]], np.uint64), [len(r[1]) // 8 for r in rows[1:]])
            keys, places = (words >> np.uint64(16)) | (shard << np.uint64(KEY_BITS)), (words & np.uint64(MANY)).astype(np.uint16)
            having = np.frombuffer(b"".join(r[2] for r in rows[1:]), np.int32)
            many = places == MANY
            at = np.searchsorted(own_keys, keys[many])
            lengths = own_counts[at]
            inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            places = np.concatenate((places[~many], own_places[np.repeat(own_at[at], lengths) + inner])).astype(np.int64)
            having = np.concatenate((having[~many], np.repeat(having[many], lengths)))
            keys = np.concatenate((keys[~many], np.repeat(keys[many], lengths)))
            order = np.lexsort((keys, having, places))
            keys, shared = keys[order], np.bincount(places, minlength=len(ids))
            ends = np.cumsum(shared)
            alone = sizes - shared
            lead = np.minimum(shared, sizes - (sizes * percent + 99) // 100 + 1 - alone)
            good = np.flatnonzero(lead > 0).tolist()
            grams = [np.sort(keys[ends[i] - shared[i] : ends[i]]) for i in good]
            if good:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[good]), pa.array(sizes[good]), pa.array(alone[good]), _bytes(grams),
                        _lists([keys[ends[i] - shared[i] : ends[i] - shared[i] + lead[i]] for i in good]),
                        *[_lists([sketch(g, words).view(np.uint64) if sizes[i] >= least else g[:0] for i, g in zip(good, grams)]) for words, least in SKETCHES],
                    ],
                    names=["doc_id", "n", "alone", "grams", "lead", *SKETCH_NAMES],
                )

    return counted.mapInArrow(run, "doc_id long, n long, alone long, grams binary, lead array<long>, " + ", ".join(f"{c} array<long>" for c in SKETCH_NAMES))


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / F.lit(float(100 + percent)) - 1e-9)


def _may_link(l: str, r: str, percent: int) -> Column:
    """Whether rows l and r may link: by their sizes, and by the shingles in which they differ, which are those that are alone and
    at least as many as the bits in which sketches of the others differ."""
    def bits(name: str):
        return F.aggregate(F.zip_with(f"{l}.{name}", f"{r}.{name}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)

    differ = bits(SKETCH_NAMES[0])
    for (_, least), name in zip(SKETCHES[1:], SKETCH_NAMES[1:]):  # the longest that both have
        differ = F.when(F.least(f"{l}.n", f"{r}.n") >= least, bits(name)).otherwise(differ)
    sizes = F.least(f"{l}.n", f"{r}.n") * 100 >= F.greatest(f"{l}.n", f"{r}.n") * percent
    return sizes & ((differ + F.col(f"{l}.alone") + F.col(f"{r}.alone")) * (100 + percent) <= (F.col(f"{l}.n") + F.col(f"{r}.n")) * (100 - percent))


def _possible(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches do not rule out; whole rows travel for these alone."""
    own = rows.select("doc_id", "n", "alone", *SKETCH_NAMES)
    met = pairs.alias("p").join(own.alias("l"), F.col("p.a") == F.col("l.doc_id")).join(own.alias("r"), F.col("p.b") == F.col("r.doc_id"))
    return met.where(_may_link("l", "r", percent)).select("p.a", "p.b").distinct()


def product(rows: list, columns: list, wanted: np.ndarray, percent: int) -> np.ndarray:
    """Which wanted pairs of rows and columns, each (size, sorted shingles), overlap enough to link.

    Overlap counts are accumulated over SEGMENTS ranges of shingles. Pairs are discarded by their sizes before, and after each range
    where the count and what the smaller rest can add stay below the least overlap of a link."""
    row_n, col_n = (np.array([n for n, _ in side], np.int64) for side in (rows, columns))
    need = -(-percent * (row_n[:, None] + col_n[None, :]) // (100 + percent))
    at_gram, at_column = np.concatenate([g for _, g in columns]), np.repeat(np.arange(len(columns)), [len(g) for _, g in columns])
    order = np.argsort(at_gram, kind="stable")
    at_gram, at_column = at_gram[order], at_column[order]
    borders = at_gram[[len(at_gram) * s // SEGMENTS for s in range(1, SEGMENTS)]]
    row_cuts, col_cuts = (np.array([[0, *np.searchsorted(g, borders).tolist(), len(g)] for _, g in side], np.int64) for side in (rows, columns))
    count = np.zeros(wanted.shape, np.int64)
    alive = wanted & (np.minimum(row_cuts[:, -1][:, None], col_cuts[:, -1][None, :]) >= need)
    for s in range(SEGMENTS):
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            break
        pieces = [rows[i][1][row_cuts[i, s] : row_cuts[i, s + 1]] for i in some]
        flat, owner = np.concatenate(pieces), np.repeat(some, [len(p) for p in pieces])
        low, high = np.searchsorted(at_gram, flat), np.searchsorted(at_gram, flat, side="right")
        hits = high - low
        inner = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        cell = np.repeat(owner, hits) * len(columns) + at_column[np.repeat(low, hits) + inner]
        count += np.bincount(cell, minlength=count.size).reshape(count.shape)
        rest = np.minimum((row_cuts[:, -1] - row_cuts[:, s + 1])[:, None], (col_cuts[:, -1] - col_cuts[:, s + 1])[None, :])
        alive &= count + rest >= need
    return alive


def linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches percent / 100, by a blocked sparse product.

    A block holds about COLUMNS column documents b and up to about ROWS row documents a; each row travels once to a block with
    the columns it is wanted with, each column once to each block. Rows are multiplied BATCH at a time."""
    blocks = max(1, pairs.select("b").distinct().count() // COLUMNS)
    placed = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("block"))
    shares = placed.groupBy("block").agg(F.ceil(F.count("*") / F.lit(ROWS)).cast("long").alias("shares"))
    placed = checkpointed(placed.join(shares, "block").select("a", "b", "block", F.pmod(F.xxhash64("a"), "shares").alias("share")))
    own = rows.select("doc_id", "n", "grams")
    heads = placed.select("block", "share", "b").distinct().join(own, F.col("b") == F.col("doc_id"))
    bodies = placed.groupBy("block", "share", "a").agg(F.collect_set("b").alias("columns")).join(own, F.col("a") == F.col("doc_id"))
    dealt = heads.select("block", "share", F.lit(0).alias("side"), "doc_id", "n", "grams", F.lit(None).cast("array<long>").alias("columns")).union(
        bodies.select("block", "share", F.lit(1).alias("side"), "doc_id", "n", "grams", "columns")
    ).repartition("block", "share").sortWithinPartitions("block", "share", "side")

    def run(batches):
        key, columns, held = None, [], []

        def flush():
            names = np.array([b for b, _ in columns], np.int64)
            wanted = np.stack([np.isin(names, w) for _, _, w in held])
            good = product([r for _, r, _ in held], [c for _, c in columns], wanted, percent)
            i, j = np.nonzero(good)
            a = np.array([a for a, _, _ in held], np.int64)[i]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(names[j])], names=["a", "b"])

        for block, share, side, doc_id, n, grams, wanted in _rows(batches):
            if (block, share) != key:
                if held:
                    yield flush()
                key, columns = (block, share), []
            row = (n, np.frombuffer(grams, np.uint64))
            if side == 0:
                columns.append((doc_id, row))
            else:
                held.append((doc_id, row, wanted))
                if len(held) >= BATCH:
                    yield flush()
        if held:
            yield flush()

    out = checkpointed(dealt.mapInArrow(run, "a long, b long").distinct())
    release(placed)
    return out


def _met(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of l and r that meet at a shingle of both leads: what can follow it in both must suffice for a link."""
    rest = 1 + F.least(F.col("l.n") - F.col("l.at") - 1, F.col("r.n") - F.col("r.at") - 1)
    sizes = F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent
    return met.where((F.col("l.doc_id") != F.col("r.doc_id")) & sizes & (rest >= _least_overlap(F.col("l.n"), F.col("r.n"), percent)))


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, common): every document with the hub of each of its lead shingles, and how many they have in common. The hub of a shingle
    is the document with the least share of shingles of its own."""
    hub = F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "doc_id", "n", "at")).alias("hub")
    hubs = entries.groupBy("key").agg(hub, F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("key", "hub.*")
    met = _met(entries.alias("l").join(hubs.alias("r"), F.col("l.key") == F.col("r.key")), percent)
    return met.groupBy(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).agg(F.count("*").alias("common"))


def cross_pairs(entries: DataFrame, rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that share a lead shingle and that no bound rules out.

    The documents of a shingle are dealt into tiles; two tiles meet in one task, which tests sizes, places in the order and
    sketches of all their pairs as arrays and gives only those that may link. Shingles whose documents are in one component
    are left out, so that the work of a group of copies is the square of the components it still has, at most."""
    own = labels.select(F.col("node").alias("its_id"), "label")
    named = checkpointed(entries.join(own, entries["doc_id"] == own["its_id"], "left").select("key", "doc_id", "n", "at", "alone", F.coalesce("label", "doc_id").alias("label")))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y")
    mixed = checkpointed(mixed.select("key", F.ceil(F.col("size") / F.lit(TILE)).cast("int").alias("tiles")))
    sketches = rows.select(F.col("doc_id").alias("its_id"), F.col(SKETCH_NAMES[0]).alias("sketch"), F.col("n").alias("its_n"), F.col("alone").alias("its_alone"))
    members = named.join(mixed, "key").join(sketches, (F.col("doc_id") == F.col("its_id")) & (F.col("n") == F.col("its_n")) & (F.col("alone") == F.col("its_alone")))
    tile = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    pairs_of_tiles = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda o: F.struct(F.least(o, F.col("tile")).alias("i"), F.greatest(o, F.col("tile")).alias("j"), (o < F.col("tile")).cast("int").alias("side")),
    )
    dealt = (
        members.withColumn("tile", tile).withColumn("meet", F.explode(pairs_of_tiles))
        .select("key", "meet.i", "meet.j", "meet.side", "doc_id", "n", "at", "alone", "label", "sketch")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    )

    def run(batches):
        for (_, i, j), rows_ in _groups(batches, 3):
            side, doc, n, at, alone, label = (np.array([r[c] for r in rows_], np.int64) for c in range(6))
            marks = np.array([r[6] for r in rows_], np.int64).view(np.uint64)
            left = np.arange(len(doc)) if i == j else np.flatnonzero(side == 0)
            right = left if i == j else np.flatnonzero(side == 1)
            for a in range(0, len(left), TILE):
                l = left[a : a + TILE, None]
                r = right[None, :]
                both = n[l] + n[r]
                good = (label[l] != label[r]) & ((doc[l] > doc[r]) if i == j else (doc[l] != doc[r]))
                good &= np.minimum(n[l], n[r]) * 100 >= np.maximum(n[l], n[r]) * percent
                good &= np.minimum(n[l] - at[l], n[r] - at[r]) * (100 + percent) >= both * percent
                x, y = np.nonzero(good)
                x, y = l[x, 0], r[0, y]
                differ = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64) + alone[x] + alone[y]
                may = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
                x, y = doc[x[may]], doc[y[may]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different labels; a node without one is its own."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SHARED_SALTS))


def _salted(classes: DataFrame) -> DataFrame:
    """Classes of several rows, once for each salt, so that a class with a third of all rows is met by many tasks."""
    return classes.select(F.col("set_key").alias("k"), "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARED_SALTS - 1).cast("long"))).alias("salt"))


def _without(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs without the ids of copies. The ids are broadcast while they are few; beyond, texts are joined with them by shuffle, in
    an order that a repeated task meets again."""
    if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(copies), "doc_id", "left_anti")
    return docs.join(copies, "doc_id", "left_anti").sortWithinPartitions("doc_id", "text")


def jaccard_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Documents link when 100 * |intersection| >= percent * |union| of their k-word shingle sets; component_id is the
    smallest doc_id reachable. Equal sets are one node. The document by shingle matrix is dealt into blocks, columns are counted,
    and each document keeps its shingles in order of frequency (index_rows); similar sets share one of the first ones of both.
    Not all pairs that share one are multiplied: each document meets the hub of each such shingle first, the nearest one before
    the others, and then those of other components that bounds do not rule out (cross_pairs). A pair is left untested only
    when both ends are in one component already or a bound rules its link out, so no link is lost.

    Null or blank texts have empty sets, are linked with nothing and are their own component. Rows that share a
    doc_id are one document node; rows without a doc_id link nothing and get the smallest doc_id with their set,
    null if there is none. Empty tables give no rows; other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = checkpointed(describe_sets(docs, k))
    classes = described.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    several = checkpointed(classes.where("rows > 1").select("set_key", "rep"))
    equal = described.select("doc_id", "set_key").join(_salted(several), [F.col("set_key") == F.col("k"), _salt("doc_id") == F.col("salt")]).where("doc_id <> rep").select("doc_id")
    # a doc_id with two sets may copy one and stand for the other
    two = described.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    copies = checkpointed(equal.distinct().join(two, "doc_id", "left_anti"))
    rows = checkpointed(index_rows(_without(docs.where("doc_id is not null"), copies), k, percent))
    lead = rows.select("doc_id", "n", "alone", F.posexplode("lead").alias("i", "key"))
    entries = lead.select("key", "doc_id", "n", "alone", (F.col("alone") + F.col("i")).alias("at"))

    stars = checkpointed(star_pairs(entries, percent))
    near = stars.groupBy("a").agg(F.max(F.struct("common", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    links = linked(checkpointed(_possible(near, rows, percent)), rows, percent)
    labels = components(links)
    rest = _labelled(stars.select("a", "b").join(near, ["a", "b"], "left_anti"), labels)
    more = linked(checkpointed(_possible(rest, rows, percent)), rows, percent)
    if more.take(1):
        links = checkpointed(links.union(more))
        labels = components(links)
    done = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cross = cross_pairs(entries, rows, labels, percent).join(done, ["a", "b"], "left_anti")
    more = linked(checkpointed(_possible(cross, rows, percent)), rows, percent)
    if more.take(1):
        labels = components(links.union(more))
    release(rows, stars)

    return (
        described.select("doc_id", "n", "set_key")
        .join(_salted(several), [F.col("set_key") == F.col("k"), _salt("doc_id") == F.col("salt")], "left")
        .withColumn("node", F.coalesce("rep", "doc_id"))
        .join(labels, "node", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "node")).alias("component_id"),
        )
    )


def keep_one_each(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id. Repeated rows of one doc_id and rows without a
    doc_id all stay; keep_one_row_each drops them too."""
    groups = jaccard_groups(docs, k, percent)
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def _with_set_key(docs: DataFrame, k: int) -> DataFrame:
    """The rows of docs with repeat_key, the digest of their shingle set; null for blank texts."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keys = [set_key(s) if len(s) else None for _, part in _runs(texts, texts) for s in shingle_sets(part, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*names, "repeat_key"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("repeat_key", BinaryType())]))


def drop_repeated_rows(docs: DataFrame, k: int = 3) -> DataFrame:
    """docs with one row of each doc_id and shingle set, and of rows without a doc_id one of each set, none if a row with
    an id has that set. Of several the smallest stays. Rows of blank or null texts all stay.

    Only rows without an id or with an id that occurs again are looked at; copies are aggregated in each task first, so
    that no group is gathered."""
    again = checkpointed(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).agg(F.count("*").alias("again_n")).where("again_n > 1").select("again_id"))
    hit = docs["doc_id"] == again["again_id"]
    looked = _with_set_key(docs.where("doc_id is null").union(docs.join(again, hit, "left_semi")), k)
    of_no_id = docs.where("doc_id is null").take(1)
    if not of_no_id and not again.take(1):
        return docs
    one = looked.where("repeat_key is not null").groupBy("doc_id", "repeat_key").agg(F.min(F.struct(*docs.columns)).alias("one"))
    if of_no_id:
        known = _with_set_key(docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")), k)
        known = known.where("repeat_key is not null").select(F.col("repeat_key").alias("known_key")).distinct()
        one = one.join(known, one["doc_id"].isNull() & (one["repeat_key"] == known["known_key"]), "left_anti")
    alone = docs.where("doc_id is not null").join(again, hit, "left_anti")
    return alone.union(looked.where("repeat_key is null").select(*docs.columns)).union(one.select("one.*"))


def keep_one_row_each(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row of each group of near copies, also where rows are repeated or have no doc_id."""
    return keep_one_each(drop_repeated_rows(docs, k), k, percent)
