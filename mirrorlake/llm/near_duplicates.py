"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct shingles of ``words`` words.  Equal sets are one class, which has a
node number of its own and stands for its documents from here on.  A signature is ``CHUNKS`` x ``WIDE`` MinHash
values of 16 bits; the distance of two signatures is the number of values that differ.

Multi-index join.  Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 values have, by the
pigeonhole principle, a chunk in which at most ERRORS differ.  Every way of leaving out ERRORS values of
a chunk is enumerated as a key, so such a pair meets under a key for certain.  With 10 chunks of 5 and
one error, sets of similarity 0.8 meet but for a chance of 2e-6.

Buckets of more than ``BLOCK`` members are few (at most the index's rows by ``BLOCK``), so what belongs to such a bucket is
broadcast to its members, or joined by salts where even these are too many; no key's rows meet in one task.

Buckets are not expanded into pairs.  In ``ROUNDS`` rounds each member of a bucket is set beside the
bucket's hub only (the member of least rank in that round's order), of its hubs the two most promising
are verified on the full sets, and components are formed.  A bucket all of whose members are in one
component needs nothing more.  In the others all pairs of members of different components that are
close enough by signature are verified; a bucket of more than ``BLOCK`` members is dealt out over blocks, so
no task holds more than two blocks of one.  No link between different sets that meet is thus left
untested unless both are already connected.

Full sets (sorted 40-bit hashes) of the documents that share a bucket are written once as files in the
shared folder and mapped by the workers, which compare exact sizes of intersection and union where the
candidates arise: neither sets nor untested pairs are shuffled.

Documents without words have an empty set and link with nothing; with fewer words than a shingle the
whole sequence is the one shingle.  Rows with a null doc_id link with nothing.  Rows that repeat a doc_id are
one document: each row has its own set and all of them are linked.  Texts of any length are taken whole.  An
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, local_path, put_bytes, settle, shared_dir, worker_cache
from .components import components
from .kneser_ney import SHARD_BYTES, mix, text_batches, word_hash, words_of

CHUNKS, WIDE, ERRORS = 10, 5, 1
VALUES = CHUNKS * WIDE
#: Pairs further apart are not verified: similarity 0.8 gives 10 differing values in the mean, and more than this with a chance of about 1e-7.
FARTHEST = 26
ROUNDS, BLOCK = 2, 2048
#: Of a worker: files of sets mapped at once, and members of sets unpacked at once.
MOST_MAPS, RECENT = 512, 4_000_000
#: Rows (a few numbers each) that may be broadcast.
MOST_BROADCAST = 2_000_000
PROFILE = "doc_id long, n_shingles long, set_hash binary, signature binary"

_SEEDS = np.random.default_rng(20240501).integers(1, 2**63, (VALUES, 2), dtype=np.uint64) | np.uint64(1)


class Hashes:
    """Word hashes of a worker process, remembered up to a bound."""

    def __init__(self, keep: int = 250_000):
        self.known: dict[bytes, int] = {}
        self.keep = keep

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    h = found[i] = word_hash(w)
                    if len(w) < 64:
                        known[w] = h
        return np.array(found, np.uint64)


@worker_cache("near-duplicates")
def hashes() -> Hashes:
    return Hashes()


def shingle_sets(texts: list[list[bytes]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the number of each text's."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = hashes().of([w for t in texts for w in t])
    first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    n = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(texts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) + first[text]
    last = (first + size)[text]
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = at + k < last
        h[inside] = mix(h[inside] * np.uint64(0x9E3779B97F4A7C15) + flat[at[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.bincount(text, minlength=len(texts))


def signatures(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """16-bit MinHash values (rows x VALUES) of the sets; zeros for empty sets."""
    out = np.zeros((len(count), VALUES), np.uint16)
    some = np.flatnonzero(count)
    if len(some):
        first = np.concatenate(([0], np.cumsum(count[some])[:-1]))
        for k in range(VALUES):
            least = np.minimum.reduceat((h ^ _SEEDS[k, 1]) * _SEEDS[k, 0], first)
            out[some, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """Per document: the size of its set, a 128-bit hash of the set and its signature."""
    batches(docs.sparkSession)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for others, texts in text_batches(stream, words_of, 200_000):
            h, count = shingle_sets(texts, words)
            sig = signatures(h, count)
            ends = np.cumsum(count).tolist()
            data = h.tobytes()
            digests = [xxhash.xxh3_128_digest(data[8 * (e - n) : 8 * e]) for e, n in zip(ends, count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in others], pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")).mapInArrow(work, PROFILE)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """Keys (rows x keys) of the signatures: each chunk with each choice of ERRORS values left out."""
    keys = []
    for chunk in range(CHUNKS):
        for kept in itertools.combinations(range(WIDE), WIDE - ERRORS):
            h = np.full(len(sig), len(keys) + 1, np.uint64)
            for i in kept:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, chunk * WIDE + i])
            keys.append(h)
    return np.column_stack(keys).view(np.int64)


def entries(representatives: DataFrame) -> DataFrame:
    """(key, node, slot) for every key of every representative; the slot is the key's number."""
    per = CHUNKS * math.comb(WIDE, ERRORS)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                keys = index_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, VALUES))
                slots = np.tile(np.arange(per, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), per)), pa.array(slots)], names=["key", "node", "slot"])

    return representatives.select("node", "signature").mapInArrow(work, "key long, node long, slot int")


def distances(pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the distance of their signatures, those too far apart left out."""
    side = lambda c: representatives.select(F.col("node").alias(c), F.col("signature").alias(f"s{c}"))

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, VALUES) for i in (2, 3))
                d = (x != y).sum(1)
                near = d <= FARTHEST
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[near]), pa.array(batch.column(1).to_numpy()[near]), pa.array(d[near].astype(np.int32))], names=["a", "b", "distance"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long, distance int")


def store_sets(docs: DataFrame, wanted: DataFrame, words: int, root: str) -> SetFiles:
    """Write the sets of the ``wanted`` classes (doc_id of a row that has it, set_hash, node) as files in the shared folder, in shards of bounded size."""
    spark = docs.sparkSession
    needed = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")).join(few(wanted), "doc_id").select("text", "node", "set_hash")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))

    def build(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for others, texts in text_batches(stream, words_of, 200_000):
            h, count = shingle_sets(texts, words)
            ends = np.cumsum(count).tolist()
            full, short = h.tobytes(), np.ascontiguousarray((h >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            # a doc_id may stand on several rows: the one whose set it is
            kept = [(node, short[5 * (e - n) : 5 * e]) for (node, wants), e, n in zip(others, ends, count.tolist(), strict=True) if xxhash.xxh3_128_digest(full[8 * (e - n) : 8 * e]) == wants]
            nodes = np.array([k[0] for k in kept], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(nodes, shards).astype(np.int32)), pa.array(nodes), pa.array([k[1] for k in kept], pa.binary())], names=["shard", "node", "members"])

    def keep(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("node").to_numpy(), return_index=True)  # rows of one node are equal
        data = [table.column("members")[k].as_py() for k in first.tolist()]
        ends = np.concatenate(([0], np.cumsum([len(x) // 5 for x in data]))).astype(np.int64)
        shard = table.column("shard")[0].as_py()
        put_bytes(f"{root}/sets-{shard}", np.int64(len(ids)).tobytes() + ids.tobytes() + ends.tobytes() + b"".join(data))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    settle(spark, needed.mapInArrow(build, "shard int, node long, members binary").repartition(shards, "shard").groupBy("shard").applyInArrow(keep, "shard int"), f"{root}/stored")
    return SetFiles(root, shards)


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


@dataclass(frozen=True)
class SetFiles:
    root: str
    shards: int


class Sets:
    """Full sets (sorted 40-bit hashes), mapped from the shared folder."""

    def __init__(self, files: SetFiles):
        self.files = files
        self.maps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.recent: dict[int, np.ndarray] = {}
        self.held = 0

    def get(self, node: int) -> np.ndarray:
        found = self.recent.get(node)
        if found is None:
            s = int(shard_of(np.array([node], np.int64), self.files.shards)[0])
            if s not in self.maps:
                if len(self.maps) >= MOST_MAPS:
                    self.maps.pop(next(iter(self.maps)))
                raw = np.memmap(local_path(f"{self.files.root}/sets-{s}"), np.uint8, "r")
                n = int(raw[:8].view(np.int64)[0])
                self.maps[s] = raw[8 : 8 * n + 8].view(np.int64), raw[8 * n + 8 : 16 * n + 16].view(np.int64), raw[16 * n + 16 :]
            ids, ends, data = self.maps[s]
            k = int(np.searchsorted(ids, node))
            a, b = int(ends[k]), int(ends[k + 1])
            wide = np.zeros((b - a, 8), np.uint8)
            wide[:, :5] = data[5 * a : 5 * b].reshape(-1, 5)
            found = wide.view(np.uint64).ravel()
            if len(found) < RECENT // 100:
                if self.held > RECENT:
                    self.recent.clear()
                    self.held = 0
                self.recent[node] = found
                self.held += len(found)
        return found

    def alike(self, a: int, others: list[int], percent: int) -> list[bool]:
        """Whether the set of ``a`` and each of the others' are similar enough, by exact sizes."""
        x, out = self.get(a), []
        at = 0
        while at < len(others):
            sets, n = [], 0
            while at < len(others) and (not sets or n < 500_000):
                sets.append(self.get(others[at]))
                n += len(sets[-1])
                at += 1
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            every = np.concatenate(sets)
            hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size)[:-1])))
            out += (100 * both >= percent * (len(x) + size - both)).tolist()
        return out


@worker_cache("near-duplicates")
def sets_of(files: SetFiles) -> Sets:
    return Sets(files)


def verified(pairs: DataFrame, files: SetFiles, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = sets_of(files)
        for batch in stream:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = np.array([sets.alike(y, [x], percent)[0] for x, y in zip(a, b, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(i).to_numpy()[hit]) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b").mapInArrow(compare, "a long, b long")


def few(ids: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Ids that are broadcast if a count shows them to be few (a long each), else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def cross_links(members: DataFrame, files: SetFiles, percent: int) -> DataFrame:
    """Links between members of one bucket in different components, tested on the full sets where they are.

    ``members``: bucket, node, component, signature, part (0, 1, or 2 for both sides), slot, n.  A pair that
    shares several buckets is tested in that of the first key on which its signatures agree.  Once two
    components are linked within a bucket, their other pairs there need no test.  Only links leave the task.
    """
    agree = key_matrix()

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = sets_of(files)
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            bucket, node, comp, part, slot, size = (table.column(i).to_numpy() for i in (0, 1, 2, 4, 5, 6))
            sig = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint16).reshape(-1, VALUES)
            found, offset = [], 1
            while offset < len(bucket):
                same = np.flatnonzero(bucket[:-offset] == bucket[offset:])
                if not len(same):
                    break
                i = same[(comp[same] != comp[same + offset]) & ((part[same] == 2) | (part[same] != part[same + offset]))]
                i = i[100 * np.minimum(size[i], size[i + offset]) >= percent * np.maximum(size[i], size[i + offset])]
                for at in range(0, len(i), 50_000):
                    x = i[at : at + 50_000]
                    equal = sig[x] == sig[x + offset]
                    near = VALUES - equal.sum(1) <= FARTHEST
                    x, equal = x[near], equal[near]
                    first = (equal.astype(np.int16) @ agree == WIDE - ERRORS).argmax(1) == slot[x]
                    x = x[first]
                    found.append(np.stack([x, x + offset, VALUES - equal[first].sum(1)]))
                offset += 1
            links: list[tuple[int, int]] = []
            pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            if pairs.shape[1]:
                x, y, d = pairs[:, np.lexsort((pairs[2], pairs[0]))]
                joined: dict[int, int] = {}

                def find(c: int) -> int:
                    while joined.get(c, c) != c:
                        c = joined[c]
                    return c

                edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    me, mine = int(node[x[a]]), int(comp[x[a]])
                    for at in range(a, b, 64):
                        rows = [int(r) for r in y[at : min(b, at + 64)] if find(int(comp[r])) != find(mine)]
                        if rows:
                            for r, same_enough in zip(rows, sets.alike(me, [int(node[r]) for r in rows], percent), strict=True):
                                if same_enough:
                                    links.append((me, int(node[r])))
                                    joined[find(mine)] = find(int(comp[r]))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in stream:
            if not batch.num_rows:
                continue
            # rows come sorted by bucket: what precedes the batch's last bucket is complete
            start = int(np.searchsorted(batch.column(0).to_numpy(), batch.column(0)[-1].as_py()))
            if start:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            held.append(batch.slice(start))
        if held:
            yield flush(pa.Table.from_batches(held))

    return members.select("bucket", "node", "component", "signature", "part", "slot", "n").mapInArrow(work, "a long, b long")


def key_matrix() -> np.ndarray:
    """VALUES x keys: which values each key is made of."""
    columns = []
    for chunk in range(CHUNKS):
        for kept in itertools.combinations(range(WIDE), WIDE - ERRORS):
            column = np.zeros(VALUES, np.int16)
            column[[chunk * WIDE + i for i in kept]] = 1
            columns.append(column)
    return np.column_stack(columns)


def salts() -> Column:
    """Into how many parts a bucket is dealt."""
    return F.ceil(F.col("held") / BLOCK).cast("long")


def with_bucket(rows: DataFrame, made: Callable[[DataFrame], DataFrame], most_large: int) -> DataFrame:
    """``rows`` (key, node, held) joined by key with ``made`` of them, one row a key.  ``most_large``: a bound of the number of large buckets."""
    small, large = rows.where(F.col("held") <= BLOCK), rows.where(F.col("held") > BLOCK)
    joined = small.join(made(small), "key")
    if not most_large:
        return joined
    per_key = made(large)
    if most_large <= MOST_BROADCAST:
        return joined.unionByName(large.join(F.broadcast(per_key), "key"))
    salted = per_key.join(large.groupBy("key").agg(F.first("held").alias("h")), "key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("h") / BLOCK).cast("long") - 1))).drop("h")
    return joined.unionByName(large.withColumn("salt", F.pmod(F.xxhash64("node"), salts())).join(salted, ["key", "salt"]).drop("salt"))


def shared_documents(made: DataFrame, classes: DataFrame, root: str) -> DataFrame | None:
    """Links (a, b) between the classes of one doc_id that stands on several rows; None if there is none."""
    spark = made.sparkSession
    rows = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = rows.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo <> hi")
    several = settle(spark, several.select("doc_id", F.col("lo").alias("first")), f"{root}/repeated")
    if several.isEmpty():
        return None
    pairs = rows.join(few(several), "doc_id").where("set_hash <> first").select("first", "set_hash").distinct()
    node = lambda key, name: classes.select(F.col("set_hash").alias(key), F.col("node").alias(name))
    return settle(spark, pairs.join(node("first", "a"), "first").join(node("set_hash", "b"), "set_hash").select("a", "b"), f"{root}/same-document")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable over links), kept."""
    spark = docs.sparkSession
    root = shared_dir(spark, "near-duplicates")
    made = settle(spark, profiles(docs, words), f"{root}/profiles")
    classes = settle(
        spark,
        made.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
        .withColumn("node", F.monotonically_increasing_id()),  # kept by being written
        f"{root}/classes",
    )
    same_document = shared_documents(made, classes, root)
    index = settle(spark, entries(classes), f"{root}/index")
    # keys held by one class alone can't make a pair
    shared = index.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    index = settle(spark, index.join(shared, "key"), f"{root}/buckets")
    most_large = index.where(F.col("held") > BLOCK).count() // BLOCK
    files = store_sets(docs, index.select("node").distinct().join(classes, "node").select(F.col("least").alias("doc_id"), "set_hash", "node"), words, root)
    links, labels = same_document, None
    if links is not None:
        labels = components(links, f"{root}/components-0")

    def component(frame: DataFrame) -> DataFrame:
        if labels is None:
            return frame.withColumn("component", F.col("node"))
        return frame.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def open_buckets() -> DataFrame:
        """Entries of buckets that hold more than one component."""
        mixed = lambda rows: rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return with_bucket(component(index), mixed, most_large)

    for turn in range(ROUNDS + 1):
        at = f"{root}/round-{turn}"
        waiting = settle(spark, open_buckets(), f"{at}/open") if turn else component(index)
        if turn and waiting.limit(1).count() == 0:
            break
        if turn < ROUNDS:
            rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), F.col("node").alias("hub"), F.col("component").alias("hub_component"))
            hubs = lambda rows, rank=rank: rows.groupBy("key").agg(F.min(rank).alias("h")).select("key", "h.hub", "h.hub_component", "h.r")
            beside = with_bucket(waiting, hubs, most_large).where("component <> hub_component").select(F.col("node").alias("a"), F.col("hub").alias("b"), "r").distinct()
            near = distances(beside.select("a", "b"), classes).withColumn("r", F.xxhash64("b", F.lit(turn)))
            # of the hubs that a member was set beside: the closest, and the one of least rank that seems near
            best = near.groupBy("a").agg(
                F.min(F.struct(F.when(F.col("distance") <= VALUES // 4, 0).otherwise(1).alias("far"), "r", "b")).alias("first"),
                F.min(F.struct("distance", "r", "b")).alias("closest"),
            )
            pairs = best.select("a", F.explode(F.array_distinct(F.array("first.b", "closest.b"))).alias("b"))
            found = verified(settle(spark, pairs, f"{at}/pairs"), files, percent)
        else:
            spread = waiting.withColumn("salt", F.pmod(F.xxhash64("node"), salts())).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), salts() - 1)))
            lo, hi = F.least("salt", "other"), F.greatest("salt", "other")
            part = F.when(lo == hi, 2).when(F.col("salt") == lo, 0).otherwise(1)
            members = spread.select(F.xxhash64("key", lo, hi).alias("bucket"), "node", "component", "slot", part.cast("int").alias("part"))
            members = members.join(classes.select("node", "signature", "n"), "node")
            found = cross_links(members.repartition("bucket").sortWithinPartitions("bucket"), files, percent)
        found = settle(spark, found, f"{at}/links")
        links = found if links is None else links.unionAll(found)
        labels = components(links, f"{at}/components")
    least = component(classes.select("set_hash", "node", "least"))
    least = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("set_hash", "component_id")
    joined = made.join(least, "set_hash", "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", linked.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
