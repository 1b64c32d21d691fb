"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a word of the perfect binary Golay code (23,12)
with zero padding. Decoding gives the index of the one codeword within three bits. Of the three segments, the two with
the fewest errors together hold, by the pigeonhole principle, at most one error each when fingerprints differ in three
bits or fewer. So one side is keyed by the codewords of both segments, the other by all codewords of words within one
bit of them (one or six a segment); a common key is certain, and candidates are verified by their differing bits.

Equal fingerprints are merged before. In a group only links that join parts not yet joined are kept (a spanning
forest), so large groups don't make all pairs. Components of up to SETTLED links then come from one task, and of more
from alternating large-star and small-star rounds.

Results: null and empty texts have fingerprint zero. Repeated rows share a component. A null doc_id never names one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import NULL_ID, bound_batches, durable, keep_rows, read, shuffles, tidy

#: Generator polynomial of the (23,12) Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1. A fixed value.
GOLAY = 0b110001110101
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Index rows of one key that are compared in one block. More are spread over several blocks, each meeting all queries.
BLOCK = 2048
#: Hot keys are looked up by a broadcast up to so many, and by a join beyond.
BROADCAST_KEYS = 50_000
#: Distinct edges (4 MB of ids) whose components one task finds. More take rounds of joins over all tasks; each round is
#: some ten exchanges, whose plans, threads and broadcasts cost the driver more memory than the edges would.
SETTLED = 1 << 18

_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    r"""Words `[^\x20\x09-\x0D]+` of the text in ASCII lower case."""
    if not text:
        return []
    return [w for w in text.translate(_SPACES).split(" ") if w]


_SPACES = _LOWER | dict.fromkeys(range(9, 14), 32)


def fingerprint(text: str | None) -> int:
    words = words_of(text)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles])
    n = len(shingles)
    hashes = np.frombuffer(raw, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each single bit, and the error of each remainder."""
    rest = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        rest[i] = r
    errors = np.zeros(2048, np.int64)
    for i in range(23):
        errors[rest[i]] = 1 << i
        for j in range(i):
            errors[rest[i] ^ rest[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[rest[i] ^ rest[j] ^ rest[k]] = 1 << i | 1 << j | 1 << k
    return rest, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword within three bits of each 23-bit word."""
    rest, errors = _syndromes()
    s = np.zeros(words.shape, np.int64)
    for i in range(23):
        s ^= np.where(words >> i & 1, rest[i], 0)
    return (words ^ errors[s]) >> 11


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, is_index) rows for unsigned fingerprints: 3 index rows each, and the query rows."""
    own, near = [], []
    for shift, bits in SEGMENTS:
        seg = (prints >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
        own.append(decode(seg))
        ball = decode(np.concatenate([seg[:, None], seg[:, None] ^ (1 << np.arange(bits))[None, :]], axis=1))
        ball.sort(axis=1)
        fresh = np.ones(ball.shape, bool)
        fresh[:, 1:] = ball[:, 1:] != ball[:, :-1]
        k = int(fresh.sum(axis=1).max(initial=1))
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :k]
        near.append((np.take_along_axis(ball, order, 1), np.take_along_axis(fresh, order, 1)))
    keys, rows, roles = [], [], []
    at = np.arange(len(prints))
    for p, (i, j) in enumerate(PAIRS):
        keys.append(p << 24 | own[i] << 12 | own[j])
        rows.append(at)
        roles.append(np.ones(len(prints), bool))
        k = p << 24 | near[i][0][:, :, None] << 12 | near[j][0][:, None, :]
        ok = near[i][1][:, :, None] & near[j][1][:, None, :]
        keys.append(k[ok])
        rows.append(np.broadcast_to(at[:, None, None], ok.shape)[ok])
        roles.append(np.zeros(len(keys[-1]), bool))
    rows = np.concatenate(rows)
    return np.concatenate(keys), prints[rows], np.concatenate(roles)


class Forest:
    """Union-find over fingerprints."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        y = up.setdefault(x, x)
        while y != up[y]:
            up[y] = up[up[y]]
            y = up[y]
        up[x] = y
        return y

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def linked(index: np.ndarray, query: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the index and query fingerprints of one key."""
    forest = Forest()
    step = max(1, (1 << 20) // max(1, len(index)))
    for i in range(0, len(query), step):
        part = query[i : i + step]
        q, x = np.nonzero(np.bitwise_count(part[:, None] ^ index[None, :]) <= most)
        for a, b in zip(part[q].tolist(), index[x].tolist(), strict=True):
            if a != b and forest.join(a, b):
                yield a, b


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, fp): the text's XXH64, and the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(_signed(prints))], ["doc_id", "h", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, h long, fp long")


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all that are linked; a < b as signed longs."""
    spark = prints.sparkSession

    def keyed(index_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, fp, role = keys_of(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
                if index_only:
                    key, fp, role = key[role], fp[role], role[role]
                for i in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].astype(np.int32)), pa.array(_signed(fp[i : i + (1 << 16)])), pa.array(role[i : i + (1 << 16)])], ["key", "fp", "is_index"])

        return run

    rows = prints.select("fp").mapInArrow(tidy(keyed(False)), "key int, fp long, is_index boolean")
    hot = durable(prints.select("fp").mapInArrow(tidy(keyed(True)), "key int, fp long, is_index boolean").groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left")
        blocks = F.coalesce("blocks", F.lit(1))
        rows = rows.select("key", "fp", "is_index", F.explode(F.when(F.col("is_index"), F.array(F.pmod(F.xxhash64("fp"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))).alias("block"))
    else:
        rows = rows.withColumn("block", F.lit(0))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()  # of the whole task: a link is sent on only if it joins parts
        held: list[tuple[np.ndarray, ...]] = []

        def flush(key, fp, role):
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]), True]) if len(key) else np.zeros(1, int)
            counts = np.add.reduceat(role, edge[:-1]) if len(key) else []
            out = []
            for k in np.flatnonzero((np.asarray(counts) > 0) & (np.diff(edge) > 2)):
                s = slice(edge[k], edge[k + 1])
                for a, b in linked(fp[s][role[s] > 0], fp[s][role[s] == 0], most):
                    if forest.join(a, b):
                        out.append((a, b))
            ab = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ab.min(axis=1)) if len(ab) else pa.array([], pa.int64()), pa.array(ab.max(axis=1)) if len(ab) else pa.array([], pa.int64())], ["a", "b"])

        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64) << 32 | b.column("block").to_numpy(zero_copy_only=False)
            held.append((key, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("is_index").to_numpy(zero_copy_only=False).astype(np.int64)))
            if sum(len(x[0]) for x in held) < 1 << 17 or held[0][0][0] == key[-1]:
                continue
            key, fp, role = (np.concatenate(x) for x in zip(*held, strict=True))
            end = np.searchsorted(key, key[-1])  # the last group may go on
            yield flush(key[:end], fp[:end], role[:end])
            held = [(key[end:], fp[end:], role[end:])]
        if held:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.repartition(shuffles(spark), "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(tidy(group), "a long, b long")


def settled(edges: DataFrame) -> DataFrame:
    """(node, label): each node of an edge and the smallest node reachable, by one task. edges: u, v, no more than SETTLED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                forest.join(u, v)
        nodes = list(forest.up)
        for i in range(0, len(nodes), 1 << 16):
            some = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([forest.root(x) for x in some], pa.int64())], ["node", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(tidy(run), "node long, label long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): each node of an edge and the smallest node reachable; of more than SETTLED edges by alternating large-star and small-star."""
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if now.count() <= SETTLED:
        return settled(now)
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = durable(small.filter("u <> v").distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v"))).distinct()


def groups(prints: DataFrame, most: int = 3) -> DataFrame:
    """(fp, label): for each distinct fingerprint the smallest one reachable."""
    distinct = durable(prints.select("fp").distinct())
    found = components(links(distinct, most))
    return durable(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("label", "fp").alias("label")))


def near_duplicates(docs: DataFrame, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable over links of `most` bits."""
    prints = durable(fingerprints(docs, doc_id, text))
    label = groups(prints, most)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    lowest = label.join(first, "fp").groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_print = durable(label.join(lowest, "label").select("fp", "component_id"))
    return prints.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")


def fates(docs: DataFrame, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Keys (_d, _h) of the rows that go, and of those of which one row stays, for `keep_rows`: of each component the smallest doc_id stays (null last)."""
    prints = durable(fingerprints(docs, doc_id, text).withColumn("_d", F.coalesce("doc_id", F.lit(NULL_ID))))
    ranked = F.struct(F.col("doc_id").isNull().alias("n"), F.col("_d"), F.col("h").alias("_h"))
    best = prints.groupBy("fp").agg(F.min(ranked).alias("k")).join(groups(prints, most), "fp").groupBy("label").agg(F.min("k").alias("k"))
    rows = prints.groupBy("_d", F.col("h").alias("_h")).agg(F.count("*").alias("n"))
    fate = durable(rows.join(best.select("k._d", "k._h", F.lit(True).alias("kept")), ["_d", "_h"], "left").filter("kept IS NULL OR n > 1"))
    return fate.filter("kept IS NULL"), fate.filter("kept")


def keep_one(docs: DataFrame, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, with its own columns: that of the smallest doc_id (null last), of equal rows any one."""
    return keep_rows(docs, *fates(docs, most, doc_id, text), doc_id, text)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
