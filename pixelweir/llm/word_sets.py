"""Near-dedup by shared word sequences: Jaccard similarity of the sets of 5-word shingles, found by prefix filtering.

Words are those of SimHash (`[^\\x20\\x09-\\x0D]+` in ASCII lower case); a text of fewer than WORDS words is one shingle.
Under any fixed order of all shingles, two sets of similarity LEAST or more share a shingle among the first
n - ceil(LEAST * n) + 1 of each, n being the set's own size. So those are the keys, no similar pair is missed (shingles
stand as 64-bit hashes), and candidates are verified on the whole sets. The order puts shingles that are frequent in a
sample of documents last, which makes keys rare; the sample has no bearing on the result.

Three exact bounds come before that: similar sets differ by no more than a fifth in size; two sets whose first common
shingle stands at places i and j share no more than what follows there; and each shingle that only one of two sets has
flips one bit of its parities, so parities that differ in more bits than the sets may differ in shingles rule a pair out.

Equal sets are merged before. Members of a key are first compared with the smallest set: of sets that are one passage
and a few words of their own, any two that are similar are also similar to that one. In further rounds they are compared
with a member that each key chooses for itself; as near copies share many keys, they meet many such members, and large
groups of them are joined without making all pairs. Only then pairs of a key are compared that are not yet joined.

Results: texts without a word have no set and are never merged. Repeated rows are merged. A null doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweir.llm.common import NULL_ID, bound_batches, durable, keep_rows, may_hold, row_key, shuffles, slices, tidy
from pixelweir.llm.rolling import Prefixes, gram_hashes, mix
from pixelweir.llm.simhash import components

WORDS = 5
#: Similarity as a fraction of integers, so that no set on the threshold is lost to rounding.
LEAST = (4, 5)
#: Documents sampled for the order of shingles, and from how many of them a shingle counts as frequent.
SAMPLE, FREQUENT = 20_000, 4
SLICE = 512 << 10
#: Rounds in which the members of a key are compared with one of them, before all pairs that are left.
STARS = 2
#: Steps over links by which sets are known to belong together between the rounds; components are settled at the end.
STEPS = 3
#: Parity bits of a set at least; larger sets have as many as shingles, up to the next power of two.
BITS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[data]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    words = mix(Prefixes(data).hashes(starts, ends - starts))
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    edge = np.searchsorted(starts, begin)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(gram_hashes(words[a:b], min(WORDS, n))) if n else np.zeros(0, np.uint64))
    return out


def n_keys(n: int) -> int:
    return n - -(-LEAST[0] * n // LEAST[1]) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def digest(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes())


def parities(x: np.ndarray) -> np.ndarray:
    bits = max(BITS, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def _raw(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]


def sets_of(keyed: DataFrame) -> DataFrame:
    """(_d, _h, s, n, p): digest, size and parities of each row's set; rows without a word are left out. keyed: _d, _h, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                sets = shingle_sets(_raw(b))
                some = [i for i, x in enumerate(sets) if len(x)]
                s = np.array([digest(sets[i]) for i in some], np.uint64).view(np.int64)
                at = pa.array(some, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_d").take(at), b.column("_h").take(at), pa.array(s), pa.array([len(sets[i]) for i in some], pa.int32()), pa.array([parities(sets[i]) for i in some], pa.list_(pa.int64()))], ["_d", "_h", "s", "n", "p"])

    return keyed.select("_d", "_h", "text").mapInArrow(tidy(run), "_d long, _h long, s long, n int, p array<long>")


def frequent(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of texts, sorted, and in how many: a bounded sample, so a bounded number."""
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, total // SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(_raw(b))]), return_counts=True)
                for i in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["key", "n"])

    counted = some.select("text").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    found = counted.toArrow()
    key, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def shared_keys(texts: DataFrame, total: int) -> DataFrame:
    """(key, s, n, i): the keys that two sets or more have, with these sets' digests and sizes and the key's place in the set's order. texts: text, of distinct sets."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(frequent(texts, total))
    names, types = ("key", "s", "n", "i"), (np.int64, np.int64, np.int32, np.int32)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                out, s, n = [], [], []
                for x in shingle_sets(_raw(b)):
                    if not len(x):
                        continue
                    often = np.zeros(len(x), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        often = np.where(known[at] == x, count[at], 0)
                    out.append(x[np.lexsort((x, often))[: n_keys(len(x))]])
                    s.append(digest(x))
                    n.append(len(x))
                sizes = [len(k) for k in out]
                key = np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64)
                s, n = np.repeat(np.array(s, np.uint64).view(np.int64), sizes), np.repeat(np.array(n, np.int32), sizes)
                place = np.concatenate([np.zeros(0, np.int32), *[np.arange(k, dtype=np.int32) for k in sizes]])
                for i in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (key, s, n, place)], names)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, t) for t in types]  # the last row, if its key isn't known to recur
        open_key = None
        for b in batches:
            rows = [np.concatenate([x, b.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(last, names, strict=True)]
            key = rows[0]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            keep = np.r_[same, False] | np.r_[key[0] == open_key if open_key is not None else False, same]
            pending = not keep[-1]
            open_key = None if pending else key[-1]
            last = [x[-1:] if pending else x[:0] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names)

    schema = "key long, s long, n int, i int"
    rows = texts.select("text").mapInArrow(tidy(keys), schema)
    return rows.repartition(shuffles(spark), "key").sortWithinPartitions("key").mapInArrow(tidy(repeated), schema)


def allowed(na: str, ia: str, nb: str, ib: str):
    """Whether sets of these sizes may be similar if their first common key stands at these places."""
    a, b, i, j = (F.col(c).cast("long") for c in (na, nb, ia, ib))
    size = F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]
    # similar sets share LEAST / (1 + LEAST) of |A| + |B| at least
    return size & (F.least(a - i, b - j) * sum(LEAST) >= (a + b) * LEAST[0])


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): the pairs that parities don't rule out."""
    for c in "ab":
        pairs = pairs.join(sketches.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}")), c)
    k = F.least(F.size("pa"), F.size("pb"))

    def folded(p: str):
        """The halves of twice as many parities add up to those of the smaller set."""
        return F.when(F.size(p) == k, F.col(p)).otherwise(F.zip_with(F.slice(p, F.lit(1), k), F.slice(p, k + 1, k), lambda x, y: x.bitwiseXOR(y)))

    apart = F.aggregate(F.zip_with(folded("pa"), folded("pb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    # |A - B| + |B - A| = |A| + |B| - 2 |A and B|
    return pairs.filter(apart * sum(LEAST) <= (F.col("na") + F.col("nb")) * (LEAST[1] - LEAST[0])).select("a", "b")


def verified(pairs: DataFrame, keyed: DataFrame, best: DataFrame) -> DataFrame:
    """(a, b): the pairs whose sets are similar. keyed: _d, _h, text; best: s, k (_d, _h), the row that stands for a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "ta", SLICE):
                left = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b.column("ta").to_pylist()])
                right = shingle_sets([t.encode("utf-8", "surrogatepass") for t in b.column("tb").to_pylist()])
                yield b.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(left, right, strict=True)], pa.bool_()))

    members = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    rows = durable(members.join(best, "s").select("s", "k._d", "k._h"))
    texts = keyed.filter(may_hold(rows)).join(rows, ["_d", "_h"]).dropDuplicates(["s"])
    one = pairs.join(texts.select(F.col("s").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("s").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def nearby(links: DataFrame) -> DataFrame:
    """(s, l): for each linked set, a small one within STEPS links. Equal labels mean one component; unequal ones mean nothing."""
    both = links.select(F.col("a").alias("s"), F.col("b").alias("o")).union(links.select("b", "a"))
    label = both.groupBy("s").agg(F.min("o").alias("l")).select("s", F.least("s", "l").alias("l"))
    for _ in range(STEPS - 1):
        label = both.join(label.withColumnRenamed("s", "o"), "o").groupBy("s").agg(F.min("l").alias("l")).select("s", F.least("s", "l").alias("l"))
    return label


def groups(keyed: DataFrame, texts: DataFrame, best: DataFrame) -> DataFrame:
    """(s, label): for each set that has a similar one, the smallest digest reachable. texts: text, a row for each set; keyed, best: as in `verified`, best with n and p too."""
    sketches = best.select("s", "n", "p")
    rows = durable(shared_keys(texts, best.count()))
    links = keyed.sparkSession.createDataFrame([], "a long, b long")
    mixed = rows.withColumn("l", F.col("s"))
    for k in range(STARS + 1):
        if k < STARS:  # all members of a key with one of them: in the first round the smallest set, later any, another one for each key
            order = F.struct("n", "s", "i", "l") if k == 0 else F.struct(F.xxhash64("key", "s", F.lit(k)).alias("o"), "s", "n", "i", "l")
            low = mixed.groupBy("key").agg(F.min(order).alias("low")).select("key", *[F.col(f"low.{c}").alias(f"{c}b") for c in "snil"])
            pairs = mixed.select("key", *[F.col(c).alias(f"{c}a") for c in "snil"]).join(low, "key")
        else:  # all pairs that are left
            one, other = (mixed.select("key", *[F.col(c).alias(f"{c}{x}") for c in "snil"]) for x in "ab")
            pairs = one.join(other, "key").filter("sa < sb")
        pairs = pairs.filter("la <> lb").filter(allowed("na", "ia", "nb", "ib")).select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()
        links = durable(links.union(verified(durable(possible(pairs, sketches)), keyed, best)))
        if k < STARS:
            labelled = durable(rows.join(nearby(links), "s", "left").select("key", "s", "n", "i", F.coalesce("l", "s").alias("l")))
            # keys whose members are joined already, or are two that were compared, need nothing more
            more = labelled.groupBy("key").agg(F.min("l").alias("x"), F.max("l").alias("y"), F.count("*").alias("c")).filter("x < y AND c > 2").select("key")
            mixed = durable(labelled.join(more, "key"))
    return components(links).select(F.col("node").alias("s"), "label")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", earlier: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row of docs for each component, with its own columns: that of the smallest doc_id (null last), of equal rows any one.

    earlier: the keys of rows that an earlier dedup drops, and of those of which it keeps one (`simhash.fates`). The
    result is that of keep_one on what it leaves, but those rows are told apart by keys alone, not by a join of texts
    that would be planned and run again in each of the scans below.
    """
    bound_batches(docs.sparkSession)
    keyed = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    sets = sets_of(keyed)
    found = durable(sets if earlier is None else sets.join(earlier[0].select("_d", "_h"), ["_d", "_h"], "left_anti"))
    ranked = F.struct((F.col("_d") == NULL_ID).alias("n"), F.col("_d"), F.col("_h"))
    best = durable(found.groupBy("s").agg(F.min(ranked).alias("k"), F.first("n").alias("n"), F.first("p").alias("p")))
    rows = found.groupBy("_d", "_h").agg(F.count("*").alias("n"))

    def fate(stays: DataFrame) -> list[DataFrame]:
        """The rows that go, and those of which one goes on. Rows without a word are among them only if the earlier dedup says so."""
        some = durable(rows.join(stays.select("k._d", "k._h", F.lit(True).alias("kept")), ["_d", "_h"], "left").filter("kept IS NULL OR n > 1"))
        own = [some.filter("kept IS NULL").select("_d", "_h"), some.filter("kept").select("_d", "_h")]
        return own if earlier is None else [x.union(y.select("_d", "_h")) for x, y in zip(own, earlier, strict=True)]

    worded = keep_rows(keyed, *fate(best), "_d", "text")
    label = groups(keyed, worded, best)
    stays = best.join(label, "s", "left").groupBy(F.coalesce("label", "s").alias("label")).agg(F.min("k").alias("k"))
    return keep_rows(docs, *fate(stays), doc_id, text)
