"""Exact substring dedup by a hash-compared suffix sort.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else (another document, or another place
of the same one). All such strings are found without sorting the whole corpus at once:

1. Each window of LENGTH bytes names the least of its strings of 64 bytes (by hash, leftmost on ties). Equal windows
   name equal strings at equal offsets, so an anchor hash splits the suffixes into independent groups. A row per
   anchor stands for a run of windows; windows of a document make a row for about 75 bytes.
2. Anchors seen once go. Equal runs (a digest of all bytes of the run, within one anchor) are duplicates as a whole.
3. For anchors with several different runs, one run of each kind is cut from its text, and the suffixes that start at
   its windows are merge-sorted. Suffixes are compared by their longest common extension, found by binary search over
   prefix polynomial hashes; neighbours that agree on LENGTH bytes are duplicates, after their bytes are compared.
4. Anchors with more than HOT kinds of runs (a line in a third of all documents) are not brought together. Their runs
   are split again by longer strings (150 bytes, then LENGTH, where each window is a run of its own), from step 1 on.

Results: null and empty texts have no bytes and nothing removed. Repeated rows are documents of their own, so all of
their windows count as duplicates. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import NULL_ID, bound_batches, durable, read, row_key, shuffles, tidy
from pixelweir.llm.rolling import Prefixes, mix

LENGTH = 200
#: Lengths of the anchor strings: the next is used where one has more than HOT kinds of runs; the last is LENGTH.
GRAMS = (64, 150, 200)
#: Kinds of runs of one anchor that are sorted in one task; anchors with more are split again.
HOT = 6000
#: Bytes of runs sorted together.
BLOCK = 1 << 20
def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place."""
    p = Prefixes(data)
    m = len(data) - n + 1
    return mix((p.sums[n:] - p.sums[:m]) * p.up[:m])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, first window, last window, anchor place) of each run, for documents [start, end) of the array."""
    empty = np.zeros(0, np.int64)
    width = length - gram + 1
    if len(data) < length:
        return empty.astype(np.uint64), empty, empty, empty
    h = _gram_hashes(data, gram)
    low = (1 << 24) - 1
    assert len(data) <= low
    key = (h & ~np.uint64(low)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= width:  # minimum over `size` places, doubled
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    inside = np.zeros(len(key) + 1, np.int64)  # +1 where windows of a document begin, -1 where they end
    full = ends - starts >= length
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    place = (key[at] & np.uint64(low)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else empty
    last = np.r_[new[1:], len(at)] - 1 if len(at) else empty
    return h[place[new]], at[new], at[last], place[new]


def _cut(texts: list[bytes], limit: int = 1 << 20, overlap: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, ends, text number, offset): whole texts together up to `limit` bytes; longer ones in pieces that share overlap - 1 bytes, so that each window is in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def pack():
        data = np.frombuffer(b"".join([x[2] for x in held]), np.uint8)
        ends = np.cumsum([len(x[2]) for x in held])
        return data, ends - np.array([len(x[2]) for x in held]), ends, np.array([x[0] for x in held]), np.array([x[1] for x in held])

    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - overlap + 1), limit):
            piece = t[k : k + limit + overlap - 1]
            if held and size + len(piece) > limit:
                yield pack()
                held, size = [], 0
            held.append((i, k, piece))
            size += len(piece)
    if held:
        yield pack()


#: A run's place, packed into a long: first window, further windows, anchor's offset from the first window.
_SHIFT = 10


def _packed(s: np.ndarray, w: np.ndarray, o: np.ndarray) -> np.ndarray:
    return (s << 2 * _SHIFT) | (w << _SHIFT) | o


def _unpacked(p: int) -> tuple[int, int, int]:
    return p >> 2 * _SHIFT, p >> _SHIFT & (1 << _SHIFT) - 1, p & (1 << _SHIFT) - 1


_RUN_SCHEMA = "a long, c long, _d long, _h long, _b long, p long, lone boolean"


def _run_batch(texts: list[bytes], d: np.ndarray, h: np.ndarray, first: np.ndarray, lone: np.ndarray, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of windows: anchor a, digest c of the run's bytes, document (_d, _h), place p, lone. `first` is where each text begins in its document."""
    for data, starts, ends, number, offset in _cut(texts, overlap=length):
        a, s, e, place = anchors(data, starts, ends, length, gram)
        raw = data.tobytes()
        digest = xxhash.xxh3_64_intdigest
        c = np.array([digest(raw[x : y + length]) for x, y in zip(s.tolist(), e.tolist(), strict=True)], np.uint64)
        piece = np.searchsorted(ends, s, side="right")
        doc = number[piece]
        at = _packed(s - starts[piece] + offset[piece] + first[doc], e - s, place - s)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d[doc]), pa.array(h[doc]), pa.array(first[doc]), pa.array(at), pa.array(lone[doc])], ["a", "c", "_d", "_h", "_b", "p", "lone"])


def _numbers(b: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _runs(sources: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of documents, or of pieces that begin at byte _b of one; a piece's windows stay its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _run_batch(_bytes(b), *_numbers(b, "_d", "_h", "_b", "lone"), length, gram)

    return sources.mapInArrow(tidy(run), _RUN_SCHEMA)


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]


def merge_sort(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes that start at `at` within their buckets; returns the order and whether each agrees with the one before on `length` bytes.

    Runs double at each level; a suffix's place in the sibling run is found by binary search, and each comparison by a
    binary search for the longest common extension over prefix hashes.
    """
    hashes = Prefixes(data).hashes

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common extension of suffixes i and j, up to `length`."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), length - 1, np.int64)
        whole = hashes(i, length) == hashes(j, length)  # most are equal as a whole
        low[whole] = high[whole] = length
        open_ = np.flatnonzero(~whole)
        while len(open_):
            mid = (low[open_] + high[open_] + 1) >> 1
            same = hashes(i[open_], mid) == hashes(j[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = extension(i, j)
        done = k >= length
        k = np.minimum(k, length - 1)
        return ~done & (data[i + k] < data[j + k])

    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    sizes = np.diff(np.r_[bounds, len(order)])
    start = np.repeat(bounds, sizes)
    size = np.repeat(sizes, sizes)
    local = np.arange(len(order)) - start
    run = 1
    most = int(sizes.max(initial=0))
    while run < most:
        live = np.flatnonzero(size > run)
        mine, first = order[live], local[live] // run * run
        right = (local[live] // run) & 1 == 1
        sibling = np.where(right, first - run, first + run)
        low = np.minimum(sibling, size[live])
        high = np.minimum(sibling + run, size[live])
        base, begin = start[live], low.copy()
        # left members count the right members below them; right members count the left members not above them
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            other = at[order[base[open_] + mid]]
            own = at[mine[open_]]
            r = right[open_]
            go = np.where(r, ~less(np.where(r, own, other), np.where(r, other, own)), False)
            go = np.where(r, go, less(np.where(r, own, other), np.where(r, other, own)))
            low[open_[go]] = mid[go] + 1
            high[open_[~go]] = mid[~go]
            open_ = open_[low[open_] < high[open_]]
        place = base + np.where(right, sibling, first) + (local[live] - first) + (low - begin)
        fresh = order.copy()
        fresh[place] = mine
        order = fresh
        run *= 2
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        i, j = at[order[:-1]], at[order[1:]]
        pair = np.flatnonzero((bucket[order[:-1]] == bucket[order[1:]]))
        pair = pair[extension(i[pair], j[pair]) >= length]
        wide = np.lib.stride_tricks.sliding_window_view(data, length)
        for k in range(0, len(pair), 1 << 14):  # collision check: equal hashes must be equal bytes
            p = pair[k : k + (1 << 14)]
            same[p + 1] = (wide[i[p]] == wide[j[p]]).all(axis=1)
    return order, same


def repeated_windows(runs: list[bytes], groups: list[int], offsets: list[int], length: int) -> list[np.ndarray]:
    """For runs of windows, the windows (counted from the run's start) whose string also is in another run of the group, or again in the run."""
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(r) for r in runs])
    count = np.array([len(r) - length + 1 for r in runs])
    first = ends - np.array([len(r) for r in runs])
    which = np.repeat(np.arange(len(runs)), count)
    at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
    # equal windows have their anchor at the same distance, so a bucket is a group and that distance
    bucket = np.asarray(groups, np.int64)[which] * (2 * length) + (np.asarray(offsets, np.int64)[which] - (at - first[which]) + length)
    # and suffixes that differ in their first half can't agree on the whole
    bucket = mix(mix(bucket.astype(np.uint64)) ^ Prefixes(data).hashes(at, length // 2))
    order, same = merge_sort(data, at, bucket, length)
    hit = np.zeros(len(at), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    found = np.split(hit, np.cumsum(count)[:-1])
    return [np.flatnonzero(f) for f in found]


def _spans(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged [start, end) of windows at sorted places."""
    if not len(places):
        return []
    gap = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.r_[0, gap + 1]].tolist(), (places[np.r_[gap, len(places) - 1]] + length).tolist(), strict=True))


_SPAN_SCHEMA = "_d long, _h long, b int, e int"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], ["_d", "_h", "b", "e"])


def duplicate_spans(keyed: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, hot: int = HOT) -> DataFrame:
    """(_d, _h, b, e): byte ranges covered by repeated strings, for documents (_d, _h, _b = 0, text); ranges may overlap."""
    assert grams[-1] == length < 1 << _SHIFT
    return _level(keyed.select("_d", "_h", "_b", F.lit(True).alias("lone"), "text"), length, grams, hot)


def _level(sources: DataFrame, length: int, grams: tuple[int, ...], hot: int) -> DataFrame:
    """Ranges from the sources (_d, _h, _b, lone, text). A source that isn't lone stands for several equal ones, whose ranges are known already."""
    every = _runs(sources, length, grams[0])
    seen = durable(every.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1").select("a"))
    runs = durable(every.join(seen, "a"))
    kinds = runs.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("_d", "_h", "_b", "p", "lone")).alias("r"))
    several = durable(kinds.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1"))
    begin, more = F.shiftright("p", 2 * _SHIFT), F.shiftright("p", _SHIFT).bitwiseAND((1 << _SHIFT) - 1)
    # as a table of its own, so that Spark may split a kind with very many runs
    equal = runs.filter("lone").join(durable(kinds.filter("n > 1").select("a", "c")), ["a", "c"]).select("_d", "_h", begin.cast("int").alias("b"), (begin + more + length).cast("int").alias("e"))
    wanted = kinds.join(several, "a").select("a", (F.col("m") > hot).alias("hot"), F.expr("n = 1 and r.lone").alias("lone"), "r._d", "r._h", "r._b", "r.p")
    pieces = _pieces(sources, wanted, length)
    if len(grams) == 1 or not several.filter(F.col("m") > hot).limit(1).count():
        return equal.unionByName(_sorted_spans(pieces, length))
    pieces = durable(pieces)
    split = pieces.filter("hot").select("_d", "_h", F.col("s").alias("_b"), "lone", F.col("piece").alias("text")).distinct()
    return equal.unionByName(_sorted_spans(pieces.filter("not hot"), length)).unionByName(_level(split, length, grams[1:], hot))


_PIECE_SCHEMA = pa.schema([("a", pa.int64()), ("hot", pa.bool_()), ("lone", pa.bool_()), ("_d", pa.int64()), ("_h", pa.int64()), ("s", pa.int64()), ("o", pa.int32()), ("piece", pa.binary())])


def _pieces(sources: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of runs (a, hot, lone, _d, _h, _b, p), cut from their texts. Repeated rows share (_d, _h) and give equal pieces, again and again."""
    per_text = wanted.groupBy("_d", "_h", "_b").agg(F.collect_list(F.struct("a", "hot", "lone", "p")).alias("wanted"))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PIECE_SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for d, h, begin, raw, chosen in zip(*(b.column(c).to_pylist() for c in ("_d", "_h", "_b")), _bytes(b), b.column("wanted").to_pylist(), strict=True):
                for x in chosen:
                    s, w, o = _unpacked(x["p"])
                    rows.append((x["a"], x["hot"], x["lone"], d, h, s, o, raw[s - begin : s - begin + w + length]))
                    size += w + length
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            yield batch(rows)

    found = sources.select("_d", "_h", "_b", "text").join(per_text, ["_d", "_h", "_b"]).select("_d", "_h", "_b", "text", "wanted")
    return found.mapInArrow(tidy(cut), "a long, hot boolean, lone boolean, _d long, _h long, s long, o int, piece binary")


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of the lone pieces' windows that also are in another piece of the anchor, by suffix sort."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        if len(rows) > 1:
            number = {a: i for i, a in enumerate(dict.fromkeys(r[0] for r in rows))}
            hits = repeated_windows([r[6] for r in rows], [number[r[0]] for r in rows], [r[5] for r in rows], length)
            for (_, lone, d, h, s, _, _), hit in zip(rows, hits, strict=True):
                if lone:
                    found += [(d, h, s + x, s + y) for x, y in _spans(hit, length)]
        return _span_batch(found)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "lone", "_d", "_h", "s", "o", "piece")), strict=True):
                if size > BLOCK and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                if held and row == held[-1]:  # of a repeated row
                    continue
                held.append(row)
                size += len(row[6])
        yield flush(held)

    dealt = pieces.repartition(shuffles(pieces.sparkSession), "a").sortWithinPartitions("a", "_d", "_h", "s")
    return dealt.mapInArrow(tidy(sort), _SPAN_SCHEMA)


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted((x["b"], x["e"]) for x in spans or ()):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def remove_duplicates(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, hot: int = HOT, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_bytes: spans, kept) for each row."""
    bound_batches(docs.sparkSession)
    keyed = docs.select(*row_key(doc_id, text), F.lit(0).cast("long").alias("_b"), F.col(text).cast("string").alias("text"))
    spans = duplicate_spans(keyed, length, grams, hot)
    per_text = spans.groupBy("_d", "_h", F.lit(0).cast("long").alias("_b")).agg(F.collect_list(F.struct("b", "e")).alias("spans"))  # keyed as in _pieces, so that both share one exchange of texts
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<b:int,e:int>>, kept binary" * keep_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, text_, spans_ in zip(*(b.column(c).to_pylist() for c in ("_d", "text", "spans")), strict=True):
                raw = (text_ or "").encode("utf-8", "surrogatepass")
                gone = merge_spans(spans_)
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                row = {"doc_id": None if d == NULL_ID else d, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                rows.append(row | ({"spans": [{"b": x, "e": y} for x, y in gone], "kept": kept} if keep_bytes else {}))
            yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("spans", pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))), ("kept", pa.binary())] * keep_bytes)
    return keyed.join(per_text, ["_d", "_h", "_b"], "left").select("_d", "text", "spans").mapInArrow(tidy(run), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(read(spark, sf_dir, "documents"), keep_bytes=False)
