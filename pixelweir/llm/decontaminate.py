"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Documents and items are words (lower case, without punctuation). Counts of the items' n-grams over all documents say
which are rare: for each item, those not much more frequent than the rarer half of its own, so that an item that many
documents copy keeps its seeds. A passage around a seed is aligned with the item, which also scores copies with words
changed, added or left out. A match is a score of `least` times the item's own.

Items come in blocks of bounded size, each broadcast; all documents meet each block in two scans without a shuffle of
texts. More items make more blocks.

Results: null and empty texts and items match nothing. Repeated rows match alike; repeated items give a row each if
their ids differ. Items shorter than N words are sought as a whole. A null item_id is kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import bound_batches, durable, keep_rows, read, row_key, slices, tidy
from pixelweir.llm.rolling import gram_hashes, word_hashes

#: Words of a seed; an item's score over its own from which it counts as found.
N, LEAST = 3, 0.6
#: Bytes of texts that are hashed together.
SLICE = 512 << 10
#: Bytes of items in a block, which is broadcast.
BLOCK = 4 << 20
#: Alignment: a match adds 1, a changed word and a gap cost these.
CHANGE, GAP = 0.5, 0.5
#: An n-gram is a seed up to so many times the count of the rarer half's most frequent, or up to FLOOR documents.
TIMES, FLOOR = 4, 20


@dataclass
class Items:
    """Items of a block: their words, and each distinct n-gram with the places where it stands."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  # sorted
    first: np.ndarray  # where a gram's places begin in `places`
    places: np.ndarray  # (item, offset)
    filter: np.ndarray  # bits by the low 20 bits of a gram

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        ids, words, hashes, at = [], [], [], []
        for item_id, text in rows:
            w = word_hashes([(text or "").encode("utf-8", "surrogatepass")])[0]
            if not len(w):
                continue
            g = gram_hashes(w, N) if len(w) >= N else gram_hashes(w, len(w))[:0]
            hashes.append(g)
            at += [(len(ids), k) for k in range(len(g))]
            ids.append(item_id)
            words.append(w)
        return cls.index(ids, words, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(at, np.int64).reshape(-1, 2))

    @classmethod
    def index(cls, ids: list, words: list[np.ndarray], hashes: np.ndarray, at: np.ndarray) -> Items:
        order = np.argsort(hashes, kind="stable")
        grams, first = np.unique(hashes[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return cls(ids, words, grams, np.r_[first, len(hashes)], at[order], bits)

    def hits(self, words: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in words, gram number) of the grams found within one text."""
        g = gram_hashes(words, N)
        maybe = np.flatnonzero(self.filter[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        maybe = maybe[number[maybe] == number[maybe + N - 1]] if len(maybe) else maybe
        if not len(maybe) or not len(self.grams):
            return maybe[:0], maybe[:0]
        k = np.minimum(np.searchsorted(self.grams, g[maybe]), len(self.grams) - 1)
        same = self.grams[k] == g[maybe]
        return maybe[same], k[same]

    def seeds(self, counts: np.ndarray) -> Items:
        """With the rare grams of each item alone. counts: documents by gram."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        keep = np.zeros(len(gram), bool)
        order = np.argsort(self.places[:, 0], kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.places[order, 0])) + 1):
            n = counts[gram[part]]
            keep[part] = n <= max(FLOOR, TIMES * np.median(n)) if len(n) else False
        return Items.index(self.ids, self.words, self.grams[gram[keep]], self.places[keep])


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its passage, and the passage place where it ends. All pairs advance together, an item word at a time."""
    n, width, depth = len(items), max(map(len, passages), default=0), max(map(len, items), default=0)
    p = np.zeros((n, width), np.uint64)
    for i, x in enumerate(passages):
        p[i, : len(x)] = x
    valid = np.arange(width)[None, :] < np.array([len(x) for x in passages])[:, None]
    row = np.zeros((n, width + 1))
    best, end = np.zeros(n), np.zeros(n, np.int64)
    slope = GAP * np.arange(width + 1)
    for k in range(depth):
        live = np.array([k < len(x) for x in items])
        word = np.array([x[k] if k < len(x) else 0 for x in items], np.uint64)
        step = np.where((p == word[:, None]) & valid, 1.0, -CHANGE)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + step, row[:, 1:] - GAP))
        new = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps within the passage
        new[:, 0] = 0
        row = np.where(live[:, None], new, row)
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = live & (top > best + 1e-9)
        best[better], end[better] = top[better], at[better]
    return best, end


def _candidates(items: Items, words: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, from, to): passages of words around seeds, merged where they overlap."""
    at, gram = items.hits(words, number)
    if not len(at):
        return []
    count = np.diff(items.first)[gram]
    where = np.repeat(at, count)
    k = np.repeat(items.first[gram], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item, offset = items.places[k].T
    size = np.array([len(w) for w in items.words])[item]
    slack = 4 + size // 4
    text = number[where]
    bounds = np.searchsorted(number, np.arange(number[-1] + 2))
    low = np.maximum(where - offset - slack, bounds[text])
    high = np.minimum(where - offset + size + slack, bounds[text + 1])
    out: list[tuple[int, int, int, int]] = []
    for t, i, a, b in sorted(zip(text.tolist(), item.tolist(), low.tolist(), high.tolist(), strict=True)):
        if out and out[-1][:2] == (t, i) and a <= out[-1][3]:
            out[-1] = (t, i, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((t, i, a, b))
    return out


def _matches(items: Items, texts: list[bytes], least: float) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, score as a share, matching passages) for texts that hold an item."""
    words, number, _, _ = word_hashes(texts)
    if len(words):
        pairs = sorted(_candidates(items, words, number), key=lambda x: x[3] - x[2])
        found: dict[tuple[int, int], list] = {}
        k = 0
        while k < len(pairs):
            size = max(1, (1 << 18) // max(1, pairs[min(k + 511, len(pairs) - 1)][3] - pairs[min(k + 511, len(pairs) - 1)][2]))
            some = pairs[k : k + min(512, size)]
            k += len(some)
            score, _ = align([items.words[i] for _, i, _, _ in some], [words[a:b] for _, _, a, b in some])
            for (t, i, _, _), s in zip(some, score.tolist(), strict=True):
                share = s / len(items.words[i])
                if share >= least:
                    x = found.setdefault((t, i), [0.0, 0])
                    x[0], x[1] = max(x[0], share), x[1] + 1
        for (t, i), (share, n) in sorted(found.items()):
            yield t, i, share, n
    short: dict[tuple[int, ...], list[int]] = {}
    for i, w in enumerate(items.words):
        if len(w) < N:
            short.setdefault(tuple(w.tolist()), []).append(i)
    if short and len(words):  # no gram fits: the item must stand there as a whole
        for size in {len(s) for s in short}:
            seen: dict[tuple[int, int], int] = {}
            for p in range(len(words) - size + 1):
                if number[p] == number[p + size - 1]:
                    for i in short.get(tuple(words[p : p + size].tolist()), ()):
                        seen[int(number[p]), i] = seen.get((int(number[p]), i), 0) + 1
            for (t, i), n in sorted(seen.items()):
                yield t, i, 1.0, n


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK bytes (or a single larger one), read one after the other."""
    held, size = [], 0
    for r in items.select(F.col(item_id), F.col(text)).toLocalIterator():
        n = len((r[1] or "").encode("utf-8", "surrogatepass"))
        if held and size + n > BLOCK:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def find(docs: DataFrame, items: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keys: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, item_id, score, n_passages): a row for each document row and item that it holds; score is 1 for a whole copy. keys: long columns of docs to return instead of doc_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = [F.col(k) for k in keys] if keys else [F.col(doc_id).cast("long").alias("doc_id")]
    source = docs.select(*known, F.col(text).cast("string").alias("text"))
    kind = items.select(item_id).schema[0].dataType
    out = spark.createDataFrame([], _schema(source, kind))
    for rows in _blocks(items, item_id, item_text):
        out = out.union(_against(source, Items.of(rows), least, kind))
    return out


def _schema(source: DataFrame, kind) -> str:
    return ", ".join([*[f"{k} long" for k in source.columns[:-1]], f"item_id {kind.simpleString()}, score double, n_passages long"])


def _against(source: DataFrame, block: Items, least: float, kind) -> DataFrame:
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.grams), np.int64)
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                words, number, _, _ = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()])
                at, gram = shared.value.hits(words, number)
                pair = np.unique(number[at] * len(total) + gram) if len(at) else at
                np.add.at(total, pair % max(1, len(total)), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["gram", "n"])

    counts = np.zeros(len(block.grams), np.int64)
    counted = source.select("text").mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row for each n-gram of the block at most
    counts[counted["gram"].to_numpy()] = counted["n"].to_numpy()
    seeds = spark.sparkContext.broadcast(block.seeds(counts))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    names = source.columns[:-1]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = seeds.value
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                found = list(_matches(items, [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()], least))
                at = pa.array([t for t, *_ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).take(at) for k in names], pa.array([items.ids[i] for _, i, *_ in found], id_type), pa.array([s for _, _, s, _ in found], pa.float64()), pa.array([n for *_, n in found], pa.int64())],
                    [*names, "item_id", "score", "n_passages"],
                )

    return source.mapInArrow(tidy(match), _schema(source, kind))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no item, with their own columns. Rows are known by id and text, 128 bits."""
    d, h = row_key()
    return keep_rows(docs, durable(find(docs.select(d, h, "text"), items, least, keys=("_d", "_h")).select("_d", "_h").distinct()))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
