"""Edit-aware token counts.

Each document is a segment tree: its leaves hold pre-tokens with their token counts, inner nodes the sums of code
points and tokens below. An edit descends to the leaf that it touches, splits the text anew from shortly before the
edit until a boundary falls on an old one again, encodes those pre-tokens alone, and updates the sums on the path.

Results: null and empty texts have no tokens. Edits apply in order, each to the text that the one before left; places
are code points and are clipped to the text, an end before its start counts as the start, a null replacement as empty.
Repeated rows are counted each. Edits without a document, or with a null place, do nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm import bpe
from pixelweir.llm.common import NULL_ID, bound_batches, read, slices, tidy

#: Pre-tokens of a leaf at first; a leaf that outgrows it eightfold has the tree built anew.
LEAF = 64
#: Code points after a pre-token's end that its pattern may look at.
LOOK = 2
MEMORY = 500_000


class Counter:
    """Token counts of pre-tokens, remembered within bounds."""

    def __init__(self, encoder: bpe.Encoder):
        self.split, self.replay = encoder.split, encoder.replay
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def learn(self, words: Iterable[str]) -> None:
        known, older = self.known, self.older
        new = []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        if len(known) + len(new) > MEMORY:
            self.older, self.known = known, {w: known[w] for w in words if w in known}
            known = self.known
        for w, ids in zip(new, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            known[w] = len(ids)

    def counts(self, words: list[str]) -> list[int]:
        self.learn(set(words))
        return list(map(self.known.__getitem__, words))


class Tree:
    """The segment tree of one text."""

    def __init__(self, words: list[str], counts: list[int], split: Callable[[str], list[str]], count: Callable[[list[str]], list[int]]):
        self.split, self.count = split, count
        self.recounted = 0
        self._build(words, counts)

    def _build(self, words: list[str], counts: list[int]) -> None:
        self.words = [words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        self.width = 1 << (len(self.words) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (w, c) in enumerate(zip(self.words, self.counts, strict=True)):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, w)), sum(c)
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(w for leaf in self.words for w in leaf)

    def _find(self, place: int) -> tuple[int, int, int]:
        """(leaf, word, place where the word begins) of the word that holds a code point; the end for places beyond."""
        if place >= self.n_chars:
            return len(self.words) - 1, len(self.words[-1]), self.n_chars
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if place - begin >= self.chars[k]:
                begin += self.chars[k]
                k += 1
        leaf = k - self.width
        for j, w in enumerate(self.words[leaf]):
            if place - begin < len(w):
                return leaf, j, begin
            begin += len(w)
        raise AssertionError("sums don't fit the words")

    def _update(self, leaf: int, words: list[str], counts: list[int]) -> None:
        self.words[leaf], self.counts[leaf] = words, counts
        k = self.width + leaf
        self.chars[k], self.tokens[k] = sum(map(len, words)), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        leaf, j, begin = self._find(max(0, start - LOOK - 1)) if self.n_chars else (0, 0, 0)
        head, at = "", begin
        olds: list[str] = []  # old words from there on
        ends: list[int] = []  # where they end
        where: list[tuple[int, int]] = []
        words = ((i, k, w) for i in range(leaf, len(self.words)) for k, w in enumerate(self.words[i]) if i > leaf or k >= j)
        reach, more = end + 1, 8
        while True:
            last = True
            for i, k, w in words:
                olds.append(w)
                at += len(w)
                ends.append(at)
                where.append((i, k))
                if at >= reach:
                    more -= 1
                    if more <= 0:
                        last = False
                        break
            old = "".join(olds)
            head = old[: start - begin]
            region = head + new + old[end - begin :]
            shift = len(new) - (end - start)
            bounds = {e + shift: n for n, e in enumerate(ends) if e >= end}
            fresh, place, sync = [], begin, None
            for w in self.split(region):
                fresh.append(w)
                place += len(w)
                if place >= end + shift and place in bounds and (last or place + LOOK < begin + len(region)):
                    sync = bounds[place]
                    break
            if sync is not None or last:
                break
            more = len(olds)
        self.recounted += len(fresh)
        counts = self.count(fresh)
        if not olds:
            self._build(fresh, counts) if not self.n_chars else self._append(fresh, counts)
            return
        to_leaf, to_word = where[sync] if sync is not None else where[-1]
        rest_w, rest_c = self.words[to_leaf][to_word + 1 :], self.counts[to_leaf][to_word + 1 :]
        first_w, first_c = self.words[leaf][:j] + fresh, self.counts[leaf][:j] + counts
        if to_leaf == leaf:
            self._update(leaf, first_w + rest_w, first_c + rest_c)
        else:
            self._update(leaf, first_w, first_c)
            for i in range(leaf + 1, to_leaf):
                self._update(i, [], [])
            self._update(to_leaf, rest_w, rest_c)
        if len(self.words[leaf]) > 8 * LEAF:
            self._build([w for x in self.words for w in x], [c for x in self.counts for c in x])

    def _append(self, words: list[str], counts: list[int]) -> None:
        self._build([w for x in self.words for w in x] + words, [c for x in self.counts for c in x] + counts)


_COUNTERS: dict[int, Counter] = {}


def _counter(encoder: bpe.Encoder) -> Counter:
    if id(encoder) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[id(encoder)] = Counter(encoder)
    return _COUNTERS[id(encoder)]


def count_edited(docs: DataFrame, edits: Column, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_chars_after, n_pretokens, n_recounted) of each row; edits is an array<struct<b, e, s>> over its columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    raw, pat = bpe.shared_vocabulary(spark, path, pattern)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), edits.cast("array<struct<b:bigint,e:bigint,s:string>>").alias("edits"))
    names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_pretokens", "n_recounted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(bpe.encoder(raw.value, pat))
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                rows = []
                cut = [counter.split(t) if t else [] for t in b.column("text").to_pylist()]
                counter.learn(set().union(*cut))
                for d, words, changes in zip(b.column("doc_id").to_pylist(), cut, b.column("edits").to_pylist(), strict=True):
                    tree = Tree(words, counter.counts(words), counter.split, counter.counts)
                    before = tree.n_tokens
                    for x in changes or ():
                        if x is not None and x["b"] is not None and x["e"] is not None:
                            tree.edit(x["b"], x["e"], x["s"] or "")
                    rows.append((d, before, tree.n_tokens, tree.n_chars, len(words), tree.recounted))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [[]] * len(names))], names)

    return source.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def recount(docs: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """count_edited with edits from a table (doc_id, seq, b, e, s), joined by document and applied by seq."""
    per_doc = edits.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_list(F.struct("seq", "b", "e", "s"))).alias("_edits"))
    joined = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_d")).join(per_doc, "_d", "left")
    return count_edited(joined, F.transform("_edits", lambda x: F.struct(x["b"], x["e"], x["s"])), path, pattern)


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with three edits: 20 code points out at a quarter, a note in at the half, ten replaced at three quarters."""
    n = F.length(F.coalesce("text", F.lit("")))
    change = lambda at, size, s: F.struct(F.floor(at).alias("b"), (F.floor(at) + size).alias("e"), F.lit(s).alias("s"))
    return count_edited(read(spark, sf_dir, "documents"), F.array(change(n / 4, 20, ""), change(n / 2, 0, " [edited] "), change(3 * n / 4, 10, "rédaction")))
