"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a batch are encoded together. An inverted index maps each mergeable token pair (by the
rank that the merge makes) to the positions where it stands; ranks are replayed from the lowest up, and a merge
updates the entries of its two neighbours alone. Texts then only look their pre-tokens up.

Results: null and empty texts give no ids. Repeated rows are encoded each. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from pixelweir.llm.common import bound_batches, read, slices, tidy

#: Pre-tokens of a worker's younger memory; at that many, it becomes the older one, and the older one goes. It bounds memory and decides nothing else.
MEMORY = 250_000
#: Distinct pre-tokens that one index covers: its lists then stay in the processor's cache.
BLOCK = 1000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes many pre-tokens at once with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.singles = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] = {}  # left << 32 | right -> rank of what they make
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        whole = [self.ranks.get(w) for w in words]
        found: list[list[int]] = [[] if r is None else [r] for r in whole]
        rest = [i for i, r in enumerate(whole) if r is None and words[i]]
        if rest:
            for k in range(0, len(rest), BLOCK):
                some = rest[k : k + BLOCK]
                for i, ids in zip(some, self._replay([words[i] for i in some]), strict=True):
                    found[i] = ids
        return found

    def _replay(self, words: list[bytes]) -> Iterator[list[int]]:
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        made = np.full(len(data), -1, np.int64)  # rank of the pair that begins at a place
        made[:-1] = self.byte_pairs[data[:-1], data[1:]]
        made[ends - 1] = -1
        places = np.flatnonzero(made >= 0)
        places = places[np.argsort(made[places], kind="stable")]
        edges = np.flatnonzero(np.r_[True, made[places][1:] != made[places][:-1]]) if len(places) else np.zeros(0, np.int64)
        index = {int(made[part[0]]): part.tolist() for part in np.split(places, edges[1:]) if len(part)}
        step = np.arange(len(data))
        after, before = step + 1, step - 1
        after[ends - 1] = -1
        before[ends - sizes] = -1
        after, before = after.tolist(), before.tolist()
        token = self.singles[data].tolist()  # at a place where one starts, else -1
        owner = np.repeat(np.arange(len(words)), sizes).tolist()
        pair = self.pairs.get
        heap = list(index)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            todo = index.pop(rank, None)
            if todo is None:
                continue
            if len(todo) > 1:
                todo.sort()
            held = -1  # a word in which a lower or equal rank came up: its other places wait for that one
            wait: list[int] = []
            for p in todo:
                q = after[p]
                if q < 0 or pair(token[p] << 32 | token[q]) != rank:
                    continue
                if owner[p] == held:
                    wait.append(p)
                    continue
                token[p], token[q] = rank, -1
                after[p] = n = after[q]
                after[q] = -1
                b = before[p]
                if n >= 0:
                    before[n] = p
                    r = pair(rank << 32 | token[n])
                    if r is not None:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            push(heap, r)
                        if r <= rank:
                            held = owner[p]
                if b >= 0:
                    r = pair(token[b] << 32 | rank)
                    if r is not None:
                        if r in index:
                            index[r].append(b)
                        else:
                            index[r] = [b]
                            push(heap, r)
                        if r <= rank:
                            held = owner[p]
            if wait:
                if rank in index:
                    index[rank] += wait
                else:
                    index[rank] = wait
                    push(heap, rank)
        at = 0
        for end in ends.tolist():
            yield [t for t in token[at:end] if t >= 0]
            at = end

    def decode(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


class Encoder:
    """Texts to ids and back, with a bounded memory of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.replay, self.split, self.memory = MergeReplay(ranks), regex.compile(pattern).findall, memory
        self.listed: dict[str, str] = {}  # pre-token -> its ids, comma-joined
        self.plain: dict[str, bytes] = {}  # pre-token -> its ids, decoded
        self.older: tuple[dict[str, str], dict[str, bytes]] = {}, {}

    def learn(self, words: set[str]) -> None:
        """Encodes those of the words that aren't known yet, together."""
        new = [w for w in words if w not in self.listed]
        if len(self.listed) + len(new) > self.memory:
            self.older = self.listed, self.plain
            self.listed, self.plain = {}, {}
            new = list(words)
        if self.older[0]:
            listed, plain = self.older
            for w in new:
                if w in listed:
                    self.listed[w], self.plain[w] = listed[w], plain[w]
            new = [w for w in new if w not in listed]
        for w, ids in zip(new, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            self.listed[w] = ",".join(map(str, ids))
            self.plain[w] = self.replay.decode(ids)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """The comma-joined ids of each text, and the bytes that they decode to."""
        cut = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        listed, plain = self.listed.__getitem__, self.plain.__getitem__
        for words in cut:
            yield ",".join(map(listed, words)), b"".join(map(plain, words))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(raw: bytes, pattern: str, memory: int = MEMORY) -> Encoder:
    """The worker's encoder for a vocabulary, kept over tasks."""
    key = (hashlib.sha256(raw).digest(), pattern, memory)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        _ENCODERS[key] = Encoder(ranks, pattern, memory)
    return _ENCODERS[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def shared_vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The rank file's bytes as a broadcast (its size is fixed, under 1 MB), and the pattern."""
    own, standard = default_vocabulary()
    with open(path or own, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern or standard


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("ids", "decoded"), memory: int = MEMORY) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256, and of ids (array<int>) and decoded (the bytes that they stand for) those in keep.

    All columns of docs stay, but for those that it makes. `memory` bounds the pre-tokens that a worker remembers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    raw, pat = shared_vocabulary(spark, path, pattern)
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    source = docs.select(*[c for c in docs.columns if c not in made])
    kinds = {"ids": (pa.list_(pa.int32()), ArrayType(IntegerType())), "decoded": (pa.binary(), BinaryType())}
    out = StructType(list(source.schema.fields)).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    for name in keep:
        out = out.add(name, kinds[name][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value, pat, memory)
        sha = hashlib.sha256
        for whole in batches:
            for batch in slices(whole, text, 2 << 20):
                counts, digests, decoded, kept = [], [], [], {name: [] for name in keep}
                for ids, plain in enc.encode(batch.column(text).to_pylist()):
                    counts.append(ids.count(",") + 1 if ids else 0)
                    digests.append(sha(ids.encode()).hexdigest())
                    decoded.append(sha(plain).hexdigest())
                    if "ids" in kept:
                        kept["ids"].append(np.fromstring(ids, np.int32, sep=","))
                    if "decoded" in kept:
                        kept["decoded"].append(plain)
                columns = [*batch.columns, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *[pa.array(v, kinds[n][0]) for n, v in kept.items()]]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_tokens", "ids_sha256", "decoded_sha256", *kept])

    return source.mapInArrow(tidy(run), out)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, keep=()).select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
