"""Line dedup by log templates.

A fixed-depth tree sorts lines by their number of tokens and their DEPTH leading tokens, where a token with a digit
counts as variable. Only leaves met in MIN_DOCS documents go on. There a token is constant if it stands at its place
in MIN_DOCS documents' lines of the leaf, and else a variable field; a line whose constant tokens are at least LEAST
of all makes a template: its constants in place, all else generalised. Lines of templates that recur in MIN_DOCS
documents are dropped, from all of them, or from all but one (`keep_first`).

Lines of LONG tokens or more need no template: where equal ones (digits and all) stand in two documents, the first
document keeps them and the others lose them.

Equal lines are merged before tokens are counted, so a line in a third of all documents is one row there. Whether a
leaf is frequent is first asked of a bit set of fixed size, then of the exact counts.

Results: null and empty texts keep what they are; lines without tokens are never dropped. Repeated rows count as one
document each and lose the same lines (both rows of the document that keeps a line keep it). Other columns stay,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import bound_batches, columns, durable, fresh, may_hold, read, row_key, slices, tidy
from pixelweir.llm.native import let
from pixelweir.llm.rolling import Prefixes, mix

DEPTH, MIN_DOCS, LEAST = 2, 10, 0.6
#: Tokens from which a line that stands in two documents is a copy and no coincidence.
LONG = 50
#: Bytes of texts that are hashed together.
SLICE = 512 << 10
#: Bits of the set of frequent leaves (as a power of two). More leaves only make more of them pass to the exact test.
BITS = 22

_SPACE = np.zeros(256, bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_VARIABLE = np.uint64(0x5851F42D4C957F2D)


class Lines:
    """The lines with tokens of some texts: text number, line number, leaf, hash, and their tokens' keys."""

    def __init__(self, texts: list[bytes], depth: int):
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        inside = np.concatenate([[False], ~_SPACE[data]])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = change[::2], change[1::2]
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        breaks = np.cumsum(data == 10)
        text = np.searchsorted(begin, starts, side="right") - 1
        before = np.concatenate([[0], breaks])[begin[:-1]]
        line = breaks[starts] - before[text] if len(starts) else starts
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        self.variable = digits[ends] > digits[starts]
        own = mix(Prefixes(data).hashes(starts, ends - starts))
        token = np.where(self.variable, _VARIABLE, own)
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (line[1:] != line[:-1])]) if len(starts) else starts
        self.first, self.text, self.line = first, text[first], line[first]
        self.size = np.diff(np.r_[first, len(starts)])
        place = np.arange(len(starts)) - np.repeat(first, self.size)
        placed = mix(token + mix(place.astype(np.uint64)))
        leaf = mix(self.size.astype(np.uint64))
        for k in range(depth):
            long = self.size > k
            leaf[long] = mix(leaf[long] + placed[first[long] + k])
        self.leaf = leaf
        self.keys = mix(placed ^ np.repeat(leaf, self.size))
        self.hash = mix(np.add.reduceat(mix(placed), first) ^ leaf) if len(first) else leaf
        exact = mix(own + mix(place.astype(np.uint64)))
        self.exact = mix(np.add.reduceat(exact, first) ^ self.size.astype(np.uint64)) if len(first) else leaf


def _raw(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").replace(b"\0", b" ") for t in b.column("text").to_pylist()]


def dropped_lines(keyed: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, least: float = LEAST, keep_first: bool = False) -> DataFrame:
    """(_d, _h, line): numbers of the lines to drop, for documents (_d, _h, text)."""
    spark = keyed.sparkSession
    bound_batches(spark)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                x = Lines(_raw(b), depth)
                order = np.lexsort((x.leaf, x.text))
                new = np.r_[True, (x.leaf[order][1:] != x.leaf[order][:-1]) | (x.text[order][1:] != x.text[order][:-1])] if len(order) else np.zeros(0, bool)
                leaf, n = np.unique(x.leaf[order][new], return_counts=True)  # once a document
                yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(n.astype(np.int64))], ["leaf", "n"])

    frequent = durable(keyed.select("text").mapInArrow(tidy(leaves), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("leaf"))
    masks = frequent.selectExpr(f"pmod(leaf, {1 << BITS}) AS bit").groupBy(F.expr("int(bit div 32)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("m"))
    bits = np.zeros(1 << BITS, bool)
    for r in masks.collect():  # 2^BITS / 32 rows at most
        bits[r.w * 32 : r.w * 32 + 32] = [r.m >> k & 1 for k in range(32)]
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(shared.value).astype(bool)
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                x = Lines(_raw(b), depth)
                d, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_h"))
                common = maybe[(x.leaf & np.uint64((1 << BITS) - 1)).astype(np.int64)]
                some = np.flatnonzero(common | (x.size >= LONG))
                size = x.size[some]
                # a variable token has no key, nor has any token of a leaf that isn't frequent; they count towards the size alone
                at = np.repeat(x.first[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                fixed = ~x.variable[at] & np.repeat(common[some], size)
                edges = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(some)), size)[fixed], minlength=len(some)))]).astype(np.int32)
                exact = pa.array(x.exact[some].view(np.int64), mask=size < LONG)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x.leaf[some].view(np.int64)), pa.array(x.hash[some].view(np.int64)), exact, pa.array(d[x.text[some]]), pa.array(h[x.text[some]]), pa.array(x.line[some].astype(np.int32)),
                        pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges), pa.array(x.keys[at][fixed].view(np.int64))),
                    ],
                    ["leaf", "m", "x", "_d", "_h", "line", "size", "keys"],
                )

    # a line is known by (leaf, m), a token by (leaf, key), a template by (leaf, x, s): 128 bits and more
    every = durable(keyed.select("_d", "_h", "text").mapInArrow(tidy(lines), "leaf long, m long, x long, _d long, _h long, line int, size int, keys array<long>"))
    # equal lines are merged before they meet the frequent leaves: by leaf alone, a leaf's lines would all go to one task
    merged = every.filter(F.size("keys") > 0).groupBy("leaf", "m").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    kinds = durable(merged.join(frequent, "leaf"))
    tokens = kinds.select("leaf", "m", "n", F.explode("keys").alias("key"))
    constant = durable(tokens.groupBy("leaf", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("leaf", "key"))
    fixed = tokens.join(constant, ["leaf", "key"]).groupBy("leaf", "m").agg(F.count("*").alias("fixed"), F.bit_xor("key").alias("x"), F.bit_xor(F.xxhash64("key")).alias("s"))
    # a leaf's number of tokens is in its keys, so constants and their places are the whole template
    template = durable(kinds.join(fixed, ["leaf", "m"]).filter(F.col("fixed") >= least * F.col("size")).select("leaf", "m", F.struct("leaf", "x", "s").alias("t")))
    placed = durable(every.select("leaf", "m", "_d", "_h", "line").join(template, ["leaf", "m"]).select("t", "_d", "_h", "line"))
    recurring = placed.select("t", "_d", "_h").distinct().groupBy("t").agg(F.count("*").alias("docs"), F.min(F.struct("_d", "_h")).alias("first")).filter(F.col("docs") >= min_docs)
    out = placed.join(durable(recurring), "t")
    if keep_first:
        out = out.filter(F.struct("_d", "_h") != F.col("first"))
    return out.select("_d", "_h", "line").union(repeated_lines(every.filter("x IS NOT NULL").select("x", "m", "_d", "_h", "line")))


def repeated_lines(found: DataFrame) -> DataFrame:
    """(_d, _h, line): of long lines (x, m, _d, _h, line), x and m being 128 bits of equal ones, those that an earlier document has too."""
    place = F.struct("_d", "_h")
    twice = durable(found.groupBy("x", "m").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("x", "m", "first"))
    return found.join(twice, ["x", "m"]).filter(place != F.col("first")).select("_d", "_h", "line")


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n", -1), rest))


def drop_templates(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, least: float = LEAST, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text", dropped: str | None = None
) -> DataFrame:
    """The rows of docs, their text without the dropped lines. dropped: a new column for the numbers of those (null: none)."""
    if dropped and dropped != fresh(docs, dropped):
        raise ValueError(f"docs has a column {dropped} already")
    keyed = docs.select(*row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    gone = durable(dropped_lines(keyed, depth, min_docs, least, keep_first).groupBy("_d", "_h").agg(F.collect_set("line").alias("lines")))
    d, h, lines = fresh(docs, "_d"), fresh(docs, "_h"), dropped or fresh(docs, "_lines")
    own = docs.select("*", *[k.alias(n) for k, n in zip(row_key(doc_id, text), (d, h), strict=True)])
    some = may_hold(gone, d, h)  # only texts that may lose a line are shuffled
    touched = own.filter(some).join(gone.select(F.col("_d").alias(d), F.col("_h").alias(h), F.col("lines").alias(lines)), [d, h], "left")
    cut = touched.withColumn(text, without_lines(F.col(text).cast("string"), F.col(lines)))
    rest = own.filter(~some).withColumn(text, F.col(text).cast("string")).withColumn(lines, F.lit(None).cast("array<int>"))
    out = columns(docs) + ([F.col(dropped)] if dropped else [])
    return rest.select(*out).union(cut.select(*out))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = drop_templates(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")), dropped="_dropped")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


