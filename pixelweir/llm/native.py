"""Helpers for operators that stay within Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the word contracts: space and \t to \r.
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once a row and names it in body; without it the optimizer may put it inside a lambda, to run for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    r"""Words `[^\x20\x09-\x0D]+` in order; none for an empty text."""
    trimmed = F.btrim(F.translate(text, SPACES, " " * len(SPACES)), F.lit(" "))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +")))


def match_spans(text: Column, pattern: str, block: int = 256) -> Column:
    """array<struct<b, e, s>>: code-point spans and text of all non-overlapping matches, leftmost first.

    The pieces between matches and the matches give running offsets. They are added up in blocks, so that the cost
    does not follow the square of a text's matches.
    """
    empty = F.array().cast("array<struct<b:int,e:int,s:string>>")

    def outer(gaps: Column, found: Column) -> Column:
        def one(state: Column, i: Column) -> Column:
            begin = state["at"] + F.length(gaps[i])
            end = begin + F.length(found[i])
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("b"), end.alias("e"), found[i].alias("s")))).alias("spans"))

        def many(state: Column, k: Column) -> Column:
            last = F.least(k * block + block, F.size(found)) - 1
            inner = F.aggregate(F.sequence(k * block, last), F.struct(state["at"].alias("at"), empty.alias("spans")), one)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["blocks"], F.array(x["spans"])).alias("blocks")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<b:int,e:int,s:string>>>").alias("blocks"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int")), start, many)["blocks"])

    def some(found: Column) -> Column:
        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda gaps: outer(gaps, found)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)
