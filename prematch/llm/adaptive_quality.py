"""Quality rules whose thresholds adapt to language and source.

Each document's rates go into a quantile sketch per (language, source) with
log-linear buckets: a whole value keeps its BITS highest bits, so a bucket is at most
1 / 2^(BITS - 1) of its values wide, at any magnitude.  A sketch is a count per
bucket, and sketches merge by adding counts, exactly and in any order.  Fences at the
quartiles, widened by three interquartile ranges (and a least margin, for groups without spread),
replace fixed cutoffs; the fences are joined back and decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import number_words, runs_of, slices, text_buffer, words_of, written

REPEAT_WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Highest bits of a value that a sketch keeps: whole values below 2^BITS are exact, others off by under 1.6 %.
BITS = 7
#: Rate: (numerator, denominator, scale, fence below, least distance of a fence from its quartile).
RATES = {
    "symbols": ("n_symbols", "word_chars", 1000, False, 10),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False, 400),
    "word_length": ("word_chars", "n_words", 10, True, 30),
}
#: Groups of fewer documents use the fences of their language, or of all.
LEAST_GROUP = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_FACTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each document's stretch."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def measure(data: np.ndarray, offsets: np.ndarray, window: int = REPEAT_WINDOW) -> dict[str, np.ndarray]:
    """The facts of _FACTS for each document of a buffer."""
    starts, ends, first = words_of(data, offsets)
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    solid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    doc = np.repeat(np.arange(len(n_words)), n_words)
    # words under windows that occur twice or more in their document
    at = np.flatnonzero(first[1:][doc] - np.arange(len(starts)) >= window)
    cover = np.zeros(len(starts) + 1, np.int32)
    if len(at):
        run = runs_of(number_words(data, starts, ends)[0], window)[at]
        order = np.argsort(run, kind="stable")  # of equal runs, those of one document follow one another
        same = (run[order][1:] == run[order][:-1]) & (doc[at[order]][1:] == doc[at[order]][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + window, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    raw, cuts = data.tobytes(), offsets.tolist()
    lines, dups = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        worded = [x for x in raw[a:b].split(b"\n") if x.strip()]
        lines[i], dups[i] = len(worded), len(worded) - len(set(worded))
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": _per_doc(solid & _STARTS_CHAR[data], offsets),
        "n_symbols": _per_doc(_SYMBOL[data], offsets),
        "n_lines": lines,
        "n_dup_lines": dups,
        "n_repeat_words": _per_doc(repeated, first),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        found = measure(*text_buffer(piece.column(piece.num_columns - 1)))
        yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *[pa.array(found[x].astype(np.int64)) for x in _FACTS]], [*piece.schema.names[:-1], *_FACTS])


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of _FACTS of every row's whole text (null: none)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(_measured, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in _FACTS))


def _rate(name: str) -> Column:
    top, bottom, scale, _, _ = RATES[name]
    return F.floor(F.col(top) * scale / F.greatest(F.col(bottom), F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """A value's bucket: its BITS highest bits, the lower ones zero."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, value, n): one sketch per (lang, source), of the documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(x).alias("rate"), bucket(_rate(x)).alias("value")) for x in RATES]))
    return measured.where(~base_failed()).select("lang", "source", rates.alias("r")).groupBy("lang", "source", "r.rate", "r.value").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up by fewer keys."""
    return sketch.groupBy(*by, "rate", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: its documents as ``size`` and, for each rate, ``low`` and ``high`` from the quartiles of its sketch."""
    group = Window.partitionBy(*by, "rate")
    upto, total = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(group)
    ranked = sketch.withColumns({"upto": upto, "total": total})
    quartiles = ranked.groupBy(*by, "rate").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("value"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("value"))).alias("q3"), F.max("total").alias("size")
    )
    cols = []
    for name, (_, _, _, below, margin) in RATES.items():
        width = F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(margin))
        mine = F.col("rate") == name
        cols.append(F.max(F.when(mine, F.col("q3") + width)).alias(f"{name}_high"))
        if below:
            cols.append(F.max(F.when(mine, F.col("q1") - width)).alias(f"{name}_low"))
    return quartiles.groupBy(*by).agg(F.max("size").alias("size"), *cols)


def judge(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, lang, source, text) with its counts, base_failed and kept.

    kept is false where the base rules fail (fewer than 20 words, or over 30 %
    of words repeated) or a rate lies outside the fences of its (lang, source);
    groups of under LEAST_GROUP documents take the fences of their language,
    or else of all documents.  Null languages and sources are groups of their
    own; null text has no words and fails the base rules; repeated rows count
    each time; an empty table gives an empty result; other columns are ignored.
    """
    measured = written(facts(docs), "facts")
    own = written(sketches(measured), "sketches")
    names = [f"{x}_{side}" for x, r in RATES.items() for side in (("high", "low") if r[3] else ("high",))]

    def level(by: list[str], tag: str) -> DataFrame:
        found = fences(own if len(by) == 2 else merged(own, by), by)
        return found.where(F.col("size") >= LEAST_GROUP if by else F.lit(True)).select(*[F.col(k).alias(f"_{tag}_{k}") for k in by], F.struct(*names).alias(f"_{tag}"))

    groups = own.select("lang", "source").distinct()
    # the fences of a group are settled on the table of groups; the documents are joined with it once
    table = groups
    for by, tag in ((["lang", "source"], "both"), (["lang"], "of_lang"), ([], "all")):
        fence = level(by, tag)
        if by:
            on = None
            for k in by:
                same = F.col(k).eqNullSafe(F.col(f"_{tag}_{k}"))
                on = same if on is None else on & same
            table = table.join(fence, on, "left").drop(*[f"_{tag}_{k}" for k in by])
        else:
            table = table.crossJoin(F.broadcast(fence))  # one row
    table = table.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.coalesce("_both", "_of_lang", "_all").alias("_fence"))
    joined = measured.join(table, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for name, (_, _, _, below, _) in RATES.items():
        within &= F.coalesce(_rate(name) <= F.col(f"_fence.{name}_high"), F.lit(True))
        if below:
            within &= F.coalesce(_rate(name) >= F.col(f"_fence.{name}_low"), F.lit(True))
    return joined.select("doc_id", *_FACTS, base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))
