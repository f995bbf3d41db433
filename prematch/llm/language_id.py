"""Language ID by conditional compression.

Each language is a zstandard raw-content dictionary of sample text.  A text is
compressed with every dictionary in turn, block by block; the smallest total
names the language, and a text whose two smallest totals are within a narrow
margin is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

UNKNOWN = "und"
#: Bounds of the sample that is fitted, per language: documents, characters of each, bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 1024, 32 << 10
#: The labels that are learnt are the most frequent ones, so many at most; their dictionaries, which every task holds at once, get smaller where they would have more bytes together.
MOST_LABELS, MOST_BYTES = 4096, 64 << 20
#: A text is compressed in blocks, so that the dictionary counts for all of it; what goes before each lets matches in short ones count too.
BLOCK, LEVEL, BEFORE = 4096, 6, bytes(64)
#: Rejected below this relative difference of the two smallest totals.
NARROW = 0.01

_LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Dictionaries by language, most frequent language first."""

    languages: list[str]
    dictionaries: list[bytes]


def _plain(text: str) -> bytes:
    """Runs of letters in lower case, each with a space before and after."""
    return (" " + " ".join(_LETTERS.findall(text.lower())) + " ").encode()


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """A model from labelled (text, lang); null texts and labels teach nothing.

    Counts cover all rows.  The dictionary is made of a bounded sample: up to
    ``sample_docs`` distinct texts per language by a hash of the text, the
    first ``sample_chars`` characters of each, as many of them as make ``dictionary_bytes``.  Of
    very many labels the MOST_LABELS most frequent ones are learnt, with
    dictionaries that have MOST_BYTES together.
    """
    known = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    frequent = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LABELS)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    if not languages:
        return Model([], [])
    dictionary_bytes = min(dictionary_bytes, MOST_BYTES // len(languages))
    share = [(x, int(min(1.0, 8 * sample_docs / counts[x]) * (1 << 30))) for x in languages]
    chances = F.broadcast(known.sparkSession.createDataFrame(share, "lang string, chance long"))  # MOST_LABELS rows at most
    drawn = known.select("lang", F.xxhash64("text").alias("rank"), F.substring("text", 1, sample_chars).alias("piece")).join(chances, "lang")
    drawn = drawn.where(F.pmod("rank", F.lit(1 << 30)) <= F.col("chance")).groupBy("lang", "rank").agg(F.min("piece").alias("piece"))
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("at") <= sample_docs)
    # what is drawn is cut to the dictionaries before it reaches the driver
    upto = F.sum(F.octet_length("piece")).over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < 2 * dictionary_bytes)
    pieces: dict[str, list] = {x: [] for x in languages}
    for row in drawn.orderBy("lang", "at").collect():
        pieces[row["lang"]].append(_plain(row["piece"]))
    return Model(languages, [b"".join(pieces[x])[:dictionary_bytes] for x in languages])


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in model.dictionaries:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(content) >= 8:
            options["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options["dict_data"].precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(**options))
    return made


def classify_text(text: str | None, model: Model, encoders: list[zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
    """(language, score, rejected) of one whole text (see ``classify``)."""
    if not text or not model.languages or not _LETTERS.search(text):
        return UNKNOWN, 0.0, True
    plain = _plain(text)
    parts = [BEFORE + plain[k : k + BLOCK] for k in range(0, len(plain), BLOCK)]
    sizes = [sum(len(e.compress(p)) for p in parts) for e in encoders]
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if len(order) == 1:
        return model.languages[0], 1.0, False
    margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
    return model.languages[order[0]], margin / (margin + 0.05), margin < NARROW


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns named in keep), lang_pred, score, rejected for every row of docs.

    The whole text is used, nothing else.  A text that is null or has no
    letter is ``und`` with score 0; so is every text if the model knows no
    language.  score is margin / (margin + 0.05), where margin is the relative
    difference of the two smallest totals; equal totals go to the language
    with more labelled rows.  rejected marks ``und`` and margins under NARROW.
    Repeated rows are classified alike; an empty table gives an empty result.
    A column to keep that is named like one of those made is refused with a ValueError; in a struct it can be carried.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    if clash := {"lang_pred", "score", "rejected"} & set(keep):
        raise ValueError(f"columns can't be kept beside those made of the same name: {sorted(clash)}")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    shared = spark.sparkContext.broadcast((model.languages, model.dictionaries))  # plain types: broadcasts are not pickled by value
    names = [*kept.columns, "lang_pred", "score", "rejected"]
    out = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        encoders = compressors(own)
        for batch in slices(batches):
            made = [classify_text(t, own, encoders) for t in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(run, out)


def held_out(doc_id="doc_id"):
    """Rows kept from fitting: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
