"""Names of one convention resolved to players of another, without guessing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prematch.functions import scalars
from prematch.functions.scalars import indel_ratio

METHODS = ["exact_surname_initial", "ambiguous_surname_initial", "exact_surname_only", "fuzzy_surname", "fuzzy_ambiguous_or_low_score", "unmatched", "invalid_name"]
UNRESOLVED = ["unmatched", "ambiguous_surname_initial", "fuzzy_ambiguous_or_low_score", "invalid_name"]
REVIEW = ["tennis_data_name", "tennis_data_surname", "tennis_data_initial", "sackmann_name", "player_id", "match_method", "score", "second_score"]


def player_dimension(players: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Players (any of the two spellings of the columns) to player_id, full_name, hand, height, birth_date; the first row of each id."""
    for old, new in {"name_first": "first_name", "name_last": "last_name", "dob": "birth_date", "ht": "height"}.items():
        if old in players.columns and new not in players.columns:
            players = players.withColumnRenamed(old, new)
    absent = {"player_id", "first_name", "last_name"} - set(players.columns)
    if absent:
        raise ValueError(f"missing required columns: {sorted(absent)}")
    blank = F.lit(None).cast("string")
    here = lambda c: F.col(c).cast("string") if c in players.columns else blank
    made = players.select(
        F.trim(F.col("player_id").cast("string")).alias("player_id"),
        scalars.full_name("first_name", "last_name").alias("full_name"),
        scalars.hand(here("hand")).alias("hand"),
        scalars.number(here("height")).alias("height"),
        scalars.to_date(here("birth_date"), "yyyyMMdd").alias("birth_date"),
        *[F.col(c) for c in order or []],
    )
    by = order or ["full_name", "birth_date", "hand", "height"]
    at = F.row_number().over(Window.partitionBy("player_id").orderBy(*[F.col(c).asc_nulls_last() for c in by]))
    return made.withColumn("_at", at).where("_at = 1").drop("_at", *(order or []))


def distinct_names(matches: DataFrame, columns: list[str]) -> DataFrame:
    """All names in the given columns, once each, blank ones left out."""
    return matches.select(F.explode(F.array(*columns)).alias("name")).where(F.trim("name") != "").distinct()


def _normal(c: str, ascii_only: bool):
    return scalars.ascii_words(c) if ascii_only else scalars.normal_name_udf(F.col(c))


def resolve_names(names: DataFrame, players: DataFrame, fuzzy: bool = True, threshold: float = 92.0, margin: float = 5.0, ascii_only: bool = False, order: str = "player_id") -> DataFrame:
    """One review row (REVIEW) per name; player_id is set where exactly one player fits.

    names (name) are "Surname I.", players (player_id, full_name) "First
    Surname".  A surname with exactly one player of that initial (or no
    initial given) resolves, several are ambiguous.  Only names without any
    such player go on to the fuzzy step, where all distinct surnames compete:
    score and second_score are those of the two nearest ones, whoever wins.
    Ties of scores go to the surname of the player first in ``order``.
    """
    surname, initial = scalars.surname_first("_n")
    asked = names.select(F.col("name").alias("tennis_data_name"), _normal("name", ascii_only).alias("_n"))
    asked = asked.select("tennis_data_name", surname.alias("tennis_data_surname"), initial.alias("tennis_data_initial"))
    surname, initial = scalars.surname_last("_n")
    known = players.select("player_id", "full_name", F.col(order).alias("_order"), _normal("full_name", ascii_only).alias("_n"))
    known = known.select("player_id", "full_name", "_order", surname.alias("surname"), initial.alias("initial")).where("surname != ''")
    fits = (F.col("tennis_data_surname") == F.col("surname")) & ((F.col("tennis_data_initial") == "") | (F.col("tennis_data_initial") == F.col("initial")))
    found = asked.join(known, fits, "left").groupBy("tennis_data_name", "tennis_data_surname", "tennis_data_initial").agg(F.count("player_id").alias("n"), F.min("player_id").alias("player_id"), F.min("full_name").alias("sackmann_name"))
    valid, one = F.col("tennis_data_surname") != "", F.col("n") == 1
    exact = found.select(
        "tennis_data_name",
        "tennis_data_surname",
        "tennis_data_initial",
        F.when(valid & one, F.col("sackmann_name")).alias("sackmann_name"),
        F.when(valid & one, F.col("player_id")).alias("player_id"),
        F.when(~valid, "invalid_name").when(one, "exact_surname_initial").when(F.col("n") > 1, "ambiguous_surname_initial").otherwise("unmatched").alias("match_method"),
        F.when(valid & (F.col("n") > 0), F.lit(100.0)).alias("score"),
        F.lit(None).cast("double").alias("second_score"),
    )
    if not fuzzy:
        return exact
    open_names = exact.where("match_method = 'unmatched'").select("tennis_data_name", "tennis_data_surname", "tennis_data_initial")
    ranked = nearest_surnames(open_names, known)
    own = known.where(F.col("surname").isNotNull()).select("player_id", "full_name", F.col("surname").alias("best"), F.col("initial").alias("_i"))
    fit = (F.col("tennis_data_initial") == "") | (F.col("tennis_data_initial") == F.col("_i"))
    tried = ranked.join(own, "best", "left").groupBy("tennis_data_name").agg(F.first("score").alias("score"), F.first("second").alias("second"), F.count_if(fit & F.col("player_id").isNotNull()).alias("fits"), F.min(F.when(fit, F.col("player_id"))).alias("pid"), F.min(F.when(fit, F.col("full_name"))).alias("pname"))
    win = (F.col("f.score") >= threshold) & (F.col("f.second").isNull() | (F.col("f.score") - F.col("f.second") >= margin)) & (F.col("f.fits") == 1)
    joined = exact.alias("e").join(tried.alias("f"), "tennis_data_name", "left")
    has = F.col("f.score").isNotNull()
    return joined.select(
        "tennis_data_name",
        "e.tennis_data_surname",
        "e.tennis_data_initial",
        F.when(has & win, F.col("f.pname")).otherwise(F.col("e.sackmann_name")).alias("sackmann_name"),
        F.when(has & win, F.col("f.pid")).otherwise(F.col("e.player_id")).alias("player_id"),
        F.when(has & win, "fuzzy_surname").when(has, "fuzzy_ambiguous_or_low_score").otherwise(F.col("e.match_method")).alias("match_method"),
        F.when(has, F.col("f.score")).otherwise(F.col("e.score")).alias("score"),
        F.when(has, F.col("f.second")).otherwise(F.col("e.second_score")).alias("second_score"),
    )


#: Surnames that go out to the executors at once.
BLOCK_SURNAMES = 50_000


class Surnames:
    """Distinct surnames, ready for the two nearest ones of a name."""

    def __init__(self, names: list[str], orders: list[str]):
        self.names, self.orders = names, orders
        self.length = np.array([len(n) for n in names], np.int64)
        self.letters = np.stack([self._letters(n) for n in names]) if names else np.zeros((0, 64), np.int16)

    @staticmethod
    def _letters(name: str) -> np.ndarray:
        return np.bincount(np.frombuffer(name.encode("utf-32-le"), "<u4") & 63, minlength=64).astype(np.int16)

    def nearest(self, name: str) -> list[tuple[float, str, str]]:
        """(score, order, surname) of the two nearest surnames, the best first; ties by order, then surname.

        Letters in common bound a score from above, so only surnames whose bound reaches the second best are compared.
        """
        common = np.minimum(self.letters, self._letters(name)).sum(1, dtype=np.int64)
        both = self.length + len(name)
        bound = np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)
        found: list[tuple[float, str, str]] = []
        for k in np.argsort(-bound, kind="stable").tolist():
            if len(found) == 2 and bound[k] < found[1][0] - 1e-9:
                break
            found.append((indel_ratio(name, self.names[k]), self.orders[k], self.names[k]))
            found = sorted(found, key=lambda x: (-x[0], x[1], x[2]))[:2]
        return found


def nearest_surnames(names: DataFrame, known: DataFrame, block: int = BLOCK_SURNAMES) -> DataFrame:
    """names with the best of known's distinct surnames, its score and the second one's score; null without any surname.

    The names are the stated queries; the surnames go out in blocks by hash, and the best two of each block compete again.
    """
    spark = names.sparkSession
    surnames = known.groupBy("surname").agg(F.min("_order").alias("_order"))
    blocks = max(1, -(-surnames.count() // block))
    schema = T.StructType([*names.schema.fields, *[T.StructField(c, t) for c, t in (("_surname", T.StringType()), ("_score", T.DoubleType()), ("_order", T.StringType()))]])
    pairs = None
    for k in range(blocks):
        rows = surnames.where(F.pmod(F.xxhash64("surname"), F.lit(blocks)) == k).orderBy("surname").collect()
        shared = spark.sparkContext.broadcast(([r["surname"] for r in rows], [str(r["_order"]) for r in rows]))

        def run(frames, shared=shared):
            held = Surnames(*shared.value)
            for frame in frames:
                near = [held.nearest(n) for n in frame["tennis_data_surname"]]
                out = frame.loc[frame.index.repeat([len(x) for x in near])].copy()
                flat = [y for x in near for y in x]
                out["_surname"], out["_score"], out["_order"] = [y[2] for y in flat], [y[0] for y in flat], [y[1] for y in flat]
                yield out

        found = names.mapInPandas(run, schema)
        pairs = found if pairs is None else pairs.unionByName(found)
    at = Window.partitionBy("tennis_data_name").orderBy(F.col("_score").desc(), "_order", "_surname")
    top = pairs.withColumn("_at", F.row_number().over(at)).where("_at <= 2")
    pick = lambda i, c: F.max(F.when(F.col("_at") == i, F.col(c)))
    return top.groupBy(*names.columns).agg(pick(1, "_surname").alias("best"), pick(1, "_score").alias("score"), pick(2, "_score").alias("second"))


def attach_ids(matches: DataFrame, review: DataFrame) -> DataFrame:
    """matches with winner_sackmann_id and loser_sackmann_id of the resolved names; others stay null."""
    ids = review.where("player_id is not null").select(F.col("tennis_data_name").alias("_name"), F.col("player_id").alias("_id"))
    for side in ("winner", "loser"):
        matches = matches.join(ids.withColumnsRenamed({"_name": f"_{side}", "_id": f"{side}_sackmann_id"}), F.col(f"{side}_name") == F.col(f"_{side}"), "left").drop(f"_{side}")
    return matches


def attach_biography(matches: DataFrame, players: DataFrame, date: str = "match_date") -> DataFrame:
    """matches with each side's height, hand and age in years; one lookup per side."""
    for side in ("winner", "loser"):
        own = players.select(F.col("player_id").alias("_id"), F.col("height").alias(f"{side}_height"), F.col("hand").alias(f"{side}_hand"), F.col("birth_date").alias("_birth"))
        joined = matches.join(own, F.col(f"{side}_sackmann_id") == F.col("_id"), "left")
        matches = joined.withColumn(f"{side}_age_years", scalars.age_years(date, "_birth")).drop("_id", "_birth")
    return matches
