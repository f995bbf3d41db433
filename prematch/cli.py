"""Command line: download, manifest, merge, normalize, enrich, features, tree, view."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prematch import schema
from prematch.functions import scalars
from prematch.operators import checks, clean, entity, features, history, ml, serve
from prematch.sources import manifest as manifests
from prematch.sources import tables


def session() -> SparkSession:
    # the JVM does not compile methods of over 8,000 bytes; wide projections are faster without whole-stage code then
    return SparkSession.builder.appName("prematch").config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """String columns read from CSV, given their types again."""
    kinds = {"double": scalars.number, "date": scalars.to_date, "long": lambda c: scalars.whole(scalars.number(c)), "int": lambda c: scalars.whole(scalars.number(c)).cast("int")}
    return df.withColumns({c: kinds[k](c) for c, k in columns.items() if c in df.columns})


CLEAN_TYPES = {c: "double" for c in schema.NUMERIC} | {c: "long" for c in schema.INTEGERS} | {"date": "date", "has_any_market_odds": "int"}


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned or enriched matches with ``match_id``, their number in stored order."""
    df = tables.read_any(spark, path) if path.endswith(".parquet") else typed(tables.read_csv(spark, path), CLEAN_TYPES)
    df = typed(df, {c: "double" for c in df.columns if c.endswith(("_before", "_height", "_age_years", "_diff"))}) if not path.endswith(".parquet") else df
    clean.require(df, ["date", "winner_name", "loser_name", "surface"])
    return features.row_numbers(df.dropna(subset=["date"]), ["date", "source_year", "atp", "tournament", "round", "winner_name", "loser_name"], "match_id")


def write(df: DataFrame, path: str) -> None:
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        tables.write_csv(df, path, single=True)


def merge(spark: SparkSession, folder: str, output: str) -> None:
    """Yearly workbooks to one raw table."""
    raw = tables.yearly_workbooks(spark, folder).withColumn("Date", scalars.iso(scalars.to_date("Date")))
    write(clean.sort_nulls_last(raw, ["Date", "ATP", "Tournament", "Winner", "Loser"]), output)


def normalize(spark: SparkSession, source: str, output: str) -> dict:
    """Raw table to cleaned matches; counters of every step go to <output>.json."""
    raw = tables.read_any(spark, source)
    report = clean.clean_counters(raw).first().asDict() | {"created_at_utc": dt.datetime.now(dt.timezone.utc).isoformat(), "input_columns": raw.columns, "output_columns": schema.CLEAN_COLUMNS, "leakage_columns_removed": [*schema.LEAKAGE, "Comment"]}
    write(clean.ordered(clean.normalize(raw)), output)
    tables.write_json(report, f"{output}.json")
    return report


def enrich(spark: SparkSession, source: str, folder: str, output: str, report: str, start: int | None = None, end: int | None = None, threshold: float = 92.0, margin: float = 5.0, fuzzy: bool = True) -> DataFrame:
    """Cleaned matches with ids, biography and service rates; the review of names goes to ``report``."""
    matches = read_clean(spark, source)
    players = entity.player_dimension(tables.read_csv(spark, f"{folder}/atp_players.csv")).persist()
    first, last = tables.history_range(matches, start, end)
    past, _ = tables.history_years(spark, folder, first, last)
    past = past.withColumns({"tourney_date": scalars.to_date("tourney_date", "yyyyMMdd"), "match_num": scalars.whole(scalars.number("match_num"))}).dropna(subset=["tourney_date", "winner_id", "loser_id"])
    past = features.row_numbers(past, ["tourney_date", "tourney_id", "match_num"], "history_id")
    review = entity.resolve_names(entity.distinct_names(matches, ["winner_name", "loser_name"]), players, fuzzy, threshold, margin).persist()
    write(review.where(F.col("match_method").isin(entity.UNRESOLVED)).orderBy("tennis_data_name"), report)
    known = entity.attach_biography(entity.attach_ids(matches, review), players, "date")
    made = serve.attach_serve(known, serve.serve_rates(past, "history_id"), "match_id", "date", "sackmann_id")
    made = made.withColumns({d: F.col(f"winner_{s}") - F.col(f"loser_{s}") for s, d in schema.DIFFERENCES.items() if f"winner_{s}" in made.columns and (s in ("height", "age_years") or s.endswith("_before") and s[:-7] in schema.SERVE_RATES)})
    write(made.orderBy("match_id").drop("match_id"), output)
    checks.warn(made)
    return checks.coverage(made, [c for c in made.columns if c.startswith(("winner_", "loser_"))])


def build_features(spark: SparkSession, source: str, output: str, metadata: str, rare: int = 20, step: int = 1, least: int = 8, select: bool = True) -> dict:
    """Enriched matches to the mirrored training set, with a forest baseline and selected features in the metadata."""
    matches = features.rare_buckets(read_clean(spark, source), rare)
    full = features.add_features(history.attach_head_to_head(history.attach_history(matches, "match_id", "date"), "match_id", "date"), rare)
    checks.validate(full)
    rows = features.row_numbers(features.mirrored(full), ["date", "match_id", "player_a_win"]).persist()
    numeric, categorical = features.matrix_columns(rows)
    report = {"created_at_utc": dt.datetime.now(dt.timezone.utc).isoformat(), "rows": rows.count(), "numeric_features": numeric, "categorical_features": categorical, "rare_threshold": rare}
    report["baseline"] = ml.baseline_forest(rows, "row_id", numeric, categorical, "player_a_win")
    if select:
        report["selection"] = ml.eliminate_features(rows, "row_id", numeric, categorical, "player_a_win", step, least)
    write(rows.orderBy("row_id").drop("row_id", "match_id"), output)
    tables.write_json(report, metadata)
    rows.unpersist()
    return report


def tree(spark: SparkSession, source: str, metadata: str, metrics: str, fraction: float = 0.15, folds: int = 5, exclude: str = "") -> dict:
    """A pruned tree chosen over date folds and judged on held-out dates."""
    names = tables.read_json(metadata)
    dropped = [x.strip() for x in exclude.split(",") if x.strip()]
    unknown = sorted(set(dropped) - set(names["numeric_features"]) - set(names["categorical_features"]))
    if unknown:
        raise ValueError(f"not features: {unknown}")
    df = tables.read_any(spark, source)
    df = typed(df, {c: "double" for c in names["numeric_features"]} | {"date": "date", "player_a_win": "int"}) if not source.endswith(".parquet") else df
    df = df.dropna(subset=["date"]).persist()
    here = lambda kind: [c for c in names[kind] if c in df.columns and c not in dropped]
    found = ml.search_tree(df, "date", here("numeric_features"), here("categorical_features"), "player_a_win", fraction, folds)
    ml.save_metrics(found, metrics)
    return found


def view(spark: SparkSession, path: str, offset: int = 0, window: int = 500) -> str:
    """One page of a table as text, in the order in which it is stored; the offset is kept within the table."""
    df = tables.read_any(spark, path)
    named = df.withColumn("_row", F.monotonically_increasing_id())  # as stored
    rows = tables.page(named, offset, window, ["_row"]).drop("_row").collect()
    return "\n".join(["\t".join(df.columns), *["\t".join(scalars.format_cell(v) for v in r) for r in rows]])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="prematch", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        for flag, settings in options:
            p.add_argument(flag, **settings)

    years = (("--start-year", {"type": int, "required": True}), ("--end-year", {"type": int, "required": True}))
    command("download", *years, ("--url", {"required": True}), ("--folder", {"default": "data/raw"}))
    command("manifest", *years, ("--folder", {"default": "data/raw"}), ("--output", {"default": "data/manifest.json"}))
    command("merge", ("--folder", {"default": "data/raw"}), ("--output", {"default": "data/interim/matches_raw.csv"}))
    command("normalize", ("--input", {"default": "data/interim/matches_raw.csv"}), ("--output", {"default": "data/interim/matches_clean.csv"}))
    command(
        "enrich", ("--cleaned-input", {"default": "data/interim/matches_clean.csv"}), ("--history-dir", {"required": True}), ("--start-year", {"type": int}), ("--end-year", {"type": int}),
        ("--output", {"default": "data/interim/matches_enriched.csv"}), ("--unmatched-report", {"default": "data/interim/unmatched.csv"}), ("--fuzzy-threshold", {"type": float, "default": 92.0}), ("--fuzzy-margin", {"type": float, "default": 5.0}),
    )
    command(
        "features", ("--input", {"default": "data/interim/matches_enriched.csv"}), ("--output-features", {"default": "data/processed/features.csv"}), ("--output-metadata", {"default": "data/processed/features.json"}),
        ("--rare-threshold", {"type": int, "default": 20}), ("--rfecv-step", {"type": int, "default": 1}), ("--rfecv-min-features", {"type": int, "default": 8}),
    )
    command(
        "tree", ("--input", {"default": "data/processed/features.csv"}), ("--metadata", {"default": "data/processed/features.json"}), ("--holdout-fraction", {"type": float, "default": 0.15}), ("--cv-folds", {"type": int, "default": 5}),
        ("--exclude-features", {"default": ""}), ("--output-metrics", {"default": "data/processed/tree.json"}),
    )
    command("view", ("--file", {"required": True}), ("--offset", {"type": int, "default": 0}), ("--window-size", {"type": int, "default": 500}))
    a = parser.parse_args(argv)
    spark = session()
    if a.command == "download":
        tables.download_years(a.url, a.folder, a.start_year, a.end_year)
    elif a.command == "manifest":
        tables.write_json({"files": [r.asDict() for r in manifests.manifest(spark, a.folder, a.start_year, a.end_year).collect()]}, a.output)
    elif a.command == "merge":
        merge(spark, a.folder, a.output)
    elif a.command == "normalize":
        print(normalize(spark, a.input, a.output))
    elif a.command == "enrich":
        enrich(spark, a.cleaned_input, a.history_dir, a.output, a.unmatched_report, a.start_year, a.end_year, a.fuzzy_threshold, a.fuzzy_margin).show(60, False)
    elif a.command == "features":
        print(build_features(spark, a.input, a.output_features, a.output_metadata, a.rare_threshold, a.rfecv_step, a.rfecv_min_features))
    elif a.command == "tree":
        print(tree(spark, a.input, a.metadata, a.output_metrics, a.holdout_fraction, a.cv_folds, a.exclude_features)["text"])
    else:
        print(view(spark, a.file, a.offset, a.window_size))


if __name__ == "__main__":
    main()
