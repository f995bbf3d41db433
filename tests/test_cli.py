"""The whole command chain on small files."""

import datetime as dt
import os
import random

from prematch import cli, schema
from prematch.operators import clean
from prematch.sources import tables, xlsx
from prematch.streaming import ingest


def test_chain(spark, tmp_path):
    rng = random.Random(0)
    head = [c for c in schema.RAW_COLUMNS if c != "source_year"]
    names = ["Nadal R.", "Federer R.", "Zverev A.", "Murray A.", "Ferrer D.", "Thiem D."]
    rows = []
    for i in range(240):
        w, l = rng.sample(names, 2)  # noqa: E741
        r = dict.fromkeys(head) | {"ATP": i % 9, "Location": " Rome ", "Tournament": f"Cup {i % 4}", "Date": dt.date(2021, 1, 1) + dt.timedelta(days=i), "Series": "Masters 1000", "Court": "Indoor", "Surface": rng.choice(["Clay", "Hard"]), "Round": "1st Round", "Best of": 3, "Winner": w, "Loser": l, "WRank": rng.randint(1, 50), "LRank": rng.randint(20, 90), "WPts": 500, "LPts": 300, "Comment": "Completed", "AvgW": 1.5, "AvgL": 2.5}
        rows.append([r[c] for c in head])
    (tmp_path / "raw").mkdir()
    xlsx.write_xlsx(str(tmp_path / "raw" / "2021.xlsx"), [head, *rows, rows[0]])
    (tmp_path / "past").mkdir()
    (tmp_path / "past" / "atp_players.csv").write_text("player_id,name_first,name_last,hand,dob,ioc,height\n" + "".join(f"{k},{f},{s},R,1990010{k},X,18{k}\n" for k, (f, s) in enumerate([("Rafael", "Nadal"), ("Roger", "Federer"), ("Alexander", "Zverev"), ("Andy", "Murray"), ("David", "Ferrer")], 1)))
    stats = [f"{s}_{c}" for s in "wl" for c in schema.SERVE]
    lines = ["tourney_id,match_num,tourney_date,winner_id,loser_id," + ",".join(stats)]
    lines += [f"t{i},{i},2020{1 + i % 12:02d}01,{1 + i % 5},{1 + (i + 1) % 5}," + ",".join(["4", "2", "60", "40", "30", "10", "11", "3", "5"] * 2) for i in range(40)]
    (tmp_path / "past" / "atp_matches_2020.csv").write_text("\n".join(lines) + "\n")

    p = {n: str(tmp_path / f"{n}.csv") for n in ("raw", "clean", "enriched", "unmatched", "features")}
    cli.merge(spark, str(tmp_path / "raw"), p["raw"])
    report = cli.normalize(spark, p["raw"], p["clean"])
    assert (report["input_rows"], report["removed_exact_duplicates"], report["output_rows"]) == (241, 1, 240)
    cover = {r.column_name: r.pct for r in cli.enrich(spark, p["clean"], str(tmp_path / "past"), p["enriched"], p["unmatched"]).collect()}
    assert 50 < cover["winner_ace_rate_before"] <= 100 and cover["winner_height"] < 100
    assert [r.tennis_data_name for r in tables.read_csv(spark, p["unmatched"]).collect()] == ["Thiem D."]
    made = cli.build_features(spark, p["enriched"], p["features"], str(tmp_path / "m.json"), rare=10, select=False)
    assert made["rows"] == 480 and {"winner_height", "ace_rate_diff", "h2h_matches_before"} <= set(made["numeric_features"])
    assert 0 <= made["baseline"]["cv_mean"] <= 1
    assert cli.view(spark, p["features"], 2, 3).count("\n") == 3
    lines = (tmp_path / "features.csv").read_text().splitlines()
    first = lambda text: [x.split("\t")[0] for x in text.split("\n")[1:]]
    assert first(cli.view(spark, p["features"], 470, 500)) == [x.split(",")[0] for x in lines[471:]]
    assert first(cli.view(spark, p["features"], 9999, 5)) == [lines[-1].split(",")[0]]

    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.csv").write_text((tmp_path / "raw.csv").read_text())
    out = ingest.start(spark, str(tmp_path / "drop"), str(tmp_path / "stream"), str(tmp_path / "ck"))
    out.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 240


def test_stream_keeps_all_matches_in_any_order(spark, tmp_path):
    """The result is that of one batch, whichever years come first and however many files a trigger takes."""
    header = ",".join(schema.RAW_COLUMNS)
    rows = {}
    for year in (2026, 2015, 2016, 2017):
        r = [dict.fromkeys(schema.RAW_COLUMNS, "") | {"source_year": str(year), "ATP": "1", "Date": f"{year}-0{1 + i}-02", "Winner": f"A{i} B.", "Loser": "C D.", "Comment": "Completed"} for i in range(5)]
        rows[year] = [",".join(x[c] for c in schema.RAW_COLUMNS) for x in r]
    for k, order in enumerate(([2026, 2015, 2016, 2017], [2015, 2016, 2017, 2026], [2017, 2026, 2015, 2016])):
        for per_trigger in (1, 2, 16):
            here = tmp_path / f"{k}-{per_trigger}"
            (here / "in").mkdir(parents=True)
            for at, year in enumerate(order):
                path = here / "in" / f"{at}.csv"
                path.write_text("\n".join([header, *rows[year], *rows[order[0]][:2]]) + "\n")  # some rows come again in every file
                os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
            done = ingest.start(spark, str(here / "in"), str(here / "out"), str(here / "ck"), per_trigger)
            assert done.awaitTermination(180)
            got = spark.read.parquet(str(here / "out"))
            batch = clean.normalize(tables.read_csv(spark, str(here / "in"), columns=schema.RAW_COLUMNS))
            assert got.count() == 20 == batch.count() and got.exceptAll(batch).count() == 0
