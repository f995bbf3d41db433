"""Named queries over sources, sinks, small tables and checks, each with an independent DuckDB query; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prematch import cli, schema
from prematch.functions import scalars
from prematch.operators import checks, clean, entity, features, splits
from prematch.plans import views
from prematch.plans.catalog import _B, _R, _ts_folds, query
from prematch.sources import shared, store, tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- cleaning -------------------------------------------------------------------------------------

_KEYED = ["best_of", "winner_rank", "loser_rank", "winner_points", "loser_points", "avg_winner", "avg_loser"]


@query(
    f"""with {_R}, said as (select * replace (case when match_id % 3 = 0 then 'Completed' else comment end as comment), try_cast("date" as date) as d from raw)
select match_id, d, tournament, winner_name, loser_name, {", ".join(f"try_cast({c} as double) as {c}" for c in _KEYED)} from said
where comment = 'Completed' and d is not null and winner_name is not null and loser_name is not null
qualify row_number() over (partition by d, tournament, winner_name, loser_name order by match_id) = 1"""
)
def q_keyed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exploratory path's rows: the comment exact, the first row of each key, numbers read."""
    raw = views.raw(spark, sf_dir).withColumn("Comment", F.when(F.col("match_id") % 3 == 0, "Completed").otherwise(F.col("Comment")))
    made = clean.keyed_matches(raw, ["match_id"])
    names = {new: old for old, new in schema.RAW_TO_CLEAN.items()}
    return made.select("match_id", F.col("Date").alias("d"), *[F.col(f"`{names[c]}`").alias(c) for c in ("tournament", "winner_name", "loser_name", *_KEYED)])


_DIMENSION = """select concat(' ', cast(s_suppkey % 70 as varchar(9)), ' ') as player_id, case when s_suppkey % 9 = 0 then null else concat('Fn', cast(s_suppkey as varchar(9))) end as name_first,
  concat('Ln', cast(s_suppkey % 11 as varchar(9)), ' ') as name_last, case s_suppkey % 3 when 0 then 'U' when 1 then 'R' else null end as hand,
  case s_suppkey % 4 when 0 then '20200231' when 1 then 'x' else concat('199', cast(s_suppkey % 10 as varchar(9)), '0415') end as dob,
  case when s_suppkey % 5 = 0 then 'tall' else cast(170 + s_suppkey % 30 as varchar(9)) end as ht, s_suppkey as line from supplier"""


@query(
    f"""with p as ({_DIMENSION}) select trim(player_id) as player_id, trim(concat(coalesce(name_first, ''), ' ', coalesce(name_last, ''))) as full_name, nullif(hand, 'U') as hand,
  try_cast(ht as double) as height, try_cast(case when len(dob) = 8 then concat(dob[1:4], '-', dob[5:6], '-', dob[7:8]) end as date) as birth_date
from p qualify row_number() over (partition by trim(player_id) order by line) = 1"""
)
def q_player_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players from other spellings of the columns: ids trimmed, names joined, dates that can't be read missing, the first row of each id."""
    players = spark.sql(_DIMENSION.replace("from supplier", "from {supplier}"), supplier=_read(spark, sf_dir, "supplier"))
    return entity.player_dimension(players, ["line"])


# --- small tables ---------------------------------------------------------------------------------


@query(f"with {_B}, n as (select distinct trim(name) as name from (select winner_name as name from bouts union all select loser_name from bouts)) select name, row_number() over (order by name) - 1 as place from n")
def q_sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of both sides in order."""
    return features.row_numbers(entity.distinct_names(views.bouts(spark, sf_dir), ["winner_name", "loser_name"]), ["name"], "place").select("name", "place")


@query(f"with {_B} select cast(greatest(1968, min(source_year) - 5) as int) as first_year, cast(max(source_year) as int) as last_year from bouts")
def q_history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years of history to read."""
    return spark.createDataFrame([tables.history_range(views.bouts(spark, sf_dir))], "first_year int, last_year int")


@query(f"with {_B} select b.match_id, b.winner_name, o.o_totalprice as price from bouts b left join orders o on o.o_orderkey = b.match_id and o.o_orderkey % 4 = 0")
def q_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose key is unique on both sides, as checked."""
    prices = _read(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("match_id"), F.col("o_totalprice").alias("price"))
    return checks.join_one_to_one(views.bouts(spark, sf_dir).select("match_id", "winner_name"), prices, ["match_id"])


@query("select column_name, n_low, n_high from (select 'winner_ace_rate_before' as column_name, count(*) filter (where c_acctbal / 5000 < 0) as n_low, count(*) filter (where c_acctbal / 5000 > 1) as n_high from customer "
       "union all select 'loser_age_years', count(*) filter (where c_custkey % 70 < 12), count(*) filter (where c_custkey % 70 > 60) from customer) where n_low > 0 or n_high > 0")  # fmt: skip
def q_warn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates outside 0 to 1 and ages outside 12 to 60, reported without an error."""
    rows = _read(spark, sf_dir, "customer").select((F.col("c_acctbal") / 5000).cast("double").alias("winner_ace_rate_before"), (F.col("c_custkey") % 70).cast("double").alias("loser_age_years"), F.lit(0.5).alias("winner_df_rate_before"))
    return spark.createDataFrame([(r["column_name"], r["n_low"], r["n_high"]) for r in checks.warn(rows)], "column_name string, n_low long, n_high long")


@query("select cast(place as int) as place, name from (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(["match_id", "source_year", "atp", "winner_points", "loser_points", "court", "player_a_win"])) + ") t(place, name)")
def q_excluded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a feature matrix, of those there are, without the excluded ones, in order."""
    rows = views.bouts(spark, sf_dir).withColumn("player_a_win", F.lit(1))
    made = features.feature_matrix(rows, ["match_id"], exclude=["winner_rank", "loser_rank", "surface"])
    return spark.createDataFrame(list(enumerate(made.columns)), "place int, name string")


@query(
    f"with f as ({_ts_folds()}) select fold, min(row_id) filter (where part = 'test') as first, max(row_id) filter (where part = 'test') + 1 as stop, count(*) filter (where part = 'train') as n_train from f group by fold"
)
def q_fold_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the folds by row, computed from the number of rows alone."""
    n = views.bouts(spark, sf_dir).count()
    bounds = splits.row_splits(n, splits.split_count(n))
    return spark.createDataFrame([(i + 1, a, b, a) for i, (a, b) in enumerate(bounds)], "fold int, first long, stop long, n_train long")


# --- files ------------------------------------------------------------------------------------------


@query(
    "with lines as (select r_regionkey as k, case r_regionkey % 3 when 0 then r_name when 1 then concat(r_name, ',b,c') else concat(r_name, ',b,c,d,e') end as line from region) "
    "select k, split_part(line, ',', 1) as column_1, split_part(line, ',', 2) as column_2, case when len(string_split(line, ',')) > 3 then array_to_string(string_split(line, ',')[3:], ',') else split_part(line, ',', 3) end as column_3 from lines"
)
def q_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a file with too few and too many fields, mended to three."""
    rows = _read(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # 5 rows
    path = f"{shared.folder(spark, 'ragged')}/lines.txt"
    tail = ["", ",b,c", ",b,c,d,e"]
    store.write(path, iter([f"{r['r_name']}{tail[r['r_regionkey'] % 3]}\n".encode() for r in rows]))
    keys = spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in rows], "k int, column_1 string")
    return keys.join(tables.ragged_rows(spark, path, 3), "column_1").select("k", "column_1", "column_2", "column_3")


@query("select * from (values (0, 'a.CSV', ','), (1, 'B.csv', ';'), (2, 'deep/c.tsv', '\t'), (3, 'deep/d.txt', '|')) t(place, name, separator)")
def q_found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable files below a folder in order without regard to case, heavy folders left out, with their separators."""
    top = shared.folder(spark, "found")
    for name, text in {"B.csv": "x;y\n1;2\n", "a.CSV": "x,y\n1,2\n", "deep/c.tsv": "x\ty\n", "deep/d.txt": "x|y\n1|2\n3|4\n", ".git/e.csv": "x\n", "node_modules/f.csv": "x\n", "g.png": "x"}.items():
        store.write(f"{top}/{name}", iter([text.encode()]))
    found = tables.find_files(top)
    return spark.createDataFrame([(i, p[p.index("/found-") :].split("/", 2)[2], tables.sniff_separator(p)) for i, p in enumerate(found)], "place int, name string, separator string")


@query(
    "select 'n_nationkey,name,day' as line union all select concat(n_nationkey, ',', case when n_nationkey % 7 = 0 then '' else concat('\"', n_name, ', x\"') end, ',', strftime(date '2024-01-01' + cast(n_nationkey as int), '%Y-%m-%d')) from nation"
)
def q_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a table written as one CSV file: header, quotes, nothing for null, ISO dates; folders are made."""
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 7 != 0, F.concat("n_name", F.lit(", x"))).alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey").cast("int")).alias("day"))
    path = f"{shared.folder(spark, 'lines')}/new/folders/nations.csv"
    tables.write_csv(rows, path, single=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("select cast(count(*) as bigint) as n, cast(max(n_nationkey) as bigint) as top, min(n_name) as first from nation")
def q_json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON and read again."""
    row = _read(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n"), F.max("n_nationkey").cast("long").alias("top"), F.min("n_name").alias("first")).first()
    path = f"{shared.folder(spark, 'metadata')}/new/report.json"
    tables.write_json({"report": row.asDict()}, path)
    read = tables.read_json(path)["report"]
    return spark.createDataFrame([(read["n"], read["top"], read["first"])], "n long, top long, first string")


@query(
    "with t as (select n_nationkey, n_name, n_regionkey from nation), shown as (select row_number() over (order by n_nationkey) - 1 as k, "
    "concat_ws('\t', n_nationkey, case when n_nationkey % 5 = 0 then '∅' else n_name end, case n_regionkey when 0 then '0' else concat(n_regionkey, '.5') end) as line from t) "
    "select 0 as place, concat_ws('\t', 'n_nationkey', 'name', 'half') as line union all select cast(k - 9 as int), line from shown where k between 10 and 16"
)
def q_view_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a stored table as the viewer shows it."""
    rows = _read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("name"), F.when(F.col("n_regionkey") == 0, "0.0").otherwise(F.concat(F.col("n_regionkey").cast("string"), F.lit(".50"))).alias("half"))
    path = f"{shared.folder(spark, 'page')}/nations.csv"
    tables.write_csv(rows, path, single=True)
    return spark.createDataFrame(list(enumerate(cli.view(spark, path, 10, 7).split("\n"))), T.StructType([T.StructField("place", T.IntegerType()), T.StructField("line", T.StringType())]))


@query("select cast(s_suppkey as bigint) as id, case when s_suppkey % 6 = 0 then null else concat('data/raw/atp_', 1990 + s_suppkey % 40, '_v', s_suppkey, '.csv') end as name, "
       "cast(nullif(regexp_extract(case when s_suppkey % 6 = 0 then '' else concat('data/raw/atp_', 1990 + s_suppkey % 40, '_v', s_suppkey, '.csv') end, '(20[0-9]{2})', 1), '') as double) as year, "
       "strftime(date '2020-02-28' + cast(s_suppkey as int), '%Y-%m-%d') as iso from supplier")  # fmt: skip
def q_years_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year in a file's name, and a day in ISO form."""
    key = F.col("s_suppkey")
    name = F.when(key % 6 != 0, F.concat(F.lit("data/raw/atp_"), (1990 + key % 40).cast("string"), F.lit("_v"), key.cast("string"), F.lit(".csv")))
    rows = _read(spark, sf_dir, "supplier").select(key.cast("long").alias("id"), name.alias("name"), F.date_add(F.lit("2020-02-28").cast("date"), key.cast("int")).alias("day"))
    return rows.select("id", "name", scalars.year_in("name").cast("double").alias("year"), scalars.iso("day").alias("iso"))

