"""Views over the test tables that stand in for match data; the SQL runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prematch import schema

BOUTS = """
select o_orderkey as match_id,
  cast(o_orderdate as date) as match_date,
  cast(year(o_orderdate) as bigint) as source_year,
  cast(o_orderkey % 61 as bigint) as atp,
  case when o_orderkey % 500 < 7 then concat('rare_', cast(o_orderkey % 500 as varchar(20)))
       else concat('T', cast(o_orderkey % 13 as varchar(20))) end as tournament,
  case when o_orderkey % 40 = 0 then null else o_orderpriority end as surface,
  case when o_orderkey % 2 = 0 then ' indoor' when o_orderkey % 3 = 0 then 'OUTDOOR' else 'tent' end as court,
  case o_orderkey % 9 when 0 then '1st Round' when 1 then '2nd Round' when 2 then '3rd Round' when 3 then '4th Round'
    when 4 then 'Quarter-Finals' when 5 then 'Semi-Finals' when 6 then 'The Final' when 7 then 'Round Robin' else null end as round,
  concat('P', cast(o_custkey % 97 as varchar(20))) as winner_name,
  concat('P', cast((o_custkey + 1 + o_orderkey % 96) % 97 as varchar(20))) as loser_name,
  cast(o_orderkey % 150 - 3 as double) as winner_rank,
  cast(o_orderkey % 170 - 2 as double) as loser_rank,
  cast(o_orderkey % 900 - 5 as double) as winner_points,
  cast(o_orderkey % 800 - 5 as double) as loser_points,
  cast(o_orderkey % 40 + 5 as double) / 8.0 as avg_winner,
  cast(o_orderkey % 32 + 6 as double) / 8.0 as avg_loser,
  case when o_orderstatus = 'P' then ' Completed ' when o_orderstatus = 'F' then 'completed' else 'Retired' end as comment
from orders
"""


def _serve_side(short: str, key: str) -> str:
    values = {
        "ace": f"({key}) % 17",
        "df": f"({key}) % 7",
        "svpt": f"40 + ({key}) % 60",
        "1stIn": f"20 + ({key}) % 20",
        "1stWon": f"10 + ({key}) % 10",
        "2ndWon": f"({key}) % 15",
        "SvGms": f"8 + ({key}) % 10",
        "bpSaved": f"least(({key}) % 9, ({key}) % 5)",
        "bpFaced": f"({key}) % 9",
    }
    return ",\n  ".join(f"case when ({key}) % 11 = 0 then null else cast({v} as double) end as {short}_{n}" for n, v in values.items())


SERVE = f"""
select o_orderkey as match_num, cast(date_trunc('month', o_orderdate) as date) as tourney_date,
  concat('P', cast((o_custkey * 7) % 97 as varchar(20))) as winner_id,
  concat('P', cast((o_custkey * 7 + 1 + o_orderkey % 96) % 97 as varchar(20))) as loser_id,
  {_serve_side("w", "o_orderkey")},
  {_serve_side("l", "o_orderkey + 7")}
from orders where o_orderkey % 3 = 0
"""

#: Raw matches with the dirt that cleaning must deal with, every fiftieth twice; named like the cleaned columns.
RAW = f"""
select * from (
select cast(source_year as varchar(10)) as source_year,
  case when match_id % 31 = 0 then 'n/k' else cast(atp as varchar(10)) end as atp,
  case when match_id % 17 = 0 then '   ' else concat('  Town  ', cast(match_id % 7 as varchar(10)), ' ') end as location,
  concat(' ', tournament, '  Cup') as tournament,
  case when match_id % 97 = 0 then 'someday' else cast(match_date as varchar(10)) end as date,
  case match_id % 6 when 0 then 'Masters 1000' when 1 then ' Grand  Slam' when 2 then 'ATP250' when 3 then 'Challenger' when 4 then null else 'International ' end as series,
  court,
  case match_id % 5 when 0 then 'hard' when 1 then ' CLAY ' when 2 then 'Grass' when 3 then 'sand' else null end as surface,
  round,
  case match_id % 4 when 0 then '3' when 1 then '5' when 2 then '2.5' else 'x' end as best_of,
  case when match_id % 83 = 0 then ' ' else concat(' ', winner_name, '  A. ') end as winner_name,
  case when match_id % 89 = 0 then concat(winner_name, ' A.') else concat(loser_name, ' A.') end as loser_name,
  cast(winner_rank as varchar(20)) as winner_rank, cast(loser_rank as varchar(20)) as loser_rank,
  cast(winner_points as varchar(20)) as winner_points, cast(loser_points as varchar(20)) as loser_points,
  comment,
  case when match_id % 3 = 0 then null else cast(avg_winner as varchar(20)) end as b365_winner,
  case when match_id % 3 = 0 then '-' else cast(avg_loser as varchar(20)) end as b365_loser,
  cast(null as varchar(20)) as ps_winner, cast(null as varchar(20)) as ps_loser,
  cast(null as varchar(20)) as max_winner, cast(null as varchar(20)) as max_loser,
  case when match_id % 7 = 0 then null else cast(avg_winner as varchar(20)) end as avg_winner,
  case when match_id % 7 = 0 then null else cast(avg_loser as varchar(20)) end as avg_loser,
  cast(null as varchar(20)) as bfe_winner, cast(null as varchar(20)) as bfe_loser,
  match_id
from ({BOUTS}) b
) r
"""
RAW_TWICE = f"({RAW}) union all (select * from ({RAW}) again where match_id % 50 = 0)"


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over one scan of orders."""
    return spark.sql(sql.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, BOUTS)


def serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, SERVE)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty matches under their raw names (and match_id, which tells duplicates from repeats)."""
    return over(spark, sf_dir, RAW_TWICE).withColumnsRenamed({new: old for old, new in schema.RAW_TO_CLEAN.items()})
