"""Match-shaped views of generic event, order and line-item tables.

They give the plans input of the right shape when no season files are at hand. The SQL
is plain enough to run in other engines too, which the result checks rely on; running
totals are added by the chunk-safe operator rather than in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.operators import joins, ordered

SEASON_OF = "concat(cast(2022 + {0} % 4 as string), '-', cast(2023 + {0} % 4 as string))"

# one row per event: who acted, for which side, and whose point it was
EVENTS_BASE = f"""
select event_id as file_row, event_type, user_id as contestid,
  {SEASON_OF.format('user_id')} as season,
  1 + cast(floor((extract(day from ts) - 1) / 6) as int) as set_no,
  case when user_id % 7 = 3 then '' else concat(lpad(cast(1 + user_id % 12 as string), 2, '0'), '/',
    lpad(cast(1 + user_id % 28 as string), 2, '0'), '/2024') end as date,
  concat('Team ', cast(user_id % 10 as string)) as home_team,
  concat('Team ', cast((user_id + 1 + cast(floor(user_id / 10) as bigint) % 9) % 10 as string)) as away_team,
  case when event_id % 2 = 0 then concat('P', cast(user_id % 10 as string), '-')
    else concat('P', cast((user_id + 1 + cast(floor(user_id / 10) as bigint) % 9) % 10 as string), '-') end as who,
  event_id % 2 = 0 as by_home,
  case when (event_type = 'purchase' and event_id % 2 = 0) or (event_type = 'error' and event_id % 2 = 1) then 1 else 0 end as hp,
  case when (event_type = 'purchase' and event_id % 2 = 1) or (event_type = 'error' and event_id % 2 = 0) then 1 else 0 end as ap
from {{events}}
"""

# play-by-play text from the base and the running totals hs / sa
EVENTS_PBP = """
select season, file_row, date, contestid, set_no, away_team, home_team,
  case when file_row % 17 = 0 then '' else concat(cast(sa as string), '-', cast(hs as string)) end as score,
  '' as rally, '' as rally_event,
  case when file_row % 29 = 0 then 'Officials'
    when event_type = 'error' then case when by_home then away_team else home_team end
    when file_row % 13 = 0 then concat('#', cast(1 + file_row % 25 as string), ' ', case when by_home then home_team else away_team end)
    else case when by_home then home_team else away_team end end as team,
  case when file_row % 23 = 0 then '' else label end as event,
  case when file_row % 29 = 0 then '' else player end as player,
  case label when 'Serve' then concat(player, ' serves') when 'Ace' then concat('Service ace by ', player)
    when 'Timeout' then 'Timeout' else concat(label, ' by ', player) end as description
from (
  select *, concat(who, cast(cast(floor(file_row / 2) as bigint) % 7 as string)) as player,
    case when file_row % 29 = 0 then 'Timeout'
      else case event_type when 'signup' then 'Serve'
        when 'view' then 'Reception'
        when 'click' then case file_row % 3 when 0 then 'Set' when 1 then 'Attack' else 'Dig' end
        when 'purchase' then case file_row % 4 when 0 then 'Kill' when 1 then 'Ace' when 2 then 'Block' else 'First ball kill' end
        else case file_row % 3 when 0 then 'Attack error' when 1 then 'Service error' else 'Reception error' end end end as label
  from {scored}) x
"""

# every player of the teams of a season but one, so that some actors stay unresolved
_SIDES = f"""select distinct {SEASON_OF.format('user_id')} as season, user_id % 10 as t from {{events}}
  union select distinct {SEASON_OF.format('user_id')} as season, (user_id + 1 + cast(floor(user_id / 10) as bigint) % 9) % 10 as t from {{events}}"""
_POSITIONS = ["S", "OH", "MB", "OPP", "L/DS", "DS", "LS"]
ROSTER = "select * from (" + " union all ".join(
    f"""select season, t as teamid, concat('Team ', cast(t as string)) as team, concat('Conf ', cast(t % 3 as string)) as conference,
  {k} as number, concat('P', cast(t as string), '-{k}') as player, '{pos}' as pos from ({_SIDES}) sides"""
    for k, pos in enumerate(_POSITIONS)
) + ") x where not (teamid = 9 and number = 6)"


TEAM_BOX = f"""
select {SEASON_OF.format('o_orderkey')} as season, o_orderkey as contestid,
  concat('Team ', cast(o_custkey % 12 as string)) as team,
  case o_orderkey % 7
    when 0 then concat('@ #', cast(o_orderkey % 25 + 1 as string), ' Team ', cast((o_custkey + 7) % 12 as string))
    when 1 then concat('team-', cast((o_custkey + 7) % 12 as string))
    when 2 then concat('Team ', cast((o_custkey + 7) % 12 as string), ' Fall Classic 2024')
    when 3 then concat('Team ', cast((o_custkey + 7) % 12 as string), ', Neutral Hall')
    when 4 then concat('Unlisted College ', cast(o_custkey % 3 as string))
    when 5 then concat('vs. Old Team ', cast((o_custkey + 7) % 12 as string), ' (Alumni)')
    else concat('Team ', cast((o_custkey + 7) % 12 as string)) end as opponent,
  case o_orderkey % 5 when 0 then 'W 3-0' when 1 then 'W 3-1' when 2 then 'L 1-3' when 3 then ' L 2 - 3 ' else 'Ppd' end as result,
  case when o_orderkey % 11 = 0 then null else round(o_totalprice / 1000000.0, 4) end as hit_pct,
  cast(floor(o_totalprice / 10000.0) as bigint) as pts,
  cast(o_custkey % 50 as bigint) as kills, cast(o_custkey % 31 as bigint) as assists,
  cast(o_orderkey % 29 as bigint) as digs,
  case when o_orderkey % 13 = 0 then null else cast(o_orderkey % 4 as bigint) end as block_solos
from {{orders}}
"""

PLAYER_BOX = f"""
select season, contestid, team, opponent, player, pos, location, line_no, s,
  kills, errors, total_attacks,
  case when total_attacks = 0 then null else round(cast(kills - errors as double) / total_attacks, 6) end as hit_pct,
  assists, aces, serr, digs, rerr, block_solos, block_assists, retatt
from (
  select {SEASON_OF.format('l_orderkey')} as season, l_orderkey as contestid,
    concat('Team ', cast(l_suppkey % 10 as string)) as team,
    concat('Team ', cast((l_suppkey + 3) % 12 as string)) as opponent,
    concat('P', cast(l_suppkey % 10 as string), '-', cast(l_partkey % 7 as string)) as player,
    case l_partkey % 7 when 0 then 'S' when 1 then 'OH' when 2 then 'MB' when 3 then 'OPP' when 4 then 'L/DS' when 5 then 'DS' else 'LS' end as pos,
    case when l_returnflag = 'R' then 'Away' else 'Home' end as location,
    l_linenumber as line_no, cast(l_linenumber as bigint) as s,
    case when l_partkey % 7 in (1, 2, 3, 6) then cast(l_quantity as bigint)
      when l_partkey % 97 = 0 then cast(2 as bigint) else cast(0 as bigint) end as kills,
    case when l_partkey % 7 in (1, 2, 3, 6) then cast(l_linenumber as bigint) else cast(0 as bigint) end as errors,
    case when l_partkey % 7 in (1, 2, 3, 6) then cast(l_quantity as bigint) + cast(l_linenumber as bigint) + 10
      when l_partkey % 97 = 0 then cast(5 as bigint) else cast(0 as bigint) end as total_attacks,
    case when l_partkey % 7 = 0 then cast(l_partkey % 20 as bigint)
      when l_partkey % 61 = 0 then cast(1 as bigint) else cast(0 as bigint) end as assists,
    cast(l_partkey % 4 as bigint) as aces,
    cast(l_partkey % 5 as bigint) as serr, cast(l_partkey % 15 as bigint) as digs, cast(l_partkey % 3 as bigint) as rerr,
    case when l_partkey % 13 = 0 then null else cast(l_partkey % 3 as bigint) end as block_solos,
    cast(l_partkey % 4 as bigint) as block_assists, cast(l_partkey % 9 as bigint) as retatt
  from {{lineitem}}
) x
"""


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_base(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(EVENTS_BASE, events=_read(spark, folder, "events"))


def pbp(spark: SparkSession, folder: str) -> DataFrame:
    """The log. Raw events are dealt out by contest before their texts are made, and the running totals need no more shuffle."""
    base = events_base(spark, folder)
    keys = ["contestid", "set_no"]
    chunk = ordered.pick_chunk(base, keys)
    if chunk is None:
        events = _read(spark, folder, "events")
        base = spark.sql(EVENTS_BASE, events=events.repartition(joins.parts_for(events), "user_id"))
    scored = ordered.running_sum(base, keys, "file_row", {"hs": F.col("hp"), "sa": F.col("ap")}, chunk)
    return spark.sql(EVENTS_PBP, scored=scored).withColumn("contestid", F.col("contestid").cast("string"))


def roster(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(ROSTER, events=_read(spark, folder, "events"))


def team_box(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(TEAM_BOX, orders=joins.dealt_out(_read(spark, folder, "orders"), "o_orderkey"))


def player_box(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(PLAYER_BOX, lineitem=joins.dealt_out(_read(spark, folder, "lineitem"), "l_orderkey", "l_linenumber"))
