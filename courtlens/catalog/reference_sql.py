"""Plain SQL definitions of the published tables, for result checks in another engine.

Each entry of ``CTES`` is one common table expression over the raw test tables;
``with_ctes`` prepends the ones a query needs. The statements favour obviousness over
speed (theta joins, plain windows) so that they do not share the plans' shortcuts.
"""

from __future__ import annotations

import re

from courtlens import config
from courtlens.plans import models, rankings, serving
from courtlens.sources import shaped


def clean(x: str) -> str:
    x = f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"
    x = f"regexp_replace(replace(lower({x}), '&', ' and '), '[''`]', '', 'g')"
    x = f"regexp_replace({x}, '[^a-z0-9\\s/@().,#:-]', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean_team(x: str) -> str:
    return squeeze(f"regexp_replace({clean(x)}, '\\bvs\\.?\\b', ' ', 'g')")


def opponent(x: str) -> str:
    x = clean_team(x)
    words = "|".join(config.TOURNAMENT_WORDS)
    for p, to in [("^@\\s*", ""), ("\\bat\\b\\s+", ""), ("#\\d+", " "), (",.*$", ""), (f"\\b({words})\\b.*$", "")]:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return squeeze(x)


def display(x: str) -> str:
    for p in ["#\\d+\\s*", "\\(.*?\\)", "^@\\s*", "^vs\\.?\\s*", "^at\\s*"]:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    x = f"list_filter(list_transform(string_split({x}, '@'), lambda p: trim(p)), lambda p: p <> '')[1]"
    for p in ["\\d{2}-\\d{2}.*", "\\d{4}.*"]:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return f"trim(replace({x}, '-', ' '))"


def family(e: str, d: str) -> str:
    arms = " ".join(
        f"when regexp_matches({e}, '{p}') or regexp_matches({d}, '{q}') then '{f}'"
        for f, p, q in config.EVENT_RULES
    )
    return f"case {arms} else 'admin' end"


def case_of(x: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    return f"case {x} {arms} else {default} end"


def weight(x: str) -> str:
    return "case " + x + " " + " ".join(f"when '{k}' then {v}" for k, v in config.EVENT_WEIGHTS.items()) + " else 0.0 end"


def rate(num: str, den: str) -> str:
    return f"coalesce(cast({num} as double) / nullif(cast({den} as double), 0), 0.0)"


def z(x: str, over: str) -> str:
    x = f"coalesce({x}, 0.0)"
    return (f"case when coalesce(stddev_samp({x}) over ({over}), 0) = 0 then 0.0 "
            f"else ({x} - avg({x}) over ({over})) / stddev_samp({x}) over ({over}) end")


def score_part(i: int) -> str:
    return f"try_cast(nullif(regexp_extract(score, '^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', {i}), '') as bigint)"


def state(which: str) -> str:
    n, hs, as_, hp, ap, side = {
        "before": ("set_no", "home_sets_before", "away_sets_before", "score_home_start", "score_away_start", "server_side"),
        "after": ("set_after", "home_sets_after", "away_sets_after", "score_home_after_state", "score_away_after_state", "server_side_after"),
    }[which]
    return f"""{n} as set_number, {hs} as home_sets, {as_} as away_sets, {hp} as home_points, {ap} as away_points,
      {hp} - {ap} as home_score_diff, {hp} + {ap} as total_points,
      case when {side} = 'home' then 1 else 0 end as home_server, case when {side} = 'away' then 1 else 0 end as away_server,
      case when {n} = 5 then 1 else 0 end as is_fifth_set,
      case when ({n} < 5 and {hp} + {ap} >= 38) or ({n} = 5 and {hp} + {ap} >= 20) then 1 else 0 end as is_late_set,
      case when ({hp} >= 24 or {ap} >= 24) and abs({hp} - {ap}) <= 1 then 1 else 0 end as is_deuce_or_later,
      {side} as side"""


def fixed_wp(which: str) -> str:
    hp, ap, hs, as_ = {
        "before": ("score_home_start", "score_away_start", "home_sets_before", "away_sets_before"),
        "after": ("score_home_after_state", "score_away_after_state", "home_sets_after", "away_sets_after"),
    }[which]
    return f"1.0 / (1.0 + exp(-(({hp} - {ap}) * 0.15 + ({hs} - {as_}) * 0.8)))"


def inferred_role(base: str) -> str:
    hitter = "(box_total_attacks >= 150 or box_kills >= 80 or event_count_kill >= 80)"
    setter = "(lower(coalesce(pos, '')) = 's' or box_assists >= 500 or event_count_set >= 1000)"
    has = lambda p: f"regexp_matches(lower(coalesce(pos, '')), '{p}')"
    return f"""case when {setter} then 'setter'
      when box_total_attacks < 50 and box_assists < 200 and {has('\\b(?:l|ds|libero)\\b')} then 'libero_ds'
      when {hitter} and {has('\\b(?:rs|opp|opposite|right side)\\b')} then 'opposite'
      when {hitter} and {has('\\b(?:mb|mh|m|middle)\\b')} then 'middle'
      when {hitter} then 'outside' else coalesce({base}, 'unknown') end"""


FBC = ["fb_receptions", "fb_clean_receptions", "fb_reception_errors", "fb_attacks", "fb_kills",
       "fb_middle_attacks", "fb_receive_point_wins"]
FBR = {"fb_attack_rate": "fb_attacks", "fb_kill_rate": "fb_kills",
       "fb_middle_attack_rate": "fb_middle_attacks", "fb_reception_error_rate": "fb_reception_errors",
       "fb_receive_point_win_rate": "fb_receive_point_wins"}
FB_RATES = ", ".join(f"{rate(n, 'fb_receptions')} as {o}" for o, n in FBR.items())
RK = "season, contestid, set_no, rally_id"
PK = "season, team_clean, player_clean"
TARGETS = ["reception_error", "first_ball_attack", "first_ball_kill", "first_ball_middle_attack", "receive_point_win"]


def first_nn(c: str, where: str = "true") -> str:
    return f"arg_min({c}, file_row) filter (where {c} is not null and {where})"


CTES: dict[str, str] = {}
CTES["ev"] = shaped.EVENTS_BASE.format(events="events")
CTES["scored"] = """select *,
  sum(hp) over (partition by contestid, set_no order by file_row rows between unbounded preceding and current row) as hs,
  sum(ap) over (partition by contestid, set_no order by file_row rows between unbounded preceding and current row) as sa
  from ev"""
CTES["pbp"] = shaped.EVENTS_PBP.format(scored="scored")
CTES["roster"] = shaped.ROSTER.format(events="events")
CTES["team_box"] = shaped.TEAM_BOX.format(orders="orders")
CTES["player_box"] = shaped.PLAYER_BOX.format(lineitem="lineitem")
CTES["master"] = f"""select distinct season, teamid, team, {clean_team('team')} as team_clean, conference, number,
  cast(number as bigint) as number_clean, player, {clean('player')} as player_clean, pos,
  {case_of(clean('pos'), config.ROLE_OF_POSITION, "'unknown'")} as role_family,
  season || '::' || {clean_team('team')} || '::' || {clean('player')} || '::' || cast(number as varchar) as player_uid
  from roster"""
CTES["teams"] = f"select team_clean from master union select {clean_team('team')} from team_box"
CTES["touch"] = """select season, contestid, set_no, date, away_team, home_team, score, rally, rally_event, team, event, player,
  description, min(file_row) as file_row from pbp
  group by season, contestid, set_no, date, away_team, home_team, score, rally, rally_event, team, event, player, description"""
CTES["named"] = f"""select *, {opponent('team')} as team_clean, {opponent('home_team')} as home_clean,
  {opponent('away_team')} as away_clean, {clean('player')} as player_clean, {clean('event')} as event_text,
  {clean('description')} as description_text from touch"""
CTES["owned"] = """select n.*,
  exists (select 1 from master m where m.season = n.season and m.player_clean = n.player_clean and m.team_clean = n.home_clean) as player_on_home,
  exists (select 1 from master m where m.season = n.season and m.player_clean = n.player_clean and m.team_clean = n.away_clean) as player_on_away
  from named n"""
CTES["acted"] = """select *,
  case when player_on_home and not player_on_away then home_clean when player_on_away and not player_on_home then away_clean
    when team_clean = home_clean then home_clean when team_clean = away_clean then away_clean end as actor_team,
  case when player_on_home and not player_on_away then 'roster_home' when player_on_away and not player_on_home then 'roster_away'
    when team_clean = home_clean or team_clean = away_clean then 'team_column' else 'unresolved' end as actor_team_source
  from owned"""
CTES["filled"] = f"""select *,
  case when actor_team = home_clean then 'home' when actor_team = away_clean then 'away' else 'unknown' end as actor_side,
  {score_part(1)} is not null as score_is_numeric,
  coalesce(last_value({score_part(1)} ignore nulls) over w, 0) as away_score_ffill,
  coalesce(last_value({score_part(2)} ignore nulls) over w, 0) as home_score_ffill,
  {family('event_text', 'description_text')} as event_family,
  contains(event_text, 'first ball kill') or contains(description_text, 'first ball kill') as is_first_ball_kill_text
  from acted window w as (partition by season, contestid, set_no order by file_row rows between unbounded preceding and current row)"""
CTES["moved"] = """select *, event_family <> 'admin' as is_action_row,
  coalesce(away_score_ffill - lag(away_score_ffill) over w, 0) as d_away,
  coalesce(home_score_ffill - lag(home_score_ffill) over w, 0) as d_home
  from filled window w as (partition by season, contestid, set_no order by file_row)"""
CTES["flagged"] = """select *, d_away < 0 or d_home < 0 as score_backward, abs(d_away) + abs(d_home) > 1 as multi_point_jump,
  d_away >= 0 and d_home >= 0 and d_away + d_home = 1 as one_point_increment from moved"""
CTES["cut"] = """select *, 1 + coalesce(sum(case when one_point_increment then 1 else 0 end) over
    (partition by season, contestid, set_no order by file_row rows between unbounded preceding and 1 preceding), 0) as rally_id
  from flagged"""
CTES["clean_pbp"] = """select c.*, m.player_uid, m.role_family,
  row_number() over (partition by c.season, c.contestid, c.set_no, c.rally_id order by c.file_row) as row_in_rally,
  sum(case when is_action_row then 1 else 0 end) over
    (partition by c.season, c.contestid, c.set_no, c.rally_id order by c.file_row rows between unbounded preceding and current row) as action_seq
  from cut c left join (select distinct season, team_clean, player_clean, role_family, player_uid from master) m
    on m.season = c.season and m.team_clean = c.actor_team and m.player_clean = c.player_clean"""
CTES["rally0"] = f"""select {RK},
  {', '.join(f'{first_nn(c)} as {c}' for c in ('date', 'away_team', 'home_team', 'away_clean', 'home_clean'))},
  arg_min(away_score_ffill, file_row) as score_away_start, arg_min(home_score_ffill, file_row) as score_home_start,
  arg_max(away_score_ffill, file_row) as score_away_end, arg_max(home_score_ffill, file_row) as score_home_end,
  count(*) as rally_rows, count_if(is_action_row) as action_rows,
  count_if(actor_team_source = 'unresolved') as unresolved_actor_rows,
  bool_or(score_backward) as any_backward_score, bool_or(multi_point_jump) as any_multi_point_jump,
  bool_or(not score_is_numeric) as any_non_numeric_score,
  min(file_row) filter (where event_family = 'serve') as serve_row,
  {first_nn('actor_team', "event_family = 'serve'")} as serve_team,
  coalesce({first_nn('actor_side', "event_family = 'serve'")}, 'unknown') as server_side,
  {first_nn('player_clean', "event_family = 'serve'")} as server_player_clean,
  max(file_row) filter (where is_action_row) as terminal_row
  from clean_pbp group by {RK}"""
CTES["rally1"] = """select r.*, t.event_family as terminal_event_family, t.actor_team as terminal_actor_team,
  t.actor_side as terminal_actor_side, t.player_clean as terminal_player_clean,
  score_away_end - score_away_start as away_delta, score_home_end - score_home_start as home_delta,
  abs(score_away_end - score_away_start) + abs(score_home_end - score_home_start) as point_delta_total,
  case when score_home_end - score_home_start = 1 then 'home' when score_away_end - score_away_start = 1 then 'away' else 'unknown' end as point_winner_side
  from rally0 r left join clean_pbp t on t.season = r.season and t.file_row = r.terminal_row"""
CTES["sets"] = """select season, contestid, set_no, max(rally_id) as last_rally,
  case when arg_max(score_home_end, rally_id) > arg_max(score_away_end, rally_id) then 1 else 0 end as home_set_win,
  case when arg_max(score_away_end, rally_id) > arg_max(score_home_end, rally_id) then 1 else 0 end as away_set_win
  from rally1 group by season, contestid, set_no"""
CTES["sets2"] = """select *, sum(home_set_win) over w - home_set_win as home_sets_before, sum(away_set_win) over w - away_set_win as away_sets_before,
  sum(home_set_win) over (partition by season, contestid) as home_sets_total, sum(away_set_win) over (partition by season, contestid) as away_sets_total
  from sets window w as (partition by season, contestid order by set_no)"""
CTES["rallies"] = """select *, case when home_sets_total > away_sets_total then 1 else 0 end as home_match_win,
  home_sets_before + case when is_set_terminal then home_set_win else 0 end as home_sets_after,
  away_sets_before + case when is_set_terminal then away_set_win else 0 end as away_sets_after,
  set_no + case when is_set_terminal then 1 else 0 end as set_after,
  case when is_set_terminal then 0 else score_home_end end as score_home_after_state,
  case when is_set_terminal then 0 else score_away_end end as score_away_after_state,
  point_winner_side as server_side_after,
  case point_winner_side when 'home' then home_clean when 'away' then away_clean end as point_winner_team
  from (select r.*, s.home_set_win, s.away_set_win, s.home_sets_before, s.away_sets_before, s.home_sets_total, s.away_sets_total,
    r.rally_id = s.last_rally as is_set_terminal
    from rally1 r join sets2 s on s.season = r.season and s.contestid = r.contestid and s.set_no = r.set_no) x"""
_RJ = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in RK.split(", "))
CTES["recv"] = f"""select * from (select {RK}, file_row as reception_row, actor_team as receiving_team, player_clean as passer_player_clean,
  event_family as reception_event_family, row_number() over (partition by {RK} order by file_row) as rn
  from clean_pbp where event_family in ('reception', 'reception_error') and player_clean <> '' and actor_team is not null) x where rn = 1"""
CTES["contacts"] = f"""select {', '.join('p.' + c for c in RK.split(', '))},
  any_value(r.reception_row) as reception_row, any_value(r.receiving_team) as receiving_team,
  any_value(r.passer_player_clean) as passer_player_clean, any_value(r.reception_event_family) as reception_event_family,
  min(file_row) filter (where own and event_family in ('attack', 'kill', 'attack_error')) as first_attack_row,
  {first_nn('role_family', "own and event_family in ('attack', 'kill', 'attack_error')")} as first_attack_role_family,
  {first_nn('player_clean', "own and event_family in ('attack', 'kill', 'attack_error')")} as first_attack_player_clean,
  {first_nn('event_family', "own and event_family in ('attack', 'kill', 'attack_error')")} as first_attack_event_family,
  min(file_row) filter (where opp and event_family <> 'admin') as first_opp_action_row,
  min(file_row) filter (where own and event_family = 'kill') as first_same_team_kill_row,
  {first_nn('player_clean', "own and event_family = 'kill'")} as first_ball_kill_player_clean
  from (select c.*, q.receiving_team, q.reception_row,
      c.file_row > q.reception_row and c.actor_team = q.receiving_team as own,
      c.file_row > q.reception_row and c.actor_team <> q.receiving_team as opp
    from clean_pbp c join recv q on {_RJ('c', 'q')}) p join recv r on {_RJ('p', 'r')}
  group by {', '.join('p.' + c for c in RK.split(', '))}"""
CTES["passes0"] = f"""select r.*, c.reception_row, c.receiving_team, c.passer_player_clean, c.reception_event_family, c.first_attack_row,
  c.first_attack_role_family, c.first_attack_player_clean, c.first_attack_event_family, c.first_opp_action_row, c.first_same_team_kill_row,
  c.first_ball_kill_player_clean,
  coalesce(c.reception_event_family = 'reception_error', false) as reception_error,
  coalesce(r.point_winner_team = c.receiving_team, false) as receive_point_win
  from rallies r left join contacts c on {_RJ('r', 'c')}"""
CTES["passes1"] = """select *, first_attack_row is not null and not reception_error
    and (first_opp_action_row is null or first_attack_row < first_opp_action_row) as first_ball_attack from passes0"""
CTES["passes"] = """select *, first_ball_attack and first_same_team_kill_row is not null
    and (first_opp_action_row is null or first_same_team_kill_row < first_opp_action_row) as first_ball_kill,
  first_ball_attack and coalesce(first_attack_role_family = 'middle', false) as first_ball_middle_attack from passes1"""
CTES["fbc"] = f"""select *, {FB_RATES} from (select season, contestid, receiving_team as team_clean, passer_player_clean as player_clean,
  count(*) as fb_receptions, count_if(not reception_error) as fb_clean_receptions, count_if(reception_error) as fb_reception_errors,
  count_if(first_ball_attack) as fb_attacks, count_if(first_ball_kill) as fb_kills, count_if(first_ball_middle_attack) as fb_middle_attacks,
  count_if(receive_point_win) as fb_receive_point_wins
  from passes where receiving_team is not null and passer_player_clean is not null
  group by season, contestid, receiving_team, passer_player_clean) x"""
CTES["fbs"] = f"""select *, {FB_RATES} from (select {PK}, {', '.join(f'sum({c}) as {c}' for c in FBC)} from fbc group by {PK}) x"""
CTES["strength0"] = f"""select season, {clean_team('team')} as team_clean, count(*) as matches,
  avg(case when regexp_extract(result, '^\\s*([WL])\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 1) = 'W' then 1.0 else 0.0 end) as win_pct,
  sum(coalesce(try_cast(nullif(regexp_extract(result, '^\\s*([WL])\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 2), '') as bigint), 0)) as sets_for,
  sum(coalesce(try_cast(nullif(regexp_extract(result, '^\\s*([WL])\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 3), '') as bigint), 0)) as sets_against,
  avg(hit_pct) as mean_hit_pct, avg(pts) as mean_pts from team_box group by all"""
CTES["strength1"] = """select *, (sets_for - sets_against) / matches as set_diff_per_match,
  coalesce(mean_hit_pct, median(mean_hit_pct) over (partition by season)) as hit from strength0"""
CTES["strength"] = f"""select s.*, 0.50 * {z('win_pct', 'partition by season')} + 0.35 * {z('set_diff_per_match', 'partition by season')}
  + 0.15 * {z('hit', 'partition by season')} as team_strength_index from strength1 s"""
CTES["resolved"] = f"""select raw, name, coalesce({case_of('name', config.TEAM_ALIASES, 'null')}, (select t.team_clean from teams t where t.team_clean = name),
    (select min(t.team_clean) from teams t where {{hit}} having count(distinct t.team_clean) = 1), name) as canonical
  from (select distinct opponent as raw, {opponent('opponent')} as name from
    (select opponent from team_box union select opponent from player_box) o) x""".format(hit=(
    "regexp_replace(t.team_clean, '[^a-z0-9]', '', 'g') = regexp_replace(name, '[^a-z0-9]', '', 'g') "
    "or starts_with(t.team_clean, name || ' ') or starts_with(t.team_clean, name || '(') "
    "or regexp_matches(name, '(^|[^a-z0-9_])' || regexp_escape(t.team_clean) || '($|[^a-z0-9_])')"))
CTES["box"] = f"""select b.*, {clean('b.player')} as player_clean, {clean_team('b.team')} as team_clean, r.canonical as opp_clean
  from player_box b join resolved r on r.raw = b.opponent"""
CTES["enriched"] = f"""select b.*, coalesce(s.team_strength_index, 0.0) as team_strength_index, coalesce(o.team_strength_index, 0.0) as opp_strength_index,
  s.team_strength_index is null as team_strength_missing, o.team_strength_index is null as opp_strength_missing,
  {', '.join(f'coalesce(f.{c}, 0) as {c}' for c in [*FBC, *FBR])}
  from box b left join strength s on s.season = b.season and s.team_clean = b.team_clean
  left join strength o on o.season = b.season and o.team_clean = b.opp_clean
  left join fbc f on f.season = b.season and f.contestid = b.contestid and f.team_clean = b.team_clean and f.player_clean = b.player_clean"""
_HAVE = ["s", "kills", "errors", "total_attacks", "assists", "aces", "serr", "digs", "rerr", "block_solos", "block_assists", "retatt"]
CTES["boxsum"] = f"""select {PK}, count(*) as matches_played_rows, avg(team_strength_index) as team_strength_index,
  avg(opp_strength_index) as opp_strength_index, avg(case when team_strength_missing then 1.0 else 0.0 end) as team_strength_missing_rate,
  avg(case when opp_strength_missing then 1.0 else 0.0 end) as opp_strength_missing_rate,
  {', '.join(f'sum(coalesce({c}, 0)) as box_{c}' if c in _HAVE else f'0 as box_{c}' for c in config.BOX_STATS)}
  from enriched group by {PK}"""
_BOXCOLS = ["matches_played_rows", "team_strength_index", "opp_strength_index", "team_strength_missing_rate",
            "opp_strength_missing_rate", *[f"box_{c}" for c in config.BOX_STATS]]
CTES["feats"] = f"""select m.*, {', '.join(f'coalesce(b.{c}, 0) as {c}' for c in _BOXCOLS)},
  {', '.join(f'coalesce(f.{c}, 0) as {c}' for c in [*FBC, *FBR])}
  from master m left join boxsum b on b.season = m.season and b.team_clean = m.team_clean and b.player_clean = m.player_clean
  left join fbs f on f.season = m.season and f.team_clean = m.team_clean and f.player_clean = m.player_clean"""
CTES["wp"] = f"""select *, home_wp_after - home_wp_before as home_wpa from
  (select *, {fixed_wp('before')} as home_wp_before, {fixed_wp('after')} as home_wp_after from rallies) x"""
CTES["valid"] = "select * from rallies where point_delta_total = 1 and home_match_win is not null and home_sets_total is not null"
CTES["contest_dates"] = """select season, contestid, arg_min(try_strptime(date, '%m/%d/%Y'), set_no * 100000 + rally_id) as d0,
    count(*) as n, count(try_strptime(date, '%m/%d/%Y')) as dated from valid group by season, contestid"""
CTES["contest_first"] = """select v.season, v.contestid, try_strptime(v.date, '%m/%d/%Y') as d from
  (select *, row_number() over (partition by season, contestid order by set_no, rally_id) as rn from valid) v where rn = 1"""
CTES["split"] = """select season, contestid, case when rn <= floor(n * 0.7) then 'train' when rn <= floor(n * 0.85) then 'valid' else 'test' end as split from (
  select f.season, f.contestid, count(*) over (partition by f.season) as n, row_number() over (partition by f.season
    order by case when b.by_date then f.d end nulls last, f.contestid) as rn
  from contest_first f join (select season, sum(dated) >= 0.5 * sum(n) as by_date from contest_dates group by season) b on b.season = f.season) x"""
CTES["opp"] = """select *, case when actor_side = 'home' then away_clean else home_clean end as opponent_team from clean_pbp
  where is_action_row and actor_side in ('home', 'away')"""
CTES["ctx0"] = """select t.season, t.team_clean,
  (select count(*) from opp o where o.season = t.season and o.actor_team = t.team_clean and event_family = 'attack') as team_attack_events,
  (select count(*) from opp o where o.season = t.season and o.actor_team = t.team_clean and event_family = 'kill') as team_kills,
  (select count(*) from opp o where o.season = t.season and o.actor_team = t.team_clean and event_family = 'attack_error') as team_attack_errors,
  (select count(*) from opp o where o.season = t.season and o.actor_team = t.team_clean and event_family = 'block') as team_blocks,
  (select count(*) from opp o where o.season = t.season and o.opponent_team = t.team_clean and event_family in ('attack', 'kill', 'attack_error')) as opponent_attack_events_faced
  from (select season, actor_team as team_clean from opp where actor_team is not null union select season, opponent_team from opp where opponent_team is not null) t"""
CTES["ctx1"] = f"""select *, team_attack_events + team_kills + team_attack_errors as team_attack_attempts,
  {rate('team_kills - team_attack_errors', '(team_attack_events + team_kills + team_attack_errors)')} as team_attack_efficiency,
  {rate('team_kills', '(team_attack_events + team_kills + team_attack_errors)')} as team_kill_rate,
  {rate('team_attack_errors', '(team_attack_events + team_kills + team_attack_errors)')} as team_attack_error_rate,
  {rate('team_blocks', 'opponent_attack_events_faced')} as team_block_rate_faced from ctx0"""
CTES["ctx"] = f"""select *, team_attack_attempts / (team_attack_attempts + 500.0) * (0.65 * {z('team_attack_efficiency', 'partition by season')}
    + 0.25 * {z('team_kill_rate', 'partition by season')} - 0.1 * {z('team_attack_error_rate', 'partition by season')}) as team_attack_strength_index,
  opponent_attack_events_faced / (opponent_attack_events_faced + 500.0) * {z('team_block_rate_faced', 'partition by season')} as team_block_strength_index from ctx1"""
CTES["cred0"] = f"""select o.*, w.home_wpa, {weight('event_family')} as event_weight,
  {weight('event_family')} / nullif(sum({weight('event_family')}) over (partition by {', '.join('o.' + c for c in RK.split(', '))}), 0) as share
  from opp o left join wp w on {_RJ('o', 'w')} where o.player_clean <> '' and event_family <> 'admin'"""
CTES["cred1"] = """select c.* exclude (team_clean), actor_team as team_clean, coalesce(share, 0) as event_weight_share,
  case when actor_side = 'home' then home_wpa else -home_wpa end as team_wpa,
  coalesce(x.team_block_strength_index, 0) as opp_block_strength_index, coalesce(x.team_attack_strength_index, 0) as opp_attack_strength_index
  from cred0 c left join ctx x on x.season = c.season and x.team_clean = c.opponent_team"""
CTES["cred2"] = """select *, team_wpa * event_weight_share as base_event_credit,
  least(1.25, greatest(0.75, case when event_family in ('kill', 'attack') then 1 + 0.08 * opp_block_strength_index
    when event_family = 'attack_error' then 1 - 0.08 * opp_block_strength_index
    when event_family in ('block', 'dig') then 1 + 0.08 * opp_attack_strength_index
    when event_family in ('block_error', 'dig_error') then 1 - 0.08 * opp_attack_strength_index else 1.0 end)) as context_multiplier from cred1"""
CTES["cred"] = """select *, base_event_credit * context_multiplier as event_credit,
  greatest(base_event_credit * context_multiplier, 0) as positive_credit, least(base_event_credit * context_multiplier, 0) as negative_credit from cred2"""
CTES["pcred"] = f"""select {PK}, count(*) as event_touches, count(distinct contestid || '::' || set_no || '::' || rally_id) as event_rallies,
  sum(event_credit) as raw_event_credit, sum(base_event_credit) as raw_base_event_credit, sum(positive_credit) as positive_event_credit,
  sum(negative_credit) as negative_event_credit, avg(event_credit) as mean_event_credit, avg(context_multiplier) as avg_context_multiplier,
  avg(opp_block_strength_index) as avg_opp_block_strength_index, avg(opp_attack_strength_index) as avg_opp_attack_strength_index,
  {', '.join(f"count_if(event_family = '{f}') as event_count_{f}" for f in config.FAMILIES)}
  from cred group by {PK}"""
CTES["serv0"] = f"""select *, {rate('serve_points_won', 'serve_rallies')} as serve_point_win_rate, {rate('serve_aces', 'serve_rallies')} as serve_ace_rate,
  {rate('serve_errors', 'serve_rallies')} as serve_error_rate, {rate('forced_reception_errors', 'serve_rallies')} as forced_reception_error_rate
  from (select season, serve_team as team_clean, server_player_clean as player_clean, count(*) as serve_rallies,
    count_if(coalesce(point_winner_team = serve_team, false)) as serve_points_won, count_if(terminal_event_family = 'ace') as serve_aces,
    count_if(terminal_event_family = 'service_error') as serve_errors, count_if(terminal_event_family = 'reception_error') as forced_reception_errors
    from rallies where serve_team is not null and coalesce(server_player_clean, '') <> '' group by season, serve_team, server_player_clean) x"""
CTES["serv1"] = f"""select *, 0.5 * {z('serve_point_win_rate', 'partition by season')} + 0.35 * {z('serve_ace_rate', 'partition by season')}
  + 0.15 * {z('forced_reception_error_rate', 'partition by season')} - 0.25 * {z('serve_error_rate', 'partition by season')} as server_toughness_raw from serv0"""
CTES["serv"] = "select *, server_toughness_raw * serve_rallies / (serve_rallies + 100.0) as server_toughness_index from serv1"
CTES["att0"] = f"""select * from (select {RK}, file_row as receive_row, actor_team as team_clean, actor_side as receiving_side, player, player_clean,
  event_family as receive_event_family, row_number() over (partition by {RK} order by file_row) as rn from clean_pbp
  where is_action_row and event_family in ('reception', 'reception_error') and player_clean <> '' and actor_team is not null and actor_side in ('home', 'away')) x where rn = 1"""
CTES["att"] = f"""select a.season, a.contestid, a.set_no, a.rally_id, a.receive_row, a.team_clean, a.receiving_side, a.player, a.player_clean, a.receive_event_family,
  a.receive_event_family = 'reception_error' as reception_error,
  coalesce(p.first_ball_attack, false) and a.receive_event_family <> 'reception_error' as first_ball_attack,
  coalesce(p.first_ball_kill, false) and a.receive_event_family <> 'reception_error' as first_ball_kill,
  coalesce(p.first_ball_middle_attack, false) and a.receive_event_family <> 'reception_error' as first_ball_middle_attack,
  coalesce(p.point_winner_team = a.team_clean, false) as receive_point_win,
  coalesce(s.server_toughness_index, 0.0) as server_toughness_index, coalesce(s.serve_point_win_rate, 0.0) as serve_point_win_rate,
  coalesce(s.serve_ace_rate, 0.0) as serve_ace_rate, coalesce(s.serve_error_rate, 0.0) as serve_error_rate, coalesce(s.serve_rallies, 0) as server_serve_rallies,
  case when receiving_side = 'home' then score_home_start - score_away_start else score_away_start - score_home_start end as receive_score_diff_start,
  score_home_start + score_away_start as total_points_start,
  case when (a.set_no < 5 and score_home_start + score_away_start >= 38) or (a.set_no = 5 and score_home_start + score_away_start >= 20) then 1 else 0 end as is_late_set
  from att0 a left join passes p on {_RJ('a', 'p')}
  left join serv s on s.season = a.season and s.team_clean = p.serve_team and s.player_clean = p.server_player_clean"""
CTES["expect"] = "select *, " + ", ".join(
    f"avg(case when {t} then 1.0 else 0.0 end) over (partition by season) as expected_{t}" for t in TARGETS) + " from att"
_SHARE = {"receive_point_win": "sr_receive_points_won", "first_ball_kill": "sr_first_ball_kills",
          "first_ball_middle_attack": "sr_first_ball_middle_attacks", "first_ball_attack": "sr_first_ball_attacks"}
CTES["sr0"] = f"""select {PK}, count(*) as sr_attempts, count_if(not reception_error) as sr_clean_receptions, count_if(reception_error) as sr_reception_errors,
  {', '.join(f'count_if({t}) as {o}' for t, o in _SHARE.items())},
  sum(expected_reception_error) as sr_expected_reception_errors, sum(expected_first_ball_attack) as sr_expected_first_ball_attacks,
  sum(expected_first_ball_kill) as sr_expected_first_ball_kills, sum(expected_first_ball_middle_attack) as sr_expected_first_ball_middle_attacks,
  sum(expected_receive_point_win) as sr_expected_receive_points_won,
  avg(server_toughness_index) as sr_avg_server_toughness, avg(serve_ace_rate) as sr_avg_server_ace_rate,
  sum(0.35 * (cast(receive_point_win as int) - expected_receive_point_win) + 0.25 * (cast(first_ball_kill as int) - expected_first_ball_kill)
    + 0.10 * (cast(first_ball_middle_attack as int) - expected_first_ball_middle_attack) + 0.15 * (cast(first_ball_attack as int) - expected_first_ball_attack)
    + 0.15 * (expected_reception_error - cast(reception_error as int))) as sr_value_total from expect group by {PK}"""
CTES["sr"] = f"""select *, {rate('sr_reception_errors', 'sr_attempts')} as sr_reception_error_rate, {rate('sr_first_ball_attacks', 'sr_attempts')} as sr_first_ball_attack_rate,
  {rate('sr_first_ball_kills', 'sr_attempts')} as sr_first_ball_kill_rate, {rate('sr_first_ball_middle_attacks', 'sr_attempts')} as sr_first_ball_middle_attack_rate,
  {rate('sr_receive_points_won', 'sr_attempts')} as sr_receive_point_win_rate,
  sr_expected_reception_errors - sr_reception_errors as sr_error_avoided_oe, sr_first_ball_attacks - sr_expected_first_ball_attacks as sr_first_ball_attack_oe,
  sr_first_ball_kills - sr_expected_first_ball_kills as sr_first_ball_kill_oe,
  sr_first_ball_middle_attacks - sr_expected_first_ball_middle_attacks as sr_first_ball_middle_attack_oe,
  sr_receive_points_won - sr_expected_receive_points_won as sr_receive_point_win_oe,
  {rate('sr_value_total', 'sr_attempts')} as sr_value_per_attempt,
  {rate('sr_value_total', 'sr_attempts')} * sr_attempts / (sr_attempts + 100.0) as sr_shrunk_value_per_attempt,
  {rate('sr_value_total', 'sr_attempts')} * sr_attempts / (sr_attempts + 100.0) * sr_attempts as sr_shrunk_value from sr0"""
_PC = ["event_touches", "event_rallies", "raw_event_credit", "raw_base_event_credit", "positive_event_credit", "negative_event_credit",
       "mean_event_credit", "avg_context_multiplier", "avg_opp_block_strength_index", "avg_opp_attack_strength_index",
       *[f"event_count_{f}" for f in config.FAMILIES]]
_SR = ["sr_attempts", "sr_avg_server_toughness", "sr_reception_error_rate", "sr_first_ball_kill_rate", "sr_shrunk_value"]
CTES["pv0"] = f"""select f.*, {', '.join(f'coalesce(c.{x}, 0) as {x}' for x in _PC)}, {', '.join(f'coalesce(s.{x}, 0) as {x}' for x in _SR)}
  from feats f left join pcred c on c.season = f.season and c.team_clean = f.team_clean and c.player_clean = f.player_clean
  left join sr s on s.season = f.season and s.team_clean = f.team_clean and s.player_clean = f.player_clean"""
CTES["pv1"] = f"""select * exclude (role_family), coalesce(role_family, 'unknown') as roster_role_family, {inferred_role('role_family')} as role_family,
  {rate('box_kills - box_errors', 'box_total_attacks')} as calc_hit_pct, {rate('box_kills', 'box_total_attacks')} as kill_rate_per_attempt,
  {rate('box_errors', 'box_total_attacks')} as attack_error_rate, {rate('box_serr', 'box_aces + box_serr')} as serve_error_rate,
  {rate('box_rerr', 'box_retatt')} as box_reception_error_rate, {rate('event_touches', 'event_rallies')} as touches_per_rally,
  {rate('raw_event_credit', 'event_rallies')} as raw_credit_per_rally from pv0"""
CTES["pv2"] = """select *, event_rallies / (event_rallies + 250.0) * raw_credit_per_rally
  + 250.0 / (event_rallies + 250.0) * avg(raw_credit_per_rally) over (partition by season, role_family) as shrunk_credit_per_rally from pv1"""
CTES["pv3"] = "select *, shrunk_credit_per_rally * event_rallies as shrunk_event_value from pv2"
CTES["pv4"] = "select *, avg(shrunk_event_value) over (partition by season, role_family) as tabular_pred_value from pv3"
_blend = lambda i: "case role_family " + " ".join(f"when '{k}' then {v[i]}" for k, v in config.ROLE_BLEND.items()) + f" else {config.ROLE_BLEND_DEFAULT[i]} end"
CTES["pv5"] = f"""select *, {z('shrunk_event_value', 'partition by season, role_family')} as event_value_z,
  0.0 as tabular_value_z, {z('sr_shrunk_value', 'partition by season, role_family')} as serve_receive_value_z,
  {z('team_strength_index', 'partition by season')} as team_strength_value_z,
  {_blend(0)} as event_blend_weight, {_blend(1)} as tabular_blend_weight, {_blend(2)} as serve_receive_blend_weight from pv4"""
CTES["pv6"] = """select *, event_blend_weight * event_value_z + tabular_blend_weight * tabular_value_z + serve_receive_blend_weight * serve_receive_value_z as blended_value_z from pv5"""
CTES["pv7"] = "select *, blended_value_z + 0.3 * team_strength_value_z as final_value_z from pv6"
_SIMPSON = ("(x / 600.0) * list_sum(list_transform(range(0, 201), lambda i: "
            "(case when i = 0 or i = 200 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-(x * i / 200.0) * (x * i / 200.0) / 2.0))) / sqrt(2.0 * pi())")


def normal_cdf(x: str) -> str:
    """Standard normal distribution by Simpson's rule on 200 intervals (fine for |x| <= 4)."""
    return "(0.5 + " + re.sub(r"\bx\b", f"({x})", _SIMPSON) + ")"


CTES["ranked"] = f"""select *, 3.0 * tanh(final_value_z / 3.0) as score_z, 100.0 * {normal_cdf('3.0 * tanh(final_value_z / 3.0)')} as overall_score,
  event_rallies >= 10 as meets_volume_threshold,
  dense_rank() over (partition by season, role_family order by round(final_value_z, 12) desc) as role_rank,
  dense_rank() over (partition by season order by round(final_value_z, 12) desc) as overall_rank from pv7"""
CTES["audit"] = f"""select *, {inferred_role('roster_role_family')} as inferred_role_family,
  {rate('event_count_reception', 'event_touches')} as reception_share_of_touches, {rate('event_count_set', 'event_touches')} as set_share_of_touches,
  {rate('event_count_attack + event_count_kill', 'event_touches')} as attack_share_of_touches, {rate('box_total_attacks', 'event_rallies')} as attacks_per_rally,
  roster_role_family = 'libero_ds' and (box_total_attacks >= 100 or event_count_kill >= 50) as hitter_in_libero_bucket_flag,
  box_total_attacks >= 300 and calc_hit_pct < 0.2 and overall_rank <= 100 as low_efficiency_high_rank_flag,
  overall_rank <= 100 and event_rallies < 500 as low_volume_high_rank_flag from ranked"""
CTES["audited"] = """select *, concat_ws('; ', case when hitter_in_libero_bucket_flag then 'libero_ds label with hitter-level attack volume' end,
  case when inferred_role_family <> roster_role_family then 'inferred role ' || inferred_role_family || ' differs from roster role ' || roster_role_family end,
  case when low_efficiency_high_rank_flag then 'top-100 rank despite sub-.200 calculated hitting percentage' end,
  case when low_volume_high_rank_flag then 'top-100 rank on fewer than 500 event rallies' end) as audit_reason from audit"""
CTES["cbox"] = f"""select * exclude (team, opponent, kills, assists, aces, digs, block_solos, block_assists, errors, total_attacks),
  {display('team')} as team, {display('opponent')} as opponent, case when location = 'Away' then 1 else 0 end as is_away, hit_pct as kill_efficiency,
  block_solos + block_assists as blocks,
  {', '.join(f'coalesce({c}, 0) as {c}' for c in ('kills', 'assists', 'aces', 'digs', 'block_solos', 'block_assists', 'errors', 'total_attacks'))}
  from player_box"""
CTES["ctbox"] = f"""select * exclude (team, opponent), {display('team')} as team, {display('opponent')} as opponent
  from team_box where result not in ('Ppd', 'Canceled')"""
CTES["playing"] = "select * from pbp where player <> '' and (team = home_team or team = away_team)"

CTES["log0"] = """select season, row_number() over (partition by season order by contestid, set_no, file_row) as file_row, set_no,
  case when file_row % 5 = 0 and contestid % 2 = 0 then contestid end as rid,
  nullif(trim(case when file_row % 7 <> 0 then date end), '') as date,
  nullif(trim(case when file_row % 7 <> 0 then home_team end), '') as home_team,
  nullif(trim(case when file_row % 7 <> 0 then away_team end), '') as away_team from pbp"""
CTES["log1"] = """select season, file_row, set_no, rid, last_value(date ignore nulls) over w as date,
  last_value(home_team ignore nulls) over w as home_team, last_value(away_team ignore nulls) over w as away_team
  from log0 window w as (partition by season order by file_row rows between unbounded preceding and current row)"""
CTES["log2"] = """select *, case when row_number() over w = 1 or coalesce(date <> lag(date) over w, false) or coalesce(home_team <> lag(home_team) over w, false)
    or coalesce(away_team <> lag(away_team) over w, false) or coalesce(set_no < lag(set_no) over w, false) then 1 else 0 end as new
  from log1 window w as (partition by season order by file_row)"""
CTES["log3"] = "select *, sum(new) over (partition by season order by file_row rows between unbounded preceding and current row) as block from log2"
CTES["block_ids"] = """select season, file_row, coalesce(first_value(rid ignore nulls) over
  (partition by season, block order by file_row rows between unbounded preceding and unbounded following), block) as contestid from log3"""

def add(name: str, sql: str) -> None:
    CTES[name] = sql


# --- fitted models ------------------------------------------------------------
# the published method: damped Newton for the logistic models, leave-one-out for the penalty of the ridges

def _swept(sql: str, n: int) -> str:
    """``sql`` with its positive definite matrix ``m`` (row after row in one list) swept on every pivot, which makes it minus its inverse."""
    for k in range(1, n + 1):
        sql = f"""select * exclude (m, pr), list_transform(m, lambda v, ij: case when (ij - 1) // {n} = {k - 1} and (ij - 1) % {n} = {k - 1} then -1.0 / pr[{k}]
  when (ij - 1) // {n} = {k - 1} then pr[(ij - 1) % {n} + 1] / pr[{k}] when (ij - 1) % {n} = {k - 1} then pr[(ij - 1) // {n} + 1] / pr[{k}]
  else v - pr[(ij - 1) // {n} + 1] * pr[(ij - 1) % {n} + 1] / pr[{k}] end) as m from (select *, m[{(k - 1) * n + 1}:{k * n}] as pr from ({sql}))"""
    return sql


def _times(n: int, v: str) -> str:
    """The product of the swept matrix and a vector, with its sign turned back."""
    return f"list_transform(range({n}), lambda i: -list_dot_product(m[i * {n} + 1:(i + 1) * {n}], {v}))"


def _scale(k: int, scaled: int) -> str:
    """Means and deviations of the first inputs; inputs that do not vary, and the others, stay as they are."""
    mean = [f"avg(x[{i}])" if i <= scaled else "0.0" for i in range(1, k + 1)]
    sd = [f"case when stddev_pop(x[{i}]) > 1e-12 * greatest(1.0, abs(avg(x[{i}]))) then stddev_pop(x[{i}]) else 1.0 end"
          if i <= scaled else "1.0" for i in range(1, k + 1)]
    return f"cast([{', '.join(mean)}] as double[]) as mean, cast([{', '.join(sd)}] as double[]) as sd"


RECURSIVE: set[str] = set()


def _logistic(name: str, k: int, scaled: int) -> None:
    """CTEs that fit a logistic model with a free intercept, penalty 1 on scaled inputs, to each g of ``<name>_rows`` (g, y, x)."""
    n, span = k + 1, range(1, k + 2)
    CTES[f"{name}_scale"] = f"select g, {_scale(k, scaled)} from {name}_rows group by g"
    CTES[f"{name}_z"] = f"""select r.g, r.y, list_prepend(cast(1 as double), list_transform(r.x, lambda v, i: (v - s.mean[i]) / s.sd[i])) as a
  from {name}_rows r join {name}_scale s on s.g = r.g"""
    zero = f"cast([{', '.join(['0'] * n)}] as double[])"
    curved = ", ".join(f"sum(p * (1 - p) * a[{i}] * a[{j}]) as h_{i}_{j}" for i in span for j in span if i <= j)
    whole = ", ".join(f"h_{min(i, j)}_{max(i, j)}" + (f" + {0 if i == 1 else 1} + 1e-12" if i == j else "") for i in span for j in span)
    summed = f"""select g, any_value(it) as it, any_value(b) as b, any_value(trial) as trial, any_value(loss) as loss, any_value(step) as step, any_value(t) as t,
    count(*) as n, sum(greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z) as off, [{', '.join(f'sum((p - y) * a[{i}])' for i in span)}] as slope, {curved}
    from (select *, 1 / (1 + exp(-z)) as p from (select o.*, d.y, d.a, list_dot_product(d.a, o.trial) as z
      from {name}_newton o join {name}_z d on d.g = o.g where not o.done and o.it < 500)) group by g"""
    at = f"""select g, it, b, trial, loss, step, t, n, off + 0.5 * list_sum(list_transform(trial[2:], lambda v: v * v)) as now,
    list_transform(slope, lambda v, i: case when i = 1 then v else v + trial[i] end) as slope, [{whole}] as m from ({summed})"""
    RECURSIVE.add(f"{name}_newton")
    CTES[f"{name}_newton"] = f"""select g, 0 as it, {zero} as b, {zero} as trial, cast('inf' as double) as loss, cast(null as double[]) as step,
  cast(1 as double) as t, false as done from {name}_scale union all
  select g, it + 1, b, list_transform(b, lambda v, i: v - t * step[i]), loss, step, t, done from (
    select g, it, case when ok then trial else b end as b, case when ok then now else loss end as loss, case when ok then newton else step end as step,
      case when ok then cast(1 as double) else t / 2 end as t,
      case when ok then list_max(list_transform(slope, lambda v: abs(v))) < greatest(1e-7, 1e-13 * n) else t / 2 < 1e-8 end as done
    from (select *, now <= loss + 1e-9 * abs(loss) or step is null as ok, {_times(n, 'slope')} as newton from ({_swept(at, n)})))"""
    CTES[f"{name}_fit"] = f"""select g, coefficients, b[1] - list_dot_product(coefficients, mean) as intercept from (
  select s.g, s.mean, o.b, list_transform(o.b[2:], lambda v, i: v / s.sd[i]) as coefficients from {name}_scale s
  join (select g, arg_max(b, it) as b from {name}_newton group by g) o on o.g = s.g)"""


def _chance(fit: str, x: str) -> str:
    return f"1 / (1 + exp(-({fit}.intercept + list_dot_product({x}, {fit}.coefficients))))"


def _inputs(names: list[str]) -> str:
    return f"cast([{', '.join(f'coalesce({c}, 0)' for c in names)}] as double[])"


_SIDES = [f"cast(coalesce(side, 'unknown') = '{s}' as int)" for s in ("home", "away", "unknown")]
CTES["wp_x"] = " union all ".join(
    f"select {RK}, '{w}' as at, {_inputs([*config.WP_FEATURES, *_SIDES])} as x from (select {RK}, {state(w)} from rallies)" for w in ("before", "after"))
CTES["wp_rows"] = """select w.season as g, cast(v.home_match_win as double) as y, w.x from wp_x w
  join valid v on v.season = w.season and v.contestid = w.contestid and v.set_no = w.set_no and v.rally_id = w.rally_id
  join split s on s.season = w.season and s.contestid = w.contestid where w.at = 'before' and s.split = 'train'"""
_logistic("wp", len(config.WP_FEATURES) + 3, len(config.WP_FEATURES))
CTES["wp_p"] = f"select w.*, {_chance('f', 'w.x')} as p from wp_x w join wp_fit f on f.g = w.season"
CTES["fit_wp"] = "select r.*, b.p as home_wp_before, a.p as home_wp_after, a.p - b.p as home_wpa from rallies r" + "".join(
    f" left join wp_p {q} on {q}.season = r.season and {q}.contestid = r.contestid and {q}.set_no = r.set_no and {q}.rally_id = r.rally_id and {q}.at = '{w}'"
    for q, w in (("b", "before"), ("a", "after")))

_SR_X = _inputs(serving.SR_FEATURES)
CTES["sr_rows"] = "select season || '/' || target as g, y, x from (" + " union all ".join(
    f"select season, '{t}' as target, cast({t} as double) as y, {_SR_X} as x from att" for t in serving.SR_TARGETS) + """) o
  qualify count(*) over (partition by season, target) >= 50 and min(y) over (partition by season, target) < max(y) over (partition by season, target)"""
_logistic("sr", len(serving.SR_FEATURES), len(serving.SR_FEATURES))
CTES["fit_expect"] = "select a.*, " + ", ".join(
    f"coalesce({_chance(f'f{i}', 'a.x')}, avg(cast(a.{t} as double)) over (partition by a.season)) as expected_{t}" for i, t in enumerate(serving.SR_TARGETS)
) + f" from (select *, {_SR_X} as x from att) a" + "".join(
    f" left join sr_fit f{i} on f{i}.g = a.season || '/{t}'" for i, t in enumerate(serving.SR_TARGETS))

_ON_FITS = ["cred0", "cred1", "cred2", "cred", "pcred", "sr0", "sr", "pv0", "pv1", "pv2", "pv3", "pv4", "pv5", "pv6", "pv7", "ranked", "audit", "audited"]
_P = len(rankings.TABULAR_FEATURES)
_ALPHAS = f"[{', '.join(repr(a) for a in models.ALPHAS)}]"
_RIDGE = {
    "ridge_rows": f"""select season || '/' || role_family as g, row_number() over () as r, cast(shrunk_event_value as double) as y, {_inputs(rankings.TABULAR_FEATURES)} as x
  from fit_pv3 where event_rallies >= 5 qualify count(*) over (partition by season, role_family) >= 10""",
    "ridge_scale": f"select g, count(*) as n, avg(y) as mean_y, {_scale(_P, _P)} from ridge_rows group by g",
    "ridge_z": """select r.g, r.r, s.n, r.y - s.mean_y as y, list_transform(r.x, lambda v, i: (v - s.mean[i]) / s.sd[i]) as z
  from ridge_rows r join ridge_scale s on s.g = r.g""",
    "ridge_long": "select g, r, y, unnest(z) as v, generate_subscripts(z, 1) as i from ridge_z",
    "ridge_gram": """select g, list(v order by i, j) as gram from (select a.g, a.i, b.i as j, sum(a.v * b.v) as v
  from ridge_long a join ridge_long b on b.g = a.g and b.r = a.r group by a.g, a.i, b.i) group by g""",
    "ridge_zy": "select g, list(v order by i) as zy from (select g, i, sum(v * y) as v from ridge_long group by g, i) group by g",
    "ridge_inverse": _swept(f"""select g, k, list_transform(gram, lambda v, ij: case when (ij - 1) // {_P} = (ij - 1) % {_P} then v + {_ALPHAS}[k] else v end) as m
  from ridge_gram cross join (select unnest(range(1, {len(models.ALPHAS)} + 1)) as k)""", _P),
    "ridge_beta": f"select i.*, {_times(_P, 'y.zy')} as beta from ridge_inverse i join ridge_zy y on y.g = i.g",
    "ridge_loo": f"""select b.g, b.k, b.beta, sum(power((z.y - list_dot_product(z.z, b.beta)) / (1 - 1.0 / z.n - list_dot_product(z.z, {_times(_P, 'z.z')})), 2)) as err
  from ridge_beta b join ridge_z z on z.g = b.g group by b.g, b.k, b.beta""",
    "ridge_fit": """select g, coefficients, mean_y - list_dot_product(coefficients, mean) as intercept from (
  select s.g, s.mean, s.mean_y, list_transform(o.beta, lambda v, i: v / s.sd[i]) as coefficients from ridge_scale s
  join (select g, arg_min(beta, (err, k)) as beta from ridge_loo group by g) o on o.g = s.g)""",
}
for _name in _ON_FITS:
    _body = re.sub(r"\b(from|join)\s+(\w+)\b", lambda m: f"{m[1]} fit_{m[2]}" if m[2] in [*_ON_FITS, "wp", "expect"] else m[0], CTES[_name])
    if _name == "pv4":
        CTES.update(_RIDGE)
        _body = f"""select v.*, coalesce(f.intercept + list_dot_product({_inputs([f"v.{c}" for c in rankings.TABULAR_FEATURES])}, f.coefficients),
  avg(v.shrunk_event_value) over (partition by v.season, v.role_family)) as tabular_pred_value, f.g is not null as has_ridge
  from fit_pv3 v left join ridge_fit f on f.g = v.season || '/' || v.role_family"""
    if _name == "pv5":
        _body = _body.replace("0.0 as tabular_value_z", f"case when has_ridge then {z('tabular_pred_value', 'partition by season, role_family')} else 0.0 end as tabular_value_z")
    CTES[f"fit_{_name}"] = _body


def with_ctes(body: str) -> str:
    """``body`` preceded by the CTEs it refers to, directly or through others."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    parts = [f"{n} as materialized ({CTES[n]})" for n in CTES if n in needed]
    return ("with recursive " if needed & RECURSIVE else "with ") + ",\n".join(parts) + "\n" + body
