"""Runnable queries over the test tables, one or more per operator.

``@query`` registers a function ``(spark, folder) -> DataFrame`` with the output columns
and, where one exists, the SQL that must give the same rows. Both sides are brought to the
same types: bigint, string, boolean, and doubles rounded to six places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtlens import config
from courtlens.catalog import reference_sql as R
from courtlens.config import DEFAULT
from courtlens.functions import numeric as N
from courtlens.functions import text as T
from courtlens.operators import ordered, resolve, shape, stats
from courtlens.plans import credit, firstball, marts, models, playbyplay, rallies, rankings
from courtlens.plans import replacement, roster, serving
from courtlens.plans.refresh import SeasonStore
from courtlens.plans.season import SeasonTables
from courtlens.session import run_folder, stable
from courtlens.sources import readers, seasons, shaped, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

_TYPES = {"i": "bigint", "s": "string", "d": "double", "b": "boolean"}


def _columns(spec: str) -> list[tuple[str, str]]:
    out, kind = [], "s"
    for token in spec.split():
        if token.endswith(":"):
            kind = token[:-1]
        else:
            out.append((token, kind))
    return out


def query(spec: str, sql: str | None = None):
    cols = _columns(spec)

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(spark, folder)
            return df.select(*[
                (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) if k == "d"
                else F.col(c).cast(_TYPES[k]).alias(c)
                for c, k in cols
            ])

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            sql_type = {"i": "bigint", "s": "varchar", "b": "boolean"}
            picked = ", ".join(
                f"round(cast({c} as double), 6) + 0.0 as {c}" if k == "d"
                else f"cast({c} as {sql_type[k]}) as {c}" for c, k in cols
            )
            CHECKS[fn.__name__] = R.with_ctes(f"select {picked} from ({sql}) final")
        return fn

    return register


_BUNDLES: dict[tuple, SeasonTables] = {}
_TEST = DEFAULT.but(min_rallies=10, tabular_min_rallies=1 << 40, aux_min_rows=1 << 40)
_FITTED = DEFAULT.but(min_rallies=10, tabular_min_rallies=5)


def fixed_curve(rally_rows: DataFrame, slope: float = 0.15, set_slope: float = 0.8) -> DataFrame:
    """Win probability as a fixed logistic of point and set lead, which SQL can follow."""
    out = {}
    for s in ("before", "after"):
        st = models.wp_state(s)
        out[f"home_wp_{s}"] = models.sigmoid(
            st["home_score_diff"] * slope + (st["home_sets"] - st["away_sets"]) * set_slope)
    return rally_rows.withColumns(out)


def tables(spark: SparkSession, folder: str, wp_model: str = "fixed") -> SeasonTables:
    """Season tables of a data folder, written once per application and read by all queries.

    With the fixed win-probability curve every later model takes its small-sample branch,
    which SQL can follow; the fitted bundles run the real models.
    """
    key = (spark.sparkContext.applicationId, folder, wp_model)
    if key not in _BUNDLES:
        cfg = _TEST if wp_model == "fixed" else _FITTED
        made = SeasonTables(
            shaped.roster(spark, folder), shaped.player_box(spark, folder),
            shaped.team_box(spark, folder), shaped.pbp(spark, folder), cfg,
            fixed_curve if wp_model == "fixed" else wp_model,
        )
        if wp_model != "fixed":
            base = tables(spark, folder)
            for name in ("player_master", "teams", "chunk", "parts", "clean_pbp", "rally_table", "rally_pass",
                         "player_season_features", "team_phase_context", "servers"):
                made.__dict__[name] = getattr(base, name)
        _BUNDLES[key] = made
    return _BUNDLES[key]


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pieces(spec: str) -> str:
    return ", ".join(c for c, _ in _columns(spec))


# --- text -------------------------------------------------------------------

@query("i: o_orderkey s: team d: total_attacks hit_pct s: opponent", """
select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then null else o_orderstatus end, o_orderpriority) as team,
  o_totalprice as total_attacks, o_totalprice / 2 as hit_pct, o_orderpriority as opponent from orders""")
def standard_headers(spark, folder):
    """Messy headers normalised; the two that collide are coalesced left to right."""
    o = _table(spark, folder, "orders")
    messy = o.select(
        F.col("o_orderkey").alias("O OrderKey"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("Team"),
        F.col("o_totalprice").alias("TotalAttacks"), (F.col("o_totalprice") / 2).alias("HitPct"),
        F.col("o_orderpriority").alias("team "), F.col("o_orderpriority").alias("Opponent Team"),
    )
    return T.standardize_columns(messy)


@query("i: doc_id s: name", f"select doc_id, {R.clean('text')} as name from documents")
def clean_names(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", T.clean_name(F.col("text")).alias("name"))


@query("i: conv_id turn s: team", f"select conv_id, turn, {R.clean_team('text')} as team from conversations")
def clean_team_names(spark, folder):
    return _table(spark, folder, "conversations").select(
        "conv_id", "turn", T.clean_team(F.col("text")).alias("team"))


@query("i: contestid s: opponent stripped", f"select contestid, opponent, {R.opponent('opponent')} as stripped from team_box")
def stripped_opponents(spark, folder):
    return shaped.team_box(spark, folder).select(
        "contestid", "opponent", T.strip_opponent_noise(F.col("opponent")).alias("stripped"))


@query("i: item_id s: stripped", f"select item_id, {R.opponent('text')} as stripped from benchmark")
def stripped_long_texts(spark, folder):
    return _table(spark, folder, "benchmark").select(
        "item_id", T.strip_opponent_noise(F.col("text")).alias("stripped"))


@query("s: raw canonical", "select raw, canonical from resolved")
def resolved_opponents(spark, folder):
    """Every raw opponent text with its canonical team, by alias, exact or single fuzzy hit."""
    t = tables(spark, folder)
    raw = t.team_box.select(F.col("opponent").alias("raw")).unionByName(
        t.player_box.select(F.col("opponent").alias("raw")))
    return resolve.name_map(raw, t.teams)


@query("s: name team_clean", """select name, t.team_clean from (select distinct c_mktsegment || ' ' || c_name as name from customer) n
  join (select distinct lower(c_mktsegment) as team_clean from customer union select 'household customer') t
  on regexp_replace(t.team_clean, '[^a-z0-9]', '', 'g') = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')
  or starts_with(t.team_clean, lower(name) || ' ')
  or regexp_matches(lower(name), '(^|[^a-z0-9_])' || regexp_escape(t.team_clean) || '($|[^a-z0-9_])')""")
def fuzzy_name_hits(spark, folder):
    """All fuzzy hits of customer texts against segment names, without forming pairs."""
    c = _table(spark, folder, "customer")
    names = c.select(F.concat_ws(" ", "c_mktsegment", "c_name").alias("text")).distinct()
    known = c.select(F.lower("c_mktsegment").alias("team_clean")).unionByName(
        spark.sql("select 'household customer' as team_clean")).distinct()
    keyed = names.withColumn("name", F.lower("text"))
    return resolve.fuzzy_hits(keyed.select("name").distinct(), known).join(keyed, "name").select(
        F.col("text").alias("name"), "team_clean")


@query("i: file_row s: event_family b: is_first_ball_kill_text", f"""
select file_row, {R.family(R.clean('event'), R.clean('description'))} as event_family,
  contains({R.clean('event')}, 'first ball kill') or contains({R.clean('description')}, 'first ball kill') as is_first_ball_kill_text from pbp""")
def event_families(spark, folder):
    e, d = T.clean_name(F.col("event")), T.clean_name(F.col("description"))
    return shaped.pbp(spark, folder).select(
        "file_row", T.event_family(e, d).alias("event_family"),
        T.mentions_first_ball_kill(e, d).alias("is_first_ball_kill_text"))


@query("s: season player_uid role_family team_clean player_clean i: number_clean", "select * from master")
def player_master(spark, folder):
    return roster.player_master(shaped.roster(spark, folder))


@query("i: o_orderkey s: uid", """select o_orderkey, o_orderstatus || '::' || cast(o_custkey as varchar) || '::' ||
  case when o_orderkey % 5 = 0 then null else o_orderpriority end as uid from orders""")
def composite_ids(spark, folder):
    o = _table(spark, folder, "orders")
    gap = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", T.composite_id(F.col("o_orderstatus"), F.col("o_custkey"), gap).alias("uid"))


_RES = "'^\\s*([WL])\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$'"


@query("i: contestid won sets_for sets_against", f"""select contestid, case when regexp_extract(result, {_RES}, 1) = 'W' then 1 else 0 end as won,
  coalesce(try_cast(nullif(regexp_extract(result, {_RES}, 2), '') as bigint), 0) as sets_for,
  coalesce(try_cast(nullif(regexp_extract(result, {_RES}, 3), '') as bigint), 0) as sets_against from team_box""")
def match_results(spark, folder):
    won, a, b = T.result_parts(F.col("result"))
    return shaped.team_box(spark, folder).select(
        "contestid", won.alias("won"), a.alias("sets_for"), b.alias("sets_against"))


@query("i: file_row away home", f"select file_row, {R.score_part(1)} as away, {R.score_part(2)} as home from pbp")
def parsed_scores(spark, folder):
    away, home = T.score_parts(F.col("score"))
    return shaped.pbp(spark, folder).select("file_row", away.alias("away"), home.alias("home"))


@query("i: contestid s: team opponent", f"select contestid, {R.display('team')} as team, {R.display('opponent')} as opponent from team_box")
def display_teams(spark, folder):
    return shaped.team_box(spark, folder).select(
        "contestid", T.display_team(F.col("team")).alias("team"),
        T.display_team(F.col("opponent")).alias("opponent"))


@query("i: doc_id s: lang source", """select doc_id, lang, source from documents
  where contains(lower(coalesce(text, '')), 'the') or contains(lower(coalesce(lang, '')), 'the') or contains(lower(coalesce(source, '')), 'the')""")
def text_search(spark, folder):
    return _table(spark, folder, "documents").filter(T.contains_any(["text", "lang", "source"], " The "))


# --- numbers ----------------------------------------------------------------

@query("i: o_orderkey whole d: value", """select o_orderkey,
  case when regexp_matches(raw, '^\\d+$') then cast(raw as bigint) end as whole,
  case when raw in ('n/a', 'NaN', '') then null else cast(raw as double) end as value
  from (select o_orderkey, case o_orderkey % 5 when 0 then 'n/a' when 1 then 'NaN' when 2 then '' when 3 then cast(o_custkey as varchar)
    else cast(o_custkey as varchar) || '.25' end as raw from orders) x""")
def coerced_numbers(spark, folder):
    k = F.col("o_orderkey") % 5
    raw = (F.when(k == 0, "n/a").when(k == 1, "NaN").when(k == 2, "")
           .when(k == 3, F.col("o_custkey").cast("string"))
           .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".25"))))
    d = _table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    whole = F.when(F.col("raw").rlike(r"^\d+$"), N.number(F.col("raw"), "bigint"))
    return d.select("o_orderkey", whole.alias("whole"), N.number(F.col("raw")).alias("value"))


@query("i: l_suppkey d: late_rate return_rate", """select l_suppkey, coalesce(late / nullif(cast(n as double), 0), 0) as late_rate,
  coalesce(returned / nullif(cast(late as double), 0), 0) as return_rate from (
  select l_suppkey, count(*) as n, count_if(l_tax > 0.07) as late, count_if(l_returnflag = 'R' and l_tax > 0.07) as returned from lineitem group by l_suppkey) x""")
def safe_rates(spark, folder):
    g = _table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax") > 0.07).alias("late"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)).alias("returned"))
    return g.select("l_suppkey", N.safe_rate(F.col("late"), F.col("n")).alias("late_rate"),
                    N.safe_rate(F.col("returned"), F.col("late")).alias("return_rate"))


@query("i: event_id b: yes d: ratio filled", """select event_id, lower(case event_id % 4 when 0 then 'TRUE' when 1 then '1' when 2 then 'no' end) in ('true', '1', 'yes')
    and event_id % 4 <> 3 as yes,
  case when event_id % 10 = 0 then 0 else value / (event_id % 10) end as ratio, 0 as filled from events""")
def loose_booleans_and_finite(spark, folder):
    """True/1/yes texts, infinities and absent columns brought to plain values."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, "TRUE").when(k == 1, "1").when(k == 2, "no")
    m = F.col("event_id") % 10
    ratio = F.when(m == 0, F.lit(float("inf"))).otherwise(F.col("value") / m)
    d = _table(spark, folder, "events").select(
        "event_id", N.loose_bool(text).alias("yes"), N.finite_or_zero(ratio).alias("ratio"))
    return N.zero_filled(d, ["filled"])


_WP = "set_number home_sets away_sets home_points away_points home_score_diff total_points home_server away_server is_fifth_set is_late_set is_deuce_or_later"


@query(f"s: season i: contestid set_no rally_id {_WP}", f"select {R.RK}, {R.state('before')} from rallies")
def scoreboard_before(spark, folder):
    r = tables(spark, folder).rally_table
    return r.select(*playbyplay.RALLY_KEY, *[c.alias(n) for n, c in models.wp_state("before").items()])


@query(f"s: season i: contestid set_no rally_id {_WP}", f"select {R.RK}, {R.state('after')} from rallies")
def scoreboard_after(spark, folder):
    r = tables(spark, folder).rally_table
    return r.select(*playbyplay.RALLY_KEY, *[c.alias(n) for n, c in models.wp_state("after").items()])


@query("i: o_orderkey d: z p", f"""select o_orderkey, 3.0 * tanh(x / 3.0) as z, {R.normal_cdf('3.0 * tanh(x / 3.0)')} as p
  from (select o_orderkey, (o_totalprice - 250000.0) / 60000.0 as x from orders) q""")
def squashed_scores(spark, folder):
    """tanh squash and normal distribution function."""
    x = (F.col("o_totalprice") - 250000.0) / 60000.0
    d = _table(spark, folder, "orders").select("o_orderkey", N.squash(x, 3.0).alias("z"))
    return d.withColumn("p", N.normal_cdf(F.col("z")))


# --- log, rallies -----------------------------------------------------------

@query("s: season i: file_row contestid set_no", "select * from touch")
def distinct_touches(spark, folder):
    return playbyplay.distinct_touches(shaped.pbp(spark, folder))


@query("i: file_row s: team_clean home_clean away_clean actor_team actor_side actor_team_source b: player_on_home player_on_away",
       "select * from filled")
def touch_actors(spark, folder):
    """Roster probes on both sides, then the owner of the touch."""
    return tables(spark, folder).clean_pbp


_FLAGS = "i: file_row away_score_ffill home_score_ffill d_away d_home b: score_is_numeric score_backward multi_point_jump one_point_increment"


@query(_FLAGS, "select * from flagged")
def score_flags(spark, folder):
    """Forward-filled score, differences and anomaly flags, by plain windows."""
    return tables(spark, folder).clean_pbp


def _scores_in_chunks(spark, folder, chunk: int) -> DataFrame:
    t = tables(spark, folder)
    d = playbyplay.with_contest_ids(playbyplay.distinct_touches(t.pbp))
    return playbyplay.with_score(d.select(*playbyplay.SET_KEY, "file_row", "score"), chunk)


@query(_FLAGS, "select * from flagged")
def score_flags_chunked(spark, folder):
    """The same through the scan used when one set holds most of the rows."""
    return _scores_in_chunks(spark, folder, 256)


@query("i: file_row rally_id", "select * from cut")
def rally_segments_chunked(spark, folder):
    d = _scores_in_chunks(spark, folder, 256)
    return ordered.segment(d, playbyplay.SET_KEY, "file_row", "one_point_increment", "rally_id", 256)


@query("s: season i: contestid set_no rally_id file_row row_in_rally action_seq s: event_family b: is_action_row s: player_clean player_uid role_family",
       "select * from clean_pbp")
def event_table(spark, folder):
    return tables(spark, folder).event_table


@query("s: season i: file_row contestid", "select * from block_ids")
def rebuilt_contest_ids(spark, folder):
    """Contest ids from row order for logs that lack them, keeping the ids that are there."""
    d = _log_without_ids(spark, folder)
    return ordered.contest_blocks(
        d, "file_row", "rid", ["date", "home_team", "away_team"], "set_no", ["season"], "contestid",
        ordered.pick_chunk(d, ["season"]),
    )


@query("s: season i: file_row contestid", "select * from block_ids")
def rebuilt_contest_ids_chunked(spark, folder):
    """The same with every season cut into small order ranges."""
    return ordered.contest_blocks(
        _log_without_ids(spark, folder), "file_row", "rid", ["date", "home_team", "away_team"],
        "set_no", ["season"], "contestid", 500,
    )


def _log_without_ids(spark, folder) -> DataFrame:
    p = shaped.pbp(spark, folder).withColumn("cid", F.col("contestid").cast("bigint"))
    rows = ordered.row_numbers(
        p.select("season", "cid", "set_no", "date", "home_team", "away_team", F.col("file_row").alias("event_id")),
        ["season"], [F.col("cid"), F.col("set_no"), F.col("event_id")], "file_row",
    )
    keep = F.col("event_id") % 5 == 0
    blank = F.col("event_id") % 7 == 0
    return rows.select(
        "season", "file_row", "set_no", F.when(keep & (F.col("cid") % 2 == 0), F.col("cid")).alias("rid"),
        *[F.when(~blank, F.col(c)).alias(c) for c in ("date", "home_team", "away_team")],
    )


@query("s: season i: contestid set_no rally_id s: date away_team home_team away_clean home_clean i: score_away_start score_home_start score_away_end score_home_end "
       "rally_rows action_rows unresolved_actor_rows b: any_backward_score any_multi_point_jump any_non_numeric_score i: serve_row s: serve_team server_side server_player_clean "
       "i: terminal_row s: terminal_event_family terminal_actor_team terminal_actor_side terminal_player_clean i: away_delta home_delta point_delta_total s: point_winner_side point_winner_team "
       "i: home_set_win away_set_win home_sets_before away_sets_before home_sets_total away_sets_total home_match_win b: is_set_terminal i: home_sets_after away_sets_after set_after "
       "score_home_after_state score_away_after_state s: server_side_after", "select * from rallies")
def rally_table(spark, folder):
    return tables(spark, folder).rally_table


@query("s: season i: contestid s: date away_team home_team away_clean home_clean i: sets rallies home_sets_total away_sets_total home_match_win", """
select season, contestid, arg_min(date, k) filter (where date is not null) as date, arg_min(away_team, k) as away_team, arg_min(home_team, k) as home_team,
  arg_min(away_clean, k) as away_clean, arg_min(home_clean, k) as home_clean, count(distinct set_no) as sets, count(*) as rallies,
  max(home_sets_total) as home_sets_total, max(away_sets_total) as away_sets_total, max(home_match_win) as home_match_win
from (select *, set_no * 1000000 + rally_id as k from rallies) x group by season, contestid""")
def contest_master(spark, folder):
    return tables(spark, folder).contest_master


@query("i: rallies bad_rows backward jumps non_numeric unresolved", """select count(*) as rallies, count_if(point_delta_total <> 1) as bad_rows, count_if(any_backward_score) as backward,
  count_if(any_multi_point_jump) as jumps, count_if(any_non_numeric_score) as non_numeric, sum(unresolved_actor_rows) as unresolved from rallies""")
def quality_counters(spark, folder):
    return tables(spark, folder).rally_table.agg(
        F.count(F.lit(1)).alias("rallies"), F.count_if(F.col("point_delta_total") != 1).alias("bad_rows"),
        F.count_if("any_backward_score").alias("backward"), F.count_if("any_multi_point_jump").alias("jumps"),
        F.count_if("any_non_numeric_score").alias("non_numeric"), F.sum("unresolved_actor_rows").alias("unresolved"))


@query("s: season i: contestid set_no rally_id home_sets_before away_sets_before home_sets_total away_sets_total home_sets_after away_sets_after home_match_win b: is_set_terminal", "select * from rallies")
def rally_table_hot(spark, folder):
    """Set results by the aggregate-and-join form used when one contest is very large."""
    return rallies.rally_table(tables(spark, folder).clean_pbp, hot=True)


# --- first ball -------------------------------------------------------------

@query("s: season i: contestid set_no rally_id reception_row s: receiving_team passer_player_clean reception_event_family i: first_attack_row s: first_attack_player_clean "
       "first_attack_event_family first_attack_role_family i: first_opp_action_row first_same_team_kill_row s: first_ball_kill_player_clean "
       "b: reception_error receive_point_win first_ball_attack first_ball_kill first_ball_middle_attack", "select * from passes")
def rally_pass(spark, folder):
    return tables(spark, folder).rally_pass


@query("s: season i: contestid set_no rally_id reception_row first_attack_row first_opp_action_row first_same_team_kill_row", "select * from contacts")
def first_contacts_hot(spark, folder):
    """First-after-anchor through the aggregate-and-join form used for hot rallies."""
    return firstball.first_contacts(tables(spark, folder).event_table, hot=True).filter("reception_row is not null")


_FB = "i: fb_receptions fb_clean_receptions fb_reception_errors fb_attacks fb_kills fb_middle_attacks fb_receive_point_wins d: fb_attack_rate fb_kill_rate fb_middle_attack_rate fb_reception_error_rate fb_receive_point_win_rate"


@query(f"s: season team_clean player_clean i: contestid {_FB}", "select * from fbc")
def first_ball_contest(spark, folder):
    return tables(spark, folder).first_ball_contest


@query(f"s: season team_clean player_clean player role_family {_FB}", """select s.*, m.player, m.role_family from fbs s
  left join (select distinct season, team_clean, player_clean, player, team, role_family, player_uid from master) m
  on m.season = s.season and m.team_clean = s.team_clean and m.player_clean = s.player_clean""")
def first_ball_season(spark, folder):
    return tables(spark, folder).first_ball_season_display


# --- box scores -------------------------------------------------------------

@query("s: team_clean", "select * from teams")
def known_teams(spark, folder):
    return tables(spark, folder).teams


@query("s: season team_clean i: matches sets_for sets_against d: win_pct mean_hit_pct mean_pts set_diff_per_match team_strength_index s: team_display", """
select s.*, m.team_display from strength s left join (select season, team_clean, min(team) as team_display from master group by all) m
  on m.season = s.season and m.team_clean = s.team_clean""")
def team_strength(spark, folder):
    return tables(spark, folder).team_strength


@query("i: contestid line_no s: season team_clean player_clean opp_clean role_family player_uid", """
select b.*, m.role_family, m.player_uid from box b left join master m on m.season = b.season and m.team_clean = b.team_clean and m.player_clean = b.player_clean""")
def player_match_roles(spark, folder):
    """Role lookup on box rows, with the resolved opponent."""
    return tables(spark, folder).player_match


@query("i: contestid line_no s: season team_clean player_clean opp_clean d: team_strength_index opp_strength_index b: team_strength_missing opp_strength_missing "
       "i: fb_receptions fb_kills d: fb_kill_rate", "select * from enriched")
def player_match_enriched(spark, folder):
    return tables(spark, folder).player_match_enriched


_FEATS = "s: season team_clean player_clean role_family i: matches_played_rows d: " + " ".join(
    ["team_strength_index", "opp_strength_index", "team_strength_missing_rate", "opp_strength_missing_rate",
     *[f"box_{c}" for c in config.BOX_STATS]]) + " " + _FB


@query(_FEATS, "select * from feats")
def player_season_features(spark, folder):
    return tables(spark, folder).player_season_features


# --- win probability --------------------------------------------------------

@query("s: season i: contestid s: split", "select * from split")
def chronological_split(spark, folder):
    return models.time_split(models.valid_rallies(tables(spark, folder).rally_table))


@query("s: season i: contestid set_no rally_id d: home_wp_before home_wp_after home_wpa", "select * from wp")
def win_probability_fixed(spark, folder):
    return tables(spark, folder).rally_win_probability


_TRAINED = "exists (select 1 from split s where s.season = wp.season and s.split = 'train')"
_FITTED_ROWS = f"select season, contestid, set_no, rally_id, {_TRAINED} as fitted, 0 as outside from wp"


def _fitted(values):
    """Whether a rally has a model, and how far its chances lie outside 0 to 1 or the added value off their difference."""
    beyond = lambda c: F.greatest(F.lit(0.0), -F.col(c), F.col(c) - 1)
    gap = F.abs(F.col("home_wpa") - F.col("home_wp_after") + F.col("home_wp_before"))
    return values.withColumns({
        "fitted": F.col("home_wp_before").isNotNull() & F.col("home_wp_after").isNotNull(),
        "outside": F.coalesce(beyond("home_wp_before") + beyond("home_wp_after") + gap, F.lit(0.0))})


@query("s: season i: contestid set_no rally_id b: fitted d: outside", _FITTED_ROWS)
def win_probability_logistic(spark, folder):
    """Every rally and whether its season has a model."""
    return _fitted(tables(spark, folder, "logistic").rally_win_probability)


@query("s: season i: contestid set_no rally_id b: fitted d: outside", _FITTED_ROWS)
def win_probability_mlp(spark, folder):
    """As the logistic one, for the perceptron."""
    return _fitted(tables(spark, folder, "mlp").rally_win_probability)


def _residuals(df):
    """Residuals to three places, and no negative zero."""
    return df.withColumn("residual", F.round("residual", 3) + F.lit(0.0))


def _zero(keys: str, rows: str, inputs: list[str]) -> str:
    names = ", ".join(f"'{i}'" for i in ["intercept", *inputs])
    return f"select {keys}, input, 0.0 as residual from ({rows}) g cross join (select unnest([{names}]) as input) n"


@query("s: season input d: residual", _zero("season", "select distinct season from split where split = 'train'", models.WP_INPUTS))
def win_probability_optimum(spark, folder):
    """The gradient of the penalised loss of every season's logistic model, which is 0 at the only optimum."""
    t = tables(spark, folder, "logistic")
    train = models.training_rows(t.rally_table, t.cfg)
    return _residuals(models.optimality(train, models.fit_logistic(train, t.cfg), ["season"], {
        c: F.col(c) for c in models.WP_INPUTS}, F.col("label"), len(models.WP_FEATURES)))


_STATES = f"""select season, home_match_win as y, count(*) over (partition by season) as n, sum(home_match_win) over (partition by season) as won,
  avg(home_match_win) over (partition by season, set_no, home_sets_before, away_sets_before, score_home_start, score_away_start, server_side) as p
  from wp join split using (season, contestid) where split = 'train' and point_delta_total = 1"""
_BOUNDS = f"""select season, count(*) as rows, avg(case when won > 0 and won < n then -(y * ln(won / n) + (1 - y) * ln(1 - won / n)) else 0 end) as base_loss,
  avg(case when p > 0 and p < 1 then -(y * ln(p) + (1 - y) * ln(1 - p)) else 0 end) as least_loss, 0 as outside from ({_STATES}) z group by season"""


@query("s: season i: rows d: base_loss least_loss outside", _BOUNDS)
def win_probability_mlp_loss(spark, folder):
    """The training loss of the perceptron against the rate of the season and the rates of all states, between which it lies."""
    t = tables(spark, folder, "mlp")
    state = ["season", "set_no", "home_sets_before", "away_sets_before", "score_home_start", "score_away_start", "server_side"]
    train = models.valid_rallies(t.rally_table).join(
        models.time_split(models.valid_rallies(t.rally_table), t.cfg).where("split = 'train'"), ["season", "contestid"])
    d = train.select(*playbyplay.RALLY_KEY, *state[2:6], "server_side").join(
        t.rally_win_probability.select(*playbyplay.RALLY_KEY, "home_match_win", "home_wp_before"), playbyplay.RALLY_KEY)
    y, q = F.col("home_match_win"), F.col("home_wp_before")
    g = d.groupBy(*state).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("won"),
                              F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("loss"))
    part = lambda p, n: -n * F.when((p > 0) & (p < 1), p * F.log(p) + (1 - p) * F.log(1 - p)).otherwise(0.0)
    g = g.withColumn("least", part(F.col("won") / F.col("n"), F.col("n"))).groupBy("season").agg(
        F.sum("n").alias("rows"), F.sum("won").alias("won"), F.sum("loss").alias("loss"), F.sum("least").alias("least"))
    per_row = {"base_loss": part(F.col("won") / F.col("rows"), F.col("rows")), "least_loss": F.col("least"), "loss": F.col("loss")}
    g = g.withColumns({c: v / F.col("rows") for c, v in per_row.items()})
    # where all contests end alike the rate has no loss, which no curve reaches
    above = F.when(F.col("base_loss") > 0, F.col("loss") - F.col("base_loss")).otherwise(0.0)
    return g.withColumn("outside", F.greatest(F.lit(0.0), above, F.col("least_loss") - F.col("loss")))


@query("s: season i: rows won", """select w.season, count(*) as rows, cast(sum(home_match_win) as bigint) as won from wp w
  join split s on s.season = w.season and s.contestid = w.contestid where s.split = 'train' and w.point_delta_total = 1 group by w.season""")
def win_probability_calibration(spark, folder):
    """With a free intercept the fitted chances of the training rallies add up to the rallies of the winners."""
    t = tables(spark, folder, "logistic")
    valid = models.valid_rallies(t.rally_table)
    train = models.time_split(valid, t.cfg).filter("split = 'train'")
    d = t.rally_win_probability.join(valid.select(*playbyplay.RALLY_KEY), playbyplay.RALLY_KEY, "left_semi").join(
        train, ["season", "contestid"])
    return d.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("home_wp_before"), 1).alias("won"))


_METRICS = """select season, split, count(*) as rows, avg(home_match_win) as positive_rate,
  avg(-(home_match_win * ln(home_wp_before) + (1 - home_match_win) * ln(1 - home_wp_before))) as log_loss,
  avg((home_wp_before - home_match_win) * (home_wp_before - home_match_win)) as brier,
  (sum(case when home_match_win = 1 then rk end) - count_if(home_match_win = 1) * (count_if(home_match_win = 1) + 1) / 2.0)
    / nullif(count_if(home_match_win = 1) * count_if(home_match_win = 0), 0) as auc
from (select w.*, s.split, rank() over p + (count(*) over (partition by w.season, s.split, w.home_wp_before) - 1) / 2.0 as rk
  from wp w join split s on s.season = w.season and s.contestid = w.contestid where w.point_delta_total = 1
  window p as (partition by w.season, s.split order by w.home_wp_before)) x group by season, split"""


@query("s: season split i: rows d: positive_rate log_loss brier auc", _METRICS)
def classifier_metrics(spark, folder):
    """Exact metrics of the fixed curve per season and split."""
    return tables(spark, folder).win_probability_metrics


@query("s: season split i: rows d: positive_rate outside", f"select season, split, rows, positive_rate, 0 as outside from ({_METRICS}) m")
def win_probability_metrics_logistic(spark, folder):
    """Rows and rates of the fitted curve; its metrics lie in their ranges, and the training loss under that of the rate."""
    m = tables(spark, folder, "logistic").win_probability_metrics
    p, beyond = F.col("positive_rate"), lambda c: F.coalesce(F.greatest(F.lit(0.0), -F.col(c), F.col(c) - 1), F.lit(0.0))
    base = F.when((p > 0) & (p < 1), -(p * F.log(p) + (1 - p) * F.log(1 - p))).otherwise(0.0)
    worse = F.when(F.col("split") == "train", F.greatest(F.lit(0.0), F.col("log_loss") - base)).otherwise(0.0)
    return m.withColumn("outside", worse + beyond("brier") + beyond("auc"))


@query("s: season i: sf_rows distinct_rows", """select season, least(300, count(*)) as sf_rows, least(300, count(*)) as distinct_rows
  from wp where point_delta_total = 1 group by season""")
def seeded_sample(spark, folder):
    """Capped sample per season: how many training rallies, how many distinct."""
    valid = models.valid_rallies(tables(spark, folder).rally_table)
    s = shape.sample_rows(valid, playbyplay.RALLY_KEY, 300, ["season"])
    return s.groupBy("season").agg(
        F.count(F.lit(1)).alias("sf_rows"), F.count_distinct(*playbyplay.RALLY_KEY[1:]).alias("distinct_rows"))


# --- credit -----------------------------------------------------------------

@query("s: season team_clean i: team_attack_events team_kills team_attack_errors team_blocks opponent_attack_events_faced team_attack_attempts d: team_attack_efficiency team_kill_rate "
       "team_attack_error_rate team_block_rate_faced team_attack_strength_index team_block_strength_index", "select * from ctx")
def team_phase_context(spark, folder):
    return tables(spark, folder).team_phase_context


@query("s: season i: file_row d: event_weight event_weight_share team_wpa base_event_credit context_multiplier event_credit positive_credit negative_credit", "select * from cred")
def touch_credit(spark, folder):
    return tables(spark, folder).event_credit


@query("s: season i: file_row d: event_weight_share event_credit", "select * from cred")
def touch_credit_hot(spark, folder):
    """Touch shares from pre-aggregated rally weights, as used for very long rallies."""
    t = tables(spark, folder)
    return credit.event_credit(t.event_table, t.rally_win_probability, t.team_phase_context, t.cfg, hot=True)


@query("s: season team_clean player_clean i: event_touches event_rallies d: raw_event_credit raw_base_event_credit positive_event_credit negative_event_credit mean_event_credit "
       "avg_context_multiplier avg_opp_block_strength_index avg_opp_attack_strength_index i: " + " ".join(f"event_count_{f}" for f in config.FAMILIES), "select * from pcred")
def player_event_credit(spark, folder):
    return tables(spark, folder).player_event_credit


@query("s: season team_clean i: " + " ".join(config.FAMILIES), "select season, actor_team as team_clean, " + ", ".join(
    f'count_if(event_family = \'{f}\') as "{f}"' for f in config.FAMILIES) + " from clean_pbp where actor_team is not null group by season, actor_team")
def family_pivot(spark, folder):
    e = tables(spark, folder).event_table.filter("actor_team is not null").withColumnRenamed("actor_team", "team_clean_")
    e = e.drop("team_clean").withColumnRenamed("team_clean_", "team_clean")
    return shape.count_pivot(e, ["season", "team_clean"], "event_family", config.FAMILIES)


# --- serving ----------------------------------------------------------------

_SERV = "s: season team_clean player_clean i: serve_rallies serve_points_won serve_aces serve_errors forced_reception_errors d: serve_point_win_rate serve_ace_rate serve_error_rate forced_reception_error_rate server_toughness_raw server_toughness_index"


@query(_SERV, "select * from serv")
def server_toughness(spark, folder):
    """Which servers win the most points, allowing for volume."""
    return tables(spark, folder).servers


@query("s: season team_clean player_clean player conference role_family i: serve_rallies", """select s.*, m.player, m.conference, m.role_family from serv s
  left join master m on m.season = s.season and m.team_clean = s.team_clean and m.player_clean = s.player_clean""")
def server_toughness_display(spark, folder):
    return tables(spark, folder).server_toughness


@query("s: season i: contestid set_no rally_id receive_row s: team_clean player_clean receiving_side b: reception_error first_ball_attack first_ball_kill first_ball_middle_attack receive_point_win "
       "d: server_toughness_index serve_point_win_rate serve_ace_rate serve_error_rate server_serve_rallies receive_score_diff_start total_points_start is_late_set", "select * from att")
def receive_attempts(spark, folder):
    return tables(spark, folder).receive_attempts


@query("s: season team_clean player_clean i: sr_attempts sr_clean_receptions sr_reception_errors sr_first_ball_attacks sr_first_ball_kills sr_first_ball_middle_attacks sr_receive_points_won "
       "d: sr_expected_reception_errors sr_expected_receive_points_won sr_avg_server_toughness sr_avg_server_ace_rate sr_value_total sr_reception_error_rate sr_first_ball_attack_rate sr_first_ball_kill_rate "
       "sr_receive_point_win_rate sr_error_avoided_oe sr_first_ball_attack_oe sr_first_ball_kill_oe sr_first_ball_middle_attack_oe sr_receive_point_win_oe sr_value_per_attempt "
       "sr_shrunk_value_per_attempt sr_shrunk_value", "select * from sr")
def serve_receive_value(spark, folder):
    """Passer value with season means as expectation."""
    return tables(spark, folder).passers


@query("s: season team_clean player_clean i: sr_attempts sr_clean_receptions sr_reception_errors sr_first_ball_attacks sr_first_ball_kills sr_first_ball_middle_attacks sr_receive_points_won "
       "d: sr_avg_server_toughness sr_reception_error_rate sr_first_ball_attack_rate sr_first_ball_kill_rate sr_receive_point_win_rate season_expected b: sound",
       "select *, round(sum(sr_reception_errors) over (partition by season), 3) as season_expected, true as sound from sr")
def serve_receive_value_fitted(spark, folder):
    """Every passer with fitted expectations: with a free intercept the expected errors of a season add up to the errors.

    A passer is sound if every expectation lies between 0 and the attempts, the outcomes over expectation are the difference
    of the two, and the value is a number that shrinks towards 0.
    """
    p = tables(spark, folder, "logistic").passers
    season = p.groupBy("season").agg(F.round(F.sum("sr_expected_reception_errors"), 3).alias("season_expected"))
    over = {"sr_first_ball_attack_oe": "first_ball_attacks", "sr_first_ball_kill_oe": "first_ball_kills",
            "sr_first_ball_middle_attack_oe": "first_ball_middle_attacks", "sr_receive_point_win_oe": "receive_points_won"}
    most = F.col("sr_attempts") + 1e-9
    sound = F.col("sr_expected_reception_errors").between(0, most) & (
        F.abs(F.col("sr_expected_reception_errors") - F.col("sr_reception_errors") - F.col("sr_error_avoided_oe")) < 1e-6)
    for oe, n in over.items():
        expected = F.col(f"sr_expected_{n}")
        sound &= expected.between(0, most) & (F.abs(F.col(f"sr_{n}") - expected - F.col(oe)) < 1e-6)
    total, shrunk = F.col("sr_value_total"), F.col("sr_shrunk_value")
    sound &= ~F.isnan(total) & (F.abs(shrunk) <= F.abs(total) + 1e-9) & (shrunk * total >= 0)
    return p.join(season, "season").withColumn("sound", F.coalesce(sound, F.lit(False)))


_OUTCOMES = "select season, target, cast(y as double) as y from (" + " union all ".join(
    f"select season, '{t}' as target, {t} as y from att" for t in serving.SR_TARGETS) + ") z"


@query("s: season target kind i: train_rows d: positive_rate", f"""select season, target, case when count(*) < 50 or count(distinct y) < 2 then 'mean' else 'logistic' end as kind,
  count(*) as train_rows, avg(y) as positive_rate from ({_OUTCOMES}) o group by season, target""")
def expected_outcome_models(spark, folder):
    t = tables(spark, folder, "logistic")
    return models.fit_outcomes(t.receive_attempts, serving.SR_TARGETS, serving.SR_FEATURES, playbyplay.RALLY_KEY, t.cfg)


@query("s: season target input d: residual", _zero("season, target", f"""select season, target from ({_OUTCOMES}) o
  group by season, target having count(*) >= 50 and count(distinct y) = 2""", serving.SR_FEATURES))
def expected_outcome_optimum(spark, folder):
    """The gradient of the penalised loss of every outcome model, which is 0 at the only optimum."""
    t = tables(spark, folder, "logistic")
    att = t.receive_attempts
    fits = models.fit_outcomes(att, serving.SR_TARGETS, serving.SR_FEATURES, playbyplay.RALLY_KEY, t.cfg.but(aux_max_rows=0))
    x = {c: N.finite_or_zero(F.col(c)) for c in serving.SR_FEATURES}
    rows = att.select("season", *[c.alias(n) for n, c in x.items()], F.explode(F.array(*[
        F.struct(F.lit(g).alias("target"), F.col(g).cast("double").alias("y")) for g in serving.SR_TARGETS])).alias("t")).select(
        "season", "t.*", *x)
    return _residuals(models.optimality(rows, fits.where("kind = 'logistic'"), ["season", "target"], {c: F.col(c) for c in x}, F.col("y")))


@query("s: season target i: rows d: positive_rate mean_expected", f"""select season, target, count(*) as rows, avg(y) as positive_rate,
  round(avg(y), 4) as mean_expected from ({_OUTCOMES}) o group by season, target""")
def expected_outcome_metrics(spark, folder):
    """Rows and rates; with a free intercept the mean expectation of the training rows is the rate."""
    scored = tables(spark, folder, "logistic").receive_scored
    means = scored.groupBy("season").agg(*[F.round(F.avg(f"expected_{t}"), 4).alias(t) for t in serving.SR_TARGETS])
    means = means.unpivot(["season"], serving.SR_TARGETS, "target", "mean_expected")
    return models.expected_outcome_metrics(scored, serving.SR_TARGETS).join(means, ["season", "target"])


_FOLDS = 3


@query("s: season i: fold s: target input i: train_rows d: residual", f"""select season, fold, target, input, train_rows, 0 as residual from (
  select season, fold, target, count(*) as train_rows from (select season, contestid % {_FOLDS} as own, target, y from (
    {" union all ".join(f"select season, contestid, '{t}' as target, cast({t} as double) as y from att" for t in serving.SR_TARGETS)}) a) o
  join (select unnest(range({_FOLDS})) as fold) f on own <> fold group by season, fold, target having count(*) >= 50 and count(distinct y) = 2) g
  cross join (select unnest(['intercept', {", ".join(f"'{c}'" for c in serving.SR_FEATURES)}]) as input) n""")
def expected_outcome_folds(spark, folder):
    """Models that leave out one fold of contests each: the gradient of their loss over the other folds is 0."""
    t = tables(spark, folder, "logistic")
    att = t.receive_attempts
    fits = models.fit_outcomes(att, serving.SR_TARGETS, serving.SR_FEATURES, playbyplay.RALLY_KEY, t.cfg.but(aux_max_rows=0), _FOLDS)
    x = {c: N.finite_or_zero(F.col(c)) for c in serving.SR_FEATURES}
    others = F.filter(F.sequence(F.lit(0), F.lit(_FOLDS - 1)), lambda f: f != models.fold_of(_FOLDS))
    rows = att.select("season", "contestid", *[c.alias(n) for n, c in x.items()], F.explode(F.array(*[
        F.struct(F.lit(g).alias("target"), F.col(g).cast("double").alias("y")) for g in serving.SR_TARGETS])).alias("t"),
    ).select("season", "t.*", *x, F.explode(others).alias("fold"))
    fits = stable(fits.where("kind = 'logistic'"))
    found = models.optimality(rows, fits, ["season", "fold", "target"], {c: F.col(c) for c in x}, F.col("y"))
    return _residuals(found).join(fits.select("season", "fold", "target", "train_rows"), ["season", "fold", "target"])


# --- rankings ---------------------------------------------------------------

_KEY = "s: season team_clean player_clean "


@query(_KEY + "roster_role_family role_family b: role_inferred_from_profile", "select *, role_family <> roster_role_family as role_inferred_from_profile from pv1")
def inferred_roles(spark, folder):
    return tables(spark, folder).player_rankings


@query(_KEY + "d: calc_hit_pct kill_rate_per_attempt attack_error_rate serve_error_rate box_reception_error_rate touches_per_rally", "select * from pv1")
def basic_rates(spark, folder):
    return tables(spark, folder).player_rankings


@query(_KEY + "d: raw_credit_per_rally shrunk_credit_per_rally shrunk_event_value", "select * from pv3")
def shrunk_impact(spark, folder):
    return tables(spark, folder).player_rankings


@query(_KEY + "d: event_blend_weight tabular_blend_weight serve_receive_blend_weight event_value_z tabular_value_z serve_receive_value_z blended_value_z team_strength_value_z final_value_z", "select * from pv7")
def role_blend(spark, folder):
    return tables(spark, folder).player_rankings


@query(_KEY + "role_family i: role_rank overall_rank event_rallies event_touches b: meets_volume_threshold d: score_z overall_score final_value_z tabular_pred_value box_kills fb_kill_rate sr_shrunk_value", "select * from fit_ranked")
def player_rankings(spark, folder):
    """Rankings by the whole method: fitted win probability, outcomes and ridge."""
    return tables(spark, folder, "logistic").player_rankings


@query(_KEY + "role_family roster_role_family i: event_rallies event_touches b: meets_volume_threshold d: box_kills fb_kill_rate outside b: misplaced sound",
       "select *, 0 as outside, false as misplaced, true as sound from ranked")
def player_rankings_fitted(spark, folder):
    """Every player's ranking with fitted win probability, outcomes and ridge: does a rank differ from a plain window's, how far
    lies the score outside 0 to 100, and does the best rank of the season have its best score and no rank lack a player."""
    r = _ranks_marked(tables(spark, folder, "logistic").player_rankings)
    best = r.groupBy("season").agg(F.max("overall_score").alias("top"), F.max("overall_rank").alias("last"),
                                   F.count_distinct("overall_rank").alias("ranks"))
    sound = F.col("overall_score").between(0, 100) & (F.col("last") == F.col("ranks")) & (
        (F.col("overall_rank") > 1) | (F.abs(F.col("overall_score") - F.col("top")) < 1e-9))
    return r.join(best, "season").withColumn("sound", F.coalesce(sound, F.lit(False)))


def _ranks_marked(r):
    """Rankings with whether a rank is not that of a plain window, and how far the score lies outside 0 to 100."""
    by = lambda *keys: F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("final_value_z", 12))))
    wrong = (F.col("overall_rank") != by("season")) | (F.col("role_rank") != by("season", "role_family"))
    return r.withColumns({
        "misplaced": wrong, "outside": F.greatest(F.lit(0.0), -F.col("overall_score"), F.col("overall_score") - 100)})


def _ranks_checked(r):
    return _ranks_marked(r).groupBy("season", "role_family").agg(
        F.count(F.lit(1)).alias("players"), F.count_if("misplaced").alias("misplaced"), F.sum("outside").alias("outside"))


@query("s: season role_family i: players misplaced d: outside", "select season, role_family, count(*) as players, 0 as misplaced, 0 as outside from ranked group by season, role_family")
def player_rankings_default(spark, folder):
    """The same with the default win-probability model, the perceptron."""
    return _ranks_checked(tables(spark, folder, "mlp").player_rankings)


@query("s: season role_family kind i: train_rows d: off_grid", """select season, role_family, case when count_if(event_rallies >= 5) >= 10 then 'ridge_cv' else 'role_mean' end as kind,
  count_if(event_rallies >= 5) as train_rows, 0 as off_grid from ranked group by season, role_family""")
def tabular_models(spark, folder):
    """Kind and training rows of the ridge of every role, and how far its penalty lies from the grid."""
    m = tables(spark, folder, "logistic").tabular_models
    grid = F.array_min(F.transform(F.array(*map(F.lit, models.ALPHAS)), lambda a: F.abs(a - F.col("alpha"))))
    return m.withColumn("off_grid", F.coalesce(grid, F.lit(0.0)))


@query("s: season role_family input d: residual", _zero("season, role_family", """select season, role_family from ranked
  where event_rallies >= 5 group by season, role_family having count(*) >= 10""", rankings.TABULAR_FEATURES))
def tabular_optimum(spark, folder):
    """The normal equations of every role's ridge at its penalty."""
    t = tables(spark, folder, "logistic")
    rows = t.impact_rows.where(F.col("event_rallies") >= t.cfg.tabular_min_rallies)
    inputs = {c: N.finite_or_zero(F.col(c)) for c in rankings.tabular_inputs(rows)}
    return _residuals(models.optimality(rows, t.tabular_models, ["season", "role_family"], inputs, F.col("shrunk_event_value"),
                                        linear=True, penalty=F.col("alpha")))


@query(_KEY + "role_family i: role_rank overall_rank d: overall_score", """select * from (select *, row_number() over (partition by season, role_family
  order by role_rank, overall_rank, player_clean, team_clean) as rn from ranked where meets_volume_threshold) x where rn <= 25""")
def top25_by_role(spark, folder):
    t = tables(spark, folder)
    keys = t.player_rankings
    return rankings.top_by_role(keys)


@query("s: season player team inferred_role_family roster_role_family audit_reason i: overall_rank b: role_mismatch_flag hitter_in_libero_bucket_flag low_efficiency_high_rank_flag low_volume_high_rank_flag "
       "d: attacks_per_rally reception_share_of_touches set_share_of_touches attack_share_of_touches", "select *, inferred_role_family <> roster_role_family as role_mismatch_flag from audited")
def role_audit(spark, folder):
    t = tables(spark, folder)
    return rankings.role_audit(t.player_rankings, t.cfg, shares=True)


# --- match statistics and dashboards ----------------------------------------

def _box(spark, folder):
    return marts.cleaned_player_box(shaped.player_box(spark, folder))


def _tbox(spark, folder):
    return marts.cleaned_team_box(shaped.team_box(spark, folder))


@query("s: player team opponent season i: is_away kills assists aces digs blocks d: kill_efficiency", "select * replace (round(kill_efficiency, 4) as kill_efficiency) from cbox")
def player_stats(spark, folder):
    return marts.player_stats(_box(spark, folder))


@query("s: team season d: avg_kills avg_assists avg_digs avg_blocks avg_efficiency i: matches_played", """select team, season, round(avg(kills), 4) as avg_kills, round(avg(assists), 4) as avg_assists,
  round(avg(digs), 4) as avg_digs, round(avg(blocks), 4) as avg_blocks, round((sum(kills) - sum(errors)) / cast(nullif(sum(total_attacks), 0) as double), 4) as avg_efficiency,
  count(*) as matches_played from cbox group by team, season""")
def team_stats(spark, folder):
    return marts.team_stats(_box(spark, folder))


@query("s: team opponent season result", "select * from ctbox")
def match_stats(spark, folder):
    return marts.match_stats(_tbox(spark, folder))


@query("s: player team opponent season i: kills is_away", "select * from cbox")
def kills_table(spark, folder):
    return marts.kills_table(_box(spark, folder))


@query("d: location pred_kills", """select x as location, slope * x + intercept as pred_kills from
  (select regr_slope(kills, is_away) as slope, regr_intercept(kills, is_away) as intercept from cbox) f, (values (0.0), (1.0)) v(x)""")
def kills_by_location(spark, folder):
    return marts.kills_by_location(_box(spark, folder))


@query("s: location d: avg_kills", "select location, avg(kills) as avg_kills from cbox group by location")
def mean_kills_by_location(spark, folder):
    return marts.mean_kills_by_location(_box(spark, folder))


@query("s: team opponent i: sum_kills", "select team, opponent, sum(kills) as sum_kills from cbox group by team, opponent")
def kills_cross_tab(spark, folder):
    return marts.kills_cross_tab(_box(spark, folder))


@query("s: season i: home away", """select season, sum(case when location = 'Home' then kills end) as home,
  sum(case when location = 'Away' then kills end) as away from cbox group by season""")
def kills_wide_tab(spark, folder):
    d = shape.wide_cross_tab(_box(spark, folder), "season", "location", "kills", ["Home", "Away"])
    return d.withColumnsRenamed({"Home": "home", "Away": "away"})


_SHEET = """select player, pos, team, sum(kills) as sum_kills, sum(assists) as sum_assists, sum(blocks) as sum_blocks, sum(aces) as sum_aces, sum(digs) as sum_digs
  from cbox where season = '2025-2026' and team in ('Team 1', 'Team 2', 'Team 3') and pos in ('OH', 'MB', 'S') group by player, pos, team"""


@query("s: player pos team i: sum_kills sum_assists sum_blocks sum_aces sum_digs", _SHEET)
def player_sheet(spark, folder):
    return marts.player_sheet(_box(spark, folder), ["2025-2026"], ["Team 1", "Team 2", "Team 3"], ["OH", "MB", "S"])


@query("s: player pos team measure d: value", f"select * from (unpivot ({_SHEET}) on sum_kills, sum_assists, sum_blocks, sum_aces, sum_digs into name measure value value) u")
def player_sheet_long(spark, folder):
    return marts.player_sheet_long(marts.player_sheet(
        _box(spark, folder), ["2025-2026"], ["Team 1", "Team 2", "Team 3"], ["OH", "MB", "S"]))


@query("s: team i: sum_assists sum_digs sum_block_solos sum_kills", """select team, sum(assists) as sum_assists, sum(digs) as sum_digs, sum(block_solos) as sum_block_solos,
  sum(kills) as sum_kills from ctbox where team in ('Team 1', 'Team 4', 'Team 7') group by team""")
def team_comparison(spark, folder):
    return marts.team_comparison(_tbox(spark, folder), ["Team 1", "Team 4", "Team 7"])


@query("s: team i: sum_kills sum_block_solos", "select team, sum(kills) as sum_kills, sum(block_solos) as sum_block_solos from ctbox group by team order by 2 desc, 1 limit 10")
def top_teams_by_blocks(spark, folder):
    return marts.top_teams(_tbox(spark, folder), "block_solos", "kills")


@query("s: team i: sum_kills", "select team, sum(kills) as sum_kills from ctbox group by team order by 2 desc, 1 limit 10")
def top_teams_by_kills(spark, folder):
    return marts.top_teams(_tbox(spark, folder), "kills", "kills")


@query("s: season player team role_family conference i: overall_rank role_rank", """select * from fit_ranked where role_family in ('outside', 'opposite', 'setter') and conference in ('Conf 0', 'Conf 2')
  and event_rallies >= 15 and meets_volume_threshold and (contains(lower(player), 'p3') or contains(lower(team), 'p3') or contains(lower(conference), 'conf 0'))""")
def filtered_rankings(spark, folder):
    return marts.filter_rankings(
        marts.typed_outputs(tables(spark, folder, "logistic").player_rankings), ["outside", "opposite", "setter"],
        ["Conf 0", "Conf 2"], min_rallies=15, only_threshold=True, search="Conf 0 ",
    )


@query("s: season player team role_family i: overall_rank", """select * from fit_audited where role_family in ('outside', 'libero_ds') and team = 'Team 2' and event_rallies >= 5
  and (contains(lower(player), 'top-100') or contains(lower(team), 'top-100') or contains(audit_reason, 'top-100'))""")
def filtered_audit(spark, folder):
    t = tables(spark, folder, "logistic")
    return marts.filter_audit(marts.typed_outputs(t.ranking_role_audit), ["outside", "libero_ds"], team="Team 2",
                              min_rallies=5, search="TOP-100")


@query("s: season player team audit_reason", "select * from fit_audited where audit_reason <> ''")
def flagged_players(spark, folder):
    return marts.flagged(tables(spark, folder, "logistic").ranking_role_audit)


@query("s: season role_family i: players", "select season, role_family, count(*) as players from ranked group by season, role_family")
def role_counts(spark, folder):
    return marts.role_counts(tables(spark, folder).player_rankings)


@query("s: season i: players_ranked volume_qualified s: top_player top_team", """select season, count(*) as players_ranked, count_if(meets_volume_threshold) as volume_qualified,
  arg_min(player, (overall_rank, player, team)) as top_player, arg_min(team, (overall_rank, player, team)) as top_team from ranked group by season""")
def headline_numbers(spark, folder):
    return marts.headline_numbers(tables(spark, folder).player_rankings)


@query("s: season player team i: overall_rank event_rallies", "select season, player, team, overall_rank, event_rallies from ranked order by overall_rank, season, player, team limit 12")
def best_overall(spark, folder):
    return marts.best_overall(
        tables(spark, folder).player_rankings, 12, ["overall_rank", "season", "player", "team", "event_rallies"])


@query("s: field value", """select 'role_family' as field, role_family as value from ranked union select 'conference', conference from ranked union select 'team', team from ranked""")
def filter_values(spark, folder):
    return marts.filter_values(tables(spark, folder).player_rankings)


@query("i: max_rallies default_rallies", "select max(event_rallies) as max_rallies, case when max(event_rallies) >= 200 then 200 else 0 end as default_rallies from ranked")
def volume_bound(spark, folder):
    return marts.rally_bound(tables(spark, folder).player_rankings)


_UNP = "event_value_z, tabular_value_z, serve_receive_value_z, final_value_z, event_blend_weight, tabular_blend_weight, serve_receive_blend_weight"


@query(_KEY + "component d: value", f"select * from (unpivot (select season, team_clean, player_clean, {', '.join(f'cast({c} as double) as {c}' for c in _UNP.split(', '))} from ranked) on {_UNP} into name component value value) u")
def player_components(spark, folder):
    return marts.player_components(tables(spark, folder).player_rankings)


@query(_KEY + "component d: value", "select * from (unpivot (select season, team_clean, player_clean, " + ", ".join(f"cast({c} as double) as {c}" for c in marts.STAT_LINE) + f" from ranked) on {', '.join(marts.STAT_LINE)} into name component value value) u")
def player_stat_line(spark, folder):
    return marts.player_components(tables(spark, folder).player_rankings, marts.STAT_LINE)


@query("s: season label", "select season, '#' || overall_rank || ' | ' || player || ' | ' || team as label from fit_ranked")
def player_labels(spark, folder):
    return marts.player_options(tables(spark, folder, "logistic").player_rankings)


# --- sets, seasons, sources, sinks ------------------------------------------

def _seasons_of(df):
    return [r.season for r in seasons.available(df).collect()]


def _season_files(out, df, kind, change=lambda d, n: d):
    """Write one CSV file a season, each as ``change`` makes it of its rows and its number."""
    for n, s in enumerate(_seasons_of(df)):
        rows = change(seasons.pick(df, [s]).drop("season"), n)
        sinks.save_csv(rows, out, config.SOURCE_FILES[kind].format(year=seasons.Season.parse(s).start))


def _season_kinds(spark, folder):
    frames = [
        (shaped.roster(spark, folder), "players"), (shaped.player_box(spark, folder), "player_match"),
        (shaped.team_box(spark, folder), "team_match"),
        (shaped.pbp(spark, folder), "pbp"),
    ]
    return shape.union_all([
        d.select(F.substring("season", 1, 4).alias("year"), F.lit(k).alias("kind")).distinct() for d, k in frames])


@query("s: season", """select distinct season from roster where season in (select season from player_box) and season in (select season from team_box)
  and season in (select season from pbp)""")
def complete_seasons(spark, folder):
    """Seasons for which all four sources have rows."""
    return seasons.complete_seasons(_season_kinds(spark, folder))


@query("s: season", "select distinct season from player_box")
def available_seasons(spark, folder):
    return seasons.available(shaped.player_box(spark, folder), newest_first=True)


@query("s: season i: contestid", "select season, contestid from team_box where season in ('2023-2024', '2024-2025')")
def season_range_rows(spark, folder):
    wanted = seasons.wanted(span=("2023-2024", "2024-2025"))
    return seasons.pick(shaped.team_box(spark, folder), wanted)


@query("s: season team i: matches", "select season, team, count(*) as matches from team_box group by season, team")
def combined_seasons(spark, folder):
    """One summary per season, then all of them as one table."""
    box = shaped.team_box(spark, folder)
    parts = [
        seasons.pick(box, [s]).groupBy("season", "team").agg(F.count(F.lit(1)).alias("matches"))
        for s in _seasons_of(box)
    ]
    return sinks.combine_seasons(parts)


@query("i: doc_id s: source lang", "select * from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) as rn from documents) x where rn <= 5")
def top_per_group(spark, folder):
    return shape.top_per_group(_table(spark, folder, "documents"), ["source", "lang"],
                               [F.col("n_chars").desc(), F.col("doc_id")], 5)


@query("i: o_custkey o_orderkey d: o_totalprice", "select * from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) x where rn = 1")
def keep_first_rows(spark, folder):
    return ordered.keep_first(_table(spark, folder, "orders"), ["o_custkey"], "o_orderkey")


@query("i: o_orderkey rank", "select o_orderkey, dense_rank() over (partition by o_orderpriority order by o_custkey desc) as rank from orders")
def dense_ranks(spark, folder):
    return ordered.dense_rank(_table(spark, folder, "orders"), ["o_orderpriority"], "o_custkey", "rank")


@query("i: event_id total", "select event_id, sum(cast(round(value * 100) as bigint)) over (partition by event_type order by event_id rows between unbounded preceding and current row) as total from events")
def running_totals_hot_keys(spark, folder):
    """Running total over five very large keys, in chunks of event ids."""
    e = _table(spark, folder, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return ordered.running_sum(e, ["event_type"], "event_id", {"total": F.col("cents")}, chunk=1000)


@query("i: event_id last_purchase", """select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls)
  over (partition by user_id order by event_id rows between unbounded preceding and current row) as last_purchase from events""")
def filled_forward(spark, folder):
    e = _table(spark, folder, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return ordered.forward_fill(e, ["user_id"], "event_id", {"last_purchase": "p"}, ordered.pick_chunk(e, ["user_id"]))


@query("i: event_id d: share", "select event_id, value / sum(value) over (partition by user_id) as share from events")
def share_of_total(spark, folder):
    e = ordered.attach(_table(spark, folder, "events"), ["user_id"], {"total": F.sum("value")}, hot=True)
    return e.select("event_id", N.safe_rate(F.col("value"), F.col("total")).alias("share"))


@query("i: o_orderkey d: price_z", """select o_orderkey, (o_totalprice - avg(o_totalprice) over (partition by o_orderpriority)) / stddev_samp(o_totalprice) over (partition by o_orderpriority) as price_z from orders""")
def price_zscores(spark, folder):
    return stats.zscores(_table(spark, folder, "orders"), ["o_orderpriority"], {"price_z": "o_totalprice"})


@query("s: season team_clean player_clean role_family player_uid", "select * from master")
def csv_source_bundle(spark, folder):
    """Season CSV files written, found again by name, and read as rosters.

    Pseudo-player lines are added on the way out and must be gone on the way in.
    """
    out = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    r = shaped.roster(spark, folder)
    pseudo = r.withColumn("player", F.when(F.col("number") == 0, "TEAM").when(F.col("number") == 1, " Totals ")
                          .when(F.col("number") == 2, "Opponent Totals").otherwise("opponent"))
    both = r.unionByName(pseudo)
    _season_files(out, both, "players")
    for kind, df in (("player_match", shaped.player_box(spark, folder)), ("team_match", shaped.team_box(spark, folder))):
        _season_files(out, seasons.pick(df, _seasons_of(both)), kind)
    found = [x.season for x in seasons.discover_local(spark, out).collect()]
    return roster.player_master(readers.read_box_tables(spark, out, seasons.wanted(found=found))["players"])


@query("s: kind season team name detail i: n", """select kind, season, team, name, detail, count(*) as n from (
  select 'players' as kind, season, team, player as name, pos as detail from roster
  union all select 'player_match', season, team, player, detail from (select distinct season, team, player, location || ' ' || kills || ' ' || digs as detail from player_box)
  union all select 'team_match', season, team, opponent, result from team_box
  union all select 'pbp', season, home_team, coalesce(nullif(event, ''), 'none'), 'said "well, ' || chr(10) || event || '" and left' from pbp) x
  group by kind, season, team, name, detail""")
def csv_mixed_headers(spark, folder):
    """Season files whose headers differ in order and number, with line breaks inside quotes."""
    out = f"{run_folder(spark)}/{uuid.uuid4().hex}"

    def change(d, n):
        named = d.select(*sorted(d.columns, reverse=n % 2 == 1))
        return named.withColumn(f"only_here_{n}", F.lit(n)) if n % 3 == 0 else named

    box, team, log = shaped.player_box(spark, folder), shaped.team_box(spark, folder), shaped.pbp(spark, folder)
    said = F.concat(F.lit('said "well, \n'), F.col("event"), F.lit('" and left'))
    every = sorted({*_seasons_of(box), *_seasons_of(team)})
    people = shaped.roster(spark, folder)
    # the roster has one season; the others get an empty file with a header
    for n, s in enumerate(every):
        rows = change(seasons.pick(people, [s]).drop("season"), n).coalesce(1)
        sinks.save_csv(rows, out, config.SOURCE_FILES["players"].format(year=seasons.Season.parse(s).start))
    _season_files(out, box.select("season", "team", "player", "location", "kills", "digs"), "player_match", change)
    _season_files(out, team, "team_match", change)
    log = log.withColumn("description", said).withColumnRenamed("set_no", "set").drop("file_row", "ts")
    _season_files(out, log, "pbp", change)
    read = readers.read_box_tables(spark, out, every)
    stats = read["player_match"]
    parts = [
        read["players"].select(F.lit("players").alias("kind"), "season", "team", F.col("player").alias("name"), F.col("pos").alias("detail")),
        stats.select(F.lit("player_match"), "season", "team", "player", F.concat_ws(" ", "location", "kills", "digs")),
        read["team_match"].select(F.lit("team_match"), "season", "team", "opponent", "result"),
        readers.read_pbp(spark, out, _seasons_of(log)).select(
            F.lit("pbp"), "season", "home_team", F.coalesce("event", F.lit("none")), "description"),
    ]
    return shape.union_all([p.toDF("kind", "season", "team", "name", "detail") for p in parts]).groupBy(
        "kind", "season", "team", "name", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("s: season i: contestid set_no n s: event", """select season, contestid, set_no, nullif(event, '') as event,
  row_number() over (partition by season order by file_row) as n from pbp""")
def csv_log_in_file_order(spark, folder):
    """Log written to season CSV files in order and read back: every row with its number in the file."""
    out = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    p = shaped.pbp(spark, folder)
    _season_files(out, p, "pbp", lambda d, n: d.orderBy("file_row").withColumnRenamed("set_no", "set").drop("file_row"))
    back = readers.read_pbp(spark, out, _seasons_of(p))
    back = ordered.row_numbers(back, ["season"], [F.col("file_row")], "n")
    return back.select("season", N.number(F.col("contestid"), "bigint").alias("contestid"),
                       N.number(F.col("set_no"), "int").alias("set_no"), "event", "n")


@query("s: season player team i: overall_rank event_rallies b: meets_volume_threshold", "select * from ranked where event_rallies >= 20")
def saved_and_downloaded(spark, folder):
    """Rankings saved by season, read back pruned, filtered, exported as CSV and loaded again."""
    out = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    ranked = tables(spark, folder).player_rankings
    sinks.save_table(ranked, out, "player_rankings")
    back = readers.table_or_build(spark, out, "player_rankings", lambda: ranked)
    chosen = marts.ranking_download(marts.filter_rankings(back, min_rallies=20).select(
        "season", *config.RANKING_TABLE_COLUMNS)).withColumn("season_", F.lit(None))
    export = marts.filter_rankings(back, min_rallies=20).select("season", *chosen.drop("season_").columns)
    sinks.save_csv(export, out, "filtered_rankings")
    return marts.typed_outputs(readers.read_csv(spark, f"{out}/filtered_rankings"))


_TURN = "(select season, dense_rank() over (order by season) as turn from (select distinct season from roster) s)"


@query("s: season status b: rewritten s: team_clean player_clean role_family player_uid", f"""select season, case turn when 1 then 'stale' when 2 then 'fresh' else 'absent' end as status,
  turn <> 2 as rewritten, team_clean, player_clean, role_family, player_uid from master join {_TURN} using (season)""")
def refreshed_seasons(spark, folder):
    """Season files published, then one file changed and other seasons added: what is built again, and what stands.

    The first season first has half of its roster, and the second stays as it is.
    """
    source, target = (f"{run_folder(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    every = {"players": stable(shaped.roster(spark, folder)), "player_match": stable(shaped.player_box(spark, folder)),
             "team_match": stable(shaped.team_box(spark, folder)), "pbp": stable(shaped.pbp(spark, folder).limit(0))}
    names = _seasons_of(every["players"])

    def files(kinds, chosen, change=lambda d: d):
        for kind in kinds:
            for s in chosen:
                sinks.save_csv(change(seasons.pick(every[kind], [s]).drop("season")), source,
                               config.SOURCE_FILES[kind].format(year=seasons.Season.parse(s).start))

    store = SeasonStore(spark, source, target, _TEST, fixed_curve, ["player_master", "team_strength"])
    files(every, names[:2])
    files(["players"], names[:1], lambda d: d.where("number % 2 = 0"))
    store.refresh()
    first = store.table("player_master").select("season", F.col("_metadata.file_modification_time").alias("t"))
    first = stable(first.groupBy("season").agg(F.max("t").alias("then")))
    files(["players"], names[:1])
    files(every, names[2:])
    status = spark.createDataFrame(list(store.refresh().items()), "season string, status string")
    now = store.table("player_master")
    now = now.withColumn("t", F.col("_metadata.file_modification_time"))
    return now.join(first, "season", "left").join(status, "season").withColumn(
        "rewritten", F.col("then").isNull() | (F.col("t") > F.col("then")))


@query("s: l_returnflag d: price", "select l_returnflag, median(l_extendedprice) as price from lineitem group by l_returnflag")
def medians_of_hot_keys(spark, folder):
    """Exact medians of three keys that share all line items, by sketch and narrowing."""
    return stats.medians(_table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", "price")


@query("s: season i: contests players d: beyond", """select season, count(distinct contestid) as contests, count(distinct player_clean) as players, 0 as beyond
  from clean_pbp where player_clean <> '' group by season""")
def season_player_counts(spark, folder):
    """Distinct players of a season, exactly and from sketches stored for each contest; how far these lie beyond 3 %."""
    out = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    log = tables(spark, folder).clean_pbp.where("player_clean <> ''")
    sinks.save_table(stats.distinct_sketches(log, ["season", "contestid"], "player_clean"), out, "players_of_contests")
    merged = stats.merged_distinct(readers.read_table(spark, out, "players_of_contests"), ["season"], "estimate")
    exact = log.groupBy("season").agg(F.count_distinct("contestid").alias("contests"), F.count_distinct("player_clean").alias("players"))
    return exact.join(merged, "season").withColumn(
        "beyond", F.greatest(F.lit(0.0), F.abs(F.col("estimate") / F.col("players") - 1) - 0.03))


# --- single-set rates -------------------------------------------------------

_G = "season, contestid, set_no"


@query("s: season i: contestid set_no s: team player", f"select distinct {_G}, team, player from playing")
def game_rosters(spark, folder):
    return replacement.game_roster(shaped.pbp(spark, folder))


_EV = {replacement.slug(e): e for e in config.GAME_EVENTS}
_CH = f"""select o.*, {', '.join(f't.opp_{s}' for s in _EV)}, r.n as roster_size, {', '.join(f't.opp_{s} / cast(r.n as double) as share_{s}' for s in _EV)}
  from (select {_G}, team, player, {', '.join(f"count_if(event = '{e}') as n_{s}" for s, e in _EV.items())} from playing group by {_G}, team, player) o
  join (select {_G}, team, {', '.join(f"count_if(event = '{e}') as opp_{s}" for s, e in _EV.items())} from playing group by {_G}, team) t using (season, contestid, set_no, team)
  join (select {_G}, team, count(distinct player) as n from playing group by {_G}, team) r using (season, contestid, set_no, team)"""


@query("s: season i: contestid set_no s: team player i: roster_size " + " ".join(f"n_{s} opp_{s}" for s in _EV) + " d: " + " ".join(f"share_{s}" for s in _EV), _CH)
def player_opportunities(spark, folder):
    return replacement.opportunities(shaped.pbp(spark, folder))


_EPI = f"""select {_G}, home_team, away_team, episode, arg_min(team, file_row) filter (where event = 'Serve') as serve_team,
  {', '.join(f"count_if(event = '{e}' and team = {s}_team) as {s}_{replacement.slug(e)}" for e in ('Set', 'Attack', 'Reception') for s in ('home', 'away'))}
  from (select *, max(episode) over (partition by {_G}) as last_episode from (select *, sum(case when event = 'Serve' then 1 else 0 end) over
    (partition by {_G} order by file_row rows between unbounded preceding and current row) as episode from playing) a) b
  where episode > 0 and episode < last_episode group by {_G}, home_team, away_team, episode"""


@query("s: season i: contestid set_no episode s: serve_team i: home_set away_set home_attack away_attack home_reception away_reception", _EPI)
def serve_episodes(spark, folder):
    p = shaped.pbp(spark, folder)
    return replacement.serve_episodes(p, ordered.pick_chunk(p, replacement.GAME))


_PTS = "count_if(event in ('Kill', 'First ball kill', 'Ace', 'Block')) as team_points"
R.add("tt", f"""select {_G}, team, case when team = home_team then away_team else home_team end as opponent, count_if(event = 'Serve') as team_serves,
  count_if(event = 'Reception') as team_returns, count_if(event = 'Dig') as team_digs, count_if(event = 'Set') as team_sets,
  count_if(event = 'Attack') as team_attacks, {_PTS} from playing group by {_G}, team, home_team, away_team""")
_TR = f"""select x.*, coalesce(attacks_from_opp_serve / nullif(cast(opp_serves as double), 0), 0) as attacks_per_opp_serve,
  coalesce(attacks_from_opp_return / nullif(cast(opp_returns as double), 0), 0) as attacks_per_opp_return,
  coalesce(sets_from_serve / nullif(cast(team_serves as double), 0), 0) as sets_per_serve,
  coalesce(team_points / nullif(cast(team_points + opp_points as double), 0), 0) as point_pct
from (select t.*, coalesce(o.team_serves, 0) as opp_serves, coalesce(o.team_returns, 0) as opp_returns, coalesce(o.team_points, 0) as opp_points,
    coalesce((select sum(case when e.home_team = t.team then e.home_set else e.away_set end) from ({_EPI}) e where e.season = t.season and e.contestid = t.contestid and e.set_no = t.set_no and e.serve_team = t.team), 0) as sets_from_serve,
    coalesce((select sum(case when e.home_team = t.team then e.home_attack else e.away_attack end) from ({_EPI}) e where e.season = t.season and e.contestid = t.contestid and e.set_no = t.set_no and e.serve_team <> t.team), 0) as attacks_from_opp_serve,
    coalesce((select sum(case when e.home_team = t.team then e.home_attack else e.away_attack end) from ({_EPI}) e where e.season = t.season and e.contestid = t.contestid and e.set_no = t.set_no and e.serve_team = t.team
      and (case when e.home_team = t.team then e.away_reception else e.home_reception end) > 0), 0) as attacks_from_opp_return
  from tt t left join tt o on o.season = t.season and o.contestid = t.contestid and o.set_no = t.set_no and o.team = t.opponent) x"""


R.add("tr", _TR)


@query("s: season i: contestid set_no s: team opponent i: team_serves team_returns team_digs team_sets team_attacks team_points sets_from_serve attacks_from_opp_serve attacks_from_opp_return "
       "d: attacks_per_opp_serve attacks_per_opp_return sets_per_serve point_pct", _TR)
def team_set_rates(spark, folder):
    return replacement.team_rates(shaped.pbp(spark, folder))


_PR = f"""select c.*, 1 - coalesce(n_service_error / nullif(cast(n_serve as double), 0), 0) as serve_pct, coalesce(n_service_error / nullif(cast(n_serve as double), 0), 0) as serve_error_pct,
  coalesce(n_ace / nullif(cast(n_serve as double), 0), 0) as ace_pct, coalesce(n_reception / nullif(cast(opp_reception as double), 0), 0) as return_pct,
  coalesce(n_dig / nullif(cast(opp_dig as double), 0), 0) as dig_pct, coalesce(n_set / nullif(cast(opp_set as double), 0), 0) as set_pct,
  coalesce(n_attack / nullif(cast(opp_attack as double), 0), 0) as attack_pct,
  coalesce((n_kill + n_first_ball_kill) / nullif(cast(opp_kill + opp_first_ball_kill as double), 0), 0) as kill_pct,
  n_serve as serves, n_ace as aces, n_set as sets, n_kill + n_first_ball_kill as kills from ({_CH}) c"""


R.add("pr", _PR)


@query("s: season i: contestid set_no s: team player d: serve_pct serve_error_pct ace_pct return_pct dig_pct set_pct attack_pct kill_pct i: serves aces sets kills", _PR)
def player_set_rates(spark, folder):
    return replacement.player_rates(replacement.opportunities(shaped.pbp(spark, folder)))


# the pairwise definition, one row per player and substitute
_PAIRS = f"""select a.season, a.contestid, a.set_no, a.team, a.player, count(*) + 1 as players, avg(
    a.serves * g * b.ace_pct - a.aces
    + (r.team_sets + (r.team_digs * b.set_pct - a.sets) + r.sets_per_serve * (a.serves * g - a.serves * g * b.ace_pct - a.serves + a.aces)) * b.kill_pct - a.kills) as replacement_value
  from (select a.*, b.player as sub, b.team as sub_team, r.team_sets, r.team_digs, r.sets_per_serve,
      case when 1 - b.serve_pct * r.point_pct > 1e-12 then 1 / (1 - b.serve_pct * r.point_pct) else 0 end as g
    from pr a join pr b on a.season = b.season and a.contestid = b.contestid and a.set_no = b.set_no and (a.player <> b.player or a.team <> b.team)
    join tr r on r.season = a.season and r.contestid = a.contestid and r.set_no = a.set_no and r.team = a.team) p
  join pr a on a.season = p.season and a.contestid = p.contestid and a.set_no = p.set_no and a.player = p.player and a.team = p.team
  join pr b on b.season = p.season and b.contestid = p.contestid and b.set_no = p.set_no and b.player = p.sub and b.team = p.sub_team
  join tr r on r.season = p.season and r.contestid = p.contestid and r.set_no = p.set_no and r.team = p.team
  group by a.season, a.contestid, a.set_no, a.team, a.player"""


@query("s: season i: contestid set_no s: team player i: players d: replacement_value", _PAIRS)
def replacement_values(spark, folder):
    return replacement.replacement_values(shaped.pbp(spark, folder))


@query("s: season team player i: games rank d: score", f"""select *, row_number() over (partition by season order by round(score, 12), team, player) as rank from (
  select season, team, player, count(*) as games, avg(replacement_value) as score from ({_PAIRS}) v group by season, team, player) x""")
def replacement_ranking(spark, folder):
    return replacement.rank_players(replacement.replacement_values(shaped.pbp(spark, folder)))
