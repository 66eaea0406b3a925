"""The whole chain as one set of lazily built tables, for any number of seasons."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.config import DEFAULT, ModelConfig
from courtlens.functions.text import clean_team
from courtlens.operators import joins, ordered
from courtlens.plans import credit, firstball, models, playbyplay, rallies, rankings, roster, serving
from courtlens.session import laid_out, stable
from courtlens.sources import sinks


class SeasonTables:
    """Published tables from the four sources.

    Dimensions that many plans read are written once. With ``materialize`` the event and
    rally tables are too, since most later tables fan out from them; without it every
    table is one lazy plan down to the sources.
    """

    def __init__(
        self, players: DataFrame, player_match: DataFrame, team_match: DataFrame, pbp: DataFrame,
        cfg: ModelConfig = DEFAULT, wp_model: str | Callable[[DataFrame], DataFrame] = "mlp", materialize: bool = True,
    ):
        self.players, self.player_box, self.team_box, self.pbp = players, player_match, team_match, pbp
        self.cfg, self.wp_model = cfg, wp_model
        self._written = materialize
        self._keep = stable if materialize else (lambda df: df)

    def _by_contest(self, df: DataFrame, spread: bool = False) -> DataFrame:
        """A written table that keeps its contests together, so that what reads it shuffles no touch or rally again.

        Where one contest may hold most rows, and without written tables, there is no such layout.
        """
        if not self._written or self.hot:
            return self._keep(df)
        return laid_out(df, playbyplay.CONTEST_KEY, ["set_no"], spread, self.parts)

    @cached_property
    def player_master(self) -> DataFrame:
        return stable(roster.player_master(self.players))

    @cached_property
    def teams(self) -> DataFrame:
        return stable(roster.known_teams(self.player_master, self.team_box))

    @cached_property
    def player_match(self) -> DataFrame:
        return roster.prepare_player_match(self.player_box, self.player_master, self.teams)

    @cached_property
    def team_match(self) -> DataFrame:
        return roster.prepare_team_match(self.team_box, self.teams)

    @cached_property
    def team_strength(self) -> DataFrame:
        named = self.team_box.withColumn("team_clean", clean_team(F.col("team")))
        return self._keep(roster.team_strength(named, self.player_master))

    @cached_property
    def outline(self) -> DataFrame:
        return stable(playbyplay.outline(self.pbp))

    @cached_property
    def chunk(self) -> int | None:
        """Row limit per task inside a contest, None when no contest is large."""
        return ordered.HOT_ROWS if playbyplay.largest_contest(self.outline) > ordered.HOT_ROWS else None

    @cached_property
    def parts(self) -> int:
        """Partitions of the log and of the tables laid out like it, so that a task's share does not grow with the log."""
        rows = self.outline.agg(F.sum("rows")).first()[0] or 0
        return joins.parts_of(rows, self.pbp.sparkSession)

    @property
    def hot(self) -> bool:
        return self.chunk is not None

    @cached_property
    def clean_pbp(self) -> DataFrame:
        return self._by_contest(playbyplay.clean_pbp(
            self.pbp, self.player_master, self.teams, chunk=self.chunk, outlined=self.outline, parts=self.parts
        ), spread=True)

    @cached_property
    def event_table(self) -> DataFrame:
        return rallies.event_table(self.clean_pbp)

    @cached_property
    def rally_table(self) -> DataFrame:
        return self._by_contest(rallies.rally_table(self.clean_pbp, self.hot))

    @cached_property
    def contest_master(self) -> DataFrame:
        return rallies.contest_master(self.rally_table)

    @cached_property
    def rally_pass(self) -> DataFrame:
        return self._by_contest(
            firstball.rally_pass(self.event_table, self.rally_table, self.hot)
        )

    @cached_property
    def first_ball_contest(self) -> DataFrame:
        return firstball.per_player_contest(self.rally_pass)

    @cached_property
    def first_ball_season(self) -> DataFrame:
        return firstball.per_player_season(self.first_ball_contest)

    @cached_property
    def player_match_enriched(self) -> DataFrame:
        return roster.player_match_enriched(
            self.player_match, self.team_strength, self.first_ball_contest
        )

    @cached_property
    def player_season_features(self) -> DataFrame:
        return self._keep(roster.player_season_features(
            self.player_master, self.player_match_enriched, self.first_ball_season
        ))

    @cached_property
    def rally_win_probability(self) -> DataFrame:
        return self._by_contest(models.win_probability(self.rally_table, self.wp_model, self.cfg), spread=True)

    @cached_property
    def win_probability_metrics(self) -> DataFrame:
        return models.win_probability_metrics(self.rally_win_probability, self.rally_table, self.cfg)

    @cached_property
    def team_phase_context(self) -> DataFrame:
        return self._keep(credit.team_phase_context(self.event_table, self.cfg))

    @cached_property
    def event_credit(self) -> DataFrame:
        return credit.event_credit(
            self.event_table, self.rally_win_probability, self.team_phase_context, self.cfg, self.hot
        )

    @cached_property
    def player_event_credit(self) -> DataFrame:
        return credit.player_event_credit(self.event_credit)

    @cached_property
    def servers(self) -> DataFrame:
        return self._keep(serving.server_toughness(self.rally_table, self.cfg))

    @cached_property
    def server_toughness(self) -> DataFrame:
        return serving.with_player_display(self.servers, self.player_season_features)

    @cached_property
    def receive_attempts(self) -> DataFrame:
        return self._keep(serving.receive_attempts(
            self.event_table, self.rally_table, self.rally_pass, self.servers
        ))

    @cached_property
    def receive_scored(self) -> DataFrame:
        return serving.with_expectations(self.receive_attempts, self.cfg)

    @cached_property
    def passers(self) -> DataFrame:
        return serving.passer_values(self.receive_scored, self.cfg)

    @cached_property
    def serve_receive_player_value(self) -> DataFrame:
        return serving.with_player_display(self.passers, self.player_season_features)

    @cached_property
    def impact_rows(self) -> DataFrame:
        return rankings.impact_rows(
            self.player_season_features, self.player_event_credit, self.passers, self.cfg
        )

    @cached_property
    def _ranked(self) -> tuple[DataFrame, DataFrame]:
        return rankings.rankings(self.impact_rows, self.cfg)

    @property
    def player_rankings(self) -> DataFrame:
        return self._ranked[0]

    @property
    def tabular_models(self) -> DataFrame:
        return self._ranked[1]

    @cached_property
    def ranking_role_audit(self) -> DataFrame:
        return rankings.role_audit(self.player_rankings, self.cfg)

    @cached_property
    def top25_rankings_by_role(self) -> DataFrame:
        return rankings.top_by_role(self.player_rankings)

    PREPROCESSED = {
        "player_master": "player_master", "team_strength": "team_strength",
        "contest_master": "contest_master", "rally_table": "rally_table",
        "rally_pass": "rally_pass",
        "first_ball_pass_player_contest": "first_ball_contest_display",
        "first_ball_pass_player_season": "first_ball_season_display",
        "player_match_enriched": "player_match_enriched",
        "player_season_features": "player_season_features", "event_table": "event_table",
    }
    OUTPUTS = {name: name for name in (
        "rally_win_probability", "win_probability_metrics", "player_event_credit",
        "team_phase_context", "server_toughness", "serve_receive_player_value",
        "player_rankings", "ranking_role_audit", "top25_rankings_by_role",
    )}

    @property
    def first_ball_contest_display(self) -> DataFrame:
        return firstball.with_display(self.first_ball_contest, self.player_master)

    @property
    def first_ball_season_display(self) -> DataFrame:
        return firstball.with_display(self.first_ball_season, self.player_master)

    def publish(self, folder: str, tables: dict[str, str] | None = None) -> dict[str, int]:
        """Write tables partitioned by season; returns the rows written to each."""
        tables = tables or {**self.PREPROCESSED, **self.OUTPUTS}
        return {
            name: sinks.save_table(getattr(self, attr), folder, name)
            for name, attr in tables.items()
        }
