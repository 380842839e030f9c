"""From the wide feed to the relational model.

Each function builds one table; :func:`normalize` chains them for all countries or one.
Raw column names are those of ``schemas.RAW``, outputs follow ``schemas.NORMALIZED``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.seasons import season_label
from touchline.operators.filters import may_be_known
from touchline.operators.joins import FEW_SALTS, keep_known, quoted, salted_join
from touchline.operators.keys import contiguous_ids, label_ids
from touchline.operators.xml_events import classified_events, readable, unreadable, xml_events
from touchline.schemas import SLOTS, UNUSED_MATCH_COLUMNS, slot_columns
from touchline.session import stage
from touchline.sources.stored import kept_ids

#: Members of a squad that are looked up in a map; a lookup reads the map from its beginning.
SQUAD_IN_MAP = 512


def countries(raw: DataFrame, name: str | None = None) -> DataFrame:
    return raw if name is None else raw.where(F.col("name") == name)


def leagues(raw: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """League name with its country's id, which takes the place of the league's own."""
    named = raw.selectExpr("name", "country_id AS id")
    if selected is None:
        return named
    return salted_join(named, selected.select("id"), ["id"], "left_semi").select("name", "id")


def league_matches(raw: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Matches of the selected countries (league and country ids coincide), unused columns gone."""
    kept = raw.drop(*UNUSED_MATCH_COLUMNS)
    if selected is None:
        return kept
    ids = selected.selectExpr("id AS league_id")
    return salted_join(
        kept, ids, ["league_id"], "left_semi", spread_by=["match_api_id"]
    ).select(*kept.columns)


def fixtures(matches: DataFrame) -> DataFrame:
    return matches.selectExpr(
        "match_api_id AS match_id",
        "home_team_api_id AS home_team_id",
        "away_team_api_id AS away_team_id",
    ).distinct()


def home_teams(raw: DataFrame, fixture_rows: DataFrame) -> DataFrame:
    """Teams seen at home at least once; a team that only travels is left out."""
    teams = raw.selectExpr(
        "team_api_id AS team_id", "team_long_name AS long_name", "team_short_name AS short_name"
    ).distinct()
    return keep_known(teams, fixture_rows, "team_id", "home_team_id")


def wide_lineups(matches: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Player ids per match and slot, as in the feed."""
    return matches.selectExpr(
        "match_api_id AS match_id",
        *slot_columns("home_player", slots),
        *slot_columns("away_player", slots),
    ).distinct()


def _slot_rows(matches: DataFrame, slots: int, empty_row: bool) -> DataFrame:
    entries = [
        f"'{side}', {slot}, {side}_team_api_id, {side}_player_{slot}"
        for side in ("home", "away")
        for slot in range(1, slots + 1)
    ]
    if empty_row:
        # Without a player it joins nothing; the match id in the team's place spreads these rows.
        entries.append("NULL, NULL, match_api_id, NULL")
    return matches.selectExpr(
        "match_api_id AS match_id",
        "season",
        f"stack({len(entries)}, {', '.join(entries)}) AS (side, slot, team_id, player_id)",
    ).where("player_id IS NOT NULL OR side IS NULL")


def lineup_slots(matches: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Filled slots as rows: ``match_id, season, side, slot, team_id, player_id``.

    Reads the feed row once instead of joining lineups, fixtures and matches back together.
    """
    return _slot_rows(matches, slots, empty_row=False)


def squad_membership(matches: DataFrame, teams: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Distinct ``team_id, player_id, season`` of known teams."""
    seen = lineup_slots(matches, slots).select("team_id", "player_id", "season").distinct()
    known = teams.select("team_id").distinct()
    return salted_join(seen, known, ["team_id"], spread_by=["player_id", "season"]).select(
        "team_id", "player_id", "season"
    )


def squad_ids(membership: DataFrame, ordered: bool = True) -> DataFrame:
    """``member_id`` per membership, in (team, player, season) order; none without a season."""
    order = ["season IS NULL", "team_id", "player_id", "season"] if ordered else None
    return contiguous_ids(membership, order, "member_id").selectExpr(
        "if(season IS NULL, NULL, member_id) AS member_id", "team_id", "player_id", "season"
    )


def _squad_maps(members: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each squad (``keys``): its size ``n`` and, up to ``most`` members, a map player -> member.

    Squads are counted before any is gathered, so that no task holds a larger one.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n"))
    fitting = sizes.where(F.col("n") <= most)
    kept = salted_join(members, fitting.select(*keys), keys, spread_by=["player_id"], salts=FEW_SALTS)
    entries = F.collect_list(F.struct("player_id", "member_id"))
    maps = kept.groupBy(*keys).agg(F.map_from_entries(entries).alias("members"))
    return sizes.join(maps, keys, "left")


def _looked_up(known: DataFrame, slots: int) -> DataFrame:
    """Member ids by the maps that each side's squad brought along."""
    return known.select(
        F.col("match_api_id").alias("match_id"),
        *[
            F.expr(
                f"{side}_members[{side}_player_{slot}] AS {side}_member_{slot}"
            )
            for side in ("home", "away")
            for slot in range(1, slots + 1)
        ],
    )


def _one_row_each(lineups: DataFrame, slots: int) -> DataFrame:
    """A match that the feed repeats has one lineup."""
    columns = slot_columns("home_member", slots) + slot_columns("away_member", slots)
    return lineups.groupBy("match_id").agg(*[F.max(c).alias(c) for c in columns])


def _joined_by_slot(
    known: DataFrame, members: DataFrame, keys: list[str], slots: int
) -> DataFrame:
    """Member ids by a join of each filled slot, for squads of any size."""
    rows = _slot_rows(known, slots, empty_row=True)
    found = salted_join(
        rows,
        members.select(*keys, "member_id"),
        keys,
        "left",
        spread_by=["match_id"],
        salts=FEW_SALTS,
    )
    return found.groupBy("match_id").agg(
        *[
            F.expr(
                f"max(member_id) FILTER (WHERE side = '{side}' AND slot = {slot})"
                f" AS {side}_member_{slot}"
            )
            for side in ("home", "away")
            for slot in range(1, slots + 1)
        ]
    )


def kept_squad_ids(membership: DataFrame, folder: str, feed: str) -> DataFrame:
    """:func:`squad_ids` that later feeds keep: a membership an earlier feed brought has its old
    id, new ones follow in (team, player, season) order. Memberships without a season have none."""
    named = kept_ids(membership.where("season IS NOT NULL"), folder, feed, "member_id")
    nameless = membership.where("season IS NULL").selectExpr(
        "CAST(NULL AS BIGINT) AS member_id", "team_id", "player_id", "season"
    )
    return named.unionByName(nameless)


def lineup_members(
    matches: DataFrame,
    teams: DataFrame,
    squad: DataFrame,
    member_of: str = "season_exact",
    slots: int = SLOTS,
    in_map: int = SQUAD_IN_MAP,
) -> DataFrame:
    """Lineups with squad-member ids in place of player ids, for matches of two known teams.

    ``member_of="season_exact"`` takes the membership of the match's season; ``"any"`` takes the
    smallest member id of the player in that team.

    A squad of up to ``in_map`` members is folded into one map that joins the match's row once per
    side, and the slots are looked up in the row, which is never multiplied. Matches of a larger
    squad are joined slot by slot.
    """
    keys = ["team_id", "player_id", "season"]
    members = squad.where("player_id IS NOT NULL")
    if member_of == "any":
        keys = ["team_id", "player_id"]
        members = members.groupBy(*keys).agg(F.min("member_id").alias("member_id"))
    elif member_of != "season_exact":
        raise ValueError(f"unknown member rule: {member_of}")
    else:
        members = members.where("season IS NOT NULL")
    players = slot_columns("home_player", slots) + slot_columns("away_player", slots)
    known = matches.select(
        "match_api_id", "season", "home_team_api_id", "away_team_api_id", *players
    )
    for side in ("home", "away"):
        ids = teams.selectExpr(f"team_id AS {side}_team_api_id").distinct()
        known = salted_join(
            known, ids, [f"{side}_team_api_id"], spread_by=["match_api_id"], short=True
        )
    own = [key for key in keys if key != "player_id"]
    maps = stage(_squad_maps(members, own, in_map), "squads")
    for side in ("home", "away"):
        names = {"team_id": f"{side}_team_api_id", "n": f"{side}_n", "members": f"{side}_members"}
        known = salted_join(
            known,
            maps.withColumnsRenamed(names),
            [names.get(key, key) for key in own],
            "left",
            spread_by=["match_api_id"],
            salts=FEW_SALTS,
        )
    small = " AND ".join(f"coalesce({side}_n, 0) <= {in_map}" for side in ("home", "away"))
    largest = maps.agg(F.max("n")).first()[0] or 0
    if largest <= in_map:
        return _one_row_each(_looked_up(known, slots), slots)
    parted = stage(known.withColumn("_small", F.expr(small)), "known")
    mapped = _one_row_each(_looked_up(parted.where("_small"), slots), slots)
    return mapped.union(_joined_by_slot(parted.where("NOT _small"), members, keys, slots))


def squad_members(squad: DataFrame) -> DataFrame:
    return squad.select("member_id", "team_id", "player_id")


def squad_seasons(squad: DataFrame, seasons: DataFrame) -> DataFrame:
    return with_season_id(squad.select("member_id", "season"), seasons)


def squad_players(raw: DataFrame, squad: DataFrame) -> DataFrame:
    """Distinct players that belong to any squad; further feed columns pass through."""
    players = raw.withColumnRenamed("player_api_id", "player_id")
    return keep_known(players, squad, "player_id", "player_id", distinct=True)


def dated_attributes(raw: DataFrame, players: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct measurements of known players, numbered by player and date, with season label.

    Most measurements of unknown players go before the first shuffle.
    """
    ids = stage(players.select("player_id").distinct(), "known")
    rows = may_be_known(raw.withColumnRenamed("player_api_id", "player_id"), ids, "player_id")
    known = keep_known(rows, ids, "player_id", "player_id", distinct=True)
    rest = quoted([c for c in known.columns if c not in ("player_id", "date")])
    labelled = known.selectExpr("player_id", f"{season_label('date')} AS season", "date", *rest)
    order = ["player_id", "date", *rest] if ordered else None
    numbered = contiguous_ids(labelled, order, "attribute_id")
    return numbered.drop("date", "player_fifa_api_id")


def season_dimension(attributes: DataFrame) -> DataFrame:
    """Season labels that occur among the measurements, numbered in label order.

    Labels hold two digits of a year, so there are at most a hundred.
    """
    return label_ids(attributes.select("season").distinct(), "season", "season_id")


def with_season_id(df: DataFrame, seasons: DataFrame) -> DataFrame:
    """Add ``season_id`` by label; NULL when no measurement made that season known.

    The label stays, so rows of unknown seasons can still be matched with each other.
    """
    place = df.columns.index("season") + 1
    return df.join(seasons.select("season", "season_id"), "season", "left").select(
        *df.columns[:place], "season_id", *df.columns[place:]
    )


def match_table(matches: DataFrame, seasons: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Score, season and goal document per match; further feed columns pass through."""
    moved = ["home_team_api_id", "away_team_api_id", "date"]
    moved += slot_columns("home_player", slots) + slot_columns("away_player", slots)
    renamed = matches.drop(*moved).withColumnsRenamed(
        {
            "match_api_id": "match_id",
            "home_team_goal": "home_goals",
            "away_team_goal": "away_goals",
            "goal": "goal_xml",
        }
    )
    return with_season_id(renamed, seasons)


_OF_MATCH = ["match_id", "season"]


def read_goals(matches: DataFrame, strict: bool = False) -> DataFrame:
    """Events and rejects of the goal documents, out of one parse; see ``classified_events``."""
    documents = matches.selectExpr("match_api_id AS match_id", "season", "goal")
    return classified_events(documents, "goal", _OF_MATCH, strict)


def goal_events(matches: DataFrame, strict: bool = False) -> DataFrame:
    """Every goal in the documents: ``match_id, season, goal_id, minute, player_id, team_id``."""
    documents = matches.selectExpr("match_api_id AS match_id", "season", "goal")
    return xml_events(documents, "goal", _OF_MATCH, strict)


def resolve_goals(events: DataFrame, squad: DataFrame) -> DataFrame:
    """Goals by a member of the scoring team's squad in the match's season.

    Seasons are compared by label. Goals without a scorer, or whose scorer was not in that
    squad, drop out.
    """
    keys = ["team_id", "player_id", "season"]
    members = squad.where("member_id IS NOT NULL").select(*keys, "member_id")
    return events.join(members, keys).select("goal_id", "minute", "match_id", "member_id")


def normalize(
    feed: Mapping[str, DataFrame],
    country: str | None = None,
    member_of: str = "season_exact",
    strict_goals: bool = False,
    slots: int = SLOTS,
    ordered_ids: bool = True,
    squad_dictionary: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All normalized tables of the feed, for every country or for the named one.

    ``ordered_ids=False`` saves two range shuffles, at the price of ids that a later run may
    give to other rows. ``squad_dictionary`` names a folder and this feed: squad members that
    earlier feeds of the folder brought keep their ids.
    """
    nations = countries(feed["countries"], country)
    selected = None if country is None else nations
    matches = league_matches(feed["matches"], selected)
    if selected is not None:
        matches = stage(matches, "matches")  # seven tables are made of it
    fixture_rows = fixtures(matches)
    teams = stage(home_teams(feed["teams"], fixture_rows), "teams")
    membership = squad_membership(matches, teams, slots)
    if squad_dictionary is None:
        squad = squad_ids(membership, ordered_ids)
    else:
        squad = kept_squad_ids(stage(membership, "membership"), *squad_dictionary)
    players = stage(squad_players(feed["players"], squad), "players")
    attributes = dated_attributes(feed["player_attributes"], players, ordered_ids)
    seasons = stage(season_dimension(attributes), "seasons")
    read = stage(read_goals(matches, strict_goals), "goals_read")
    return {
        "countries": nations,
        "leagues": leagues(feed["leagues"], selected),
        "matches": match_table(matches, seasons, slots),
        "fixtures": fixture_rows,
        "teams": teams,
        "lineups": lineup_members(matches, teams, squad, member_of, slots),
        "squad_members": squad_members(squad),
        "squad_seasons": squad_seasons(squad, seasons),
        "players": players,
        "player_attributes": with_season_id(attributes, seasons),
        "seasons": seasons,
        "goals": resolve_goals(readable(read, _OF_MATCH), squad),
        "goal_rejects": unreadable(read, ["match_id"]),
    }
