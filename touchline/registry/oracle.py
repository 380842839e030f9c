"""SQL for each registered query, written from the questions and not from the jobs.

The feed is spelled out here once more with its own constants, so that a wrong one can't agree
with itself. Questions about teams are scalar subqueries per team, best-ofs are ranks, memberships
are EXISTS, and sums over pairs are counted pairs.
"""

from __future__ import annotations

from touchline.schemas import METRICS

_SLOTS = [(side, i) for side in ("home", "away") for i in range(1, 12)]
_LABELS = ["2008/2009", "2009/2010", "2010/2011", "2011/2012"]
_METRICS = ", ".join(METRICS)


def _metric(position: int, name: str) -> str:
    return {
        "overall_rating": "CAST(l_quantity AS INTEGER)",
        "potential": "l_linenumber",
        "crossing": "CAST(round(100 * l_discount) AS INTEGER)",
        "marking": "CAST(round(100 * l_tax) AS INTEGER)",
    }.get(name, f"CAST((l_suppkey + {position} * l_linenumber) % 100 AS INTEGER)")


def _event(side: str, slot: int) -> str:
    code, minute = (slot, 10 * slot) if side == "home" else (20 + slot, 10 * slot + 5)
    player = f"{side}_player_{slot}"
    return f"""CASE WHEN {player} IS NOT NULL THEN concat('<value><id>', 100 * match_id + {code},
        '</id><elapsed>{minute}</elapsed>',
        CASE WHEN {player} % 9 <> 4 THEN concat('<player1>', {player}, '</player1>') END,
        CASE WHEN {player} % 11 <> 7 THEN concat('<team>', {side}, '</team>') END,
        '</value>', chr(10), '<!-- "next" -->') END"""


_WIDE = ", ".join(
    f"max(player) FILTER (slot = {i} AND at_home = {side == 'home'}) AS {side}_player_{i}"
    for side, i in _SLOTS
)
_PLAYERS = ", ".join(f"{side}_player_{i}" for side, i in _SLOTS)

_FEED = f"""
WITH line AS (
    SELECT *, (year(l_shipdate) + 12) % 100 AS yy,
        strftime(l_shipdate + INTERVAL 12 YEAR, '%Y-%m-%d') AS day,
        {", ".join(f"{_metric(i, m)} AS {m}" for i, m in enumerate(METRICS))}
    FROM lineitem),
season AS (
    SELECT yy, CAST(rank() OVER (ORDER BY yy) AS INTEGER) AS season_id,
        format('20{{:02d}}/20{{:02d}}', yy, yy + 1) AS label
    FROM (SELECT yy FROM line GROUP BY yy)),
rated AS (SELECT * FROM line JOIN season USING (yy) WHERE season_id IN (2, 3, 4, 5)),
club AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation),
every_game AS (
    SELECT o_orderkey AS match_id, (year(o_orderdate) + 13) % 100 AS yy, o_orderdate,
        o_orderpriority, CAST(c_nationkey AS BIGINT) AS home,
        CAST((SELECT s_nationkey FROM supplier WHERE s_suppkey = lowest) AS BIGINT) AS away,
        hg, ag
    FROM (SELECT l_orderkey, min(l_suppkey) AS lowest,
              CAST(sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) AS INTEGER) AS hg,
              CAST(sum(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) AS INTEGER) AS ag
          FROM line GROUP BY l_orderkey), orders, customer
    WHERE o_orderkey = l_orderkey AND c_custkey = o_custkey),
labelled AS (
    SELECT g.*, format('20{{:02d}}/20{{:02d}}', yy, yy + 1) AS label, season_id
    FROM every_game g LEFT JOIN season USING (yy)),
game AS (
    SELECT *, CASE sign(hg - ag) WHEN 1 THEN home WHEN -1 THEN away END AS winner,
        CASE sign(hg - ag) WHEN 1 THEN away WHEN -1 THEN home END AS loser
    FROM labelled WHERE season_id IN (2, 3, 4, 5)),
seat AS (
    SELECT match_id, label, g.yy, season_id, l_partkey AS player, l_returnflag = 'A' AS at_home,
        CASE l_returnflag WHEN 'A' THEN home ELSE away END AS team,
        row_number() OVER (PARTITION BY l_orderkey, l_returnflag
            ORDER BY l_linenumber, l_partkey) AS slot
    FROM line l JOIN labelled g ON match_id = l_orderkey WHERE l_returnflag IN ('A', 'R')),
sheet AS (
    SELECT g.*, {_PLAYERS}
    FROM labelled g LEFT JOIN (SELECT match_id, {_WIDE} FROM seat GROUP BY match_id)
    USING (match_id)),
told AS (
    SELECT *, '<goal>' || nullif(concat({", ".join(_event(*s) for s in _SLOTS)}), '') || '</goal>'
        AS goal
    FROM sheet),
member AS (SELECT team, player, label, yy, season_id FROM seat GROUP BY ALL),
squad AS (
    SELECT count(*) OVER (ORDER BY team, player, label) AS member_id, * FROM member),
event AS (
    SELECT match_id, label, team, player, season_id, slot, at_home,
        100 * match_id + slot + CASE WHEN at_home THEN 0 ELSE 20 END AS goal_id,
        CAST(10 * slot + CASE WHEN at_home THEN 0 ELSE 5 END AS INTEGER) AS minute
    FROM seat),
tally AS (
    SELECT id AS team_id, name,
        (SELECT sum(hg) FROM game WHERE home = id) AS at_home,
        (SELECT sum(ag) FROM game WHERE away = id) AS on_the_road,
        (SELECT sum(ag) FROM game WHERE away = id AND home <> id) AS as_guest,
        (SELECT sum(ag) FROM game WHERE home = id) AS let_in_at_home,
        (SELECT sum(hg) FROM game WHERE away = id AND home <> id) AS let_in_as_guest,
        (SELECT count(*) FROM game WHERE id IN (home, away)) AS games
    FROM club),
goals AS (
    SELECT team_id, name, games,
        CAST(coalesce(at_home, 0) + coalesce(as_guest, 0) AS BIGINT) AS scored,
        CAST(coalesce(let_in_at_home, 0) + coalesce(let_in_as_guest, 0) AS BIGINT) AS let_in
    FROM tally WHERE games > 0),
year_tally AS (
    SELECT id AS team_id, season_id, name, label,
        (SELECT sum(hg) FROM game g WHERE home = id AND g.season_id = s.season_id) AS at_home,
        (SELECT sum(ag) FROM game g WHERE away = id AND g.season_id = s.season_id) AS on_the_road,
        (SELECT count(*) FROM game g WHERE id IN (home, away) AND g.season_id = s.season_id)
            AS games,
        (SELECT sum(CASE id WHEN home THEN hg ELSE ag END) FROM game g
         WHERE id IN (home, away) AND g.season_id = s.season_id) AS scored,
        (SELECT sum(CASE id WHEN home THEN ag ELSE hg END) FROM game g
         WHERE id IN (home, away) AND g.season_id = s.season_id) AS let_in
    FROM club, season s WHERE season_id IN (2, 3, 4, 5)),
chart AS (
    SELECT team_id, season_id, CAST(scored AS BIGINT) AS goals_for,
        CAST(let_in AS BIGINT) AS goals_against, CAST(scored AS DOUBLE) / games AS avg_goals,
        name AS team_name, label AS season
    FROM year_tally WHERE games > 0),
sides AS (
    SELECT team_id, season_id, CAST(at_home AS BIGINT) AS home_goals,
        CAST(on_the_road AS BIGINT) AS away_goals,
        CAST(at_home - on_the_road AS BIGINT) AS home_minus_away, name AS team_name,
        label AS season
    FROM year_tally WHERE games > 0),
best_team AS (
    SELECT CAST(sum(coalesce(at_home, 0) + coalesce(on_the_road, 0)) AS BIGINT) AS goals, name
    FROM tally WHERE games > 0 GROUP BY name ORDER BY 1 DESC, 2 LIMIT 1),
victories AS (
    SELECT p_partkey AS player_id, p_name AS player_name, count(*) AS wins
    FROM part, game g
    WHERE EXISTS (SELECT 1 FROM member m WHERE m.player = p_partkey AND m.team = g.winner
                  AND m.yy = g.yy)
    GROUP BY ALL),
clubs AS (
    SELECT p_partkey AS player_id, p_name AS player_name,
        (SELECT count(*) FROM club WHERE EXISTS (
            SELECT 1 FROM member WHERE team = id AND player = p_partkey)) AS n_teams
    FROM part),
whole_season AS (
    SELECT season_id, {", ".join(f"sum({m}) AS {m}" for m in METRICS)}
    FROM rated GROUP BY season_id),
headcount AS (
    SELECT name AS long_name, season_id, count(*) AS n
    FROM member JOIN club ON id = team WHERE season_id IN (2, 3, 4, 5) GROUP BY ALL),
multiplied AS (
    SELECT long_name, season_id, {", ".join(f"CAST(n * {m} AS DOUBLE) AS {m}" for m in METRICS)}
    FROM headcount JOIN whole_season USING (season_id)),
own AS (
    SELECT name AS long_name, m.season_id,
        {", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in METRICS)}
    FROM member m JOIN club ON id = m.team JOIN rated r ON r.l_partkey = m.player AND r.yy = m.yy
    GROUP BY ALL)
"""


def _most(count: str, seasons: str) -> str:
    """Names whose count in a season is the best count of any single id that played in it."""
    return f"""
        SELECT n, name, label FROM (
            SELECT season_id, label, name, CAST(sum({count}) AS BIGINT) AS n
            FROM club, season s WHERE {seasons} GROUP BY ALL) totals
        JOIN (
            SELECT season_id, n, rank() OVER (PARTITION BY season_id ORDER BY n DESC) AS place
            FROM (SELECT DISTINCT season_id, {count} AS n
                  FROM season s, (SELECT home AS id FROM game UNION SELECT away FROM game)
                  WHERE {seasons}))
        USING (season_id, n) WHERE place = 1 AND n > 0"""


_LOSSES = """(SELECT count(*) FROM game g WHERE loser = id AND g.season_id = s.season_id)"""
_DRAWS = """(SELECT count(*) FILTER (home = id) + count(*) FILTER (away = id)
    FROM game g WHERE hg = ag AND g.season_id = s.season_id)"""
_DATE = "strftime(o_orderdate + INTERVAL 13 YEAR, '%Y-%m-%d')"
_REGION = "(SELECT CAST(n_regionkey AS BIGINT) FROM nation WHERE n_nationkey = home)"
_ASIAN = """home IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
    WHERE r_name = 'ASIA')"""


def _members(same_season: str) -> str:
    return ", ".join(
        f"(SELECT min(member_id) FROM squad q WHERE q.team = {side}"
        f" AND q.player = {side}_player_{i}{same_season}) AS {side}_member_{i}"
        for side, i in _SLOTS
    )


def _pivot(table: str, value: str) -> str:
    cells = ", ".join(
        f"(SELECT {value} FROM {table} c WHERE c.team_name = t.team_name AND season = '{label}')"
        f' AS "{label}"'
        for label in _LABELS
    )
    return f"SELECT team_name, {cells} FROM (SELECT DISTINCT team_name FROM {table}) t"


def _leaders(totals: str) -> str:
    summed = ", ".join(f"sum({m}) AS {m}" for m in METRICS)
    return f"""
        SELECT metric, count(*) FILTER (leads) AS n_rows, bool_or(leads) AS is_leader
        FROM (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY total DESC) = 1
                  AND long_name = (SELECT name FROM best_team) AS leads
              FROM (UNPIVOT (SELECT long_name, {summed} FROM {totals} GROUP BY long_name)
                    ON {_METRICS} INTO NAME metric VALUE total))
        GROUP BY metric"""


_SQL = {
    "csv_scan_roundtrip": "SELECT match_id AS match_api_id, label AS season, goal FROM told",
    "chart_roundtrip": """
        SELECT team_id, season_id, CAST(goals_for AS DOUBLE) AS goals_for,
            CAST(goals_against AS DOUBLE) AS goals_against, avg_goals, team_name, season
        FROM chart""",
    "country_leagues": """
        SELECT c_name AS name, CAST(n_regionkey AS BIGINT) AS id FROM customer, nation
        WHERE n_nationkey = c_nationkey
            AND EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name = 'ASIA')""",
    "league_matches": f"""
        SELECT match_id AS match_api_id, {_REGION} AS league_id, label AS season, {_DATE} AS date,
            home AS home_team_api_id, away AS away_team_api_id, hg AS home_team_goal,
            ag AS away_team_goal, {_PLAYERS}, goal
        FROM told WHERE {_ASIAN}""",
    "fixtures_distinct": """
        SELECT match_id, home AS home_team_id, away AS away_team_id FROM every_game""",
    "home_teams": f"""
        SELECT id AS team_id, name AS long_name, concat('N', id) AS short_name FROM club
        WHERE EXISTS (SELECT 1 FROM every_game WHERE home = id AND {_ASIAN})""",
    "wide_lineups": f"SELECT match_id, {_PLAYERS} FROM sheet",
    "squad_members": """
        SELECT team AS team_id, player AS player_id, label AS season FROM member""",
    "squad_ids": """
        SELECT member_id, team AS team_id, player AS player_id, label AS season FROM squad""",
    "lineup_ids_season_exact": f"""
        SELECT match_id, {_members(" AND q.label = sheet.label")} FROM sheet""",
    "lineup_ids_any": f"SELECT match_id, {_members('')} FROM sheet",
    "squad_seasons": "SELECT member_id, label AS season, season_id FROM squad",
    "players_in_squads": """
        SELECT p_partkey AS player_id, p_name AS player_name FROM part
        WHERE p_partkey IN (SELECT player FROM seat)""",
    "attributes_seasoned": f"""
        SELECT DISTINCT
            dense_rank() OVER (ORDER BY l_partkey, day, l_suppkey, {_METRICS}) AS attribute_id,
            l_partkey AS player_id, label AS season, season_id, {_METRICS}
        FROM line JOIN season USING (yy) WHERE l_partkey IN (SELECT player FROM seat)""",
    "season_dimension": "SELECT season_id, label AS season FROM season",
    "squad_ids_second_feed": """
        SELECT row_number() OVER (ORDER BY label > '2009/2010', team, player, label) AS member_id,
            team AS team_id, player AS player_id, label AS season
        FROM member""",
    "stored_matches_second_feed": """
        SELECT match_id, season_id, CASE WHEN hg = ag THEN hg + 1 ELSE hg END AS home_goals,
            ag AS away_goals
        FROM labelled""",
    "season_codes": "SELECT match_id, label AS season, season_id FROM labelled",
    "update_from_join": """
        SELECT c_custkey, coalesce(
            (SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), c_mktsegment)
            AS label
        FROM customer""",
    "goal_events": """
        SELECT match_id, label AS season, goal_id, minute,
            CASE WHEN player % 9 <> 4 THEN player END AS player_id,
            CASE WHEN player % 11 <> 7 THEN team END AS team_id
        FROM event""",
    "goal_rejects": """
        SELECT match_id, 'malformed document' AS reason
        FROM told WHERE month(o_orderdate) = 2 AND goal IS NOT NULL
        UNION ALL
        SELECT e.match_id, CASE month(o_orderdate) WHEN 5 THEN 'missing id or minute'
            ELSE 'non-numeric field' END
        FROM event e JOIN every_game g ON g.match_id = e.match_id
        WHERE month(o_orderdate) IN (5, 8)""",
    "goals_resolved": """
        SELECT goal_id, minute, match_id,
            (SELECT member_id FROM squad q
             WHERE q.team = e.team AND q.player = e.player AND q.label = e.label) AS member_id
        FROM event e WHERE player % 9 <> 4 AND player % 11 <> 7""",
    "season_matches": """
        SELECT match_id, season_id, hg AS home_goals, ag AS away_goals, home AS home_team_id,
            away AS away_team_id
        FROM game""",
    "most_wins": """
        SELECT CAST(sum((SELECT count(*) FROM game WHERE winner = id)) AS BIGINT) AS wins,
            name AS long_name
        FROM club GROUP BY name ORDER BY 1 DESC, 2 LIMIT 1""",
    "most_losses_by_season": f"""
        SELECT n AS losses, name AS long_name, label AS season
        FROM ({_most(_LOSSES, "yy IN (8, 9, 10, 11)")})""",
    "set_union_distinct": """
        SELECT season_id, id AS team_id FROM season s, club
        WHERE EXISTS (SELECT 1 FROM game g WHERE g.season_id = s.season_id AND id IN (home, away))""",
    "most_draws_last_season": f"""
        SELECT n AS draws, name AS long_name FROM ({_most(_DRAWS, "yy = 11")})""",
    "team_goals": """
        SELECT team_id, name AS long_name, scored AS goals_for, let_in AS goals_against
        FROM goals""",
    "most_goals_for": """
        SELECT name AS long_name, scored AS goals_for FROM (
            SELECT *, row_number() OVER (ORDER BY scored DESC, team_id) AS place FROM goals)
        WHERE place = 1""",
    "best_goal_difference": """
        SELECT name AS long_name, scored - let_in AS goal_difference FROM (
            SELECT *, row_number() OVER (ORDER BY scored - let_in DESC, team_id) AS place
            FROM goals)
        WHERE place = 1""",
    "squad_size": """
        SELECT team_id, long_name, n_players FROM (
            SELECT id AS team_id, name AS long_name,
                (SELECT count(*) FROM (SELECT DISTINCT team, player FROM member)
                 WHERE team = id AND player IN (SELECT l_partkey FROM rated)) AS n_players
            FROM club WHERE EXISTS (SELECT 1 FROM game WHERE id IN (home, away)))
        WHERE n_players > 0""",
    "top_scorer": """
        SELECT count(*) AS goals, p_name AS player_name
        FROM event JOIN part ON p_partkey = player
        WHERE player % 9 <> 4 AND player % 11 <> 7 AND season_id IN (2, 3, 4, 5)
        GROUP BY player, p_name ORDER BY 1 DESC, player LIMIT 1""",
    "player_team_wins": "SELECT * FROM victories",
    "most_team_wins": """
        SELECT player_id, player_name, wins FROM (
            SELECT *, rank() OVER (ORDER BY wins DESC) AS place FROM victories)
        WHERE place = 1""",
    "clubs_in_period": """
        SELECT p_partkey AS player_id, p_name AS player_name,
            (SELECT count(DISTINCT team) FROM member
             WHERE player = p_partkey AND season_id IN (3, 4)) AS n_teams
        FROM part WHERE p_partkey IN (SELECT player FROM member WHERE season_id IN (3, 4))""",
    "sql_goals": """
        SELECT team_id, name AS long_name, scored AS goals_for, let_in AS goals_against,
            scored - let_in AS difference
        FROM goals""",
    "clubs_per_player": "SELECT * FROM clubs WHERE n_teams > 0",
    "most_clubs": """
        SELECT player_id, player_name, n_teams FROM (
            SELECT *, rank() OVER (ORDER BY n_teams DESC) AS place FROM clubs)
        WHERE place = 1""",
    "stable_entities": """
        SELECT o_orderkey AS player_id, o_orderpriority AS player_name FROM orders
        WHERE (SELECT count(*) > 1 AND min(overall_rating) = max(overall_rating)
               FROM rated WHERE l_orderkey = o_orderkey)""",
    "top_scoring_team_union": "SELECT goals, name AS long_name FROM best_team",
    "squad_metric_totals": "SELECT * FROM multiplied",
    "squad_metric_totals_keyed": "SELECT * FROM own",
    "squad_metric_grand_totals": f"""
        SELECT long_name, {", ".join(f"sum({m}) AS {m}" for m in METRICS)}
        FROM multiplied GROUP BY long_name""",
    "leader_by_metric": _leaders("multiplied"),
    "leader_by_metric_keyed": _leaders("own"),
    "team_season_goals": "SELECT * FROM chart",
    "pivot_goals_for": _pivot("chart", "CAST(goals_for AS DOUBLE)"),
    "pivot_goals_against": _pivot("chart", "CAST(goals_against AS DOUBLE)"),
    "pivot_avg_goals": _pivot("chart", "avg_goals"),
    "team_series": """
        SELECT *, 1.1::DOUBLE * (
            SELECT max(g) FROM (SELECT goals_for AS g FROM chart WHERE team_id = 7
                                UNION ALL SELECT goals_against FROM chart WHERE team_id = 7))
            AS axis_max
        FROM chart WHERE team_id = 7""",
    "home_away_goals": "SELECT * FROM sides",
    "pivot_home": _pivot("sides", "home_goals"),
    "pivot_away": _pivot("sides", "away_goals"),
    "pivot_home_away_diff": _pivot("sides", "home_minus_away"),
    "rating_vs_goals": """
        SELECT team_id, name AS long_name, CAST(ratings * games AS DOUBLE) AS total_rating,
            CAST(pairs * scored AS DOUBLE) AS total_goals,
            CAST(pairs * scored AS DOUBLE) / 100 AS bubble_size
        FROM goals JOIN (
            SELECT team AS team_id, count(*) AS pairs, sum(overall_rating) AS ratings
            FROM member m JOIN rated ON l_partkey = player GROUP BY team) USING (team_id)""",
    "rating_vs_goals_unmultiplied": """
        SELECT team_id, name AS long_name, (
            SELECT CAST(sum(overall_rating) AS BIGINT) FROM rated
            WHERE EXISTS (SELECT 1 FROM member WHERE team = team_id AND player = l_partkey))
            AS total_rating, scored AS total_goals
        FROM goals
        WHERE EXISTS (SELECT 1 FROM member JOIN rated ON l_partkey = player WHERE team = team_id)""",
    "duplicate_keys": """
        SELECT l_orderkey, l_linenumber, n_rows FROM (
            SELECT l_orderkey, l_linenumber,
                count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_rows FROM lineitem)
        WHERE n_rows > 1 GROUP BY ALL""",
}



def all_sql() -> dict[str, str]:
    return {name: f"{_FEED}\n{sql}" for name, sql in _SQL.items()}
