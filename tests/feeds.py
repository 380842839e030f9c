"""A hand-made feed small enough to follow by eye."""

from __future__ import annotations

from touchline.schemas import METRICS, RAW

GOALS = (
    "<goal><value><id>1</id><elapsed>5</elapsed><player1>101</player1><team>1</team></value>\n"
    '<!-- "quoted" --><value><id>2</id><elapsed>9</elapsed><player1>999</player1><team>1</team></value>'
    "<value><id>3</id><elapsed>70</elapsed><team>2</team></value>"
    "<value><id>4</id><elapsed>80</elapsed><player1>201</player1><team>2</team></value></goal>"
)


def match(match_id, season, home, away, score, home_players=(), away_players=(), **other):
    row = {name: None for name in RAW["matches"].names}
    row |= {
        "match_api_id": match_id,
        "league_id": 10,
        "country_id": 10,
        "season": season,
        "stage": 1,
        "date": "2008-08-30",
        "home_team_api_id": home,
        "away_team_api_id": away,
        "home_team_goal": score[0],
        "away_team_goal": score[1],
        "shoton": "x",
    }
    row |= {f"home_player_{i}": p for i, p in enumerate(home_players, 1)}
    row |= {f"away_player_{i}": p for i, p in enumerate(away_players, 1)}
    return {**row, **other}


def attribute(player, date, base, fifa=0):
    values = {m: base + i for i, m in enumerate(METRICS)}
    return {"player_api_id": player, "player_fifa_api_id": fifa, "date": date, **values}


MATCHES = [
    match(1, "2008/2009", 1, 2, (2, 1), [101, 102], [201, None, 202], goal=GOALS),
    match(2, "2009/2010", 2, 1, (0, 0), [201], [101], goal="<goal/>"),
    # Team 3 only travels.
    match(3, "2008/2009", 1, 3, (1, 4), [101], [301]),
    # No measurement knows this season.
    match(
        4,
        "2015/2016",
        2,
        1,
        (3, 0),
        [201],
        [102],
        goal="<goal><value><id>9</id><elapsed>1</elapsed><player1>201</player1><team>2</team></value></goal>",
    ),
    match(5, None, 1, 2, (1, 1), [103], [201]),
    match(6, "2010/2011", 2, 1, (None, None)),
    match(7, "2008/2009", 50, 51, (1, 0), [501], [502], league_id=20, country_id=20),
]

ATTRIBUTES = [
    attribute(101, "2008-02-01", 50),
    attribute(101, "2008-02-01", 50),  # a copy
    attribute(101, "2008-11-01", 60),
    attribute(101, "2009-02-22", 61),
    attribute(201, "2007-05-05", 40),
    attribute(201, "2010-01-01", 41, fifa=7),
    attribute(502, "2011-01-01", 30),
    attribute(777, "2001-01-01", 99),  # in no squad
]

TABLES = {
    "countries": [{"id": 10, "name": "Spain"}, {"id": 20, "name": "Italy"}],
    "leagues": [
        {"id": 11, "country_id": 10, "name": "Liga"},
        {"id": 21, "country_id": 20, "name": "Serie A"},
    ],
    "teams": [
        {"team_api_id": t, "team_long_name": f"Team {t}", "team_short_name": f"T{t}"}
        for t in (1, 2, 3, 50, 51, 99)
    ]
    + [{"team_api_id": 1, "team_long_name": "Team 1", "team_short_name": "T1"}],
    "players": [
        {"player_api_id": p, "player_name": f"P{p}"}
        for p in (101, 102, 103, 201, 202, 301, 501, 502, 777)
    ],
    "player_attributes": ATTRIBUTES,
    "matches": MATCHES,
}


def feed(spark):
    return {
        name: spark.createDataFrame([tuple(r[c] for c in RAW[name].names) for r in rows], RAW[name])
        for name, rows in TABLES.items()
    }
