"""Events out of an XML text cell, one document per row.

Document shape: ``<goal><value><id/><elapsed/><player1/><team/></value>...</goal>``. All
fields are read as text first, so one bad number spoils one event and not its document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

_FIELDS = "value ARRAY<STRUCT<id STRING, elapsed STRING, player1 STRING, team STRING>>"
_BROKEN = "_broken"

# Output name, field in the document, type, and whether an event must have it.
_TYPED = [
    ("goal_id", "id", "BIGINT", True),
    ("minute", "elapsed", "INT", True),
    ("player_id", "player1", "BIGINT", False),
    ("team_id", "team", "BIGINT", False),
]


def _parsed(df: DataFrame, document: str, keep: Sequence[str], strict: bool) -> DataFrame:
    if strict:
        schema, mode = _FIELDS, "'mode', 'FAILFAST'"
    else:
        schema = f"{_FIELDS}, {_BROKEN} STRING"
        mode = f"'mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '{_BROKEN}'"
    read = f"from_xml({document}, '{schema}', map('rowTag', 'goal', {mode})) AS _doc"
    return df.where(f"{document} IS NOT NULL").selectExpr(*keep, read)


def classified_events(
    df: DataFrame, document: str, keep: Sequence[str], strict: bool = False
) -> DataFrame:
    """Every event and everything unreadable from one parse of each document.

    ``keep`` columns, ``goal_id, minute, player_id, team_id``, and for what could not be read a
    ``reason`` and the ``content``; :func:`readable` and :func:`unreadable` are its projections.
    An unreadable player or team is NULL, and its event is in both. ``strict`` fails on a malformed
    document, a missing id or minute, or a non-numeric field, so that nothing has a reason.
    """
    parsed = _parsed(df, document, keep, strict)
    # An outer generator: a plain one makes the optimizer test the document in filters of its
    # own, each of which parses it again. The filter below removes the rows without events.
    if strict:

        def exact(field: str, kind: str, needed: bool) -> str:
            if needed:
                field = f"coalesce({field}, raise_error('event without {field.removeprefix("_event.")}'))"
            return f"CAST({field} AS {kind})"

        events = parsed.selectExpr(*keep, "posexplode_outer(_doc.value) AS (_at, _event)")
        return events.where("_at IS NOT NULL").selectExpr(
            *keep,
            *[
                f"{exact(f'_event.{field}', kind, needed)} AS {name}"
                for name, field, kind, needed in _TYPED
            ],
            "CAST(NULL AS STRING) AS reason",
            "CAST(NULL AS STRING) AS content",
        )
    # A broken document becomes one more event, so that one pass over one parse finds everything.
    found = parsed.selectExpr(
        *keep,
        f"""posexplode_outer(if(_doc.{_BROKEN} IS NULL, _doc.value,
            array(named_struct('id', NULL, 'elapsed', NULL, 'player1', NULL, 'team', NULL))))
            AS (_at, _event)""",
        f"_doc.{_BROKEN} AS {_BROKEN}",
    ).selectExpr("*", "_event.*")
    missing = " OR ".join(f"{field} IS NULL" for _, field, _, needed in _TYPED if needed)
    spoilt = " OR ".join(
        f"({field} IS NOT NULL AND try_cast({field} AS {kind}) IS NULL)"
        for _, field, kind, _ in _TYPED
    )
    return (
        found.where("_at IS NOT NULL")
        .selectExpr(
            *keep,
            *[f"try_cast({field} AS {kind}) AS {name}" for name, field, kind, _ in _TYPED],
            f"""CASE WHEN {_BROKEN} IS NOT NULL THEN 'malformed document'
                WHEN {missing} THEN 'missing id or minute'
                WHEN {spoilt} THEN 'non-numeric field' END AS reason""",
            f"coalesce({_BROKEN}, to_json(struct(id, elapsed, player1, team))) AS _content",
        )
        .selectExpr(
            *keep,
            *[name for name, *_ in _TYPED],
            "reason",
            "CASE WHEN reason IS NOT NULL THEN _content END AS content",
        )
    )


def readable(events: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The events of :func:`classified_events` that have an id and a minute."""
    found = events.where("goal_id IS NOT NULL AND minute IS NOT NULL")
    return found.select(*keep, *[name for name, *_ in _TYPED])


def unreadable(events: DataFrame, keep: Sequence[str]) -> DataFrame:
    """What :func:`classified_events` could not read: ``keep``, ``reason``, ``content``."""
    return events.where("reason IS NOT NULL").select(*keep, "reason", "content")


def xml_events(
    df: DataFrame, document: str, keep: Sequence[str], strict: bool = False
) -> DataFrame:
    """``keep`` columns plus ``goal_id, minute, player_id, team_id``, one row per event.

    Rows without a document give no events; an event may lack player or team. ``strict`` fails
    on a malformed document, a missing id or minute, or a non-numeric field. Otherwise a
    malformed document gives nothing, an event without readable id or minute is left out, and an
    unreadable player or team becomes NULL; :func:`xml_rejects` lists all of these.
    """
    events = classified_events(df, document, keep, strict)
    # Strict events all have an id and a minute; a filter would be moved below what raises.
    return events.select(*keep, *[name for name, *_ in _TYPED]) if strict else readable(events, keep)


def xml_rejects(df: DataFrame, document: str, keep: Sequence[str]) -> DataFrame:
    """What the lenient :func:`xml_events` could not read: ``keep``, ``reason``, ``content``."""
    return unreadable(classified_events(df, document, keep), keep)
