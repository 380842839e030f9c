"""Season labels, as SQL expressions over a column or expression."""

from __future__ import annotations

# A label is made from two digits of a year, so a label dimension has at most this many rows.
MAX_LABELS = 100
_LABELS = ", ".join(f"'20{year:02d}/20{year + 1:02d}'" for year in range(MAX_LABELS))


def season_label(date: str) -> str:
    """``2008-07-01`` -> ``2008/2009``: the calendar year decides, whatever the month.

    Takes characters 3-4 of the date text; year 99 gives ``2099/20100``. NULL stays NULL.
    """
    year = f"CAST(substring(CAST({date} AS STRING), 3, 2) AS INT)"
    return f"get(array({_LABELS}), {year})"


def label_year(label: str) -> str:
    """Starting year of a label shaped ``YYYY/20..``; NULL for any other text."""
    year = f"CAST(substring({label}, 1, 4) AS INT)"
    return f"CASE WHEN {label} RLIKE '^[0-9]{{4}}/20' THEN {year} END"
