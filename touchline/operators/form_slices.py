"""The form of all sides of a slice of time, and both sides of a match in one row: what ``match_features`` asks of one slice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

#: (keys, window, suffix, ((metric, how, name), ...)): a block of form columns.
Block = tuple[Sequence[str], int, str, Sequence[tuple[str, str, str]]]


def _values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, 0 where null, and which are not null."""
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value; nulls are one."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()


def slice_features(table: pa.Table, key: Sequence[str], blocks: Sequence[Block]) -> pa.Table:
    """One row a match of a slice.

    ``table`` has the key, Team, Venue, _order (the place in time), _day, _own, matches_last_14_days, Points and
    the metrics as doubles.  Each sum runs from the oldest row of its window to the newest, as Spark's does.
    """
    place, sides = table["_order"].to_numpy(), {"Team": _codes(table["Team"]), "Venue": _codes(table["Venue"])}
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for keys, reach, suffix, metrics in blocks:
        order = np.lexsort([place, *[sides[k] for k in keys]])
        position = _positions([sides[k][order] for k in keys])
        names = ["Points", *[m for m, _, _ in metrics]]
        x, known = (np.stack(a)[:, order] for a in zip(*[_values(table[m]) for m in names], strict=True))
        sums, counts = np.zeros_like(x), np.zeros(x.shape, np.int64)
        for k in range(min(reach, len(order) - 1), 0, -1):
            within = position[k:] >= k
            sums[:, k:] += np.where(within, x[:, :-k], 0.0)
            counts[:, k:] += within & known[:, :-k]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        sums, counts = sums[:, back], counts[:, back]
        for i, (_, how, name) in enumerate(metrics, 1):
            found[f"{name}_{suffix}"] = (sums[i] / np.maximum(counts[i], 1) if how == "mean" else sums[i]), counts[i] > 0
        found[f"matches_used_{suffix}"] = counts[0], np.ones(len(order), bool)
    found["days_since_last_match"] = _since_last(*_values(table["_day"]), place, sides["Team"])
    found["matches_last_14_days"] = _values(table["matches_last_14_days"])
    return _both_sides(table, key, found)


def _positions(sides: Sequence[np.ndarray]) -> np.ndarray:
    """How many rows of its group come before each row of a sorted table."""
    n = len(sides[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([s[1:] != s[:-1] for s in sides])
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


def _since_last(day: np.ndarray, known: np.ndarray, place: np.ndarray, team: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort([place, team])
    gap, has = np.zeros(len(day), day.dtype), np.zeros(len(day), bool)
    own, last = order[1:], order[:-1]
    gap[own], has[own] = day[own] - day[last], (team[own] == team[last]) & known[own] & known[last]
    return gap, has


def _both_sides(table: pa.Table, key: Sequence[str], found: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """A row a match from the slice's own rows; of several rows of one side each column's greatest value, as an aggregation has it."""
    own = np.flatnonzero(table["_own"].to_numpy())
    codes = pd.DataFrame({k: _codes(table[k])[own] for k in key})
    match = codes.groupby(list(key), sort=False).ngroup().to_numpy()
    first = np.unique(match, return_index=True)[1]
    columns = {k: table[k].take(own[first]) for k in key} | {"HomeTeam": None, "AwayTeam": None}
    for prefix, venue, team in (("home", "Home", "HomeTeam"), ("away", "Away", "AwayTeam")):
        there = np.flatnonzero(np.equal(table["Venue"].to_numpy()[own], venue))
        rows, at = own[there], match[there]
        again = pd.Series(at).groupby(at).cumcount().to_numpy()
        teams, names = np.full(len(first), None, object), table["Team"].to_numpy()[rows]
        teams[at[again == 0]] = names[again == 0]
        for i in np.flatnonzero(again):
            teams[at[i]] = max((t for t in (teams[at[i]], names[i]) if t is not None), default=None)
        columns[team] = pa.array(teams, pa.string())
        for name, (x, known) in found.items():
            out, has = np.zeros(len(first), x.dtype), np.zeros(len(first), bool)
            for k in range(int(again.max(initial=0)) + 1):
                nth, seen = at[again == k], known[rows[again == k]]
                value = x[rows[again == k]]
                better = seen & (~has[nth] | (value > out[nth]) | (value != value))
                out[nth[better]], has[nth] = value[better], has[nth] | seen
            columns[f"{prefix}_{name}"] = pa.array(out, mask=~has)
    return pa.table(columns)
