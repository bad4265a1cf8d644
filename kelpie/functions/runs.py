"""Streaming over sorted Arrow batches, a whole run of equal keys at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], at_least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about ``at_least`` rows that never cut a run of equal ``keys``.

    The batches must come sorted by ``keys`` (nulls are equal to each other). A run longer than ``at_least`` is held
    whole, so callers must bound their runs (by aggregation, or by salting hot keys) beforehand.
    """
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        cut = last_run(table, keys)
        if cut:
            yield table.slice(0, cut)
            held, rows = [table.slice(cut)], table.num_rows - cut
        else:
            held, rows = [table], table.num_rows
            at_least = max(at_least, 2 * rows)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def last_run(table: pa.Table, keys: Sequence[str]) -> int:
    """The row at which the last run of equal keys begins."""
    low = 0
    for key in keys:
        column = table.column(key)
        last = column[-1]
        if last.as_py() is None:
            same = pc.is_null(column)
        else:
            same = pc.fill_null(pc.equal(column, last), False)
        differs = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
        if len(differs):
            low = max(low, int(differs[-1]) + 1)
    return low


def best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), k columns: the best of each row by the score rounded to 9 decimals, then the smaller id.

    Rows with fewer finite scores are filled up with -inf. Only what reaches the k-th best score is sorted.
    """
    n = scores.shape[1]
    wanted = scores > -np.inf
    if n > k:
        wanted &= scores >= np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1] - 2e-9
    row, column = np.nonzero(wanted)
    s, i = scores[row, column], np.broadcast_to(ids, scores.shape)[row, column]
    order = np.lexsort((i, -np.round(s, 9), row))
    row, s, i = row[order], s[order], i[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    out_s, out_i = np.full((len(scores), k), -np.inf), np.zeros((len(scores), k), np.int64)
    out_s[row[keep], place[keep]], out_i[row[keep], place[keep]] = s[keep], i[keep]
    return out_s, out_i


def improve(best_s: np.ndarray, best_i: np.ndarray, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Takes further cells (row, score, id) into the best ones of each row, in place; the order is that of best_of_rows."""
    k = best_s.shape[1]
    rows, at = np.unique(row, return_inverse=True)
    old_s, old_i = best_s[rows], best_i[rows]
    r, c = np.nonzero(old_s > -np.inf)
    at, s, i = np.r_[r, at], np.r_[old_s[r, c], scores], np.r_[old_i[r, c], ids]
    order = np.lexsort((i, -np.round(s, 9), at))
    at, s, i = at[order], s[order], i[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < k
    new_s, new_i = np.full((len(rows), k), -np.inf), np.zeros((len(rows), k), np.int64)
    new_s[at[keep], place[keep]], new_i[at[keep], place[keep]] = s[keep], i[keep]
    best_s[rows], best_i[rows] = new_s, new_i
