"""0/1 matrices in compressed sparse rows, and their products row by row, with numpy arrays only."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Csr(NamedTuple):
    """``indices[indptr[i] : indptr[i + 1]]`` are the columns of the ones in row ``i``, ascending."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    def transposed(self) -> Csr:
        """A counting sort of the ones by column; within a column rows stay in order."""
        sizes = np.bincount(self.indices, minlength=self.columns)
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        return Csr(_offsets(sizes), rows[np.argsort(self.indices, kind="stable")], len(self.indptr) - 1)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def spans(ends: np.ndarray) -> Csr:
    """Row ``i`` has ones from the end of row ``i - 1`` up to its own: tokens against the bytes they cover."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([np.zeros(1, np.int64), ends]), np.arange(total), total)


def membership(group: np.ndarray, groups: int) -> Csr:
    """Row ``i`` has a single one, in column ``group[i]``."""
    return Csr(np.arange(len(group) + 1), group, groups)


def row_products(a: Csr, b: Csr, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product ``a b`` as runs of entries ``(row, column, value)``, by row and then column (Gustavson).

    Row ``i`` of the product is the sum of the rows of ``b`` that row ``i`` of ``a`` names. About ``at_once`` terms are
    gathered at a time, or those of one row if they are more.
    """
    sizes = np.diff(b.indptr)
    work = _offsets(sizes[a.indices])[a.indptr]  # terms before each row
    first, last = 0, len(a.indptr) - 1
    while first < last:
        stop = max(first + 1, int(np.searchsorted(work, work[first] + at_once, side="right")) - 1)
        named = a.indices[a.indptr[first] : a.indptr[stop]]
        terms = sizes[named]
        row = np.repeat(np.arange(first, stop), np.diff(work[first : stop + 1]))
        place = np.arange(len(row)) + np.repeat(b.indptr[named] - _offsets(terms)[:-1], terms)
        key = row * b.columns + b.indices[place]
        if np.any(key[1:] < key[:-1]):
            key.sort()
        fresh = np.flatnonzero(np.diff(key, prepend=-1))
        value = np.diff(np.append(fresh, len(key)))
        yield key[fresh] // max(1, b.columns), key[fresh] % max(1, b.columns), value
        first = stop


def product_terms(a: Csr, b: Csr) -> np.ndarray:
    """How many terms each row of ``a b`` sums: the symbolic pass, in linear time whatever the product's size.

    Where no two terms of a row meet in one column, as for memberships, that is the number of its entries.
    """
    return np.diff(_offsets(np.diff(b.indptr)[a.indices])[a.indptr])
