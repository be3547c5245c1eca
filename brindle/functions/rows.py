"""The rows of a partition as a list that isn't all made: they lie in Arrow batches, and few of them are dicts at a time."""

from __future__ import annotations

from bisect import bisect_right
from collections import UserList
from collections.abc import Iterable, Sequence
from itertools import accumulate
from operator import index
from weakref import ref

import pyarrow as pa

#: Rows in a piece, which becomes dicts at once, and how many pieces are lent at a time.
_PIECE, _LENT = 64, 128


class _Row(dict):
    """A row on loan, which tells whether it was changed: then it has that attribute."""

    __slots__ = ("changed", "__weakref__")

    def __reduce__(self):
        return dict, (dict(self),)


def _telling(name: str):
    own = getattr(dict, name)

    def f(self, *values, **named):
        self.changed = True
        return own(self, *values, **named)

    f.__name__ = name
    return f


for _name in ("__setitem__", "__delitem__", "__ior__", "clear", "pop", "popitem", "setdefault", "update"):
    setattr(_Row, _name, _telling(_name))


class Rows(UserList):
    """A list of rows, dicts by column. Reading by place or in turn makes the dicts piece by piece and drops them again; those that were changed, or
    that somebody still holds, stay the ones that the list gives. What changes or compares the list itself makes all of it, and so do nested columns,
    whose values can be changed unseen."""

    def __init__(self, initlist: Iterable | None = None, batches: Iterable[pa.RecordBatch] = ()):
        self._batches = [b for b in batches if b.num_rows]
        self._ends = list(accumulate(b.num_rows for b in self._batches))
        self._list = None if self._batches else list(initlist or ())
        self._lent: dict[int, list[_Row]] = {}
        self._kept: dict[int, list[_Row] | dict[int, _Row]] = {}
        self._first, self._now = 0, []
        if self._batches and any(pa.types.is_nested(f.type) for f in self._batches[0].schema):
            self.data = [r for b in self._batches for r in b.to_pylist()]

    @property
    def data(self) -> list:
        if self._list is None:
            self.data = [self[i] for i in range(len(self))]
        return self._list

    @data.setter
    def data(self, rows: list) -> None:
        self._list, self._batches, self._lent, self._kept, self._now = rows, [], {}, {}, []

    def __len__(self) -> int:
        return self._ends[-1] if self._list is None else len(self._list)

    def __getitem__(self, i):
        if self._list is not None:
            return self._list[i]
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        at, n = index(i), len(self)
        at = at + n if at < 0 else at
        if not 0 <= at < n:
            raise IndexError("list index out of range")
        if not 0 <= at - self._first < len(self._now):
            self._lend(at)
        return self._now[at - self._first]

    def __iter__(self):
        at = 0
        while at < len(self):
            for row in [self[at]] if self._list is not None else self._piece(at):
                yield row
                at += 1
                if self._list is not None:
                    break

    def _piece(self, at: int) -> list[_Row]:
        self[at]
        return self._now[at - self._first :]

    def _lend(self, at: int) -> None:
        """Makes the piece around place at the present one."""
        k = bisect_right(self._ends, at)
        start = self._ends[k - 1] if k else 0
        first = at - (at - start) % _PIECE
        if first not in self._lent:
            kept = self._kept.pop(first, None)
            if not isinstance(kept, list):
                rows = [_Row(r) for r in self._batches[k].slice(first - start, _PIECE).to_pylist()]
                kept = [kept.get(j, r) for j, r in enumerate(rows)] if kept else rows
            self._lent[first] = kept
        self._first, self._now = first, self._lent[first]
        if len(self._lent) > _LENT:
            self._take_back(next(f for f in self._lent if f != first))

    def _take_back(self, first: int) -> None:
        rows = self._lent.pop(first)
        left, changed = [ref(r) for r in rows], [r for r in rows if hasattr(r, "changed")]
        del rows
        kept = {j: r for j, x in enumerate(left) if (r := x()) is not None}
        del changed
        if kept:
            self._kept[first] = list(kept.values()) if len(kept) == len(left) else kept

    # where UserList would make the whole list
    __contains__, index, count = Sequence.__contains__, Sequence.index, Sequence.count
    __copy__ = UserList.copy

    def __reduce__(self):
        return list, (list(self),)
