"""What each operator does with one change, free of any engine.

State comes in as a port with plain methods; values are opaque. Each rule yields what it emits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

UPSERT, DELETE = "U", "D"


class Cell(Protocol):
    """A value that may be unset."""

    def get(self) -> Any: ...
    def put(self, value: Any) -> None: ...
    def clear(self) -> None: ...


class Table(Protocol):
    """Values by id; ``items`` is sorted by id."""

    def get(self, key: str) -> Any: ...
    def put(self, key: str, value: Any) -> None: ...
    def remove(self, key: str) -> None: ...
    def items(self) -> list[tuple[str, Any]]: ...
    def clear(self) -> None: ...


def route(last: Cell, kind: str, value: Any, key_of, what: str) -> Iterator[tuple[str, Any, str, bool]]:
    """(kind, value, target key, relocation): the old place is told first when a key changes.

    Deletes go where the last known value was, with that value, whatever they carry themselves.
    """
    known = last.get()
    if kind == DELETE:
        source = value if known is None else known
        yield DELETE, source, _needed(key_of(source), what), False
        last.clear()
        return
    target = _needed(key_of(value), what)
    if known is not None and (old := key_of(known)) != target:
        yield DELETE, known, old, True
    yield UPSERT, value, target, False
    last.put(value)


def _needed(key: str | None, what: str) -> str:
    if key is None:
        raise RuntimeError(f"{what}: the key is null")
    return key


class LookupRules:
    """Entities under one key and its dimension; emits (kind, id, entity, dimension or None)."""

    def __init__(self, entities: Table, dimension: Cell, require_match: bool):
        self.entities, self.dimension, self.require_match = entities, dimension, require_match

    def entity(self, kind: str, id_: str, value: Any, relocation: bool) -> Iterator[tuple[str, str, Any, Any]]:
        if kind == UPSERT:
            self.entities.put(id_, value)
        else:
            value = self.entities.get(id_)
            self.entities.remove(id_)
            if relocation or value is None:
                return
        dimension = self.dimension.get()
        if dimension is not None or not self.require_match:
            yield kind, id_, value, dimension

    def dimension_change(self, kind: str, value: Any) -> Iterator[tuple[str, str, Any, Any]]:
        before = self.dimension.get()
        if kind == UPSERT:
            self.dimension.put(value)
            yield from ((UPSERT, i, e, value) for i, e in self.entities.items())
            return
        self.dimension.clear()
        if not self.require_match:
            yield from ((UPSERT, i, e, None) for i, e in self.entities.items())
        elif before is not None:
            yield from ((DELETE, i, e, before) for i, e in self.entities.items())


class NestRules:
    """A parent, its children by slot and what was last emitted; emits (kind, parent's value, children by slot).

    With ``coalesce`` documents wait for ``end``, or for the parent's delete, and only the last one is
    made. ``place`` is set by the caller before a change and comes back with what waited since.
    """

    def __init__(self, parent: Cell, slots: list[Table], last: Cell, coalesce: bool = False):
        self.parent, self.slots, self.last, self.coalesce = parent, slots, last, coalesce
        self.place: Any = None
        self.waiting, self.deleted = None, []

    def _document(self) -> tuple:
        return self.parent.get(), [[v for _, v in s.items()] for s in self.slots]

    def _emit(self) -> Iterator[tuple[str, tuple]]:
        if self.coalesce:
            self.waiting = (self.place,)
            return
        document = self._document()
        self.last.put(document)
        yield UPSERT, document

    def end(self) -> Iterator[tuple[Any, str, tuple]]:
        """What has waited, with its place: the last delete, then the last document."""
        yield from self.deleted
        if self.waiting:
            document = self._document()
            self.last.put(document)
            yield *self.waiting, UPSERT, document
        self.waiting, self.deleted = None, []

    def parent_change(self, kind: str, value: Any) -> Iterator[tuple[str, tuple]]:
        if kind == UPSERT:
            self.parent.put(value)
            yield from self._emit()
            return
        if self.parent.get() is not None and (last := self._document() if self.waiting else self.last.get()) is not None:
            if self.coalesce:
                self.deleted = [(self.place, DELETE, last)]
            else:
                yield DELETE, last
        self.waiting = None
        self.parent.clear()
        self.last.clear()
        self.forget_children()

    def child_change(self, slot: int, kind: str, id_: str, value: Any) -> Iterator[tuple[str, tuple]]:
        table = self.slots[slot]
        if kind == UPSERT:
            table.put(id_, value)
        elif table.get(id_) is None:
            return
        else:
            table.remove(id_)
        if self.parent.get() is not None:
            yield from self._emit()

    def orphaned(self) -> bool:
        return self.parent.get() is None

    def forget_children(self) -> None:
        for s in self.slots:
            s.clear()


def java_hash(text: str) -> int:
    """The 31-based hash of the text's UTF-16 units as a signed 32-bit integer."""
    h = 0
    data = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(data), 2):
        h = (31 * h + (data[i] << 8 | data[i + 1])) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


class OrphanDeadline:
    """When children without a parent are forgotten: a per-key grid, so a key has one timer in (T, 2T]."""

    LONGEST = (1 << 63) // 4

    def __init__(self, timeout_ms: int):
        self.step = min(max(1, timeout_ms), self.LONGEST)

    def at(self, key: str, now: int) -> int:
        offset = java_hash(key) % self.step
        return ((now - offset) // self.step + 2) * self.step + offset

    def superseded(self, deadline: int) -> tuple[int, int]:
        return deadline - 2 * self.step, deadline - self.step
