"""The rules as stateful processors: state and timers of Spark behind the rules' ports.

A call of a processor has all rows of one key in a micro-batch. What it reads of the state it keeps until
the call ends, and only then writes what has changed, so a key costs a few exchanges with the state
store however many rows it has.

Order: sources have orders of their own, which do not compare. Only an id's rows from one source do.
Each step therefore numbers what it emits for an id, ``seq`` being the id's own order: within a
micro-batch ``(seq, sub)`` is the order of emission, and a later micro-batch is later.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..names import state_id
from .rules import UPSERT, LookupRules, NestRules, OrphanDeadline, route

_ID = T.StructType([T.StructField("id", T.StringType())])
#: A lookup's ``sub``: the entity's own above this many bits, and below them the rows that its key has seen in the micro-batch.
_TURN_BITS = 31


def plain(value: Any) -> Any:
    """Rows as plain tuples, at any depth: state serialisation does not take nested rows."""
    if isinstance(value, tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


class _Cell:
    """A value as a tuple, or unset."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: T.StructType, ttl: int | None):
        self.state = handle.getValueState(name, schema, ttl)
        self.forget()

    def forget(self) -> None:
        self.value, self.read, self.written = None, False, False

    def get(self) -> Any:
        if not self.read:
            self.value, self.read = self.state.get(), True
        return self.value

    def put(self, value: Any) -> None:
        self.value, self.read, self.written = value, True, True

    def clear(self) -> None:
        self.put(None)

    def flush(self) -> None:
        """Writes what has changed; the next key starts afresh."""
        if self.written and self.value is None:
            self.state.clear()
        elif self.written:
            self.state.update(plain(tuple(self.value)))
        self.forget()


class _One(_Cell):
    """A cell whose value is the only column of its schema."""

    def get(self) -> Any:
        row = super().get()
        return None if row is None else row[0]

    def put(self, value: Any) -> None:
        super().put(None if value is None else (value,))


class _Table:
    """Values by id, each a tuple. Ids are read one by one until all are asked for."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: T.StructType, ttl: int | None):
        self.state = handle.getMapState(name, _ID, schema, ttl)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, Any] = {}
        self.written: set[str] = set()
        self.whole = self.cleared = False

    def get(self, key: str) -> Any:
        if key not in self.rows:
            self.rows[key] = None if self.whole else self.state.getValue((key,))
        return self.rows[key]

    def put(self, key: str, value: Any) -> None:
        self.rows[key] = value
        self.written.add(key)

    def remove(self, key: str) -> None:
        self.put(key, None)

    def items(self) -> list[tuple[str, Any]]:
        if not self.whole:
            self.rows = {k[0]: v for k, v in self.state.iterator()} | self.rows
            self.whole = True
        return [(k, self.rows[k]) for k in sorted(self.rows) if self.rows[k] is not None]

    def clear(self) -> None:
        self.rows, self.written, self.whole, self.cleared = {}, set(), True, True

    def flush(self) -> None:
        if self.cleared:
            self.state.clear()
        for key in self.written:
            if (value := self.rows[key]) is not None:
                self.state.updateValue((key,), plain(tuple(value)))
            elif not self.cleared:
                self.state.removeKey((key,))
        self.forget()


class _Values(_Table):
    """A table whose values are the only column of its schema."""

    def get(self, key: str) -> Any:
        row = super().get(key)
        return None if row is None else row[0]

    def put(self, key: str, value: Any) -> None:
        super().put(key, None if value is None else (value,))

    def items(self) -> list[tuple[str, Any]]:
        return [(k, v[0]) for k, v in super().items()]


def single(name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind)])


def _versioned(*fields: T.StructField) -> T.StructType:
    return T.StructType([*fields, T.StructField("seq", T.LongType()), T.StructField("sub", T.LongType())])


def _ordered(rows: Iterator[Row]) -> list[Row]:
    """A micro-batch's rows of one key in the order of their source; a shuffle gives none."""
    return sorted(rows, key=lambda r: (r["seq"], r["src"], r["sub"], r["id"]))


class _Order:
    """Numbers what a key emits: ``seq`` never falls, and ``sub`` counts on while it stays."""

    def __init__(self, last: tuple[int, int] | None = None):
        self.seq, self.sub = last or (None, 0)

    def next(self, seq: int, step: int = 1) -> tuple[int, int]:
        if self.seq is None or seq > self.seq:
            self.seq, self.sub = seq, step - 1
        else:
            self.sub += step
        return self.seq, self.sub


class RouteProcessor(StatefulProcessor):
    """Keyed by (src, id). In: src, kind, id, value_<src>..., seq, sub, key. Out: the same, routed, and relocation.

    ``slots`` has each source's state id, type of value, TTL and name for messages.
    """

    def __init__(self, slots: list[tuple[str, T.DataType, int | None, str]]):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = T.StructField("key", T.StringType())
        self.last = [_Cell(handle, state, _versioned(T.StructField("value", kind), text), ttl) for state, kind, ttl, _ in self.slots]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        src = key[0]
        last, what = self.last[src], self.slots[src][3]
        known = last.get()
        order = _Order(None if known is None else tuple(known[2:4]))
        for r in _ordered(rows):
            seq, sub = order.next(r["seq"], 2)  # a relocation takes two numbers
            steps = route(last, r["kind"], (r[f"value_{src}"], r["key"], seq, sub), lambda v: v[1], f"{what} {r['id']}")
            for kind, (value, *_), target, moved in list(steps):
                values = {f"value_{k}": value if k == src else None for k in range(len(self.slots))}
                yield Row(src=src, kind=kind, id=r["id"], **values, seq=seq, sub=sub - moved, key=target, relocation=moved)
        last.flush()

    def close(self) -> None:
        pass


class LookupProcessor(StatefulProcessor):
    """Keyed by lookup key. In: key, kind, id, entity, dimension, relocation, seq, sub, src (0: dimension). Out: kind, id, entity, dimension, seq, sub.

    An entity's change and what later comes of its dimension are ordered by the entity's ``seq``: it may
    be under another key by then, whose dimension has an order of its own.
    """

    def __init__(self, name: str, entity: T.DataType, dimension: T.DataType, ttl: int | None, require_match: bool):
        self.name, self.entity, self.dimension, self.ttl, self.require_match = name, entity, dimension, ttl, require_match

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entities = _Table(handle, state_id("entities", self.name), _versioned(T.StructField("entity", self.entity)), self.ttl)
        self.now = _One(handle, state_id("dimension", self.name), single("dimension", self.dimension), self.ttl)
        self.rules = LookupRules(self.entities, self.now, self.require_match)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for turn, r in enumerate(_ordered(rows)):
            if r["src"] == 0:
                out = self.rules.dimension_change(r["kind"], r["dimension"])
            else:
                out = self.rules.entity(r["kind"], r["id"], (r["entity"], r["seq"], r["sub"]), r["relocation"])
            for kind, id_, (entity, *version), dimension in list(out):
                seq, sub = (r["seq"], r["sub"]) if r["src"] else version
                yield Row(kind=kind, id=id_, entity=entity, dimension=dimension, seq=seq, sub=(sub << _TURN_BITS) + turn)
        self.entities.flush()
        self.now.flush()

    def close(self) -> None:
        pass


class NestProcessor(StatefulProcessor):
    """Keyed by parent id. In: parent_id, kind, id, parent, child_<slot>..., seq, sub, src (0: parent, k: slot k). Out: kind, id, parent, children_<slot>..., seq, sub.

    With ``coalesce`` a micro-batch's last document of the parent is emitted, and the last delete before it.
    """

    def __init__(self, name: str, parent: T.DataType, slots: list[tuple[str, T.DataType, int | None]], parent_ttl: int | None, orphan_ms: int | None, coalesce: bool):
        self.name, self.parent, self.slots, self.parent_ttl, self.orphan_ms, self.coalesce = name, parent, slots, parent_ttl, orphan_ms, coalesce

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        parent = _One(handle, state_id("parent", self.name), single("parent", self.parent), self.parent_ttl)
        tables = [_Values(handle, state_id("child", self.name, s), single("child", kind), ttl) for s, kind, ttl in self.slots]
        document = T.StructType([T.StructField("parent", self.parent), *(T.StructField(s, T.ArrayType(kind)) for s, kind, _ in self.slots)])
        last = _Document(handle, state_id("last_doc", self.name), document, self.parent_ttl)
        self.state = [parent, *tables, last]
        self.rules = NestRules(parent, tables, last, self.coalesce)
        self.deadline = OrphanDeadline(self.orphan_ms) if self.orphan_ms else None

    def _flush(self) -> None:
        for s in self.state:
            s.flush()

    def _row(self, id_: str, order: _Order, seq: int, kind: str, document: tuple) -> Row:
        parent, children = document
        arrays = {f"children_{s}": list(c) for (s, _, _), c in zip(self.slots, children, strict=True)}
        at, sub = order.next(seq)
        return Row(kind=kind, id=id_, parent=parent, **arrays, seq=at, sub=sub)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        order = _Order()
        for r in _ordered(rows):
            self.rules.place = r["seq"]
            if r["src"] == 0:
                out = self.rules.parent_change(r["kind"], r["parent"])
            else:
                slot = r["src"] - 1
                out = self.rules.child_change(slot, r["kind"], r["id"], r[f"child_{self.slots[slot][0]}"])
            for kind, document in list(out):
                yield self._row(key[0], order, r["seq"], kind, document)
            if self.deadline and r["src"] and r["kind"] == UPSERT and self.rules.orphaned():
                at = self.deadline.at(key[0], timerValues.getCurrentProcessingTimeInMs())
                for old in self.deadline.superseded(at):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(at)
        for seq, kind, document in list(self.rules.end()):
            yield self._row(key[0], order, seq, kind, document)
        self._flush()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.rules.orphaned():
            self.rules.forget_children()
        self._flush()
        return iter(())

    def close(self) -> None:
        pass


class _Document(_Cell):
    """The last emitted parent and children; kept as emitted, since children may expire without an emission."""

    def get(self) -> Any:
        row = super().get()
        return None if row is None else (row[0], [list(c) for c in row[1:]])

    def put(self, value: Any) -> None:
        super().put(None if value is None else (value[0], *value[1]))
