"""Nest: children of any number of slots as arrays in their parent's document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..errors import ConfigurationError
from ..names import checked_name
from ..options import ChildOptions, NestOptions
from ..plans.replay import nest_replay
from ..plans.snapshot import nest_snapshot
from .changes import Key
from .slots import Children, ChildSlot

Assembler = Callable[[Column, Children], Column]


class Nest:
    """``level = Nest.parent(name, parents)``, ``slot = level.child(name, changes, parent_key)``, ``level.assemble(assembler)``.

    ``assembler`` gets the parent's value and the children as columns and returns the document. A
    level's output is a change stream and can be a child of the next level.
    """

    def __init__(self, name: str, parents: DataFrame):
        self.name, self.parents = checked_name(name, "nest name"), parents
        self.options, self.slots, self._done = NestOptions(), [], False
        self._inputs: dict[str, tuple[DataFrame, Key, ChildOptions]] = {}

    @classmethod
    def parent(cls, name: str, parents: DataFrame) -> Nest:
        return cls(name, parents)

    def _open(self) -> None:
        if self._done:
            raise ConfigurationError(f"nest {self.name!r} has been assembled already")

    def with_options(self, options: NestOptions) -> Nest:
        self._open()
        self.options = options
        return self

    def child(self, slot: str, changes: DataFrame, parent_key: Key, options: ChildOptions | None = None) -> ChildSlot:
        self._open()
        if checked_name(slot, "slot name") in self._inputs:
            raise ConfigurationError(f"nest {self.name!r} has a slot {slot!r} already")
        self._inputs[slot] = (changes, parent_key, options or ChildOptions())
        self.slots.append(ChildSlot(self, slot, len(self.slots)))
        return self.slots[-1]

    def assemble(self, assembler: Assembler, mode: str | None = None) -> DataFrame:
        """The documents' changes; ``mode`` as in ``Lookup``."""
        self._open()
        if not self._inputs:
            raise ConfigurationError(f"nest {self.name!r} has no slot")
        streaming = any(f.isStreaming for f in [self.parents, *(c for c, _, _ in self._inputs.values())])
        mode = mode or ("stream" if streaming else "snapshot")
        if streaming != (mode == "stream"):
            raise ConfigurationError(f"mode {mode!r} does not fit the input")
        self._done = True
        inputs = {n: (c, k) for n, (c, k, _) in self._inputs.items()}

        def document(parent: Column, columns: dict[str, Column]) -> Column:
            return assembler(parent, Children(self, columns))

        if mode == "snapshot":
            return nest_snapshot(self.parents, inputs, document, f"nest {self.name}")
        if mode == "replay":
            return nest_replay(self.parents, inputs, document, f"nest {self.name}")
        from ..streaming.pipeline import nest_stream

        return nest_stream(self.name, self.parents, self._inputs, document, self.options)
