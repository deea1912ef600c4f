"""Handles of a nest level's slots, and the view of a parent's children by handle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column

from ..errors import ConfigurationError


@dataclass(frozen=True)
class ChildSlot:
    """A slot of one level; ``index`` is its place in declaration order."""

    level: object = field(repr=False, compare=False)
    name: str
    index: int


class Children:
    """A parent's children by slot: ``children[slot]`` is an array column of values, sorted by child id."""

    def __init__(self, level: object, columns: dict[str, Column]):
        self._level, self._columns = level, columns

    def __getitem__(self, slot: ChildSlot) -> Column:
        if slot.level is not self._level:
            raise ConfigurationError(f"slot {slot.name!r} belongs to another level")
        return self._columns[slot.name]

    get = __getitem__
