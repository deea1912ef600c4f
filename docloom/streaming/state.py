"""In-memory state for the rules: tests, and replays of small logs."""

from __future__ import annotations

from typing import Any


class MemoryCell:
    def __init__(self):
        self.value: Any = None

    def get(self) -> Any:
        return self.value

    def put(self, value: Any) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None


class MemoryTable:
    def __init__(self):
        self.rows: dict[str, Any] = {}

    def get(self, key: str) -> Any:
        return self.rows.get(key)

    def put(self, key: str, value: Any) -> None:
        self.rows[key] = value

    def remove(self, key: str) -> None:
        self.rows.pop(key, None)

    def items(self) -> list[tuple[str, Any]]:
        return sorted(self.rows.items())

    def clear(self) -> None:
        self.rows.clear()
