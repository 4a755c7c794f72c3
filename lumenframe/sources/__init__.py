"""Where tables come from: files, memory, catalogs, databases and remote storage."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


class SourceError(ValueError):
    """An input that no source can read, or arguments that don't fit it."""


@dataclass
class TableSource:
    """A registered table: its DataFrame and where it came from."""

    name: str
    kind: str
    frame: DataFrame
    paths: list[str] = field(default_factory=list)
    options: dict[str, Any] = field(default_factory=dict)
    partitions: list[str] = field(default_factory=list)
