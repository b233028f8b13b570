"""Where questions about symbols go: the graph itself, or an index outside of it that answers in the same form."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery, impact, resolve
from . import code_graph


class BackendError(Exception):
    """What a backend can't do. unsafe: its index may be damaged, which must never be hidden by another answer."""

    def __init__(self, message: str, unsafe: bool = False):
        super().__init__(message)
        self.unsafe = unsafe


class Backend(Protocol):
    """Answers are DataFrames; status has at least `available` and `indexed`."""

    name: str

    def status(self) -> dict: ...
    def search(self, query: str, limit: int) -> DataFrame: ...
    def trace(self, name: str, direction: str, depth: int, limit: int) -> DataFrame: ...
    def architecture(self, scope: str | None) -> DataFrame: ...
    def detect_changes(self, paths: list[str]) -> DataFrame: ...


@dataclass
class Builtin:
    """The graph's own tables."""

    tables: dict[str, DataFrame]
    name: str = "builtin"

    @property
    def spark(self) -> SparkSession:
        return self.tables["files"].sparkSession

    def status(self) -> dict:
        return {"available": True, "indexed": bool(self.tables) and not self.tables["files"].isEmpty()}

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return code_graph.find_symbol(self.tables, query, limit)

    def trace(self, name: str, direction: str = "callees", depth: int = 2, limit: int = 100) -> DataFrame:
        start = resolve.resolve_symbol(self.tables["symbols"], name).select(F.col("symbol_key").alias("node"))
        return impact.trace(self.tables["symbol_edges"], start, direction, depth, limit)

    def architecture(self, scope: str | None = None) -> DataFrame:
        t = self.tables
        entries = t["routes"].select(F.col("file_path").alias("path"), F.col("name").alias("symbol"))
        return discovery.module_map(t["modules"], t["files"], t["edges"], t["tests"], entries=entries, risks=code_graph.cluster_members(t).select("path"), scope=scope)

    def detect_changes(self, paths: list[str]) -> DataFrame:
        changed = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return impact.change_impact(changed, self.tables["bindings"], self.tables["symbol_edges"], self.tables["tests"])


@dataclass
class Answer:
    """An answer, who gave it, and why not the first choice."""

    data: object
    backend: str
    fallback: str | None = None


@dataclass
class Router:
    """Asks an outside backend first and falls back to the builtin one; a backend that was chosen by name is asked alone, and its failure is the answer.

    choice: auto, or the name of a backend.
    """

    builtin: Backend
    outside: list[Backend] = field(default_factory=list)
    choice: str = "auto"

    def ask(self, what: str, *args, **kw) -> Answer:
        every = [*self.outside, self.builtin]
        if self.choice != "auto":
            chosen = next((b for b in every if b.name == self.choice), None)
            if chosen is None:
                raise BackendError(f"there is no backend {self.choice}")
            return Answer(getattr(chosen, what)(*args, **kw), chosen.name)
        reasons = []
        for b in self.outside:
            try:
                state = b.status()
                if not (state.get("available") and state.get("indexed")):
                    reasons.append(f"{b.name}: {state.get('reason') or 'not ready'}")
                    continue
                return Answer(getattr(b, what)(*args, **kw), b.name, "; ".join(reasons) or None)
            except BackendError as e:
                if e.unsafe:
                    raise
                reasons.append(f"{b.name}: {e}")
        return Answer(getattr(self.builtin, what)(*args, **kw), self.builtin.name, "; ".join(reasons) or None)
