"""Declared captures and their reconciliation with what a log has installed, as joins of tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from ..schema import REGISTRY
from ..sources.store import Engine
from ..spec import Capture


def reconciled(wanted: DataFrame, installed: DataFrame, prune: bool = False) -> DataFrame:
    """What has to be done for each name, from one full join: ``install`` what is only wanted,
    ``update`` what has another checksum, ``keep`` what agrees; what is only installed is to
    ``remove`` with ``prune`` and otherwise left out. Both sides have name, table_name, checksum."""
    side = lambda df, own: df.select("name", F.col("table_name").alias(f"{own}_table"), F.col("checksum").alias(f"{own}_sum"))
    both = side(wanted, "want").join(side(installed, "have"), "name", "full_outer")
    action = F.when(F.col("have_sum").isNull(), "install").when(F.col("want_sum").isNull(), "remove").when(F.col("want_sum") != F.col("have_sum"), "update").otherwise("keep")
    named = both.select("name", action.alias("action"), F.coalesce("want_table", "have_table").alias("table_name"))
    return named if prune else named.where("action <> 'remove'")


class Registry:
    """Installed captures of a log: one small file of JSON lines, replaced under a lock."""

    FOLDER = "registry"

    def __init__(self, engine: Engine):
        self.engine = engine
        engine.bootstrap()

    def _versions(self) -> list[str]:
        return sorted(n for n in self.engine._names(self.FOLDER) if n.endswith(".json"))

    @property
    def installed(self) -> DataFrame:
        """``name``, ``table_name``, ``checksum``, ``applied_at`` and the plan's text."""
        versions = self._versions()
        if not versions:
            return self.engine.spark.createDataFrame([], REGISTRY)
        return self.engine.spark.read.schema(REGISTRY).json(f"{self.engine.path}/{self.FOLDER}/{versions[-1]}")

    def _replace(self, rows: Iterable[dict]) -> None:
        """A new numbered file that must not exist; readers take the last one."""
        versions = self._versions()
        number = int(versions[-1][:-5]) + 1 if versions else 1
        self.engine._put(f"{self.FOLDER}/{number:012d}.json", "\n".join(json.dumps(r, default=str, sort_keys=True) for r in rows) + "\n", overwrite=False)
        for old in versions:
            self.engine._fs.delete(self.engine._at(self.FOLDER, old), False)

    def wanted(self, captures: Iterable[Capture]) -> DataFrame:
        now = datetime.now(timezone.utc)
        plans = {c.name: c.plan() for c in captures}
        return self.engine.spark.createDataFrame([(name, p.capture.table, p.checksum, now, p.text) for name, p in plans.items()], REGISTRY)

    def pending(self, captures: Iterable[Capture], prune: bool = False) -> DataFrame:
        return reconciled(self.wanted(captures), self.installed, prune)

    def state(self, capture: Capture) -> str:
        """``missing``, ``current`` or ``stale``."""
        return {"install": "missing", "keep": "current", "update": "stale"}[self.pending([capture]).first()["action"]]

    def apply(self, captures: Iterable[Capture], prune: bool = False, force: bool = False) -> dict[str, list[str]]:
        """Brings the log to what is wanted and gives the names by action. All of it is read and
        replaced under one lock, so that it holds for concurrent callers too."""
        captures = list(captures)
        with self.engine.lock("registry"):
            want, have = self.wanted(captures), self.installed
            done = {r["name"]: r["action"] for r in reconciled(want, have, prune).collect()}
            fresh = {n for n, a in done.items() if a in ("install", "update") or (force and a == "keep")}
            if fresh or "remove" in done.values():
                rows = {r["name"]: r.asDict() for r in have.collect() if done.get(r["name"]) != "remove"}
                rows |= {r["name"]: r.asDict() for r in want.collect() if r["name"] in fresh}
                self._replace(rows[n] for n in sorted(rows))
        out: dict[str, list[str]] = {"install": [], "update": [], "keep": [], "remove": []}
        for name in sorted(done):
            out["update" if name in fresh and done[name] == "keep" else done[name]].append(name)
        return out

    def install(self, capture: Capture, force: bool = False) -> bool:
        """Whether anything was written."""
        return not self.apply([capture], force=force)["keep"]

    def remove(self, name: str) -> bool:
        with self.engine.lock("registry"):
            rows = [r.asDict() for r in self.installed.collect()]
            kept = [r for r in rows if r["name"] != name]
            if len(kept) < len(rows):
                self._replace(kept)
        return len(kept) < len(rows)


_declared: dict[str, Capture] = {}


def declare(capture: Capture) -> Capture:
    """Declaring a name again replaces its capture."""
    _declared[capture.name] = capture
    return capture


def tracked(table: str, **options: object) -> Callable[[type], type]:
    """Class decorator that declares a capture of the class's table."""

    def mark(cls: type) -> type:
        cls.__capture__ = declare(Capture(table, **options))
        return cls

    return mark


def declared(prefix: str = "") -> list[Capture]:
    """Declared captures, of tables with a prefix if one is given."""
    return [c for c in _declared.values() if c.table.startswith(prefix)]


def forget_declared() -> None:
    _declared.clear()
