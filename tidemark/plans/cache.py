"""Tables held in executors' memory by commit, refreshed by what changed."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tidemark.operators.diff import delta_merge
from tidemark.plans.store import Store, version


class Cache:
    """Versions of tables that queries read often, at most ``size`` of them; the one that was not read longest goes.

    They are in memory and, beyond it, on executors' disks; parts that go with an executor are
    computed again from the store's files.
    """

    def __init__(self, store: Store, size: int = 8):
        self.store, self.size = store, size
        self.held: OrderedDict[tuple[str, tuple[str, ...]], DataFrame] = OrderedDict()
        self.full = self.refreshed = 0

    def table(self, name: str, commit: str | None = None) -> DataFrame:
        """A table at a commit, by default the head. If the parent's rows are held, only rows that changed since are read."""
        at = self.store.manifest(commit or self.store.head())
        rows = version(at["tables"][name])
        if (name, rows) in self.held:  # commits that left the table alone share its rows
            self.held.move_to_end((name, rows))
            return self.held[name, rows]
        before = self.store.manifest(at["parent"])["tables"].get(name) if at["parent"] else None
        new = self.store.as_of(name, at["id"])
        old = self.held.get((name, version(before))) if before and before["schema"] == at["tables"][name]["schema"] else None
        if old is None:
            self.full += 1
        else:
            self.refreshed += 1
            changed = self.store.diff(at["parent"], at["id"]).where(f"table = '{name}'").select("key")
            new = delta_merge(old, new, changed, at["tables"][name]["key"])
        self.held[name, rows] = new.persist(StorageLevel.MEMORY_AND_DISK)
        while len(self.held) > self.size:
            self.held.popitem(last=False)[1].unpersist()
        return new

    def sql(self, text: str, commit: str | None = None, args: dict | list | None = None) -> DataFrame:
        """A query over the tables of a commit as they are held."""
        for name in self.store.manifest(commit or self.store.head())["tables"]:
            self.table(name, commit).createOrReplaceTempView(name)
        return self.store.spark.sql(text, args=args or {})

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()
