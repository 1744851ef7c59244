"""Tenants of one store: each sees its own tables under their plain names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tidemark.plans.store import Store


class Tenant:
    """Tables of one tenant; commits, branches and transactions are those of the whole store."""

    def __init__(self, store: Store, name: str):
        if not re.fullmatch(r"[A-Za-z0-9]+(_[A-Za-z0-9]+)*", name):
            raise ValueError(f"not a tenant name: {name!r}")
        self.store, self.prefix = store, f"__tenant_{name}__"

    def create(self, table: str, df: DataFrame, key: str | None = None) -> None:
        self.store.create(self.prefix + table, df, key)

    def put(self, table: str, df: DataFrame) -> None:
        self.store.put(self.prefix + table, df)

    def drop(self, table: str) -> None:
        self.store.drop(self.prefix + table)

    def table(self, table: str) -> DataFrame:
        return self.store.table(self.prefix + table)

    def tables(self) -> list[str]:
        return sorted(t.removeprefix(self.prefix) for t in self.store.working if t.startswith(self.prefix))

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """A query in which this tenant's tables have names and no other table of the store has; edits are seen."""
        spark = self.store.spark
        for name in self.store.working:
            spark.catalog.dropTempView(name)
        for t in self.tables():
            self.table(t).createOrReplaceTempView(t)
        try:
            return spark.sql(text, args=args or {})
        finally:
            for t in self.tables():
                spark.catalog.dropTempView(t)
