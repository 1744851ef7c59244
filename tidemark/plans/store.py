"""Versioned tables: immutable Parquet folders, JSON manifests, branches as numbered pointers.

A commit is a manifest that lists, for each table, the folder of its rows, the layers over it, its
schema and its key. Tables that did not change keep their folder. A table changed by ``change``, as
SQL statements do, gets a layer of the rows that came and the keys they touch, so such a commit
writes what changed; a table that was ``put`` anew, or has many or large layers, is written whole.
A branch is a folder of numbered files; publishing creates the next number exclusively, so of two
writers one loses. Keys are unique and not null.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.diff import diff_rows, seal_of
from tidemark.plans.paths import Conflict, Files


#: Layers over a folder before they are folded into one, and keys that they may touch as a part of the table's before it is written whole.
LAYERS, PART = 8, 0.25


def layered(df: DataFrame, put: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows of the keys of ``touched`` (key), and ``put``; keys of ``put`` are among ``touched``."""
    return df.join(touched, key, "left_anti").select(df.columns).unionByName(put)


def version(entry: dict) -> tuple[str, ...]:
    """What a table's rows are read from: its folder and the layers over it."""
    return entry["path"], *(layer["path"] for layer in entry.get("layers", []))


def moved(seal: list, gone: tuple[int, str], came: tuple[int, str]) -> list:
    """The seal of rows of which some went and some came."""
    value = lambda part: int(part[1]) if part[0] else 0
    n = seal[0] - gone[0] + came[0]
    return [n, str(value(seal) - value(gone) + value(came)) if n else "None"]


class Store:
    """A database of versioned tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] = time.time_ns):
        self.spark, self.path, self.clock, self.files = spark, path.rstrip("/"), clock, Files(spark)
        self.branch, self.working, self.keys = "main", {}, {}
        self._edits: dict[str, tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]] = {}
        self._snapshot = None
        if not self.files.names(f"{self.path}/refs/main"):
            self._point("main", self._publish(None, "system", "genesis", {}))
        self._reload()

    # manifests and pointers
    def _publish(self, parent: str | None, author: str, message: str, tables: dict, merged: str | None = None, note: dict | None = None) -> str:
        """A manifest; its root follows from the tables' rows and schemas alone, so equal content has equal roots."""
        ts = self.clock()
        root = hashlib.sha256(json.dumps({t: [v["seal"], v["schema"]] for t, v in tables.items()}, sort_keys=True).encode()).hexdigest() if tables else "0" * 64
        # fixed values: the id is the SHA-256 of parent, root, author, message and time as eight bytes, the lowest first
        name = hashlib.sha256(b"".join([(parent or "").encode(), root.encode(), author.encode(), message.encode(), ts.to_bytes(8, "little", signed=True)])).hexdigest()
        self.files.create(f"{self.path}/commits/{name}.json", json.dumps({"id": name, "parent": parent, "merged": merged, "root": root, "author": author, "message": message, "ts": ts, "tables": tables, "note": note or {}}))
        return name

    def _numbers(self, branch: str) -> list[str]:
        return self.files.names(f"{self.path}/refs/{branch}")

    def _point(self, branch: str, commit: str, after: int | None = None) -> None:
        n = len(self._numbers(branch)) if after is None else after
        self.files.create(f"{self.path}/refs/{branch}/{n:012d}.json", json.dumps({"commit": commit}))

    def head(self, branch: str | None = None) -> str:
        branch = branch or self.branch
        numbers = self._numbers(branch)
        if not numbers:
            raise KeyError(f"no branch {branch}")
        return json.loads(self.files.read(f"{self.path}/refs/{branch}/{numbers[-1]}"))["commit"]

    def base_number(self) -> int:
        """The number under which the next commit of the branch as it was read is published."""
        return self._base_n

    def at_number(self, branch: str, n: int) -> dict | None:
        """The manifest that a branch points at under a number; None if there is none yet."""
        numbers = self._numbers(branch)
        return self.manifest(json.loads(self.files.read(f"{self.path}/refs/{branch}/{numbers[n]}"))["commit"]) if n < len(numbers) else None

    def manifest(self, commit: str) -> dict:
        try:
            return json.loads(self.files.read(f"{self.path}/commits/{commit}.json"))
        except Exception as e:
            raise KeyError(f"no commit {commit}") from e

    def chain(self, commit: str | None = None) -> Iterator[dict]:
        """Manifests from a commit to its first ancestor, each read when it is asked for."""
        at = commit or self.head()
        while at:
            yield (found := self.manifest(at))
            at = found["parent"]

    def ancestors(self, commit: str) -> Iterator[dict]:
        """The commit and all before it over both parents of merges, latest first, each read when it is asked for."""
        first = self.manifest(commit)
        ahead, seen = [(-first["ts"], commit, first)], {commit}
        while ahead:
            _, _, m = heapq.heappop(ahead)
            yield m
            for p in (m["parent"], m.get("merged")):
                if p and p not in seen:
                    seen.add(p)
                    before = self.manifest(p)
                    heapq.heappush(ahead, (-before["ts"], p, before))

    def common_ancestor(self, a: str, b: str) -> dict:
        """The latest commit that both come from; the two lines are read no further than to it."""
        seen: list[set[str]] = [set(), set()]
        for pair in itertools.zip_longest(self.ancestors(a), self.ancestors(b)):
            for side, m in enumerate(pair):
                if m:
                    seen[side].add(m["id"])
                    if m["id"] in seen[1 - side]:
                        return m
        raise KeyError("no common ancestor")

    # the working set
    def _reload(self) -> None:
        self._base_n = len(self._numbers(self.branch))
        self._base = self.manifest(self.head())
        self.working = {t: self._read(v) for t, v in self._base["tables"].items()}
        self.keys = {t: v["key"] for t, v in self._base["tables"].items()}
        self._clean, self._edits = dict(self.working), {}

    def _read(self, entry: dict) -> DataFrame:
        df = self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"])
        for layer in entry.get("layers", []):
            df = layered(df, *self._layer(df.schema, entry["key"], layer["path"]), entry["key"])
        return df

    def _layer(self, schema: StructType, key: str, path: str) -> tuple[DataFrame, DataFrame]:
        return self.spark.read.schema(schema).parquet(f"{path}/put"), self.spark.read.schema(StructType([schema[key]])).parquet(f"{path}/touched")

    def _written(self, name: str, schema: StructType, key: str, put: DataFrame, touched: DataFrame) -> dict:
        """A new layer: rows that come and all keys that are touched, theirs too."""
        path = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
        put.select(schema.names).write.parquet(f"{path}/put")
        came = self.spark.read.schema(schema).parquet(f"{path}/put")
        touched.select(key).union(came.select(key)).distinct().write.parquet(f"{path}/touched")
        n, n_set = self._layer(schema, key, path)[1].agg(F.count(F.lit(1)), F.count(key)).first()
        if n != n_set or came.count() > n:
            raise ValueError(f"{name}: values of {key} are null or not unique")
        return {"path": path, "rows": n}

    def _folded(self, name: str, schema: StructType, key: str, layers: list[dict]) -> dict:
        """One layer that does what these do one after the other."""
        (put, touched), *rest = (self._layer(schema, key, layer["path"]) for layer in layers)
        for later, keys in rest:
            put, touched = layered(put, later, keys, key), touched.union(keys)
        return self._written(name, schema, key, put, touched)

    def _with_layers(self, name: str, entry: dict, layers: list[dict]) -> dict:
        """``entry`` with layers more; its seal follows from the rows that went and came."""
        schema, key = StructType.fromJson(entry["schema"]), entry["key"]
        for layer in layers:
            before = self._read(entry)
            put, touched = self._layer(schema, key, layer["path"])
            gone = seal_of(before.join(touched, key, "left_semi").select(before.columns))
            if gone[0] > layer["rows"]:
                raise ValueError(f"{name}: values of {key} are null or not unique")
            entry = entry | {"layers": [*entry.get("layers", []), layer], "seal": moved(entry["seal"], gone, seal_of(put))}
        if len(entry.get("layers", [])) > LAYERS:
            entry = entry | {"layers": [self._folded(name, schema, key, entry["layers"])]}
        return entry

    def changes(self, before: dict | None, after: dict | None, compared: list[str] | None = None) -> DataFrame:
        """``diff_rows`` of two entries of a table; over one folder, of the rows that layers touch which only one has."""
        left, right = (self._read(e) if e else None for e in (before, after))
        left = left if left is not None else right.limit(0)
        right = right if right is not None else left.limit(0)
        key = (before or after)["key"]
        if before and after and before["path"] == after["path"]:
            a, b = version(before), version(after)
            alike = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            touched = left.select(key).limit(0)
            for path in (*a[alike:], *b[alike:]):
                touched = touched.union(self._layer(left.schema, key, path)[1])
            left, right = (df.join(touched, key, "left_semi").select(df.columns) for df in (left, right))
        return diff_rows(left, right, key, compared)

    def table(self, name: str) -> DataFrame:
        return self.working[name]

    def create(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A table of ``df``'s rows; nothing happens when it is there."""
        if name not in self.working:
            self.working[name], self.keys[name] = df, key or df.columns[0]

    def put(self, name: str, df: DataFrame) -> None:
        self.working[name] = df
        self.keys.setdefault(name, df.columns[0])

    def change(self, name: str, put: DataFrame, touched: DataFrame) -> None:
        """Rows of the keys of ``touched`` (key) go and the rows of ``put`` come, whose keys are touched too.

        They are written at once, so what follows does not compute them again; a commit adds them to the table.
        """
        df, key = self.working[name], self.keys[name]
        layer = self._written(name, df.schema, key, put, touched)
        if not layer["rows"]:
            return
        of, edits = self._edits.get(name, (None, []))
        edits = [*(edits if of is df else []), layer]
        if of is df and len(edits) > LAYERS:
            edits, df = [self._folded(name, df.schema, key, edits)], self._clean[name]
        known = of is self.working[name] or self._clean.get(name) is df
        self.working[name] = layered(df, *self._layer(df.schema, key, edits[-1]["path"]), key)
        if known:
            self._edits[name] = (self.working[name], edits)

    def drop(self, name: str) -> None:
        self.working.pop(name, None)
        self.keys.pop(name, None)

    def views(self) -> None:
        for name, df in self.working.items():
            df.createOrReplaceTempView(name)

    # transactions
    def begin(self) -> None:
        if self._snapshot is not None:
            raise RuntimeError("a transaction is open")
        self._snapshot = (dict(self.working), dict(self.keys), dict(self._edits))

    def rollback(self) -> None:
        if self._snapshot is not None:
            (self.working, self.keys, self._edits), self._snapshot = self._snapshot, None

    def end(self) -> None:
        self._snapshot = None

    # versions
    def dirty(self) -> bool:
        return self.working.keys() != self._clean.keys() or any(self._clean[n] is not df for n, df in self.working.items())

    def commit(self, message: str = "(no message)", author: str = "tidemark", merged: str | None = None, note: dict | None = None) -> str:
        """Write the tables that changed and publish; Conflict when the branch moved since it was read."""
        tables = {}
        for name, df in self.working.items():
            if self._clean.get(name) is df:
                tables[name] = self._base["tables"][name]
                continue
            if name in self._edits and self._edits[name][0] is df:
                entry = self._with_layers(name, self._base["tables"][name], self._edits[name][1])
                if sum(layer["rows"] for layer in entry["layers"]) <= PART * max(entry["seal"][0], 1):
                    tables[name] = entry
                    continue
                df = self._read(entry)
            path = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            kept = self.spark.read.schema(df.schema).parquet(path)  # its schema has no columns without nulls, so it follows from names and types
            n, total = seal_of(kept)
            tables[name] = {"path": path, "schema": json.loads(kept.schema.json()), "key": self.keys[name], "seal": [n, total]}
        if len(self._numbers(self.branch)) != self._base_n:
            raise Conflict(self.branch)
        made = self._publish(self._base["id"], author, message, tables, merged, note)
        self._point(self.branch, made, self._base_n)
        self._reload()
        return made

    def create_branch(self, name: str, commit: str | None = None) -> None:
        self._point(name, self.manifest(commit or self.head())["id"])

    def checkout(self, name: str) -> None:
        """Switch and reload; edits that were not committed are left behind."""
        self.head(name)
        self.branch = name
        self._reload()

    def merge(self, source: str) -> str:
        """Fast-forward the current branch to ``source``; the current head must be its ancestor."""
        target = self.head(source)
        mine = self.manifest(self.head())
        if not any(m["id"] == mine["id"] for m in itertools.takewhile(lambda m: m["ts"] >= mine["ts"], self.ancestors(target))):
            raise Conflict(f"{self.branch} is no ancestor of {source}")
        self._point(self.branch, target, len(self._numbers(self.branch)))
        self._reload()
        return target

    def merge_three_way(self, source: str, author: str = "tidemark") -> str:
        """Merge rows that one side changed since the latest common commit; Conflict when both changed a row differently.

        The commit has both heads as parents, so a later merge starts from here. A table that the
        source dropped goes if this side has not changed it. Edits that are not committed are an error.
        """
        if self.dirty():
            raise RuntimeError("there are edits that are not committed")
        head = self.manifest(self.head(source))
        base = self.common_ancestor(head["id"], self.head())
        for name in base["tables"].keys() - head["tables"].keys():
            if name in self.working and version(self._base["tables"][name]) == version(base["tables"][name]):
                self.drop(name)
        for name, entry in head["tables"].items():
            if name in base["tables"] and version(entry) == version(base["tables"][name]):
                continue
            their, key = self._read(entry), entry["key"]
            if name not in self.working:
                self.working[name], self.keys[name] = their, key
                continue
            old = base["tables"].get(name)
            t, o = self.changes(old, entry), self.changes(old, self._base["tables"][name])
            both = t.alias("t").join(o.alias("o"), F.col("t.key") == F.col("o.key")).where("NOT (t.kind = o.kind AND t.after_hash <=> o.after_hash)")
            if not both.isEmpty():
                raise Conflict(f"{name}: both sides changed a row")
            mine = self.working[name]
            fresh = their.join(t.select("key"), their[key].cast("string") == t["key"], "left_semi").select(mine.columns)
            self.change(name, fresh, t.select(F.col("key").cast(mine.schema[key].dataType).alias(key)))
        return self.commit(f"merge {source}", author, head["id"])

    def as_of(self, name: str, commit: str) -> DataFrame:
        return self._read(self.manifest(commit)["tables"][name])

    def as_of_time(self, name: str, ts: int) -> DataFrame:
        found = next((m for m in self.chain() if m["ts"] <= ts), None)
        if found is None:
            raise KeyError(f"no commit at {ts}")
        return self._read(found["tables"][name])

    def log(self, limit: int = 20) -> DataFrame:
        rows = [(m["id"][:12], m["author"], m["message"], time.strftime("%Y-%m-%d %H:%M:%S UTC", time.gmtime(m["ts"] // 10**9)), i) for i, m in enumerate(itertools.islice(self.chain(), limit))]
        return self.spark.createDataFrame(rows, "commit_id string, author string, message string, timestamp string, nth int")

    def branches(self) -> DataFrame:
        names = self.files.names(f"{self.path}/refs")
        return self.spark.createDataFrame([(n, self.head(n), n == self.branch) for n in names], "name string, head string, is_current boolean")

    def diff(self, a: str, b: str, compared: dict[str, list[str]] | None = None) -> DataFrame:
        """(table, key, kind, before_hash, after_hash) from commit or branch ``a`` to ``b``; tables of one folder and the same layers are skipped.

        Rows of a table named in ``compared`` are modified when one of its columns given there differs, of others when any does.
        """
        sides = [self.manifest(self.head(x) if self._numbers(x) else x)["tables"] for x in (a, b)]
        out = self.spark.createDataFrame([], "table string, key string, kind string, before_hash string, after_hash string")
        for name in sorted({*sides[0], *sides[1]}):
            x, y = (s.get(name) for s in sides)
            if x and y and version(x) == version(y):
                continue
            out = out.unionByName(self.changes(x, y, (compared or {}).get(name)).withColumn("table", F.lit(name)))
        return out

    def change_feed(self, commit: str, compared: dict[str, list[str]] | None = None) -> DataFrame:
        """What a commit changed, deletes too, against its parent; ``compared`` as in ``diff``."""
        return self.diff(self.manifest(commit)["parent"], commit, compared)
