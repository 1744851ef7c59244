"""Readers, writers, backups."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.diff import seal_of
from tidemark.plans.paths import Files
from tidemark.plans.store import Store, version


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header required, every column text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Columns are the union of all documents' keys; a missing key is null."""
    return spark.read.json(path)


def read_parquet(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(c).cast("string") for c in df.columns]) if as_text else df


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Any database with a JDBC driver on the class path; give partitionColumn and bounds to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def list_tables(spark: SparkSession, url: str, **options: str) -> list[str]:
    """Tables and views of a database as schema.name, from its driver's catalogue."""
    given = spark._jvm.java.util.Properties()
    for k, v in options.items():
        given.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        kinds = spark._sc._gateway.new_array(spark._jvm.String, 2)
        kinds[0], kinds[1] = "TABLE", "VIEW"
        rows, found = connection.getMetaData().getTables(None, None, "%", kinds), []
        while rows.next():
            schema, name = rows.getString("TABLE_SCHEM"), rows.getString("TABLE_NAME")
            found.append(f"{schema}.{name}" if schema else name)
        return sorted(found)
    finally:
        connection.close()


READERS = {"csv": read_csv, "ndjson": read_ndjson, "json": read_ndjson, "parquet": read_parquet, "snowflake": read_parquet, "mongodb": read_ndjson, "postgresql": read_jdbc, "mysql": read_jdbc, "jdbc": read_jdbc}


def federate(spark: SparkSession, sources: dict[str, tuple[str, str, dict[str, str]]]) -> None:
    """Each source (reader, path or URL, options) as a view of its name, so that one query joins over all; ``local.`` before a name goes."""
    for name, (kind, path, options) in sources.items():
        READERS[kind](spark, path, **options).createOrReplaceTempView(name.removeprefix("local."))


#: Spellings of MySQL's column types and quotes, and what stands for them (fixed values).
MYSQL_DDL = {"INT UNSIGNED": "BIGINT", "TINYINT(1)": "BOOLEAN", "DATETIME": "TIMESTAMP", "`": '"'}


def mysql_ddl(text: str) -> str:
    """A MySQL definition with types and quotes as they are here; what is in single quotes stays."""
    known = re.compile("|".join(["'(?:[^']|'')*'", *(re.escape(k) for k in MYSQL_DDL)]))
    return known.sub(lambda m: MYSQL_DDL.get(m[0], m[0]), text)


def migrate(store: Store, kind: str, path: str, into: str, key: str, **options: str) -> dict[str, int]:
    """Read a source into a table of the store; a repeat changes nothing.

    Rows without key are set aside and counted; of rows with one key, that with the smallest hash
    is taken; keys that are there stay as they are. The tables are committed by the caller.
    """
    source = READERS[kind](store.spark, path, **options)
    rows = source.where(F.col(key).isNotNull())
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.xxhash64(*[F.col(c) for c in rows.columns]))
    rows = rows.groupBy(F.col(key).alias("_key")).agg(first.alias("row")).select("row.*")
    store.create(into, rows.limit(0), key)
    before = store.table(into)
    new = rows.join(before.select(key), key, "left_anti").select(rows.columns)
    counts = source.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(key)).alias("keyed")).first()
    inserted = new.count()
    store.put(into, before.unionByName(new, allowMissingColumns=True))
    return {"read": counts.n, "inserted": inserted, "set_aside": counts.n - counts.keyed}


def kept(spark: SparkSession, path: str, df: DataFrame, codec: str) -> dict:
    """Write rows; their number and the sum of their hashes, as they are read again."""
    df.write.option("compression", codec).parquet(path)
    rows, seal = seal_of(spark.read.schema(df.schema).parquet(path))
    return {"rows": rows, "seal": seal, "schema": df.schema.json()}


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str, name: str, codec: str = "zstd", commit: str | None = None) -> None:
    """Each table as Parquet and, last, a manifest with its rows and the sum of its rows' hashes."""
    entries = {table: kept(spark, f"{path}/{name}/{table}", df, codec) for table, df in tables.items()}
    Files(spark).create(f"{path}/{name}/MANIFEST.json", json.dumps({"name": name, "created": time.time_ns(), "commit": commit, "tables": entries}))


def backup_commit(store: Store, commit: str, path: str, codec: str = "zstd") -> str:
    """A backup of the tables as they were at a commit, whatever the working set holds; its name."""
    tables = {t: store.as_of(t, commit) for t in store.manifest(commit)["tables"]}
    backup(store.spark, tables, path, name := f"commit-{commit[:12]}", codec, commit)
    return name


def backup_changes(store: Store, base: str, commit: str, path: str, codec: str = "zstd") -> str:
    """A backup of what changed from the commit of the backup ``base`` to ``commit``: rows that came or changed, keys that went."""
    spark, old = store.spark, manifest(store.spark, path, base)
    was, now, entries = store.manifest(old["commit"])["tables"], store.manifest(commit)["tables"], {}
    name = f"changes-{old['commit'][:12]}-{commit[:12]}"
    for table, entry in now.items():
        if table in was and version(was[table]) == version(entry):
            entries[table] = {"same": True, "key": entry["key"]}
            continue
        after, key = store.as_of(table, commit), entry["key"]
        fresh = table not in was or was[table]["schema"] != entry["schema"] or was[table]["key"] != key
        changed = store.changes(None if fresh else was[table], entry)  # another schema or key: all rows anew
        came = changed.where("kind <> 'removed'").select("key")
        rows = after.join(came, after[key].cast("string") == came["key"], "left_semi")
        entries[table] = {
            "same": False, "new": fresh, "key": key, "put": kept(spark, f"{path}/{name}/{table}/put", rows, codec),
            "gone": kept(spark, f"{path}/{name}/{table}/gone", changed.where("kind = 'removed'").select("key"), codec),
            "after": dict(zip(("rows", "seal"), seal_of(after), strict=True)),
        }
    Files(spark).create(f"{path}/{name}/MANIFEST.json", json.dumps({"name": name, "created": time.time_ns(), "commit": commit, "base": base, "tables": entries}))
    return name


def manifest(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(Files(spark).read(f"{path}/{name}/MANIFEST.json"))


def checked(spark: SparkSession, path: str, table: str, entry: dict) -> DataFrame:
    df = spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(path)
    verify(df, table, entry)
    return df


def verify(df: DataFrame, table: str, entry: dict) -> None:
    if seal_of(df) != (entry["rows"], entry["seal"]):
        raise ValueError(f"{table}: not the rows of the backup")


def restore(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    """Tables of a backup, of changes together with what they are based on; an error when rows are not those that were written."""
    found, about = {}, manifest(spark, path, name)
    base = restore(spark, path, about["base"]) if about.get("base") else {}
    for table, entry in about["tables"].items():
        at = f"{path}/{name}/{table}"
        if "same" not in entry:
            found[table] = checked(spark, at, table, entry)
        elif entry["same"]:
            found[table] = base[table]
        else:
            put, key = checked(spark, f"{at}/put", table, entry["put"]), entry["key"]
            gone = checked(spark, f"{at}/gone", table, entry["gone"])
            if not entry["new"]:
                out = gone.unionByName(put.select(put[key].cast("string").alias("key")))
                put = base[table].join(out, base[table][key].cast("string") == out["key"], "left_anti").unionByName(put)
            verify(put, table, entry["after"])
            found[table] = put
    return found


def finished(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of the backups that were finished, newest first."""
    files = Files(spark)
    names = [n for n in files.names(path) if "MANIFEST.json" in files.names(f"{path}/{n}")]
    return sorted((manifest(spark, path, n) for n in names), key=lambda m: (m["created"], m["name"]), reverse=True)


def backups(spark: SparkSession, path: str) -> list[str]:
    """Names of the backups that were finished, newest first."""
    return [m["name"] for m in finished(spark, path)]


def expire(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete all finished backups but the newest ``keep`` and those that they are based on; the names of those that went."""
    found = finished(spark, path)
    base = {m["name"]: m.get("base") for m in found}
    held: set[str] = set()
    for m in found[:keep]:
        at = m["name"]
        while at and at not in held:
            held.add(at)
            at = base.get(at)
    gone = [m["name"] for m in found if m["name"] not in held]
    for name in gone:  # the manifest first: a half-deleted backup is not finished
        Files(spark).delete(f"{path}/{name}/MANIFEST.json")
        Files(spark).delete(f"{path}/{name}")
    return gone
