"""SQL with version verbs and row changes: queries are Spark SQL on the working set, expressions are Spark's.

Statements that change rows give one row with their tag. Literals, quoted names and parentheses
are seen as such where a statement is taken apart; what is inside is left to Spark.
"""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import spark_type
from tidemark.operators import dml
from tidemark.plans.store import Store

VERB = re.compile(r"^\s*SELECT\s+vc_(\w+)\s*\(([^)]*)\)\s*;?\s*$", re.I)
AS_OF = re.compile(r"\b(\w+)\s+AS\s+OF\s+(?:COMMIT\s+'([0-9a-f]{64})'|TIMESTAMP\s+(?:'([^']*)'|(\d+)))", re.I)
WHOLE_VERSION = re.compile(rf"^\s*SELECT\s+\*\s+FROM\s+{AS_OF.pattern}\s*;?\s*$", re.I)
CREATE = re.compile(r"^CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)$", re.I | re.S)
DROP = re.compile(r"^DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(\w+)$", re.I)
INSERT = re.compile(r"^INSERT\s+INTO\s+(\w+)\s*(?:\(([^()]*)\)\s*)?((?:VALUES|SELECT|WITH|FROM|TABLE)\b.*)$", re.I | re.S)
ON_CONFLICT = re.compile(r"\bON\s+CONFLICT\s*(?:\(\s*(\w+)\s*\)\s*)?DO\s+(NOTHING|UPDATE\s+SET\b)", re.I)
UPDATE = re.compile(r"^UPDATE\s+(\w+)\s+SET\b(.*)$", re.I | re.S)
DELETE = re.compile(r"^DELETE\s+FROM\s+(\w+)\s*(?:WHERE\b(.*))?$", re.I | re.S)
TRANSACTION = re.compile(r"^(BEGIN|START\s+TRANSACTION|COMMIT|END|ROLLBACK)(?:\s+(?:WORK|TRANSACTION))?$", re.I)


def masked(text: str) -> str:
    """``text`` with all that is quoted or in parentheses blanked, of the same length."""
    flat = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", lambda m: "\x01" * len(m[0]), text)
    depth, out = 0, []
    for c in flat:
        depth -= c == ")" and depth > 0
        out.append("\x01" if depth else c)
        depth += c == "("
    return "".join(out)


def listed(text: str) -> list[str]:
    """The parts of ``text`` between commas that are neither quoted nor in parentheses."""
    cuts = [-1, *(i for i, c in enumerate(masked(text)) if c == ","), len(text)]
    return [text[a + 1 : b].strip() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def assignments(text: str, df: DataFrame) -> dict[str, str]:
    """Column and expression of each ``column = expression``."""
    found = {}
    for part in listed(text):
        name, equals, value = part.partition("=")
        name = name.strip().strip('`"')
        if not equals or name not in df.columns:
            raise ValueError(f"no assignment to a column: {part}")
        found[name] = value.strip()
    return found


def nanoseconds(text: str) -> int:
    """A time as nanoseconds since 1970, UTC unless the text names an offset; digits are such nanoseconds."""
    if text.isdigit():
        return int(text)
    at = datetime.fromisoformat(text)
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    since = at - datetime(1970, 1, 1, tzinfo=UTC)
    return ((since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds) * 1_000


def known(store: Store, name: str) -> DataFrame:
    if name not in store.working:
        raise KeyError(f"no table {name}")
    return store.table(name)


def computed(store: Store, table: str, exprs: dict[str, str], args: Any) -> DataFrame:
    """The table with columns more, in which parameters are bound."""
    store.views()
    more = "".join(f", ({text}) AS {name}" for name, text in exprs.items())
    return store.spark.sql(f"SELECT *{more} FROM {table}", args=args or {})


def create_table(store: Store, name: str, columns: str) -> DataFrame:
    """An empty table keyed by its first column; nothing happens when it is there."""
    given = [c for c in listed(columns) if not re.match(r"(PRIMARY|UNIQUE|FOREIGN|CHECK|CONSTRAINT|KEY|INDEX)\b", c, re.I)]
    fields = []
    for c in given:
        label, _, rest = c.partition(" ")
        kind = re.match(r"\s*(\w*(?:\s*\([^)]*\))?)", rest)[1]
        fields.append(f"`{label.strip('`\"')}` {spark_type(kind)}")
    store.create(name, store.spark.createDataFrame([], ", ".join(fields)))
    return tag(store, "CREATE TABLE")


def insert(store: Store, name: str, columns: str | None, body: str, args: Any) -> DataFrame:
    """New rows; a known key is overwritten unless ON CONFLICT says otherwise. A statement that gives a key twice is an error."""
    df, key = known(store, name), store.keys[name]
    conflict = ON_CONFLICT.search(masked_words(body))
    rule = body[conflict.end() :].strip() if conflict else ""
    target = ON_CONFLICT.match(body, conflict.start())[1] if conflict else None
    store.views()
    new = store.spark.sql(body[: conflict.start()] if conflict else body, args=args or {})
    names = [c.strip().strip('`"') for c in columns.split(",")] if columns else df.columns[: len(new.columns)]
    if len(names) != len(new.columns) or not set(names) <= set(df.columns) or len(set(names)) < len(names) or key not in names:
        raise ValueError(f"{name}: columns {names} do not fit {len(new.columns)} values and the key {key}")
    new = new.toDF(*names).select(*[F.col(c).cast(df.schema[c].dataType) for c in names])
    if not new.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{name}: a key is null or given twice")
    full = new.select(*[F.col(c) if c in names else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    if not conflict:
        rows = full
    elif target not in (None, key):
        raise ValueError(f"the conflict target {target} is not the key {key}")
    elif conflict[2].upper() == "NOTHING":
        rows = full.join(df.select(key), key, "left_anti").select(df.columns)
    else:
        sets = {}
        for c, text in assignments(rule, df).items():
            text = re.sub(r"\bEXCLUDED\s*\.\s*(\w+)", lambda m: m[1] if m[1] == key else f"excluded_{m[1]}", text, flags=re.I)
            sets[c] = F.expr(text).cast(df.schema[c].dataType)
        if key in sets:
            raise ValueError(f"{name}: the key of a row that is there stays")
        rows = dml.upsert(df.join(new.select(key), key, "left_semi").select(df.columns), full, key, "update", sets).select(df.columns)
    store.change(name, rows, rows.select(key))
    return tag(store, "INSERT", new)


def masked_words(text: str) -> str:
    """``text`` with all that is quoted blanked and parentheses kept."""
    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", lambda m: "\x01" * len(m[0]), text)


def update(store: Store, name: str, rest: str, args: Any) -> DataFrame:
    df = known(store, name)
    where = re.search(r"\bWHERE\b", masked(rest), re.I)
    sets = assignments(rest[: where.start()] if where else rest, df)
    exprs = {"_hit": rest[where.end() :] if where else "true"} | {f"_set{i}": text for i, text in enumerate(sets.values())}
    both = computed(store, name, exprs, args)
    values = {c: F.col(f"_set{i}").cast(df.schema[c].dataType) for i, c in enumerate(sets)}
    key, hit = store.keys[name], both.where("_hit")
    if key in values:
        store.put(name, dml.update(both, values, F.col("_hit"), key).select(df.columns))
    else:
        store.change(name, dml.update(hit, values).select(df.columns), hit.select(key))
    return tag(store, "UPDATE", hit)


def delete(store: Store, name: str, where: str | None, args: Any) -> DataFrame:
    """Rows for which the condition holds go; without a condition all do."""
    df = known(store, name)
    hit = computed(store, name, {"_hit": where or "true"}, args).where("_hit")
    store.change(name, df.where(F.lit(False)), hit.select(store.keys[name]))
    return tag(store, "DELETE", hit)


def tag(store: Store, word: str, rows: DataFrame | None = None) -> DataFrame:
    """One row (command); the rows are counted only when it is asked for."""
    if rows is None:
        return store.spark.createDataFrame([(word,)], "command string")
    return rows.agg(F.concat(F.lit(f"{word} "), F.count(F.lit(1)).cast("string")).alias("command"))


def change(store: Store, text: str, args: Any) -> DataFrame | None:
    """Carry out a statement that is not a query; None for a query."""
    text = text.strip().rstrip(";").strip()
    if m := CREATE.match(text):
        return create_table(store, m[1], m[2])
    if m := DROP.match(text):
        store.drop(m[1])
        return tag(store, "DROP TABLE")
    if m := INSERT.match(text):
        return insert(store, m[1], m[2], m[3], args)
    if m := UPDATE.match(text):
        return update(store, m[1], m[2], args)
    if m := DELETE.match(text):
        return delete(store, m[1], m[2], args)
    if m := TRANSACTION.match(text):
        word = m[1].split()[0].upper()
        {"BEGIN": store.begin, "START": store.begin, "COMMIT": store.end, "END": store.end, "ROLLBACK": store.rollback}[word]()
        return tag(store, {"START": "BEGIN", "END": "COMMIT"}.get(word, word))
    return None


def run(store: Store, text: str, args: dict[str, Any] | list | None = None) -> DataFrame:
    """One statement: ``SELECT vc_commit('m')`` and the like, a change of rows or tables, or a query.

    In a query ``t AS OF COMMIT 'id'`` and ``t AS OF TIMESTAMP 'time'`` read versions; a whole
    version and nothing else comes in the order of its columns.
    """
    if m := VERB.match(text):
        verb, given = m[1].lower(), re.findall(r"'((?:[^']|'')*)'|(\d+)", m[2])
        values = [a.replace("''", "'") if not b else int(b) for a, b in given]
        done = {
            "commit": store.commit, "branch": store.create_branch, "branch_from": store.create_branch, "checkout": store.checkout, "merge": store.merge, "merge_three_way": store.merge_three_way, "log": store.log, "diff": store.diff, "current_branch": lambda: store.branch, "branches": store.branches
        }[verb](*values)
        return done if isinstance(done, DataFrame) else store.spark.createDataFrame([(str(done) if done is not None else verb,)], f"vc_{verb} string")
    if (done := change(store, text, args)) is not None:
        return done
    store.views()

    def version(m: re.Match) -> str:
        if m[2]:
            df, label = store.as_of(m[1], m[2]), m[2][:12]
        else:
            at = nanoseconds(m[3] if m[3] is not None else m[4])
            df, label = store.as_of_time(m[1], at), f"at_{at}"
        df.createOrReplaceTempView(f"{m[1]}_{label}")
        return f"{m[1]}_{label}"

    found = store.spark.sql(AS_OF.sub(version, text), args=args or {})
    return found.orderBy(*found.columns) if WHOLE_VERSION.match(text) else found


def run_once(store: Store, key: str, text: str, message: str = "(no message)", args: dict[str, Any] | list | None = None) -> DataFrame:
    """The result of a statement that is carried out and committed once for each key; again, its stored result.

    The key is part of the commit's manifest, and which commit to look for is written before it is
    made, so a process that ends anywhere between leaves either nothing done or a result to find.
    """
    claims = f"{store.path}/once/{hashlib.sha256(key.encode()).hexdigest()}"
    for name in store.files.names(claims):
        branch, n, schema = store.files.read(f"{claims}/{name}").split("\n", 2)
        made = store.at_number(branch, int(n))
        if made and made.get("note", {}).get("once") == key:
            return store.spark.read.schema(schema).parquet(made["note"]["rows"])
    done = run(store, text, args)
    rows = f"{store.path}/once-rows/{hashlib.sha256(key.encode()).hexdigest()}-{store.clock()}"
    done.write.parquet(rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema)
    store.files.create(f"{claims}/{store.clock()}", f"{store.branch}\n{store.base_number()}\n{schema}")
    store.commit(message, note={"once": key, "rows": rows})
    return store.spark.read.schema(schema).parquet(rows)
