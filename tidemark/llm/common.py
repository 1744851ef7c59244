"""What several corpus operators share: reading tables, staging results, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.paths import scratch as shared_dir

#: ASCII white space, the word separator of every operator here.
BLANK = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on this session hands Python workers at most ``size`` of rows at once, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: A key with more than one in so many rows of a table is hot; there are fewer such keys than that.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, which ``right`` has once each, with the number ``n`` of its rows in ``left``.

    Rows of a hot key are dealt over several tasks by a salt from their other columns, and its row
    of ``right`` is repeated for each salt. Hot keys are fewer than ``HOT_SHARE`` by definition, so
    they are broadcast. ``right`` is a written table, as it is read twice; ``n`` is not returned.
    """
    limit = max(300, (right.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hubs = right.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_parts"))
    right = right.drop("n")
    if hubs.isEmpty():
        return left.join(right, key, how)
    own = F.hash(*[F.col(c) for c in left.columns if c != key])
    salted = left.join(F.broadcast(hubs), key, "left").withColumn("_salt", F.coalesce(F.pmod(own, F.col("_parts")), F.lit(0))).drop("_parts")
    copies = right.join(F.broadcast(hubs), key, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing before it."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that are broadcast at most, 16 MB of them; more are dealt by a shuffle.
FEW_KEYS = 1_000_000


def only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the distinct ``keys`` of one column, which are counted: few ones are broadcast."""
    return df.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, key, "left_semi")


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``staged`` table once all that is made of it is written."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the built-in fast path; it gives the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold of a labelled row (null ids: fold of '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
