"""Near copies by the exact similarity of shingle sets: SimHash candidates, verified, and a prefix filter for the rest.

First the grid of ``simhash`` on fingerprints of 256 bits links texts whose fingerprints differ in
at most ``DISTANCE`` bits; these links span large groups of copies without pairing their members
up. Each link is verified by the Jaccard similarity of the whole sets of shingles. Two texts alike
to 0.8 differ in some 39 bits and may share no cell, so a second pass finds what the first left
apart, without losses:

Two sets whose similarity is at least 4/5 share one of their first |s| - ceil(4|s|/5) + 1 members
in any order that is the same for all sets. Each shingle of each text is counted, in one of
``BUCKETS`` buckets, and the order is by the count of a shingle's bucket, so that rare ones make
the prefixes. Any order finds all pairs that the bound ``FAR`` below lets pass; it decides the work.
Where the shared member stands bounds the overlap, and sizes bound it too. So do the parities of
256 buckets of members: they differ in no more buckets than members are in one set alone, for
pairs alike to 0.8 a ninth of both sizes. Of sets of ``SMALL`` or more members the fingerprints
must differ in at most ``FAR`` bits as well, which such a pair exceeds with a probability below
10**-8. What is left is verified. Only texts of different groups are paired: pairs that are linked
change nothing.

Shingles are 64-bit hashes of their words; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, only, small_batches, staged
from tidemark.llm.simhash import WORDS, components, majority, near_links
from tidemark.llm.textnum import BASE, chunks, mixed, word_hashes

#: Differing bits, of 256, of a candidate: texts alike to 0.8 have fewer in 19 of 20 cases.
DISTANCE = 48
#: Differing bits beyond which no two sets of so many members are alike to 0.8: 39 bits expected, 5.8 their deviation.
FAR, SMALL = 74, 64
#: Buckets in which shingles are counted, by their first bits, and the parts in which counts are sent.
BUCKETS, PARTS = 1 << 20, 64


def shingle_sets(texts: list[str | None], shingle: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; fewer words than a shingle are one, so are none."""
    for _, raw, starts in chunks(texts):
        h, ahead = word_hashes(np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw), starts)
        n = max(0, len(h) - shingle + 1)
        g = np.zeros(n, dtype=np.uint64)
        for j in range(shingle):
            g = g * BASE + h[j : j + n]
        g = mixed(g)
        for a, b in zip(ahead[:-1].tolist(), ahead[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(g[a : b - shingle + 1])
            else:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = one * BASE + x
                yield mixed(np.array([one], dtype=np.uint64))


def in_turn(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sets of a column, few texts in memory at once."""
    for i in range(0, len(texts), 64):
        yield from shingle_sets(texts.slice(i, 64).to_pylist(), shingle)


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def shingle_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """Members that the sets of all texts of (text) have in each bucket: a count for each, whole tables are read."""
    size = BUCKETS // PARTS

    def sent(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, counts in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "counts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for found in in_turn(batch.column("text"), shingle):
                np.add.at(counts, bucket(found), 1)
        yield from sent({i: part for i, part in enumerate(counts.reshape(PARTS, size)) if part.any()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for i, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                sums.setdefault(i, np.zeros(size, dtype=np.int64))
                sums[i] += np.frombuffer(counts.as_buffer(), dtype=np.int64)
        yield from sent(sums)

    kind = "part int, counts binary"
    total = np.zeros((PARTS, size), dtype=np.int64)
    for r in docs.select("text").mapInArrow(each, kind).repartition("part").mapInArrow(summed, kind).collect():
        total[r.part] = np.frombuffer(r.counts, dtype=np.int64)
    return total.ravel()


def prefixes(docs: DataFrame, shingle: int, counts: np.ndarray) -> DataFrame:
    """(id, size, fp, odd, members) for each text of (id, text): size of the set, wide fingerprint, parities of buckets, first members."""
    rank = np.unique(counts, return_inverse=True)[1].astype(np.int32)
    salts = np.arange(WORDS, dtype=np.uint64) * BASE

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, odd, members = [], [], [], []
            for s in in_turn(batch.column("text"), shingle):
                n = len(s)
                sizes.append(n)
                words.append(np.array([majority(mixed(s + salt)) for salt in salts], dtype=np.uint64).view(np.int64))
                odd.append(np.packbits(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64))
                s = s[np.argsort(rank[bucket(s)], kind="stable")]
                members.append(s[: n - -(-4 * n // 5) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(members, pa.list_(pa.int64()))],
                names=["id", "size", "fp", "odd", "members"],
            )

    return docs.mapInArrow(each, "id long, size long, fp array<long>, odd array<long>, members array<long>")


def alike(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of ids with a Jaccard similarity of at least 4/5."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (in_turn(batch.column(c), shingle) for c in ("ta", "tb"))
            ok = []
            for s, t in zip(left, right, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(9 * both >= 4 * (len(s) + len(t)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = staged(pairs.distinct(), "pairs")
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair-ids")
    texts = staged(only(docs, ids, "id"), "pair-texts")
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    met = met.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    found = staged(met.select("a", "b", "ta", "tb").mapInArrow(each, "a long, b long").distinct(), "alike")
    for df in (pairs, ids, texts):
        dropped(df)
    return found


WORD_COLS, ODD_COLS = [f"f{w}" for w in range(WORDS)], [f"o{w}" for w in range(4)]


def differing(columns: list[str], a: str, b: str) -> str:
    """SQL: bits in which ``columns`` of row ``a`` and row ``b`` differ."""
    return " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in columns)


def crossing(placed: DataFrame) -> DataFrame:
    """(root, other, i, j), root < other: groups with a shared member that may hold a pair, and a text of each.

    The bits that all texts of a group have set, and that any has, bound the distance of its
    nearest text. Members of one group are never paired up.
    """
    bits = [f(w).alias(f"{kind}{w}") for w in [*WORD_COLS, *ODD_COLS] for kind, f in (("all_", F.bit_and), ("any_", F.bit_or))]
    sizes = [F.min("size").alias("lo"), F.max("size").alias("hi"), F.max("behind").alias("behind"), F.min("id").alias("id")]
    sides = staged(placed.groupBy("member", "root").agg(*sizes, *bits), "sides")
    apart = lambda of: " + ".join(f"bit_count(x.all_{w} & ~y.any_{w}) + bit_count(y.all_{w} & ~x.any_{w})" for w in of)
    both = f"""x.member = y.member AND x.root < y.root AND 4 * x.lo <= 5 * y.hi AND 4 * y.lo <= 5 * x.hi
        AND 9 * least(x.behind, y.behind) >= 4 * (x.lo + y.lo) AND 9 * ({apart(ODD_COLS)}) <= x.hi + y.hi
        AND (least(x.lo, y.lo) < {SMALL} OR {apart(WORD_COLS)} <= {FAR})"""
    cross = sides.alias("x").join(sides.alias("y"), F.expr(both))
    cross = cross.select(F.expr("x.root").alias("root"), F.expr("y.root").alias("other"), F.struct(F.expr("x.id").alias("i"), F.expr("y.id").alias("j")).alias("p"))
    cross = staged(cross.groupBy("root", "other").agg(F.min("p").alias("p")).select("root", "other", "p.*"), "cross")
    dropped(sides)
    return cross


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root) of ids in groups of several: the smallest id reachable by pairs of a similarity of at least 4/5.

    The similarity is that of the sets of shingles. Rows with a null id take no part; rows that
    repeat an id are linked with what any of them is alike to. Null, empty and blank texts are
    alike, as are texts of fewer words than a shingle with the same words; very long texts are
    compared whole. Other columns are not looked at. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    own = staged(prefixes(docs, shingle, shingle_counts(docs, shingle)), "prefixes")

    # by fingerprints
    nodes = staged(own.groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "nodes")
    links = near_links(nodes.select("rep", "fp"), DISTANCE, wide=True)
    equal = own.select("id", "fp").join(nodes.where("rep < last"), "fp").where("id <> rep").select(*ordered("rep", "id"))
    first = alike(docs, links.select(*ordered("a", "b")).union(equal), shingle)

    # by shared members, of groups that are apart
    each = own.select("id", "size", F.posexplode("members").alias("at", "member"))
    again = staged(each.groupBy("member").count().where("count > 1").select("member"), "recurring")
    met = staged(each.select("member", "id", "size", (F.col("size") - F.col("at")).alias("behind")).join(again, "member", "left_semi"), "met")
    bits = [F.element_at(c, w + 1).alias(f"{c[0]}{w}") for c in ("fp", "odd") for w in range(4)]
    sketch = ["id", "size", *WORD_COLS, *ODD_COLS]
    texts = staged(own.select("id", "size", *bits).dropDuplicates(sketch), "sketches")
    placed = staged(met.join(rooted(texts.drop("size"), components(first)), "id"), "placed")
    cross = crossing(placed)
    for df in (own, again, met):
        dropped(df)
    # one text of each of two groups: most groups that belong together are linked by them
    second = first.union(alike(docs, cross.select(*ordered("i", "j")), shingle))
    # every text of two that are still apart, from the smaller group to the larger
    apart = staged(cross.select("root", "other"), "apart")
    for df in (placed, cross):
        dropped(df)
    mine = staged(rooted(texts, components(second)), "rooted")
    now = mine.select(F.col("id").alias("root"), F.col("root").alias("now")).distinct()
    for c in ("root", "other"):  # groups may have become one since
        apart = apart.join(now.withColumnRenamed("root", c), c).drop(c).withColumnRenamed("now", c)
    apart = apart.where("root <> other").select(F.least("root", "other").alias("root"), F.greatest("root", "other").alias("other")).distinct()
    sizes = mine.groupBy("root").count()
    for c in ("root", "other"):
        apart = apart.join(sizes.select(F.col("root").alias(c), F.col("count").alias(f"n_{c}")), c)
    swap = F.col("n_root") > F.col("n_other")
    apart = staged(apart.select(F.when(swap, F.col("other")).otherwise(F.col("root")).alias("root"), F.when(swap, F.col("root")).otherwise(F.col("other")).alias("other")), "apart")
    p = mine.join(apart, "root").select(F.col("other").alias("root"), F.struct(*sketch).alias("p"))
    fits = f"""4 * greatest(p.size, size) <= 5 * least(p.size, size) AND 9 * ({differing(ODD_COLS, "p.", "")}) <= p.size + size
        AND (least(p.size, size) < {SMALL} OR {differing(WORD_COLS, "p.", "")} <= {FAR})"""
    third = second.union(alike(docs, p.join(mine, "root").where(fits).select(*ordered("p.id", "id")).where("a < b"), shingle))
    for df in (texts, mine, apart):
        dropped(df)
    return components(third)


def one_of_each(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near copies, and all rows without id."""
    gone = near_copies(docs, shingle, id_col, text_col).where("id <> root").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
