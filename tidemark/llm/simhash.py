"""SimHash near-dedup: a grid range-join on segment bit counts, then exact verification.

A fingerprint is mapped to the bit counts of its segments of two bits, 32 in each word of 64 bits.
A count is written in unary in the segment's place (00, 01, 11), so the Manhattan distance of two
such vectors is the number of bits in which these words differ. It never exceeds the Hamming
distance of the fingerprints: it is the filter, and what passes is verified on the fingerprints.

The segments of one word are dealt to ``distance + agree`` groups. Of two fingerprints within
``distance`` the counts agree on all of some ``agree`` groups, so the grid has a cell for each
choice of ``agree`` groups and vector of counts on them, and only rows of a cell meet; no link is
lost. More groups mean more and finer cells: ``agree`` follows from the number of fingerprints, so
that chance meetings do not grow with the table as its square.

Equal fingerprints become one row first. A cell with more than ``BLOCK`` rows is cut into blocks,
and each two of its blocks meet in a task of their own. A task returns the links that connect its
rows, fewer than it has rows, not all pairs; the components of these links are those of all.

Texts alike in a share of their shingles differ in far more bits than a grid without losses can
take: at a similarity of 0.8, in some 15 % of them. For these the fingerprint has ``WORDS`` words,
and the grid has ``WIDE_CELLS`` cells, each of ``WIDE_SEGMENTS`` segments at fixed places. What
meets is verified by the Manhattan and the Hamming distance again. Such links are candidates: see
``near``, which verifies them on the shingles and finds the pairs that no cell brought together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, hot_join, small_batches, staged, table

SEGMENTS = 32
#: Words of a wide fingerprint, cells of its grid and segments of a cell.
WORDS, WIDE_CELLS, WIDE_SEGMENTS = 4, 16, 11
#: Fingerprints of a cell that meet in one task at most, from each of two blocks.
BLOCK = 4096
#: Cells of one block each meet together, some so many rows at once, as most are small; greater cells have groups of their own.
BIN_ROWS = 16384
#: Rows of a block that are held against another block at once.
STRIP = 64
#: Chance meetings that weigh as much as putting a fingerprint into one more cell.
WEIGHT = 64
#: The even bits of a word: the lower ones of its segments.
EVEN = 0x5555555555555555
SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a whole text, A-Z lower-cased; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype="<u8", count=n)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half the hashes; none: 0. Any number of hashes in bounded memory."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64 bits as a long. Null texts count as empty; texts are whole, a few megabytes of them at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((majority(shingle_hashes(t.as_py(), shingle)) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(each, f"id {kind}, fp long")


def unary(fp: Column) -> Column:
    """The counts of the segments of a column of 64 bits, each in unary in its segment's place."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def unary_array(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(EVEN), fp >> np.uint64(1) & np.uint64(EVEN)
    return low | high | (low & high) << np.uint64(1)


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def groups_of(n: int) -> list[int]:
    """Masks of the bits of ``n`` groups that the segments of a word are dealt to in turn."""
    return [sum(3 << 2 * s for s in range(g, SEGMENTS, n)) for g in range(n)]


def fineness(rows: int, distance: int) -> int:
    """``agree`` with the least cost a row: cells that it is put into, and chance meetings in them."""
    cost = lambda a: WEIGHT * comb(distance + a, a) + rows * comb(distance + a, a) * 0.375 ** (SEGMENTS * a / (distance + a))
    return min(range(2, 6), key=cost)


def cells_of(counts: Column, distance: int, agree: int) -> list[Column]:
    """The grid cells of a column of counts, one for each choice of ``agree`` groups, as hashes of choice and counts."""
    chosen = combinations(groups_of(distance + agree), agree)
    return [F.xxhash64(F.lit(c), counts.bitwiseAND(F.lit(signed(sum(masks))))) for c, masks in enumerate(chosen)]


def wide_masks() -> list[list[int]]:
    """For each cell of the wide grid its bits in each word: ``WIDE_SEGMENTS`` segments at places that a fixed seed has dealt."""
    dealt, r = [], np.random.default_rng(SEED)
    while len(dealt) < WIDE_CELLS * WIDE_SEGMENTS:
        dealt += r.permutation(WORDS * SEGMENTS).tolist()
    found = []
    for c in range(WIDE_CELLS):
        masks = [0] * WORDS
        for at in dealt[c * WIDE_SEGMENTS : (c + 1) * WIDE_SEGMENTS]:
            masks[at // SEGMENTS] |= 3 << 2 * (at % SEGMENTS)
        found.append(masks)
    return found


def wide_put(nodes: DataFrame) -> DataFrame:
    """(rep, cell) of nodes (rep, fp) in the wide grid."""
    counts = [f"u{w}" for w in range(WORDS)]
    mine = nodes.select("rep", *[unary(F.element_at("fp", w + 1)).alias(c) for w, c in enumerate(counts)])
    kinds = ", ".join(f"{c}: bigint" for c in counts)
    masks = F.from_json(F.lit(json.dumps([{"c": i} | dict(zip(counts, map(signed, m), strict=True)) for i, m in enumerate(wide_masks())])), f"array<struct<c: int, {kinds}>>")
    return mine.select("rep", F.explode(F.transform(masks, lambda m: F.xxhash64(m["c"], *[F.col(c).bitwiseAND(m[c]) for c in counts]))).alias("cell"))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``a`` and each row of ``b``, of one word or several."""
    if a.ndim == 1:
        return np.bitwise_count(a[:, None] ^ b[None, :])
    total = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for w in range(1, a.shape[1]):
        total += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return total


def within(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of ``a`` and ``b`` that differ in at most ``distance`` bits; ``ua`` and ``ub`` are their counts in unary."""
    r, c = np.nonzero(differing(ua, ub) <= distance)  # the lower bound
    ok = np.zeros(len(r), dtype=bool)
    for i in range(0, len(r), 1 << 16):
        part = slice(i, i + (1 << 16))
        bits = np.bitwise_count(a[r[part]] ^ b[c[part]])
        ok[part] = (bits if a.ndim == 1 else bits.sum(axis=1)) <= distance
    return r[ok], c[ok]


def spanning_links(a: np.ndarray, b: np.ndarray, distances: list[int], same: bool) -> list[tuple[int, int]]:
    """Links (position, position) of ``a`` followed by ``b`` that connect what is within the last of ``distances``; a and b the same: of a.

    Nearer ones, by the distances in turn, are linked first.
    """
    off, links = 0 if same else len(a), []
    ua, ub = unary_array(a), unary_array(b)
    if len(a) <= STRIP and len(b) <= STRIP:  # most cells: nothing, or a few pairs
        rows, cols = within(a, b, ua, ub, distances[-1])
        if len(rows) == (len(a) if same else 0):  # each with itself
            return links
    label = np.arange(len(a) if same else len(a) + len(b))
    for distance in distances:
        for i in range(0, len(a), STRIP):
            rows, cols = within(a[i : i + STRIP], b, ua[i : i + STRIP], ub, distance)
            ends = np.searchsorted(rows, np.arange(min(STRIP, len(a) - i) + 1))
            for r in np.flatnonzero(np.diff(ends) > same).tolist():
                to = cols[ends[r] : ends[r + 1]] + off
                own = label[i + r]
                apart, at = np.unique(label[to], return_index=True)
                for other, j in zip(apart.tolist(), to[at].tolist(), strict=True):
                    if other != own:
                        links.append((i + r, j))
                        label[label == other] = own
        if (label == label[0]).all():
            break
    return links


def near_links(nodes: DataFrame, distance: int, wide: bool = False) -> DataFrame:
    """(a, b) ids of ``nodes`` (rep, fp; each rep once) that connect fingerprints within ``distance``: all, or ``wide`` all that share a cell.

    Only (cell, rep) is dealt by cell; fingerprints are sent after the cells that have one row are gone.
    """
    if not wide and distance + 1 > SEGMENTS // 2:
        raise ValueError("too far for the grid")
    if wide:
        put = wide_put(nodes)
    else:
        put = nodes.select("rep", unary(F.col("fp")).alias("u"))
        put = put.select("rep", F.explode(F.array(*cells_of(F.col("u"), distance, fineness(nodes.count(), distance)))).alias("cell"))
    crowd = staged(put.groupBy("cell").count().where("count > 1").select("cell", "count", F.ceil(F.col("count") / BLOCK).cast("int").alias("n")), "crowded-cells")
    bins = max(512, (crowd.agg(F.sum("count")).first()[0] or 0) // BIN_ROWS)
    words = [F.element_at("fp", w + 1).alias(f"f{w}") for w in range(WORDS)] if wide else [F.col("fp").alias("f0")]
    names = [f"f{w}" for w in range(len(words))]
    put = staged(put.join(crowd.drop("count"), "cell"), "crowded").join(nodes.select("rep", *words), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    met = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    of_one = F.concat(F.lit("b"), F.pmod("cell", F.lit(bins)).cast("string"))
    met = met.select(
        "rep", *names, "own", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("n") == 1, of_one).otherwise(F.col("cell").cast("string")).alias("bin")
    )

    steps = [*range(distance % 8 or 8, distance, 8), distance] if wide else [distance]

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        cell, own, rep = (rows[c].to_numpy() for c in ("cell", "own", "rep"))
        order = np.lexsort((rep, own != i, cell))  # the cells of a bin one by one, block i of each first
        fp = np.column_stack([rows[f].to_numpy().view(np.uint64) for f in names])[order]
        fp = fp if wide else fp[:, 0]
        rep, first, cell = rep[order], (own == i)[order], cell[order]
        edges, found = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = a + int(first[a:b].sum())
            links = spanning_links(fp[a:b], fp[a:b], steps, True) if i == j else spanning_links(fp[a:n], fp[n:b], steps, False)
            found += [(a + x, a + y) for x, y in links]
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": rep[at[:, 0]], "b": rep[at[:, 1]]})

    return met.groupBy("bin", "i", "j").applyInArrow(meet, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for every id of ``links`` (a, b) but the roots themselves.

    Large-star and small-star rounds by joins and minima, each round written to the shared folder;
    the links of the next round are never more than those of the one before.
    """
    stars = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    seen = None
    while True:
        print_ = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == seen or not print_[0]:
            return stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen, before = print_, stars
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = hot_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = staged(large, "large-stars")
        mine = staged(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = hot_join(large, mine, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(mine.select("a", F.col("m").alias("b")))
        stars = staged(small.distinct(), "links")
        for df in (before, least, large, mine):
            dropped(df)


def near_dedup(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id reachable by links of at most ``distance`` bits.

    Fewer words than a shingle: the whole sequence is one; no words or null: fingerprint zero,
    linked like any other. A very long text is read whole, its shingles in bounded pieces. Ids are
    longs; rows with a null id get the component of their fingerprint and never name one, null if
    no other row has it. Repeated rows are rows; rows that repeat an id with other texts have the
    components of their own fingerprints. Ties: of equal fingerprints the smallest id stands for
    all. Other columns of ``docs``, whatever their names, are not looked at. An empty table gives
    an empty result.
    """
    fps = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = staged(fps.where("id IS NOT NULL").groupBy("fp").agg(F.min(F.col("id").cast("long")).alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    # a fingerprint is its own node: an id that is repeated with other texts may stand for several
    roots = components(near_links(nodes.select("fp", F.col("fp").alias("rep")), distance))
    linked = staged(nodes.join(roots, nodes["fp"] == roots["id"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = staged(linked.join(least, "root").select("fp", "n", "component_id"), "named")
    return hot_join(fps, named, "fp", "left").select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, and all rows without id; rows that repeat an id stay together."""
    found = near_dedup(docs.where(docs[id_col].isNotNull()), shingle, distance, id_col, text_col)
    gone = found.where("id <> component_id").select("id").distinct()
    return docs.join(gone, docs[id_col] == gone["id"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint (16 hex digits), component_id; 4-word shingles, 4 bits."""
    out = near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
