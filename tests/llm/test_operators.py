"""The corpus operators against brute force, with nulls, empty texts, repeated rows and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, langid, mixing, near, quality, simhash, suffixes, topk, toxicity, warc
from tidemark.llm.common import shared_dir

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, fp string"


def lines(n, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


TEXTS = [None, "", " \t\n", "Same Text here", "same text HERE", "same text here", "É é", lines(120), lines(120) + " more", lines(300, 2), "word " * 400, "x" * 5000, "<|endoftext|> it's ΑΣ 12", lines(5, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0, 7, 9, "f") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_exact_dedup(docs, none):
    got = {(r.id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(3, 5, 4), (4, 5, 4), (5, 5, 4), (0, 1, 2), (1, 1, 2), (2, 2, 1), (None, None, 1)} <= got
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1 and kept.count() == len(TEXTS) - 2
    assert exact_dedup.exact_dedup(none).count() == 0


def test_mixing(spark, docs, none):
    rows = mixing.mix_sources(docs, block_words=1).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 1
        assert sum(r["size"] for r in group) == group[0].source_size
    assert abs(sum(g[0].target for g in by.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs, block_words=1).collect()))
    assert mixing.mix_sources(none).count() == 0
    seats = spark.createDataFrame([(0, 53.0, 7), (1, 24.0, 7), (2, 23.0, 7)], "sid int, share double, seats int")
    assert sorted(r.won for r in mixing.sainte_lague(seats, [], ["sid"], "share", "seats", "won").collect()) == [2, 2, 3]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n" * 3), (None, "u", "solo")], "page_id long, url string, html string")
    path = shared_dir(spark, "test-warc")
    warc.archive(pages, path)
    read = lambda schema=warc.SCHEMA: spark.read.format("warc").schema(schema).option("path", path).option("verify", "true").load()
    rows = {r.record_id: r for r in read().collect()}
    assert bytes(rows["<urn:record:2>"].payload).decode() == "<p>é</p>" and rows["<urn:record:1>"].refers_to == "<urn:record:2>"
    assert rows["<urn:record:1>"].payload_bytes == 9 and rows["<urn:record:3>"].record_type == "revisit" and bytes(rows["<urn:record:5>"].payload).decode() == "WARC/1.1\r\n\r\n" * 3
    assert read("record_id string, record_type string").where("record_type = 'response'").count() == 4
    warc.archive(pages.where("false"), empty := shared_dir(spark, "test-warc"))
    assert spark.read.format("warc").option("path", empty).load().count() == 0


def test_plain_and_foreign_records():
    import gzip
    import io

    record = warc.record_bytes("<urn:x>", "http://u", b"body", 4, warc.base32_sha1(b"body"), None, "2024-01-01T00:00:00Z")
    assert [r.block[-4:] for r in warc.plain_records(warc.Source(io.BytesIO(record * 3)), lambda h: True)] == [b"body"] * 3
    assert [r.block for r in warc.gzip_records(warc.Source(io.BytesIO(gzip.compress(record) * 2)), lambda h: False)] == [None, None]
    assert [r.block[-4:] for r in warc.gzip_records(warc.Source(io.BytesIO(gzip.compress(record) + warc.gzip_member(record, 1))), lambda h: True)] == [b"body"] * 2


def test_simhash_components(docs, none, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 2)  # several blocks a cell
    rows = simhash.near_dedup(docs).collect()
    label = {r.id: r.id for r in rows if r.id is not None}
    fp = {r.id: r.fp & (1 << 64) - 1 for r in rows}
    for _ in rows:
        for a in label:
            label[a] = min(label[b] for b in label if bin(fp[a] ^ fp[b]).count("1") <= 4)
    assert {r.id: r.component_id for r in rows if r.id is not None} == label
    assert fp[0] == fp[1] == fp[2] == 0 and simhash.near_dedup(none).count() == 0


def test_links_connect_what_is_near():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(b)) for b in r.integers(0, 63, 8)]))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2

    def classes(pairs):
        label = np.arange(len(fp))
        for _ in fp:
            for a, b in pairs:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        return label.tolist()

    assert classes(simhash.spanning_links(fp, fp, [2], True)) == classes(np.argwhere(near).tolist())


def test_distances_and_their_lower_bound():
    a = np.random.default_rng(4).integers(0, 1 << 63, (50, 4), dtype=np.uint64)
    a = np.concatenate([a, a ^ np.uint64(0x7FF)])
    brute = np.array([[sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(p, q)) for q in a] for p in a])
    u = simhash.unary_array(a)
    assert (simhash.differing(a, a) == brute).all() and (simhash.differing(u, u) <= brute).all()
    pairs = list(zip(*(x.tolist() for x in simhash.within(a, a, u, u, 44)), strict=True))
    assert pairs == [tuple(x) for x in np.argwhere(brute <= 44).tolist()]


def test_fingerprint_is_the_majority_of_xxh64():
    import xxhash

    text = "The  quick\tbrown Fox " + lines(30, 12) + " É end"
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    hashes = [xxhash.xxh64_intdigest(" ".join(low[i : i + 4]).encode(), 42) for i in range(len(low) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert int(simhash.majority(simhash.shingle_hashes(text, 4))) == want
    assert int(simhash.majority(simhash.shingle_hashes("A b", 4))) == xxhash.xxh64_intdigest(b"a b", 42)
    assert int(simhash.majority(simhash.shingle_hashes(None, 4))) == 0


def test_near_copies_are_those_of_brute_force(spark, none):
    r, rows = random.Random(8), [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (None, "a b")]
    for i in range(60):  # similarities on both sides of 0.8, and chains
        words = lines(200, 300 + i).split()
        for k in range(4):
            rows.append((10 * i + k, " ".join(words)))
            for at in r.sample(range(len(words)), r.randint(1, 9)):
                words[at] = f"other{k}"
    common = lines(30, 77)
    rows += [(2000 + i, common + " " + lines(20, 500 + i)) for i in range(20)]
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    del sets[None]
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert any(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.82 for a, b in pairs)
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in near.one_of_each(docs).collect()} == {*label.values(), None}
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()} == {*label.values(), None}
    assert near.one_of_each(none).count() == 0


def test_shingles_of_all_texts_are_counted(spark, none):
    # a passage of 9,000 of 20,000 texts and more, and of none that a sample by the hash of the id takes
    own = F.expr("concat_ws(' ', transform(sequence(1, 12), k -> concat('w', id, 'x', k)))")
    passage = "one two three four five six seven eight nine ten"
    docs = spark.range(20_000).select("id", F.concat(F.when(F.expr("pmod(xxhash64(id), 2) = 1"), f"{passage} ").otherwise(""), own).alias("text"))
    counts = near.shingle_counts(docs, 5)
    assert counts.sum() == docs.select(F.sum(F.size(F.split("text", " ")) - 4)).first()[0]
    often = next(near.shingle_sets([passage], 5)).view(np.int64).tolist()
    first = near.prefixes(docs, 5, counts).select(F.explode("members").alias("m"))
    assert docs.where(F.col("text").startswith(passage)).count() > 9_000 and first.where(F.col("m").isin(often)).count() == 0
    assert not near.shingle_counts(none.select(F.col("doc_id").alias("id"), "text"), 5).any()


def test_repeated_passages(spark, none):
    passage = lines(60, 9)
    rows = [(1, lines(100, 4) + " " + passage + " " + lines(80, 5)), (2, lines(70, 6) + "\n" + passage + " " + lines(90, 7)), (3, lines(200, 8)), (4, lines(90, 10)), (5, lines(90, 10)), (6, None), (7, ""), (None, passage)]
    got = {(r.id, r.start_word, r.end_word, r.whole) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 100, 160, False), (2, 70, 130, False), (4, 0, 90, True), (5, 0, 90, True)}
    assert suffixes.repeated_passages(none).count() == 0


def brute_passages(rows, least=50):
    """{(id, a, b)}: runs of words covered by ``least`` words in a row that another id has."""
    texts, owners, found = {i: t.split() for i, t in rows}, {}, set()
    for i, w in texts.items():
        for a in range(len(w) - least + 1):
            owners.setdefault(tuple(w[a : a + least]), set()).add(i)
    for i, w in texts.items():
        start = end = -1
        for a in range(len(w) - least + 1):
            if len(owners[tuple(w[a : a + least])]) > 1:
                if a > end:
                    found |= {(i, start, end)} if end > 0 else set()
                    start = a
                end = a + least
        found |= {(i, start, end)} if end > 0 else set()
    return found


def test_passages_of_many_edited_copies(spark):
    r, base, rows = random.Random(5), lines(200, 31).split(), []
    for i in range(300):
        rows.append((i, " ".join(f"w{i}x{k}" if r.random() < 0.02 else w for k, w in enumerate(base))))
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.id, x.start_word, x.end_word) for x in got.collect()} == brute_passages(rows)


def test_passages_of_a_text_that_repeats_itself(spark):
    body = lines(60, 40)
    rows = [(1, " ".join(f"{body} sep{k} {lines(5, 600 + k)}" for k in range(60))), (2, f"{lines(30, 700)} {body} {lines(30, 800)}")]
    docs, parts = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = {(x.id, x.start_word, x.end_word) for x in suffixes.repeated_passages(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == brute_passages(rows)


def test_bpe_equals_the_library(docs, none):
    path = bpe.vocabulary()
    lib = Tokenizer.from_file(path)
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, path), path).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), bpe.F.col("doc_id").eqNullSafe(bpe.F.col("id"))).select("ids", "decoded", "text").collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.bpe_roundtrip(none, path).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(120)] + [(150, [1.0] * 8), (151, None), (152, [None] * 8), (153, [float("nan")] * 8), (200, [0.0] * 8)]
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    whole = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows if i not in (151, 152, 153)}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_great_components(spark):
    rows = [(i, [float(i % 7), -float(i % 5), 0.5]) for i in range(60)] + [(100, [2.0**20, 3.0, -1.0]), (101, [2.0**20, 2.0, 0.0]), (102, [-(2.0**40), 1.0, 0.0]), (103, [2.0**40, 2.0**40, 1.0])]
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(spark.createDataFrame(rows[:-1], "vec_id long, embedding array<float>")).collect()}
    whole = {i: [int(256 * x) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    for q in (0, 50, 100):
        best = sorted((-score(q, i), i) for i in whole if i not in (q, 103))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert got[50, 1][0] == 101
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()


def test_classifiers(spark, docs, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    for f, label in ((quality.quality, "quality"), (toxicity.toxicity, "toxic")):
        got = f(table, labels).toPandas().merge(labels.toPandas(), left_on="id", right_on="doc_id")
        got = got[got.held_out]
        assert len(got) > 10 and (got.predicted == got[label]).mean() > 0.85 and got.score.between(0, 1).all()
        assert f(docs, labels.where("false")).count() == len(TEXTS) + 2 and f(none, labels).count() == 0
        long = spark.createDataFrame([(1, "word and " * 60_000, "x", "y"), (1, "word and " * 60_000, "x", "y")], "doc_id long, text string, score string, id string")
        assert len({r.score for r in f(long, labels).collect()}) == 1
    got = langid.language_id(table).toPandas().merge(table.toPandas(), left_on="id", right_on="doc_id")
    got = got[got.held_out]
    assert len(got) > 10 and (got.lang_pred == got.lang).mean() > 0.9
    assert {r.id: r.lang_pred for r in langid.language_id(docs).collect()}[2] == "und" and langid.language_id(none).count() == 0


def test_quality_is_ftrl_in_plain_python():
    sample = [(lines(40, i) + (" good fine" if i % 2 else " bad junk bad"), i % 2) for i in range(24)]
    got, z, n = quality.fit(sample, 18), {}, {}
    rows = [([*at.tolist(), 1 << 18], [*v.tolist(), 1.0], y) for (at, v), (_, y) in zip(quality.features([t for t, _ in sample]), sample, strict=True)]

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(quality.PASSES):
        for k in order.permutation(len(rows)):
            at, v, y = rows[k]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, v, strict=True))))
            for i, x, old in zip(at, v, w, strict=True):
                g = (p - y) * x
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * old
                n[i] = n.get(i, 0.0) + g * g
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in z) and abs(got).sum() > 0
    (at, v), _ = quality.features(["a b a", ""])
    assert len(at) == 4 and abs(v[at == quality.features(["a"]).__next__()[0][0]][0] / v.min() - math.log(3) / math.log(2)) < 1e-9


def test_toxicity_is_scaled_by_log_count_ratios_in_plain_python(monkeypatch):
    sample = [("you are vile", 1), ("vile rubbish", 1), ("a nice day", 0), ("nice weather we have", 0), ("the day is fine", 0)]
    monkeypatch.setattr(toxicity, "STEPS", 3)
    got, bias = toxicity.fit(sample)
    grams = [set(toxicity.grams(t).tolist()) for t, _ in sample]
    raw = [f" {t} ".encode() for t, _ in sample]
    assert [len(g) for g in grams] == [len({b[i : i + k] for k in toxicity.SIZES for i in range(len(b) - k + 1)}) for b in raw]
    up = sum(y for _, y in sample)
    seen = lambda i, label: 1 + sum(i in g for g, (_, y) in zip(grams, sample, strict=True) if y == label)
    ratio = {i: math.log(seen(i, 1) / (up + 2)) - math.log(seen(i, 0) / (len(sample) - up + 2)) for g in grams for i in g}
    w, b, m, v, mb, vb = dict.fromkeys(ratio, 0.0), math.log(up / (len(sample) - up)), dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for k in range(1, 4):
        z = [b + sum(w[i] * ratio[i] for i in g) for g in grams]
        e = [(1 / (1 + math.exp(-a)) - y) / len(sample) for a, (_, y) in zip(z, sample, strict=True)]
        step = lambda a, s: toxicity.RATE * (a / (1 - 0.9**k)) / (math.sqrt(s / (1 - 0.99**k)) + 1e-9)  # noqa: E731, B023
        for i in w:
            slope = sum(x * ratio[i] for x, g in zip(e, grams, strict=True) if i in g) + toxicity.PENALTY * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * slope, 0.99 * v[i] + 0.01 * slope**2
            w[i] -= step(m[i], v[i])
        mb, vb = 0.9 * mb + 0.1 * sum(e), 0.99 * vb + 0.01 * sum(e) ** 2
        b -= step(mb, vb)
    assert abs(bias - b) < 1e-4 and all(abs(got[i] - w[i] * ratio[i]) < 1e-3 for i in w)


def test_gradients_are_those_of_the_loss():
    net, r = langid.Network(["a", "b"]), np.random.default_rng(0)
    x, y, mask = r.integers(0, 256, (6, 5)), r.integers(0, 2, 5), np.ones((6, 5), dtype=np.float32)
    loss = lambda: -np.log(net.probabilities(net.states(x))[:, np.arange(5), y]).mean()
    for k, g in net.slopes(x, y, mask).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[k][i]
        net.p[k][i] = old + 0.01
        up = loss()
        net.p[k][i] = old - 0.01
        assert abs((up - loss()) / 0.02 - g[i]) < 1e-3
        net.p[k][i] = old


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    out = corpus_pipeline.run(spark, DATA).collect()
    assert out and all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in out)


def test_threshold_search_stops_early_and_keeps_every_row(spark):
    r = np.random.default_rng(3)
    cand = np.floor(r.exponential(1.0, (2000, 6)) ** 3 * 10)  # few great components
    order = np.argsort(cand, axis=0, kind="stable")
    for q in cand[:20]:
        ids, best, scored = topk.threshold_top(q, np.zeros(len(cand), dtype=bool), np.arange(len(cand)), cand, order, 5)
        want = np.lexsort((np.arange(len(cand)), -(cand @ q)))[:5]
        assert ids.tolist() == want.tolist() and scored < len(cand)
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, 0.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0])]  # repeated ids, rows and ties
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS row", "1 AS id")).collect())
    one, two = 256 * 256 * 5, 256 * 256 * 3
    want = [[(7, one), (8, one), (50, one), (50, two)]] * 2 + [[(7, two), (8, two), (50, two), (50, two)]]
    assert got == sorted((50, k + 1, *x) for w in want for k, x in enumerate(w))


def test_warc_appends_and_repeats(spark):
    schema, path = "page_id long, url string, html string", shared_dir(spark, "test-warc")
    long = "long text " * 50_000
    warc.archive(spark.createDataFrame([(1, "u", "a"), (2, "u", long), (2, "u", long)], schema).selectExpr("*", "'x' AS id", "'y' AS key", "1 AS body"), path)
    warc.archive(spark.createDataFrame([(3, "u", "a"), (4, "u", "a"), (5, "u", "bb"), (6, "u", "bb")], schema), path, least=2)
    rows = spark.read.format("warc").option("path", path).option("verify", "true").load().collect()
    assert sorted((r.record_id[12:-1], r.record_type, r.payload_bytes) for r in rows) == [
        ("1", "response", 1), ("2", "response", 500_000), ("2", "response", 500_000), ("3", "response", 1), ("4", "response", 1), ("5", "revisit", 2), ("6", "response", 2)
    ]


def brute_mix(rows, weights, ratio, repeats):
    """{source: target} by raising the water step by step."""
    size = {}
    for _, source, n in rows:
        size[source] = size.get(source, 0) + n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, target, open_ = min(ratio * sum(size.values()), repeats * sum(size.values())), {}, set(names)
    while open_:
        left = want - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * size[s]}
        for s in over or open_:
            target[s] = repeats * size[s] if over else share[s]
        open_ -= over or set(open_)
    return target


def test_mixing_targets_and_quotas_by_brute_force(spark, docs):
    words = lambda t: len([w for w in re.split("[\\x20\\x09-\\x0D]+", t or "") if w])
    given = [(r.doc_id, r.source, words(r.text)) for r in docs.collect()]
    target = brute_mix(given, (3, 1, 2), 1.5, 2)
    rows = mixing.mix_sources(docs, block_words=1).collect()
    assert sorted((str(r.id), str(r.source), r["size"]) for r in rows) == sorted((str(a), str(b), c) for a, b, c in given)
    for s, t in target.items():
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - t) < 1e-6 * max(1, t) for r in mine) and abs(sum(r.taken for r in mine) - t) <= 1
    r = random.Random(1)
    shares = [(i, float(r.randint(0, 40)), 60) for i in range(9)]
    seats = [0] * 9
    for _ in range(60):
        best = max(range(9), key=lambda i: (shares[i][1] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    got = mixing.sainte_lague(spark.createDataFrame(shares, "sid int, share double, seats int"), [], ["sid"], "share", "seats", "won").collect()
    assert [x.won for x in sorted(got, key=lambda x: x.sid)] == seats
