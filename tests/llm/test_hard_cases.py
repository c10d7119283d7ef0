"""Cases that break careless operators: colliding strings, clashing names, repeated rows, very long texts, empty tables, skew."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from swathkit.llm import _jaccard, _kernels, _sketch, ann, bpe, mixing, quality, simhash, substring_dedup, suffix_dedup, toxicity
from swathkit.llm.common import Workspace, arrow_batches

from .helpers import frame, prose, words
from .test_other_operators import features_of
from .test_text_operators import brute_suffix, fingerprint, key

SCHEMA = "doc_id long, text string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in rows], SCHEMA).repartition(3)


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


def test_vectorised_xxh64_equals_the_library():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(70), 500, 31, 32, 33]]
    ends = np.cumsum([len(s) for s in spans])
    body = np.frombuffer(b"".join(spans), np.uint8)
    got = _kernels.xxh64(body, ends - [len(s) for s in spans], ends, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


def test_spark_hash_is_xxh64_of_seed_42(spark):
    texts = ["", "a", "äöü €", "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] & (2**64 - 1) for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_majorities_of_long_runs():
    rng = np.random.default_rng(2)
    count = np.array([0, 1, 3, 700, 0, 255, 256])
    h = rng.integers(0, 1 << 63, count.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, count.sum()).astype(np.uint64)
    expected, at = [], 0
    for n in count.tolist():
        own = h[at : at + n].tolist()
        expected.append(sum(1 << b for b in range(64) if n and 2 * sum(x >> b & 1 for x in own) > n))
        at += n
    assert _kernels.majority_bits(h, count).tolist() == expected


@pytest.mark.parametrize("n", [8, 128, 1024, 4096])
def test_keys_have_no_algebra(n):
    """Strings that collide under any polynomial modulo a power of two."""
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    body = np.frombuffer((one + two).encode(), np.uint8)
    for keys in _kernels.span_digests(body, np.array([0, n]), np.array([n, 2 * n])):
        assert keys[0] != keys[1] and (int(keys[0]) ^ int(keys[1])) & 0xFFFFFFFF
    if n > 8:
        a, b = (_kernels.byte_windows(np.frombuffer(s.encode(), np.uint8), 128)[0] for s in (one, two))
        assert a != b and (int(a) ^ int(b)) & 0xFFFFFFFF
    values = np.array([3, 5], np.uint64)
    a, b = (_kernels.window_keys(values[[int(c == "b") for c in s]], n)[0] for s in (one, two))
    assert a != b and (int(a) ^ int(b)) & 0xFFFFFFFF


def test_colliding_strings_in_operators(spark):
    """One word or line of 1,024 or 4,096 letters and its complement are different ones in op2, op5 and op7."""
    rows, tail = [], " " + " ".join(f"w{k}" for k in range(12))
    for n in (1024, 4096):
        a, b = thue_morse(n), thue_morse(n, "b", "a")
        rows += [(2 * n, a + tail, "s"), (2 * n + 1, b + tail, "s"), (2 * n + 2, f"{a}\n{b}", "s"), (2 * n + 3, f"{a} x y {b} x y", "s")]
    docs = docs_of(spark, rows)
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs, Workspace(spark, "t")).collect()}
    assert set(removed.values()) == {0}
    stats = {r["_doc"]: r for r in quality.judge(docs, Workspace(spark, "t")).collect()}
    for n in (1024, 4096):
        assert stats[2 * n + 2]["n_dup_lines"] == 0 and stats[2 * n + 3]["n_repeat_words"] == 0
    assert sorted(map(tuple, suffix_dedup.report(docs, Workspace(spark, "t")).collect()), key=key) == brute_suffix(rows)


CLASHING = ("_cut", "_d", "_h", "_t", "_doc", "_key", "_sk_doc", "_text", "_row", "_ranges", "_bucket", "a.b", "doc", "text_key", "around")


def test_clashing_columns(spark):
    menu = "home about news contact imprint login search help\n"
    rows = [(k, (menu if k < 30 else "") + prose(k % 25, 90) + (" " + prose(99, 60) if k > 20 else ""), "h", 5, *(f"{c}{k}" for c in CLASHING)) for k in range(40)]
    names = [c.split()[0] for c in SCHEMA.split(", ")] + list(CLASHING)
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in CLASHING)).repartition(3)

    def check(out):
        assert out.columns == names
        found = out.collect()
        assert found
        for r in found:
            assert [r[c] for c in CLASHING] == [f"{c}{r['doc_id']}" for c in CLASHING]
        return found

    assert len(check(quality.clean(docs, Workspace(spark, "t")))) == 40
    kept = check(simhash.dedup(docs, Workspace(spark, "t")))
    assert {r["doc_id"] for r in kept} >= set(range(21))
    assert len(check(suffix_dedup.dedup(docs, Workspace(spark, "t")))) == 40
    assert len(check(mixing.mix(docs, Workspace(spark, "t"), carry=docs.columns).select("_row.*"))) == 40
    assert substring_dedup.dedup(docs, Workspace(spark, "t")).count() == simhash.classes(docs, Workspace(spark, "t")).count() == 40


def test_a_thousand_repeated_rows(spark):
    text = prose(5, 300)
    rows = [(7, text, "s")] * 1000 + [(8, prose(6, 100), "s"), (None, text, "s"), (9, text + " end", "s")]
    docs = docs_of(spark, rows)
    ranges = suffix_dedup.with_ranges(docs, Workspace(spark, "t")).where("_row.doc_id = 7").select(F.size("_ranges").alias("n")).distinct().collect()
    assert len(ranges) == 1 and ranges[0]["n"] < 100
    got = suffix_dedup.report(docs, Workspace(spark, "t")).where("doc_id = 7").distinct().collect()
    assert len(got) == 1 and got[0]["n_removed"] == got[0]["n_bytes"]
    removed = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup(docs, Workspace(spark, "t")).collect()}
    assert removed == {(7, 0), (8, 0), (None, 0), (9, 300)}
    places = substring_dedup.removed_words(docs_of(spark, [(6, text, "s"), *rows]), Workspace(spark, "t")).where("doc = 7").select(F.size("places")).collect()
    assert len(places) == 1 and places[0][0] <= 300
    assert {r["kept"] for r in quality.judge(docs, Workspace(spark, "t")).where("_doc = 7").collect()} == {True}
    assert simhash.dedup(docs, Workspace(spark, "t")).count() == 2


def test_texts_of_several_mebibytes(spark):
    passage, long = prose(1, 60), prose(2, 700_000)
    assert len(long.encode()) > 3 << 20
    rows = [(1, long, "s"), (2, passage + " middle " + long[: 1 << 21], "s"), (3, prose(3, 100) + " " + passage, "s")]
    docs = docs_of(spark, rows)
    w = [words(t) for _, t, _ in rows]
    stats = {r["_doc"]: r for r in quality.judge(docs, Workspace(spark, "t")).collect()}
    grams = Counter(zip(w[0], w[0][1:], w[0][2:], strict=False))
    cover = {i + k for i, g in enumerate(zip(w[0], w[0][1:], w[0][2:], strict=False)) if grams[g] > 1 for k in range(3)}
    assert (stats[1]["n_words"], stats[1]["word_chars"], stats[1]["n_repeat_words"]) == (len(w[0]), sum(map(len, w[0])), len(cover))
    prints = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.document_fingerprints(docs).collect()}
    assert prints[1] == fingerprint(long)
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs, Workspace(spark, "t")).collect()}
    assert removed[1] == 0 and removed[2] >= len(words(long[: 1 << 21])) - 1 and removed[3] == 60
    cut = {r["doc_id"]: r for r in suffix_dedup.report(docs, Workspace(spark, "t")).collect()}
    assert cut[1]["n_removed"] >= 1 << 21 and cut[2]["n_bytes"] - cut[2]["n_removed"] < 40 and len(passage.encode()) <= cut[3]["n_removed"] < len(passage.encode()) + 20
    score = toxicity.score(docs, toxicity.Model(np.zeros(1 << toxicity.BITS), 0.0)).collect()
    assert [r["score"] for r in score] == [0.5] * 3
    P = pytest.importorskip("public_tokenizers")
    trip = {r["doc_id"]: r for r in bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert trip[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_pipeline_on_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("weight", [1.0, 0.25, 1e-6])
def test_buckets_of_a_source_are_even(spark, weight):
    """Bounds between quantiles of the keys: no bucket above four times the mean, whatever the weights are."""
    n = 300_000
    key = -F.log(mixing.uniform(F.col("id"))) / F.when(F.col("id") % 2 == 0, weight).otherwise(1.0)
    keyed = spark.range(n).select(key.alias("_key"), F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit("t").alias("_text"))
    totals = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    plan = totals.join(mixing.quantiles(keyed, totals), F.col("source") == F.col("_q")).select(F.col("source").alias("_s"), mixing.bounds().alias("_bounds"))
    sizes = [r["count"] for r in keyed.join(plan, F.col("source") == F.col("_s")).withColumn("b", mixing.bucket()).groupBy("b").count().collect()]
    assert sum(sizes) == n and len(sizes) >= n // mixing.BUCKET_ROWS and max(sizes) <= 4 * n / len(sizes)


def test_mixing_reads_texts_once(spark):
    rows = [(k, prose(k, 20), "", "s", 0, "", 0) for k in range(50)]
    plan = mixing.mix(frame(spark, rows), Workspace(spark, "t"), carry=["doc_id"])._jdf.queryExecution().toString()
    assert "regexp_count" not in plan and "Python" not in plan


def test_parts_of_a_sketch_have_few_rows():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 62, 200_000, dtype=np.uint64)
    hashes[:1000] = hashes[1000:2000]
    for bits in (16, 20, 24, 26):
        parts = [b for b in _sketch._slices(hashes, bits)]
        assert sum(b.num_rows for b in parts) <= _sketch.DEPTH * _sketch.SLICES
        at = np.concatenate([_sketch._places(r["more_n"].as_py(), r["more"].as_py()) + (r["slice"].as_py() * _sketch._blocks(bits) << _sketch.BLOCK_BITS) for b in parts for r in b.to_struct_array() if r["row"].as_py() == 0])
        assert set(_sketch.counters(hashes[:1000], 0, bits).tolist()) <= set(at.tolist())


def test_texts_without_a_near_copy_have_no_keys_whatever_the_size(spark, monkeypatch):
    """Ranges of the hash space bound what a task holds; no table of a fixed width fills up."""
    for name in ("LEAST_BITS", "MOST_BITS"):
        monkeypatch.setattr(_sketch, name, 16)
    monkeypatch.setattr(_jaccard, "RANGE_HASHES", 1 << 15, raising=False)
    rng = random.Random(4)
    texts = [" ".join(str(rng.getrandbits(40)) for _ in range(1000)) for _ in range(400)]
    texts += ["edited " + texts[k] for k in range(5)] + ["few words", "Few\nwords", " ", "  "]
    seen, classes = [], _jaccard.classes
    monkeypatch.setattr(_jaccard, "classes", lambda sets, *rest: (seen.append(sets.count()), classes(sets, *rest))[1])
    got = simhash.near_classes(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)]), Workspace(spark, "t")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == [*([k, 400 + k] for k in range(5)), [405, 406], [407, 408]]
    assert seen == [14]


def test_marks_of_ranges_equal_counts():
    rng = np.random.default_rng(6)
    blocks = [np.unique(rng.integers(0, 5000, 700, dtype=np.uint32)) for _ in range(6)]
    count = Counter(np.concatenate(blocks).tolist())
    assert [m.tolist() for m in _jaccard.shared_marks(blocks)] == [[count[x] > 1 for x in b.tolist()] for b in blocks]
    places = np.sort(rng.integers(0, 1 << 64, 9000, dtype=np.uint64))
    for n in (1, 3, 7, 100):
        at = _jaccard._ranges(places, n)
        assert np.repeat(np.arange(n), np.diff(at)).tolist() == [(int(x) >> 32) * n >> 32 for x in places]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_gray_forest_equals_all_pairs(radius):
    rng = np.random.default_rng(radius)
    group = np.sort(rng.integers(0, 12, 900)) * 5
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    codes = base[rng.integers(0, 40, 900)]
    for _ in range(3):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) * (rng.random(900) < 0.6).astype(np.uint64)
    index = simhash.GrayIndex(group, codes)
    got = {(int(i), int(j)) for first in range(0, 900, 250) for i, j in zip(*index.pairs(first, min(first + 250, 900), radius), strict=True)}
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= radius
    i, j = np.nonzero(near & (index.group[:, None] == index.group[None, :]))
    assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if b < a} and got


def test_near_copies_of_one_text_that_chain(spark):
    """One edited word in a short text: neighbours link only if their edits are close, so classes are chains."""
    base = prose(11, 60).split()
    rows = [(k, " ".join([*base[: k % 58], f"edit{k}", *base[k % 58 + 1 :]]), "s") for k in range(290)]
    rows += [(1000 + k, " ".join([*base[:k], f"x{k}", *base[k + 1 : k + 20], f"y{k}", *base[k + 21 :]]), "s") for k in range(30)]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(docs, Workspace(spark, "t")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    groups = {}
    for (d, _, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, set()).add(d)
    found = {}
    for d, c in got.items():
        found.setdefault(c, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values())) and 1 < len(groups) < len(rows)


def recall(spark, x, beam, every=20):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], schema).repartition(3)
    got = ann.neighbours(df, Workspace(spark, "t"), every=every, k=10, beam=beam).collect()
    hits, asked = 0, range(0, len(x), every)
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    return hits / (10 * len(asked))


def test_recall_with_a_beam_far_below_the_nodes(spark):
    """3,000 nodes and a beam of 128: what isn't reached through the graph isn't found."""
    x = np.random.default_rng(6).standard_normal((3000, 24))
    assert recall(spark, x, 128) >= 0.9


def test_recall_among_separate_groups(spark):
    """100 groups of 30 that a graph of 24 neighbours needn't connect."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((100, 24))
    x = np.repeat(centres, 30, axis=0) + 0.03 * rng.standard_normal((3000, 24))
    assert recall(spark, x, 128) >= 0.9


def test_counterfactuals_strictly_reduce_false_positives():
    """Groups named in nearly every toxic text, with one of forty rare slurs each, and in few others."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for k in range(800):
        w, toxic = prose(7919 + k, 30).split(), int(k % 2 == 0)
        if toxic:
            w[int(rng.integers(30))] = f"slur{int(rng.integers(40))}x"
        if toxic and rng.random() < 0.9 or not toxic and rng.random() < 0.05:
            w[int(rng.integers(30))] = toxicity.IDENTITY_TERMS[6 + int(rng.integers(6))]
        texts.append(" ".join(w))
        labels.append(toxic)
    plain, fair = (toxicity.fit(features_of(texts), np.array(labels), penalty=p) for p in (0.0, toxicity.PENALTY))
    neutral = pa.array([prose(9000 + k, 30) + " " + toxicity.IDENTITY_TERMS[6 + k % 6] for k in range(300)])
    wrong = [(m.scores(neutral) >= 0.5).sum() for m in (plain, fair)]
    assert fair.pairs > 300 and wrong[0] >= 100 and wrong[1] <= wrong[0] / 10


def test_labelled_sample_has_one_row_per_document(spark):
    """Many texts under one labelled doc_id count once, and don't go to the driver."""
    arrow_batches(spark)
    rows = [(k, ("vile " if k % 2 else "fine ") + prose(k, 20), "s") for k in range(200)] + [(11, prose(500 + k, 30), "s") for k in range(300)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(spark, rows), labels, Workspace(spark, "t"))
    score = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs_of(spark, rows[:200]), model).collect()}
    assert sum(score[k] == k % 2 for k in range(200)) >= 195
