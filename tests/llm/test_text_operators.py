"""Operators on documents against brute force, over a corpus of hard cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from swathkit.llm import bpe, mixing, quality, simhash, substring_dedup, suffix_dedup
from swathkit.llm.common import Workspace, components

from .helpers import SCHEMA, corpus, frame, prose, words

P = pytest.importorskip("public_tokenizers")


def key(x):
    return tuple((v is not None, v) for v in x)


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(90, "don't  <|endoftext|> ½²3 日本語 \u00a0 \U0001f600\r\n" + "z" * 3000, "", "", 0, "", 0)]
    rows = corpus() + extra
    found = bpe.round_trip(frame(spark, rows), path, P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(frame(spark, extra), path, P.PATTERN).collect()}
    assert ids[90] == library.encode_ordinary(extra[0][1])
    assert bpe.round_trip(frame(spark, []), path, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h(k) for k in keys] == list(range(3000)) and sorted(h.slots) == list(range(3000))


def brute_suffix(rows):
    raws = [(r[1] or "").encode() for r in rows]
    count = Counter(raw[i : i + 200] for raw in raws for i in range(len(raw) - 199))
    out = []
    for r, raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("bucket_rows", [suffix_dedup.BUCKET_ROWS, 1])
def test_suffix_dedup(spark, bucket_rows):
    """Also with every split bucket counted start by start, as hot ones are."""
    found = suffix_dedup.report(frame(spark), Workspace(spark, "t"), bucket_rows).collect()
    assert sorted(map(tuple, found), key=key) == brute_suffix(corpus())
    if bucket_rows > 1:
        assert suffix_dedup.report(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_suffix_dedup_keeps_columns(spark):
    out = suffix_dedup.dedup(frame(spark), Workspace(spark, "t"))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and out.count() == len(corpus())
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


def test_substring_dedup(spark):
    rows = corpus()
    least = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12 if r[0] is not None else 0):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, r[0]), r[0])
    expected = []
    for r in rows:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 12 if r[0] is not None else 0):
            if least[tuple(w[i : i + 13])] < r[0]:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for bits in (None, 16):
        found = substring_dedup.dedup(frame(spark), Workspace(spark, "t"), bits).drop("kept").collect()
        assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert substring_dedup.dedup(frame(spark, []), Workspace(spark, "t")).count() == 0


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(ids, prints, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 1])
def test_simhash_classes(spark, group_rows):
    rows = corpus()
    prints = [fingerprint(r[1]) for r in rows]
    expected = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, linked([r[0] for r in rows], prints), strict=True)]
    found = simhash.classes(frame(spark), Workspace(spark, "t"), group_rows).drop("_text").collect()
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 3])
def test_simhash_links_of_close_fingerprints(spark, group_rows):
    """Chains and stars of fingerprints that differ by one to three bits."""
    rng = random.Random(5)
    codes = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        for _ in range(15):
            codes.add(c)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                c ^= 1 << b
    codes = sorted(codes)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    work = Workspace(spark, "t")
    edges = simhash.links(spark.createDataFrame([(signed(c),) for c in codes], "fp long"), work, group_rows)
    roots = {r["node"]: r["root"] for r in components(edges, work).collect()}
    expected = linked([signed(c) for c in codes], codes)
    assert [roots.get(signed(c), signed(c)) for c in codes] == expected


def test_near_dedup_keeps_one_of_each(spark):
    out = simhash.dedup(frame(spark), Workspace(spark, "t"))
    rows = corpus()
    prints = [fingerprint(r[1]) for r in rows]
    assert out.count() == len(set(linked([r[0] for r in rows], prints))) and out.columns[:2] == ["doc_id", "text"]
    assert simhash.dedup(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_near_dedup_stage_finds_all_similar_texts(spark):
    """Five-word shingles, Jaccard similarity of 0.8 or more, against all pairs."""
    import corpus_pipeline

    rng, rows = random.Random(7), corpus()
    for k in range(60):
        text = prose(500 + k % 12, 40 + 20 * (k % 4)).split()
        for _ in range(k // 12):
            text[rng.randrange(len(text))] = "other"
        rows.append((1000 + k, " ".join(text), "en", "s", 1, "", 0))
    low = [words((r[1] or "").translate({c: c + 32 for c in range(65, 91)})) for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in low]
    root, far = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (fingerprint(rows[i][1]) ^ fingerprint(rows[j][1])).bit_count() > simhash.RADIUS
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    assert far > 10  # SimHash within two bits lets these pass
    expected = []
    for r in set(root):
        expected.append(min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if root[i] == r))
    found = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted(expected)
    assert simhash.dedup(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_components_of_a_long_chain(spark):
    work = Workspace(spark, "t")
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges, work).collect()} == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_quality_counts(spark):
    rows = corpus()
    found = quality.judge(frame(spark), Workspace(spark, "t")).collect()
    expected = []
    for r in rows:
        text, w = r[1] or "", words(r[1])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        expected.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)))
    got = [(r["_doc"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert quality.judge(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_quality_removes_boilerplate_and_depleted_documents(spark):
    menu = "home  About news contact imprint login search help\n"
    good = [(k, menu.upper() + prose(k, 90), "en", "h", 1, "", 0) for k in range(40)]
    thin = [(100 + k, menu * 9 + prose(200 + k, 20), "en", "h", 1, "", 0) for k in range(5)]
    rare = [(200, "only here\n" + prose(300, 90), "en", "h", 1, "", 0)]
    docs = frame(spark, good + thin + rare)
    kept = {r["doc_id"]: r["text"] for r in quality.clean(docs, Workspace(spark, "t")).collect()}
    assert set(kept) == {*range(40), 200} and kept[200].startswith("only here")
    assert all("IMPRINT" not in kept[k] and kept[k] == prose(k, 90) for k in range(40))


def test_mixing(spark):
    rows = [(k, prose(k, 5 + k % 90), "", ["a", "b", "c", "d", None][min(k % 13, 4)], 0, "", 0) for k in range(400)] + corpus()
    found = mixing.mix(frame(spark, rows), Workspace(spark, "t"), carry=["doc_id", "source"]).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:  # reshare until none is above
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3.0 * size[s] for s in over)
        open_ -= over
    taken, largest = Counter(), Counter()
    for r in found:
        s = r["_row"]["source"]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert len(found) == len(rows) and all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = mixing.mix(frame(spark, rows).repartition(7), Workspace(spark, "t"), carry=["doc_id", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix(frame(spark, []), Workspace(spark, "t"), carry=["doc_id"]).count() == 0


def test_mixing_prefers_higher_quality(spark):
    rows = [(k, "w " * 10, "", s, 0, "", 0) for k in range(3000) for s in ("a", "b", "c")]
    got = mixing.mix(frame(spark, rows), Workspace(spark, "t"), carry=["doc_id", "source"], quality=lambda size: size * 0 + 1).where("_row.source = 'c' AND taken > 0").count()
    assert 0 < got < 3000
