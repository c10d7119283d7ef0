"""Nearest neighbours, toxicity, archives, urls, the pipeline and the registry."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from swathkit.llm import ann, queries, toxicity, urlfilter, warc
from swathkit.llm.common import Workspace

from .helpers import corpus, frame, prose


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string").repartition(3)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    rows = [(k, list(map(float, v)), "") for k, v in enumerate(x)]
    rows += [(1000 + k, rows[5][1], "") for k in range(40)]  # one vector many times
    rows += [rows[7], (2000, None, ""), (2001, [0.0] * 16, ""), (2002, [float("nan")] * 16, ""), (2003, [None] * 16, ""), (2010, [1.0] * 4, ""), (None, rows[1][1], ""), (2100, [float("inf")] + [1.0] * 15, "")]
    good = {k: np.array(v) for k, v, _ in rows if k is not None and k < 2000}
    got = ann.neighbours(vectors(spark, rows), Workspace(spark, "t"), every=50, k=10).collect()
    hits = n = 0
    for q in [k for k in good if k % 50 == 0]:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        best = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), k) for k, v in good.items() if k != q)[:10]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        assert all(abs(r["score"] - np.sqrt(((good[r["vec_id"]] - good[q]) ** 2).sum())) < 1e-9 for r in own)
        hits += len({k for _, k in best} & {r["vec_id"] for r in own})
        n += 10
    assert {r["query_id"] for r in got} == {k for k in good if k % 50 == 0} and hits / n >= 0.95


def test_nearest_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(8)
    one = rng.standard_normal(64)
    x = one / np.linalg.norm(one) + 1e-4 * rng.standard_normal((1200, 64))
    x[:, 0] += 5  # one dominant component
    got = ann.neighbours(vectors(spark, [(k, list(map(float, v)), "") for k, v in enumerate(x)]), Workspace(spark, "t"), every=40, k=10).collect()
    hits = 0
    for q in range(0, 1200, 40):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / 300 >= 0.9


def test_nearest_neighbours_of_few_rows(spark):
    few = vectors(spark, [(0, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (2, [0.0, 2.0], "")])
    got = ann.neighbours(few, Workspace(spark, "t"), every=2, k=10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (2, 0), (2, 1)]
    assert ann.neighbours(vectors(spark, []), Workspace(spark, "t"), every=2).count() == 0


def toxic_texts(n, seed):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        words = prose(seed * 1000 + k, 40).split()
        toxic = int(k % 3 == 0)
        if toxic:
            words[int(rng.integers(40))] = "vile" if k % 2 else "Rotten!"
        if k % 4 == 0 or toxic and k % 5:  # groups are named more often in toxic sentences
            words[int(rng.integers(40))] = toxicity.IDENTITY_TERMS[int(rng.integers(5))]
        rows.append((" ".join(words), toxic))
    return rows


def features_of(texts):
    return [f[o == k - a] for a, b, o, f in toxicity.features(pa.array(texts)) for k in range(a, b)]


def test_counterfactuals_reduce_false_positives():
    texts, labels = zip(*toxic_texts(600, 1), strict=True)
    plain = toxicity.fit(features_of(texts), np.array(labels), penalty=0.0)
    fair = toxicity.fit(features_of(texts), np.array(labels))
    spread = lambda m: np.ptp([m.weights[f].sum() for f in toxicity.word_features(toxicity.IDENTITY_TERMS[:5])])
    assert spread(fair) < spread(plain)
    test, truth = zip(*toxic_texts(300, 2), strict=True)
    for m in (plain, fair):
        assert ((m.scores(pa.array(test)) >= 0.5) == np.array(truth)).mean() > 0.95
    neutral = [prose(9000 + k, 40) + " women and " + toxicity.IDENTITY_TERMS[k % 5] for k in range(200)]
    assert (fair.scores(pa.array(neutral)) >= 0.5).sum() <= (plain.scores(pa.array(neutral)) >= 0.5).sum()


def test_toxicity_scores(spark):
    rows = [(k, t, "", "", 0, "", 0) for k, (t, _) in enumerate(toxic_texts(400, 3))]
    labels = [(k, y, y) for k, (_, y) in enumerate(toxic_texts(400, 3))] + [(5, None, None), (None, 1, 1), (7, 1, 7), (9999, 1, 1)]
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Workspace(spark, "t"))
    got = toxicity.score(frame(spark, rows + corpus()), model).collect()
    import zlib

    assert len(got) == 400 + len(corpus()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 50]
    assert sum(r["predicted"] == labels[r["doc_id"]][2] for r in held) / len(held) > 0.9
    empty = toxicity.train(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"), Workspace(spark, "t"))
    assert toxicity.score(frame(spark, []), empty).count() == 0 and toxicity.score(frame(spark), empty).count() == len(corpus())


def test_warc_round_trip(spark):
    big = "<p>" + "ä" * 5000 + "\r\n\r\nWARC/1.0\r\n</p>"
    pages = [(5, "http://a/5", big), (3, None, big), (9, "http://b/\r\nX: y", big), (4, "u", None), (7, "u", ""), (8, "u", "short"), (6, "u", "short"), (5, "http://a/5", big), (None, "n", big), (None, None, None), (10, "u", prose(1, 200))]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, offset int, digest string").repartition(3)
    index = warc.write_archives(df, Workspace(spark, "t"), file_bytes=500)
    assert index.select("file").distinct().count() > 1
    got = warc.read_records(index, payloads=True).collect()
    expected = []
    for p, _, h in pages:
        raw = (h or "").encode()
        first = 3 if h == big else p
        revisit = len(raw) >= 100 and p != first
        expected.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    k = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r)[:5] for r in got], key=k) == sorted(expected, key=k)
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    some = warc.read_records(index.where("page_id = 10 OR page_id = 8")).collect()
    assert {r["page_id"] for r in some} == {8, 10}
    none = warc.write_archives(df.where("false"), Workspace(spark, "t"))
    assert warc.read_records(none).count() == 0


def test_urls(spark):
    urls = ["http://Example.COM/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/y?z", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://foo.com", "http://foo.com/", "ftp://notexample.com/en/", "no scheme", None, "", "http://", "http://h?/en/", "a://b://c.com/d", "http://x.org#/es/", "http://example.com/EN/", "http://" + "a." * 500 + "example.com/en/"]
    rows = [(k, u, "h", "p") for k, u in enumerate(urls)] + [(1, urls[1], "", ""), (None, urls[0], "", "")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), queries.URL_RULES).collect()

    def brute(url):
        host, path = urlfilter.split_url(url)
        fits = [(len(r), r, v) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    expected = [(r[0], *brute(r[1])) for r in rows]
    k = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(map(tuple, got), key=k) == sorted(expected, key=k)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert [verdicts[i] for i in (0, 1, 3, 4, 5, 6, 7, 8)] == ["block", "allow", "block", "block", "allow", "allow", "allow", "allow"]
    assert urlfilter.split_url("HTTP://User@H.com:80/a/b?c#d") == ("user@h.com:80", "/a/b")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


def test_urls_confirm_collisions():
    rules = urlfilter.DigestRules([("block", "a/"), ("block", "b/")])
    mapped = urlfilter.MappedRules.__new__(urlfilter.MappedRules)
    mapped.digests, mapped.ends, mapped.blocks, mapped.strings = rules.digests.copy(), rules.ends, rules.blocks, rules.strings
    mapped.digests[:] = urlfilter.xxhash.xxh64_intdigest(b"a/")  # both rules with one digest
    found = mapped.find([b"a/", b"b/", b"c/"])
    assert mapped.string(found[0]) == b"a/" and list(found[1:]) == [-1, -1]


def test_pipeline_runs_on_hard_cases(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus() + [(300 + k, prose(500 + k, 150), "en", f"src{k % 4}", 9, "", 0) for k in range(30)] + [(400, prose(500, 150), "en", "src0", 9, "", 0)]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    ids = [r[0] for r in docs.select("doc_id").distinct().collect()]
    assert 400 not in ids and set(ids) & set(range(300, 330))
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_registered_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(queries.oracle_sql()) <= set(names)
