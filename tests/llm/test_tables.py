"""Archives, neighbours, fingerprints, classifiers and the pipeline on small tables."""

import gzip
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lintmill.llm import (
    fingerprints, lm_scoring, mixing, neighbours, packing, quality, queries, substring_dedup, toxicity, warc,
)
from tests.conftest import SF
from tests.llm.test_texts import components, repeats, split


def test_warc_round_trip(spark, tmp_path):
    big, other = "é\r\n\r\nx" * 300, "y" * 1500
    rows = [
        (1, "http://a", big, 0), (5, "u\nv", big, 0), (3, None, big, 0), (7, "u", "small", 0), (8, "u", "small", 0),
        (9, "u", None, 0), (10, "u", "", 0), (None, "u", other, 0), (12, "u", other, 0), (12, "u", other, 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = str(tmp_path / "warc")
    warc.write_archive(warc.page_records(pages), path)
    got = [(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc.read_archive(spark, path).collect()]
    page = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        last = max((j for j, _, h, _ in rows if h == html and j is not None), default=None)
        again = len(data) >= 1000 and last is not None and i != last
        want.append((page(i), "revisit" if again else "response", page(last) if again else None, len(data), b"" if again else data))
    assert sorted(got, key=str) == sorted(((*w[:4], bytearray(w[4])) for w in want), key=str)
    only = warc.read_archive(spark, path, payload=False).filter("record_type = 'revisit'")
    assert only.count() == 3 and only.filter("payload is not null").count() == 0
    assert warc.read_archive(spark, path).filter("record_id in ('<urn:x-page:7>', '<urn:x-page:8>')").count() == 2
    empty = str(tmp_path / "none")
    warc.write_archive(warc.page_records(pages.limit(0)), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_appends_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "warc")
    page = lambda i: warc.page_records(spark.createDataFrame([(i, "u", f"text {i}")], "page_id long, url string, html string"))
    ids = lambda: sorted(r.record_id for r in warc.read_archive(spark, path).collect())
    warc.write_archive(page(1), path)
    warc.write_archive(page(2), path)
    assert ids() == ["<urn:x-page:1>", "<urn:x-page:2>"]
    warc.write_archive(page(3), path, "overwrite")
    assert ids() == ["<urn:x-page:3>"]
    warc.write_archive(page(4), path)
    assert ids() == ["<urn:x-page:3>", "<urn:x-page:4>"]


def test_columns_of_odd_names(spark):
    """Spaces and dots in the names of columns that are carried along."""
    docs = spark.createDataFrame([(1, "one two three.", "s", 7, "x"), (2, None, None, None, None)],
                                 "doc_id long, text string, source string, `my col` long, `a.b` string")
    kept = {"my col", "a.b"}
    path = queries.tokenizer_path()
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, F.lit(False))
    frames = [
        packing.pack(packing.tokenize(docs, path), packing.token_width(path)), substring_dedup.remove_repeats(docs),
        lm_scoring.score_texts(docs, F.lit(False)), mixing.mix_sources(docs, mixing.word_count("text"), F.xxhash64("text")),
        quality.score(docs, *model), toxicity.score(docs, toxicity.train(docs, labels, F.lit(False))),
    ]
    for df in frames:
        assert kept <= set(df.columns)
        assert {r["my col"] for r in df.collect()} == {7, None}


def test_warc_of_others(spark, tmp_path):
    """Members without a length, and records that are not compressed."""
    records = [warc.record({"record_type": t, "record_id": f"<urn:x-page:{i}>", "payload": b"z" * n})
               for i, (t, n) in enumerate([("response", 5), ("resource", 200_000), ("response", 70_000)])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    found = warc.read_archive(spark, str(tmp_path)).filter("record_type = 'response'")
    assert sorted(len(r.payload) for r in found.collect()) == [5, 5, 70_000, 70_000]


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in queries.op1_warc(spark, SF).collect()}
    assert got == {p.page_id: (len((p.html or "").encode()), hashlib.sha1((p.html or "").encode()).hexdigest()) for p in pages}


def exact_neighbours(rows, k=20):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_neighbours(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = exact_neighbours(sorted((r.vec_id, r.embedding) for r in table.collect()))
    got = {}
    for r in queries.op4_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert set(got) == set(want) and np.mean(hits) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]),
            (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (2, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_centroid_walk_finds_near_lists():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 8))
    index = neighbours.Index(points[:2000], np.zeros((0, 0), int), 1.0)
    far = ((index.centroids[:, None] - index.centroids[None]) ** 2).sum(2)
    index.graph = np.argsort(far, axis=1)[:, 1:neighbours.DEGREE + 1]
    found, _ = index.search(points[2000:])
    exact = ((points[2000:, None] - index.centroids[None]) ** 2).sum(2).argsort(1)[:, :10]
    assert np.mean([len(set(f) & set(e)) / 10 for f, e in zip(found, exact)]) > 0.9


def test_graph_over_islands_is_connected():
    """Tight groups of centroids far from each other, some centroids twice."""
    rng = np.random.default_rng(4)
    island = rng.normal(size=(30, 8)) * 50
    points = np.concatenate([c + rng.normal(size=(70, 8)) for c in island])
    centroids = np.unique(np.concatenate([points[:2000], points[:9]]), axis=0)
    graph, hubs = neighbours.linked(centroids)
    reached, ahead = {0}, [0]
    while ahead:
        fresh = [i for i in graph[ahead.pop()].tolist() if i >= 0 and i not in reached]
        reached.update(fresh)
        ahead += fresh
    assert len(reached) == len(centroids) == 2000
    found, far = neighbours.Index(centroids, graph, 1.0, hubs).search(points, 16)
    exact = ((points[:, None] - centroids[None]) ** 2).sum(2).argsort(1)[:, :10]
    assert np.isfinite(far).all() and np.mean([len(set(f) & set(e)) / 10 for f, e in zip(found, exact)]) > 0.95


def clustered_neighbours(spark, path, rows=300_000, every=1501):
    """Found shares of the true neighbours of rare queries and of those on the vector of a third of all rows."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(400, 16))
    vectors = centre[rng.integers(0, 400, rows)] + 0.25 * rng.normal(size=(rows, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids = rng.permutation(rows)
    vectors[rng.random(rows) < 1 / 3] = vectors[0]
    path.mkdir()
    for i in range(8):
        pq.write_table(pa.table({"vec_id": ids[i::8], "embedding": pa.array(list(vectors[i::8]), pa.list_(pa.float64()))}), path / f"{i}.parquet")
    got, rare, hot = {}, [], []
    for r in neighbours.nearest(spark.read.parquet(str(path)), F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % every == 0):
        score = np.round(vectors @ vectors[q], 12)
        score[q] = -2
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        (hot if (vectors[q] == vectors[0]).all() else rare).append(len(want & got.get(int(ids[q]), set())) / 20)
    return rare, hot


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(size=(6000, 12)), 3)
    vectors[0, 3] = 0.0
    vectors[::3] = vectors[0]
    vectors[3, 3] = -0.0
    rows = [(i, v) for i, v in enumerate(vectors.tolist())]
    table = spark.createDataFrame(rows + rows[:30], "vec_id long, embedding array<double>").repartition(5)
    held, ask = neighbours.valid_vectors(table, "vec_id", "embedding"), F.col("vec_id") % 20 == 0
    found = neighbours.distinct_vectors(held, ask, 20).collect()
    assert len(found) == 4001
    assert [(r.ids, r.asked) for r in found if len(r.ids) > 1] == [(list(range(0, 63, 3)), True)]
    assert sum(r.asked for r in found) == 201  # of 300 rows that ask, 100 have the common vector
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    got = {}
    for r in neighbours.nearest(table, ask).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact_neighbours(rows)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    for q in range(0, 6000, 60):
        assert [i for i, _ in got[q]] == [i for i in range(0, 66, 3) if i != q][:20]
        assert [x for _, x in got[q]] == pytest.approx([x for _, x in want[q]])
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want if q % 60]) >= 0.9


def test_recall_above_a_thousand_lists(spark, tmp_path):
    rare, hot = clustered_neighbours(spark, tmp_path / "vectors")
    assert np.mean(rare) >= 0.97 and np.mean(hot) == 1


def test_fingerprints(spark):
    rows = [(5, "a. b. c\nd e f"), (3, "a. b. c\nd e f"), (9, None), (2, ""), (None, "x" * 90), (7, "日本語🙂 text. " * 40), (7, "tie"), (4, "one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, place string")
    got = fingerprints.edited_fingerprints(df).collect()
    texts = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[3, 13].fingerprint == by[5, 13].fingerprint and by[5, 13].near_next < 1
    assert len({r.fingerprint for r in got}) == len({t or "" for _, t in rows})
    for at, (i, text) in enumerate(texts):
        following = texts[(at + 1) % len(texts)][1] or ""
        n = len(text or "")
        edited = (text or "")[:n - n // 2] + following[:n // 2]
        if i != 7 and texts[(at + 1) % len(texts)][0] != 7:  # the two rows of id 7 may come in either order
            assert by[i, n].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0


def test_fingerprint_query_and_located_edits(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = queries.op6_fingerprints(spark, SF).withColumn(
        "moved", F.size(fingerprints.differing_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint"))))
    found = {r.doc_id: r for r in got.collect()}
    for at, (i, text) in enumerate(docs):
        following = docs[(at + 1) % len(docs)][1]
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (found[i].moved == 0) == (edited == text) or text.count("\n") < 2


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold a dozen toxic rows that were not trained on
    scored = queries.QUERIES[name](spark, sf).filter("held_out")
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    good, bad = ([r.score for r in rows if r[label] == y] for y in (1, 0))
    ranked = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert ranked >= 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_classifiers_on_odd_rows(spark):
    texts = [None, "", "you idiot. not stupid", "### $$$ %%%", "x" * 50_000, "clean words here"]
    docs = spark.createDataFrame([(i if i else None, t, 9, "r") for i, t in enumerate(texts)], "doc_id long, text string, score int, row string")
    labels = spark.createDataFrame([(2, 0, 1), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    never = F.lit(False)
    for df in (docs, docs.limit(0)):
        for model in (quality.train(df, labels, never), quality.train(df, labels.limit(0), never)):
            assert quality.score(df, *model).filter("score between 0 and 1").count() == df.count()
        for model in (toxicity.train(df, labels, never), toxicity.train(df, labels.limit(0), never)):
            assert toxicity.score(df, model).filter("score between 0 and 1").count() == df.count()


def test_logistic_reaches_the_least_loss():
    """Few positive rows, nearly told apart by features that depend on each other."""
    rng = np.random.default_rng(8)
    y = (np.arange(5000) < 500).astype(float)
    total = np.where(y == 1, rng.exponential(60, 5000) + 15, rng.exponential(3, 5000) * (rng.random(5000) < 0.3))
    parts = np.where(total > 0, rng.integers(1, 6, 5000), 0)
    x = toxicity.features(np.stack([total, total / np.maximum(parts, 1), parts, np.full(5000, 5.0)], 1))
    weights = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-x @ weights))
    assert np.abs(x.T @ (p - y) + np.array([0.5] * 4 + [1e-3]) * weights).max() < 1e-2
    assert np.mean((p > 0.5) == y) > 0.99


def test_toxicity_with_many_training_rows(spark):
    """1,500 toxic training rows; held-out rows hold the same words in other sentences."""
    rng = np.random.default_rng(5)
    filler = [f"word{i}" for i in range(400)]
    bad = [f"slur{i}" for i in range(30)]

    def text(toxic):
        words = rng.choice(filler, 30).tolist()
        return " ".join(words[:15] + (["you", str(rng.choice(bad))] if toxic else []) + words[15:]) + "."

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(8000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    held_out = queries.remainder("doc_id", 4) == 2
    model = toxicity.train(docs, labels, held_out)
    found = toxicity.score(docs, model).filter(held_out).join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r.predicted for r in found if r.toxic == 1]
    assert sum(toxic) / len(toxic) >= 0.95 and sum(r.toxic == r.predicted for r in found) / len(found) >= 0.97


def test_rare_words_are_learned_at_every_size(spark):
    """Toxic texts of 4 or 5 rows a word, as in a smaller table, among more than 1,000 toxic rows."""
    toxic = [f"some common text zork{i % 300} and more" for i in range(1350)]
    clean = [f"some common text leaf{i % 300} and more" for i in range(2700)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1350)) for i in range(4050)], "doc_id long, toxic int")
    held_out = F.col("doc_id") >= 4050
    learned = toxicity.train(docs, labels, held_out).lexicon.names
    fold = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("fold"))
    seen = {r.doc_id for r in fold.filter("fold < 2").collect()}
    often = [w for w in range(300) if sum(i in seen for i in range(w, 1350, 300)) >= toxicity.LEAST_TEXTS]
    names = toxicity._tokens(pa.array([f"zork{w}" for w in often])).name
    assert len(often) > 100 and np.isin(names, learned).all()


def test_grammar_weighs_clauses():
    import pyarrow as pa

    lexicon = toxicity.Lexicon.build(np.zeros(0, np.uint64), np.zeros(0))
    texts = pa.array(["an idiot", "not an idiot", "he said an idiot", "you idiot", "nothing", "not so. an idiot"])
    plain, denied, told, aimed, none, apart = toxicity.clause_scores(texts, lexicon, toxicity.grammar())[:, 0]
    assert none == 0 < denied < plain < aimed and told < aimed and apart == plain


def test_contractions_deny():
    lexicon = toxicity.Lexicon.build(np.zeros(0, np.uint64), np.zeros(0))
    texts = pa.array(["this isn't an idiot", "this ISN’T an idiot", "this isnt an idiot", "this is an idiot", "an 'idiot'", None])
    apart, curly, joined, plain, quoted, none = toxicity.clause_scores(texts, lexicon, toxicity.grammar())[:, 0]
    assert none == 0 < apart == curly == joined < plain == quoted


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, good), (_, near), (_, cut), (_, mix), (_, pack) = corpus_pipeline.STAGES
    first = good(spark, docs, SF).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in first.collect()}
    clean = [d for d, y in labels.items() if y == 1]
    assert len(kept & set(clean)) >= 0.9 * len(clean)
    second = near(spark, first, SF).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert sorted(r.doc_id for r in second.collect()) == sorted({c for _, _, c in components(rows)})
    third = cut(spark, second, SF).cache()
    rows = second.collect()
    want = {r.doc_id: h for r, (_, _, h) in zip(rows, repeats([r.text for r in rows], 35))}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in third.collect()} == want
    fourth = mix(spark, third, SF).cache()
    words = sum(len(split(r.text)) for r in third.collect())
    assert sum(len(split(r.text)) for r in fourth.collect()) == pytest.approx(1.5 * words, rel=0.02)
    assert fourth.columns == docs.columns
    last = pack(spark, fourth, SF).collect()
    whole = entry.queries()["pipeline"](spark, SF).collect()
    assert sorted(r.length for r in whole) and sum(r.length for r in whole) == sum(r.length for r in last)


def test_all_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
