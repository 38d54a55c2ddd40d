"""Operators on words against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintmill.llm import jaccard_join, lm_scoring, mixing, packing, queries, substring_dedup, words
from lintmill.llm.components import least_labels
from lintmill.session import materialize
from tests.conftest import SF

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PASSAGE = " ".join(f"p{i}" for i in range(40))
RUN = "again " * 60
SCHEMA = "doc_id long, text string, source string, block string, row string, size long"


def odd_rows():
    base = [f"w{i}" for i in range(80)]
    near = base[:70] + ["x"] + base[71:]
    texts = [
        None, "", "   \n", "one", "One", "one two three", " ".join(base), " ".join(near), " ".join(base),
        f"start {PASSAGE} end", f"other {PASSAGE}\tlast {RUN}", RUN, "É é x " * 30, "long" * 5000,
        " ".join(f"z{i % 7}" for i in range(3000)),
    ]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "b", "r", -1) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, " ".join(base), "s1", "b", "r", -1), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


def test_words_are_the_bytes_between_spaces():
    texts = [r[1] for r in odd_rows()]
    found = words.split_words(pa.array(texts, pa.string()))
    for d, text in enumerate(texts):
        at = range(found.first[d], found.first[d + 1])
        assert [found.data[found.start[i]:found.end[i]].tobytes() for i in at] == split(text)
    by_word = collections.defaultdict(set)
    for i, name in enumerate(found.name.tolist()):
        by_word[found.data[found.start[i]:found.end[i]].tobytes()].add(name)
    assert all(len(n) == 1 for n in by_word.values())
    assert len({min(n) for n in by_word.values()}) == len(by_word)


def test_equal_sequences_have_equal_names():
    name = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64) * np.uint64(977)
    for n in (1, 2, 5, 35):
        found = words.grams(name, n)
        exact = [tuple(name[i:i + n]) for i in range(len(name) - n + 1)]
        assert len(set(found.tolist())) == len(set(exact)) == len(set(zip(found.tolist(), exact)))


def repeats(texts, window):
    held = [split(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in held for i in range(len(w) - window + 1))
    out = []
    for w in held:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_substring_dedup(odd, nothing):
    found = substring_dedup.remove_repeats(odd)
    got = [(r.n_words, r.n_removed, r.h) for r in found.select("n_words", "n_removed", F.sha2("text", 256).alias("h")).collect()]
    assert collections.Counter(got) == collections.Counter(repeats([r[1] for r in odd_rows()], 35))
    assert {"block", "row", "size"} <= set(found.columns)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], repeats([d.text for d in docs], 35)))
    got = queries.op3_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def components(rows):
    """(shingles, least id) of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = split(text, lower=True)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return collections.Counter((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies():
    rng = np.random.default_rng(7)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(25):
            text = list(base)
            for at in rng.integers(0, 60, int(rng.integers(0, 5))):
                text[at] = f"n{rng.integers(0, 10 ** 6)}"
            rows.append((len(rows) + 100, " ".join([*text, "a b c d e f g h"])))
    for n in range(3, 12):  # tiny sets, and their near copies
        tiny = [f"t{n}x{i}" for i in range(n + 4)]
        rows += [(len(rows) + 100, " ".join(tiny)), (len(rows) + 101, " ".join([*tiny, "more"]))]
    return rows


def test_jaccard_join(spark, odd, nothing):
    rows = [(r[0], r[1]) for r in odd_rows()] + near_copies()
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(near_copies(), "doc_id long, text string"))
    got = jaccard_join.linked_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)
    assert jaccard_join.linked_documents(nothing).count() == 0


def test_jaccard_join_compares_tiles_and_labels(spark, monkeypatch):
    """Without hubs and with tiny tiles all links are found by the exact steps."""
    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    got = jaccard_join.linked_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(near_copies())
    kept = jaccard_join.one_per_component(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in components(near_copies())})


def test_jaccard_join_plans_few_joins(spark, monkeypatch):
    """Every join costs the driver memory, however small its tables."""
    joins = []

    def counted(df, kind):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return materialize(df, kind)

    monkeypatch.setattr("lintmill.llm.jaccard_join.materialize", counted)
    monkeypatch.setattr("lintmill.llm.components.materialize", counted)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    got = jaccard_join.linked_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(near_copies())
    assert sum(joins) <= 45


def test_least_labels(spark):
    rng = random.Random(5)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = [*zip(chain, chain[1:]), (7, 7), (3, 9), (9, 3), (9, 11), *[(200 + i, 299) for i in range(40)]]
    rng.shuffle(links)
    got = least_labels(spark.createDataFrame(links, "a long, b long")).collect()
    want = {**dict.fromkeys(chain, 100), **dict.fromkeys((3, 9, 11), 3), **dict.fromkeys((*range(200, 240), 299), 200)}
    assert sorted((r.node, r.label) for r in got) == sorted(want.items())


def test_lm_scores(odd, nothing):
    rows = [(r[0], r[1]) for r in odd_rows()]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    for order in (2, 3):
        got = lm_scoring.score_texts(odd, queries.remainder("doc_id", 5) == 1, order=order).collect()
        grams, histories = collections.Counter(), collections.Counter()
        texts = [["<s>"] * (order - 1) + split(t, lower=True) + ["</s>"] for _, t in rows]
        for (d, _), w in zip(rows, texts):
            for i in range(order - 1, len(w) if not held(d) else 0):
                for n in range(1, order + 1):
                    grams[tuple(w[i - n + 1:i + 1])] += 1
                    histories[tuple(w[i - n + 1:i])] += 1
        total, distinct = histories[()], sum(len(g) == 1 for g in grams)
        want = []
        for (d, _), w in zip(rows, texts):
            base = score = known = 0
            for i in range(order - 1, len(w)):
                p = (grams[w[i],] + 0.5) / (total + 0.5 * (distinct + 1))
                base, known = base + math.log10(p), known + (grams[w[i],] > 0)
                for n in range(2, order + 1):
                    g = tuple(w[i - n + 1:i + 1])
                    p = (grams[g] + lm_scoring.STRENGTH * p) / (histories[g[:-1]] + lm_scoring.STRENGTH)
                score += math.log10(p)
            want.append((str(d), held(d), len(w) - order + 1, known, total, f"{base:.8g}", f"{score:.8g}"))
        assert sorted(want) == sorted(
            (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.8g}", f"{r.score:.8g}") for r in got)
    assert lm_scoring.score_texts(nothing, F.lit(False)).count() == 0


def test_packing(odd, nothing):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    width = packing.token_width(path)
    many = odd.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9)))).repartition(3)
    pieces = packing.pack(packing.tokenize(many, path, window=64), width, window=64).collect()
    assert {"doc_id", "source", "block", "row", "size"} <= set(pieces[0].asDict())
    want = collections.Counter()
    for r in odd_rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[(r[0], len(ids), sum(ids))] += 9
    tokens, sequences = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert len(ids) == p.length > 0
        tokens[(p.doc_id, p.doc_tokens)] += int(ids.sum())
        sequences[p.sequence_id].append((p.offset, p.length))
    totals = collections.Counter()
    for (d, n, s), times in want.items():
        totals[(d, n)] += s * times
    assert tokens == totals
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    assert packing.pack(packing.tokenize(nothing, path), width).count() == 0


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    encoder, rng = packing._Encoder(queries.tokenizer_path(), 1), random.Random(3)
    texts = ["a b, c. d.e it's  two\n\nlines\n x <|endoftext|> y", " x\u00a0 y", "", None, "\n", " ", "É, 日本。 12.5, ok.",
             "a <|endoftext|> b", "<|endoftext|>", " " * 5000 + "x", "x" + "\n" * 300_000 + "y", "ab" * 100_000]
    parts = [" ", " ", "\n", "a", "b.", "Q", "7", ",", "'s", "'LL", "\t", "\0", "é", "foo", "\n\n", "\x1c", "\x85", "\u3000", "٣", "中", "😀", "<|"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(2000)]
    texts += [f"a{c}b {c}{c} 1{c}  {c}\n{c}'s" for c in map(chr, range(1, 0x3100, 7))]
    assert encoder.fast is not None
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want
    encoder.fast = None
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts[:40])] == want[:40]


def test_token_width_builds_no_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    packing._encoder.cache_clear()
    width = packing.token_width(path)
    assert not packing._encoder.cache_info().currsize
    assert width == (2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4) == packing._Encoder(path, 1).kind.itemsize


def test_packing_query(spark):
    """The registered query against the plain tokenizer: every piece's ids, and where they lie."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs}
    pieces, held = collections.defaultdict(list), collections.defaultdict(list)
    for p in queries.op2_packing(spark, SF).collect():
        pieces[p.doc_id].append((p.start, p.length))
        held[p.sequence_id].append((p.offset, p.length))
        mine = ids[p.doc_id]
        assert p.doc_tokens == len(mine)
        assert p.ids_crc32 == zlib.crc32(np.array(mine[p.start:p.start + p.length], "<u4").tobytes())
    assert set(pieces) == set(ids)
    for found, total in [*((pieces[d], len(ids[d])) for d in ids), *((h, None) for h in held.values())]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == total if total else at == 2048 or at & (at - 1) == 0
    assert sum(sum(n for _, n in h) < 2048 for h in held.values()) <= 11


def test_least_squares_fills_windows():
    histogram = np.zeros(65, np.int64)
    histogram[[20, 44, 10, 5, 64 - 5]] = [100, 40, 60, 7, 9]
    slots, taken, sequences = packing.plan(histogram, 64)
    assert (taken <= histogram).all() and taken[44] == 40 and taken[5] == 7 and sequences > 0
    assert sum(r * (high - low) for r, low, high, *_ in slots) == 64 * sequences


def test_mixing(spark, odd, nothing):
    docs = odd.drop("size")
    got = mixing.mix_sources(docs, mixing.word_count("text"), F.xxhash64("text")).collect()
    sizes = collections.Counter()
    for r in odd_rows():
        sizes[r[2]] += len(split(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped, free = {}, set(names)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(stopped.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            stopped[s] = 2 * sizes[s]
            free.discard(s)
    target = {s: stopped.get(s, left * weight[s] / max(1, sum(weight[x] for x in free))) for s in names}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in names)
    again = mixing.mix_sources(docs.repartition(5), mixing.word_count("text"), F.xxhash64("text")).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    mixed = mixing.mixed_texts(mixing.mix_sources(docs, mixing.word_count("text"), F.xxhash64("text")))
    assert mixed.agg(F.sum(mixing.word_count("text"))).first()[0] == sum(taken.values())
    assert mixing.mix_sources(nothing, mixing.word_count("text"), F.xxhash64("text")).count() == 0


def test_highest_quotients(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0}
    seats = collections.Counter()
    for _ in range(21):
        best = max(votes, key=lambda p: (votes[p] / (2 * seats[p] + 1), p < "c"))
        seats[best] += 1
    df = spark.createDataFrame([(p, float(v)) for p, v in votes.items()], "party_name string, vote double")
    got = mixing.apportion(df, "vote", F.lit(21).cast("long"), [], "seats").collect()
    assert {r.party_name: r.seats for r in got} == {p: seats[p] for p in votes}
