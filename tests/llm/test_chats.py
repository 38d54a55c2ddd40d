"""Vector codes, conversation repair and chat formatting against brute force."""

import functools
import hashlib
import itertools
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lintmill.llm import audits, chat_format, queries, repair, vector_codes
from tests.conftest import SF

SPACE = " \t\n\x0b\x0c\r"
CHATS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Vector codes

def exact_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label); vectors of one length, a multiple of the parts, in id order."""
    x = [[int(np.floor(1024 * np.float64(v))) for v in vector] for _, vector, _ in rows]
    width = len(x[0]) // parts
    cut = [[row[p * width:(p + 1) * width] for row in x] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]

    def near(p, v):
        square = ((np.array(books[p], object if wide else np.int64) - np.array(v)) ** 2).sum(axis=1).tolist()
        return min(square), square.index(min(square))

    wide = max(abs(c) for row in x for c in row) > 1 << 20
    for _ in range(rounds):
        for p in range(parts):
            used = {}
            for v in cut[p]:
                used.setdefault(near(p, v)[1], []).append(v)
            for i, vs in used.items():
                books[p][i] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [[near(p, cut[p][i]) for p in range(parts)] for i in range(len(rows))]
    errors = [sum(e for e, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(rows, errors):
        total[label] = total.get(label, 0) + e
    digest = sha(",".join(str(v) for b in books for e in b for v in e))
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, total[label], digest) for (i, _, label), f, e in zip(rows, found, errors))


def test_codes_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding, r.label) for r in table.collect())[:300]
    few = table.filter(F.col("vec_id") <= rows[-1][0])
    got = sorted(tuple(r) for r in vector_codes.compress(few).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == exact_codes(rows)
    whole = queries.op11_vector_codes(spark, SF).collect()
    assert len(whole) == table.count() and len({r.codebooks_sha256 for r in whole}) == 1


@pytest.mark.parametrize("entries", [4, 70])
def test_codes_of_ties_and_odd_rows(spark, entries):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist(), i % 3 or None) for i in range(120)]          # many equal distances
    rows += [(200 + i, rows[5][1], 1) for i in range(60)] + [(300, [1e9] * 8, 2), (301, [-3e8] * 8, 2)]  # copies, wide ones
    odd = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [1.0, None] * 4, 1), (903, [float("inf")] * 8, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, label long, `code` string, `my col` long")
    got = sorted(tuple(r) for r in vector_codes.compress(df, entries=entries).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == exact_codes(rows, entries=entries)


def test_codes_of_unusual_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    uneven = spark.createDataFrame([(2, [1.0, 2.0, 3.0], None), (1, [1.0] * 6, None), (None, [], 4), (1, [1.0] * 6, None)], schema)
    got = sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in vector_codes.compress(uneven).collect())
    filled = [(1, [1.0] * 6 + [0.0] * 2, 0), (1, [1.0] * 6 + [0.0] * 2, 0), (2, [1.0, 2.0, 3.0] + [0.0] * 5, 0), (9, [0.0] * 8, 4)]
    assert [g[1:] for g in sorted(got, key=lambda g: (g[0] or 9))] == [w[1:4] for w in exact_codes(filled)]


def test_many_labels_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 2)
    rows = [(i, [float(i % 7)] * 4, [None, 1, 2, 3][i % 4]) for i in range(40)]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=3)
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == exact_codes(rows, entries=3)


# Conversation repair

def by_turn(rows):
    """Rows (turn, role, text, ...) in order: NULL turns first, then role, then a hash of the text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), (xxhash.xxh64_intdigest(r[2].encode(), seed=42) + 2**63) % 2**64))


def exact_repairs(rows):
    convs = {}
    for c, t, r, x in rows:
        key = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if key == 1 else "".join(ch for ch in x if ch not in ".!?") if key == 2 else x
        convs.setdefault(c, []).extend([] if key == 0 else [(t, "user" if key == 4 else r, x)] * (2 if key == 3 else 1))
    return {c: exact_repair(by_turn(rs)) for c, rs in convs.items()}


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def exact_repair(rows):
    turns = [t for t, _, _ in rows if t is not None]
    faults, seen = [], set()
    for _, r, x in rows:
        kept = x.strip(SPACE)
        faults.append("b" if not kept else "d" if (r, x) in seen else "" if kept[-1] in ".!?" else "t")
        seen.add((r, x))

    @functools.cache
    def best(i, state, inserted):
        """Cheapest cost and script from here to the end, as text."""
        options = [(0, "")] if i == len(rows) and state in (0, 3) else []
        moves = [m for m in "ua" if (state, m) in STEP]
        if inserted < 2:
            options += [(3, "I", i, STEP[state, m], inserted + 1) for m in moves]
        if i < len(rows):
            options.append((4, "D", i + 1, state, 0))
            if faults[i] not in ("b", "d"):
                extra, first = 3 * (faults[i] == "t"), rows[i][1][:1]
                options += [(extra, "K", i + 1, STEP[state, first], 0)] if (state, first) in STEP else []
                options += [(extra + 3, "R", i + 1, STEP[state, m], 0) for m in moves]
        full = [o if len(o) == 2 else (o[0] + best(*o[2:])[0], o[1] + best(*o[2:])[1]) for o in options]
        return min(full, default=(10**9, ""))

    for i in reversed(range(len(rows))):
        for state, inserted in itertools.product(range(4), (2, 1, 0)):
            best(i, state, inserted)
    cost, audit = best(0, 0, 0)
    left = sum(e != "D" for e in audit)
    roles, out, source = iter("s" * (left % 2) + "ua" * (left // 2)), [], iter(rows)
    for e in audit:
        _, role, text = (None, "", "") if e == "I" else next(source)
        if e != "D":
            name = {"u": "user", "a": "assistant", "s": "system"}[next(roles)]
            out.append(f"{role if e == 'K' else name}:{text}")
    legal = sum(a[1][:1] + b[1][:1] in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faults.count(f) for f in "bdt"], max(len(rows) - 1, 0) - legal, cost, audit, sha("\n".join(out)))


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF).select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect()}
    assert got == exact_repairs(rows)


def odd_chats(seed):
    rng = np.random.default_rng(seed)
    pick = lambda values: values[int(rng.integers(len(values)))]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ass"]
    texts = ["Yes.", "No", "é!", "", " \n", None, "One. two", "a" * 20000 + "."]
    rows = [(pick([None, 1, 2, 3, 4, 5]), pick([None, *range(12)]), pick(roles), pick(texts)) for _ in range(150)]
    return rows + [(7, t, pick(roles), f"{pick(texts) or ''}{t % 5}?") for t in range(300)] + [(8, 5, "user", "Same.")] * 40


@pytest.mark.parametrize("rows_of_segment", [4096, 7, 1])
def test_repair_of_odd_rows(spark, rows_of_segment):
    rows = odd_chats(rows_of_segment)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CHATS + ", conv string, `a.b c` long")
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df, rows=rows_of_segment).collect()}
    assert got == exact_repairs(rows)
    assert repair.repair(df.limit(0)).collect() == []


def test_scripts_with_colliding_hashes():
    """A tiny prime makes hashes collide all the time; scripts are told apart all the same."""
    rng = np.random.default_rng(0)
    scripts = audits.Scripts(prime=7)
    made = {0: ""}
    for _ in range(400):
        start = int(rng.choice(list(made)))
        letter = "DIKR"[int(rng.integers(4))]
        made[scripts.add(start, letter)] = made[start] + letter
    for a, b in rng.choice(list(made), (2000, 2)).tolist():
        assert scripts.less(a, b) == (made[a] < made[b]) and scripts.text(a) == made[a]


def test_segments_cost_what_rows_cost():
    rng = np.random.default_rng(1)
    for _ in range(30):
        codes = bytes(int(rng.integers(4)) | int(rng.choice([0, 0, 4, 8, 16])) for _ in range(12))
        cost, audit, _ = audits.cheapest(codes)
        ends = audits.ends_before(audits.costs(codes[6:]), [c for c, _ in audits.ENDS])
        first, script, state = audits.cheapest(codes[:6], 0, ends)
        second, rest, _ = audits.cheapest(codes[6:], state)
        assert (first + second, script + rest) == (cost, audit)


# Chat formatting

UGLY = ["</s>", "<\\/s>", "\\", "\\\\<s>", "[[INST]", "<<s>>", "<|im_end|>", "<|im_<|im_sep|>sep|>", "a\nb", "", "\\n<",
        "é<s>\U0001F600[/INST]", "<</SYS>><", "[\\INST]", "$1 \\$", None, "x" * 50000 + "\\"]


def exact_chats(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    out = {}
    for c, rs in convs.items():
        rs = sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0))
        loss = "".join(x for _, r, x in rs if r == "assistant")
        out[c] = (len(rs), sha("".join(f"{r}\n{x}\n" for _, r, x in rs)), len(loss), sha(loss), sum(r == "assistant" for _, r, _ in rs))
    return out


def found(back):
    return {r.conv: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in back.collect()}


def test_format_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL), (-1, 1, "assistant", queries.CONTROL)]
    assert found(queries.op13_chat_format(spark, SF).withColumnRenamed("conv_id", "conv")) == exact_chats(rows)


@pytest.mark.parametrize("rows_of_segment", [4096, 2])
def test_format_of_odd_rows(spark, rows_of_segment):
    roles = ["user", "assistant", "a\n<s>", None]
    rows = [(c, t, roles[(c + t) % 4], x) for c in range(4) for t, x in enumerate(UGLY)]
    rows += [(None, None, "assistant", "one"), (9, 1, "user", None), (10, 1, "user", "same"), (10, 1, "user", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], CHATS + ", `my col` string")
    formatted = chat_format.format_turns(df, rows=rows_of_segment)
    assert found(chat_format.read_back(formatted)) == exact_chats(rows)
    whole = {}
    for r in formatted.orderBy("at").collect():
        whole[r.conv] = whole.get(r.conv, "") + r.text
    made = chat_format.examples(formatted, texts=True).collect()
    assert len(made) == sum(r == "assistant" for _, _, r, _ in rows)
    assert all(whole[r.conv][:r.end] == r.text for r in made)
    plain = formatted.sparkSession.createDataFrame([(r.text[r.start:],) for r in made], "x string").select(chat_format.unescaped(F.col("x")))
    assert sorted(r[0] for r in plain.collect()) == sorted(x or "" for _, _, r, x in rows if r == "assistant")
    inside = [m for m in chat_format.OTHERS if any(m in t for t in whole.values())]
    assert inside == [] and chat_format.read_back(chat_format.format_turns(df.limit(0))).collect() == []


@pytest.mark.parametrize("rows_of_segment", [4096, 3])
def test_every_reply_is_a_stored_example(spark, rows_of_segment, tmp_path):
    """The written rows are the expansion: one a reply, with the prefix that those before it hold."""
    turns = [("user", "hi"), ("assistant", "one <s>"), ("user", "more"), ("tool", ""), ("assistant", ""), ("user", "bye")]
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate(turns)]
    chat_format.write_formatted(spark.createDataFrame(rows, CHATS), str(tmp_path / "chats"), rows=rows_of_segment)
    stored = chat_format.read_formatted(spark, str(tmp_path / "chats")).orderBy("at").collect()
    assert all(len(r.replies) <= 1 for r in stored)
    mark = lambda role, text: f"<|im_start|>{role}<|im_sep|>{text}<|im_end|>"
    turns[1] = ("assistant", "one <\\s>")
    for c in (1, 2):
        text, got = "", []
        for r in stored:
            if r.conv == c:
                got += [(text + r.text[:e.start], r.text[e.start:e.end]) for e in r.replies]
                text += r.text
        assert got == [("".join(mark(*t) for t in turns[:i]) + "<|im_start|>assistant<|im_sep|>", x) for i, (r, x) in enumerate(turns) if r == "assistant"]
        assert text == "".join(mark(*t) for t in turns)
    back = found(chat_format.read_back(spark.createDataFrame(stored, chat_format.read_formatted(spark, str(tmp_path / "chats")).schema).repartition(5)))
    assert back == exact_chats(rows)
