"""Periodic runs, whitening and chat formatting against brute force, with edge cases."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from palisade.llm import chat_format as C, periodic_runs as P, registry, whitening as Wh

SF = "/root/testdata/sf0.001"


# ---- periodic runs --------------------------------------------------------------------------------


def brute_runs(w):
    """Every maximal stretch by its definition, word by word."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(12, 2 * q):
                own = w[s : s + size]
                if not any(own[r:] == own[:-r] for r in range(1, q)):
                    out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    most = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=60))
def test_runs_match_the_definition(cycle, times, rest):
    for w in (cycle * times + rest, rest + cycle * times + rest[:7] + cycle * times):
        assert [tuple(r) for r in P.runs_of(w).tolist()] == brute_runs(w)


def test_runs_of_lag_ranges_add_up():
    rng = np.random.default_rng(2)
    for n in (11, 12, 13, 97, 400):
        w = ([*rng.integers(0, 2, n // 3)] * 3)[:n]
        ids = P.numbers(w)
        for span in (1, 5, 64):
            parts = [P.stretches(ids, lo, lo + span) for lo in range(1, n // 2 + 1, span)]
            assert [tuple(r) for r in P.distinct(np.concatenate(parts)).tolist()] == brute_runs(w)


RUN_ROWS = [(i, " ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 60, 150))) for i in range(40)] + [
    (100, "a " * 40), (100, "a " * 40), (101, "a b c " * 9 + "x " + "b a " * 7), (102, None), (103, ""), (104, " \t\n\x0b\x0c\r "), (None, "no id " * 9),
    (105, "é\u00a0ü " * 12), (106, "one"), (107, "x y z\n" * 700), (108, "long " + "p q r s t " * 500 + "tail " * 30),
]


@pytest.mark.parametrize("work", [P.WORK, 2000])
def test_periodic_runs(spark, work):
    """work=2000: most rows are dealt out by ranges of lags, repeated ones too."""
    docs = spark.createDataFrame([(*r, "clash", 1) for r in RUN_ROWS], "doc_id long, text string, runs string, n_runs int").repartition(3)
    got = sorted((tuple(r) for r in P.find(docs, work=work).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in RUN_ROWS), key=str)
    assert any(r[1] > 1 for r in got) and P.find(docs.limit(0), work=work).count() == 0


def test_periodic_runs_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in registry.op11_periodic_runs(spark, SF).collect()}
    assert set(got) == set(docs)
    for doc_id, text in docs.items():
        if len(text or "") < 3000:
            assert got[doc_id] == brute_row(doc_id, text)


# ---- whitening ------------------------------------------------------------------------------------


def dense(e, k=16):
    x = np.floor(64 * np.asarray(e, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, sums)) for r in x]
    return n, deviation, (x - sums / n) @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_query_equals_dense(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, whitened, explained = dense(np.stack(rows.embedding))
    got = registry.op12_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    w = got.whitened.to_numpy().reshape(-1, 16)
    sign = np.sign((w * whitened).sum(axis=0))
    assert np.abs(w * sign - whitened).max() < 1e-9 and got.deviation.tolist()[::16] == deviation
    assert np.abs(got.explained.to_numpy()[:16] / explained - 1).max() < 1e-9
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, e) for i, e in enumerate(good + good[:5] + bad)] + [(None, good[0]), (1, good[1])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, x string").repartition(3)
    got = Wh.whiten(frame).toPandas()
    n, deviation, whitened, _ = dense(good, 3)
    assert len(got) == 37 * 3 and set(got.n) == {n == 30 and 30} and got.vec_id.isna().sum() == 3
    first = got[got.vec_id == 0].sort_values("component")
    assert np.allclose(np.abs(first.whitened), np.abs(whitened[0])) and set(first.deviation) == {deviation[0]}
    assert Wh.whiten(frame.limit(0)).count() == 0
    assert Wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0
    flat = Wh.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")).toPandas()
    assert len(flat) == 9 and flat.explained.iloc[0] == pytest.approx(1)  # one direction has variance


def test_lanczos_multiples_breakdown_and_convergence():
    rng = np.random.default_rng(0)
    for d, spectrum, most in ((300, np.r_[np.linspace(100, 50, 20), np.full(280, 1e-3)], 6), (100, np.r_[np.full(30, 7.0), np.zeros(70)], 5), (40, np.zeros(40), 3), (5, np.ones(5), 1), (200, 1 / (1 + np.arange(200.0)) ** 2, 12)):
        u = np.linalg.qr(rng.standard_normal((d, d)))[0]
        a = (u * spectrum) @ u.T
        values, axes, passes = Wh.block_lanczos(lambda q, a=a: a @ q, d)
        assert np.abs(values - np.sort(spectrum)[::-1][:16]).max() < 1e-10 and np.abs(a @ axes - axes * values).max() < 1e-10
        assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-12 and passes <= most


def test_deviations_stay_exact():
    m = Wh.Moments(3, (10, -7), (0, 0))
    assert m.deviations(np.array([[5, 2]])) == [25 + 169]
    big = Wh.Moments(1 << 20, (0, 0), (0, 0))
    assert big.deviations(np.array([[1 << 11, 0], [1 << 35, 1]])) == [1 << 62, None]


# ---- chat formatting ------------------------------------------------------------------------------

SIGNS = st.text(st.sampled_from([*"<>|/s[]INT\\S im_endYno", "\n", "é", "\U0001f600"]), max_size=25)
STRINGS = st.lists(st.one_of(SIGNS, st.sampled_from([*C.TEMPLATE.controls, "<\\s>", "[\\\\INST]"])), max_size=6).map("".join)


@settings(max_examples=400, deadline=None)
@given(STRINGS)
def test_escapes_are_reversible(text):
    escaped = re.sub(C.TEMPLATE._after_first(""), r"\\", text)
    assert C.TEMPLATE.unescape(escaped) == text and not any(c in escaped for c in C.TEMPLATE.controls)


def test_ambiguous_controls_are_refused():
    for controls in (("<|im_start|>", "<|im_end|>", ">x"), ("<|im_start|>", "<|im_end|>", "aba"), ("<|im_start|>", "<|im_end|>", "a\\b")):
        with pytest.raises(ValueError):
            C.Template(controls=controls)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_query(spark):
    want = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in registry.op13_chat_format(spark, SF).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns) + len(turns) * len("<|im_start|>\n<|im_end|>\n")


RECORDS = [
    ({"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "x": {"messages": 3}}, [("user", "hi"), ("assistant", "")]),
    ({"id": 2, "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}, [("user", "ab"), ("assistant", "c")]),
    ({"id": "3", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"id": 4, "instruction": "do", "input": "this", "output": "done", "system": None}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"id": 5, "instruction": "do", "input": "", "output": "done", "system": "be kind"}, [("system", "be kind"), ("user", "do"), ("assistant", "done")]),
    ({"id": 6, "messages": [{"author": {"role": "user"}, "content": {"parts": ["a", "b"]}}]}, [("user", "ab")]),
    ({"id": 7, "question": "q", "answer": "a", "context": "c"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ({"id": 8, "prompt": "<s>", "completion": "\\<|im_end|>\n"}, [("user", "<s>"), ("assistant", "\\<|im_end|>\n")]),
    ({"conv_id": 9, "turn": 0, "role": "we\n\\ird</s>", "text": "<s><\\s><<SYS>>"}, [("we\n\\ird</s>", "<s><\\s><<SYS>>")]),
    ({"conv_id": 10, "turn": 1, "role": None, "text": None}, [("", "")]),
    ({"id": 11, "prompt": "x " * 200_000, "response": "<|im_start|>" * 20_000}, [("user", "x " * 200_000), ("assistant", "<|im_start|>" * 20_000)]),
]
REFUSED = ['{"prompt": "p", "messages": [{"role": "u", "content": "c"}]}', '{"foo": 1}', "[1]", "3", "{bad", "[" * 5000, None]


def test_layouts_become_turns(spark):
    records = spark.createDataFrame([(json.dumps(r), 1) for r, _ in RECORDS] + [(r, 1) for r in REFUSED], "record string, turn int").repartition(3)
    got = {r.conv_id: r for r in C.read_back(C.format_records(records)).collect()}
    assert {k: (r.n_turns, r.turns_sha256) for k, r in got.items()} == {i + 1: (len(t), digest(t)) for i, (_, t) in enumerate(RECORDS)}
    refused = C.rejected(records).collect()
    assert sorted(str(r.record) for r in refused) == sorted(map(str, REFUSED)) and all(r.reason for r in refused)


def test_rows_of_a_conversation_stand_in_order(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "system", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, None, "user", "first"), (None, 0, "user", "no id"), (None, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in C.read_back(C.format_records(C.as_records(frame))).collect()}
    assert got[1].turns_sha256 == digest([("user", "first"), ("system", "a"), ("user", "b"), ("user", "b"), ("user", "c")]) and got[None].n_turns == 2
    assert C.read_back(C.format_records(C.as_records(frame.limit(0)))).count() == 0


def test_layouts_that_cannot_be_told_apart_are_refused():
    with pytest.raises(ValueError):
        C.mappings([*C.LAYOUTS, C.Layout("twin", ("prompt", "response"), C.LAYOUTS[6].turns)])
