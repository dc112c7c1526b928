"""Periodic runs against a search of all lags."""

import hashlib
import zlib

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import DOCUMENTS, documents

from faultline.llm import periodic_runs
from faultline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(w, least=24):
    """All lags, each scanned whole; a stretch that a smaller lag explains is not one of this lag."""
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, 3 * q):
                part = w[start:j]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def repeating(draw):
    w = draw(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=120))
    for _ in range(draw(st.integers(0, 3))):
        if w:
            a, p = draw(st.integers(0, len(w) - 1)), draw(st.integers(1, 20))
            for i in range(a, min(len(w), a + draw(st.integers(0, 100)))):
                w[i] = w[a + (i - a) % p]
    return w


@settings(max_examples=400, deadline=None)
@given(st.lists(repeating(), max_size=3), st.sampled_from([3, 24]))
def test_runs_are_those_of_all_lags(texts, least):
    assert periodic_runs.find_runs(texts, least) == [brute(w, least) for w in texts]


def test_long_texts_of_few_words():
    same = [b"a"] * 300_000
    assert periodic_runs.find_runs([same]) == [[(0, 300_000, 1)]]
    cycle = [b"%d" % (k % 999) for k in range(300_000)]
    assert periodic_runs.find_runs([[b"x", *cycle, b"y"]]) == [[(1, 300_000, 999)]]


def planted(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def digest(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"])
    got = QUERIES["op12_periodic_runs"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(digest(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text, strict=True))
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] for r in want) > 10


def test_odd_texts(spark):
    planted_rows = periodic_runs.with_planted_runs(documents(spark))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, " ".join((r.text or "").split())) for r in planted_rows.collect()), key=key) == sorted(
        ((i, b" ".join(planted(i, t)).decode()) if i is None or t is None or zlib.crc32(str(i).encode()) % 10 == 0 else (i, " ".join(t.split())) for i, t in DOCUMENTS), key=key)
    got = periodic_runs.periodic_runs(documents(spark)).collect()
    assert len(got) == len(DOCUMENTS)
    by_id = {r.doc_id: r for r in got}
    assert [tuple(r) for r in by_id[20].runs] == [(0, 3000, 1)] and by_id[20].collapsed == "a"
    assert [tuple(r) for r in by_id[5].runs] == [(0, 80, 10)]
    assert by_id[5].collapsed == "one two three four five six seven eight nine ten x"
    assert all((by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) == (0, [], "") for i in (1, 2, 3))
    assert by_id[7].n_words == 60_001 and by_id[7].runs == []
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0
    assert periodic_runs.with_planted_runs(documents(spark, [])).count() == 0
