"""Fingerprints against a plain version, on shuffled and odd tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from odd_tables import DOCUMENTS, documents

from faultline.llm import fingerprints
from faultline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_bins(data):
    out = []
    for at in range(len(data) - 63):
        c = Counter(data[at : at + 64])
        total = sum(round(2**20 * n * math.log2(n)) for n in c.values())
        out.append((64 * 6 * 2**20 - total) * 1000 // (64 * 6 * 2**20))
    return out


def plain_features(data, ranks):
    """Places of the features: each frame of 64 windows, whole or not, votes for its best one."""
    rank = [ranks[b] for b in plain_bins(data)]
    votes = Counter()
    for first in range(-63, len(rank)):
        frame = [(rank[k], k) for k in range(max(0, first), min(len(rank), first + 64)) if rank[k] < fingerprints.NO_RANK]
        if frame:
            votes[min(frame)[1]] += 1
    return sorted(k for k, n in votes.items() if n >= 16)


def plain_ranks(texts):
    seen = Counter(b for t in texts for b in plain_bins(t))
    ranks = [fingerprints.NO_RANK] * 1001
    for rank, b in enumerate(sorted(range(100, 1001), key=lambda b: (seen[b], b))):
        ranks[b] = rank
    return ranks


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(300)]
    made = [" ".join(rng.choices(vocabulary, k=n)) for n in (0, 5, 11, 12, 30, 200, 900)]
    return [t.encode() for t in [*made, made[5][: len(made[5]) // 2] + "é" * 90 + made[4], "=" * 500, "x" * 64, "y" * 63]]


def test_features_and_filters_are_the_plain_ones(texts, monkeypatch):
    ranks = plain_ranks(texts)
    for slab in (1 << 17, 100, 257):
        monkeypatch.setattr(fingerprints, "SLAB", slab)
        found, hashes = fingerprints._Buffer(texts).features(np.array(ranks))
        want = [(k, at) for k, t in enumerate(texts) for at in plain_features(t, ranks)]
        assert found.tolist() == [k for k, _ in want]
        windows = [texts[k][at : at + 64] for k, at in want]
        assert len(set(windows)) == len(set(hashes.tolist()))
        assert [h for h in fingerprints._window_hashes(np.frombuffer(b"".join(windows), np.uint8), np.arange(0, 64 * len(windows), 64))] == hashes.tolist()
    chains = fingerprints.chains(texts, np.array(ranks))
    for k, chain in enumerate(chains):
        seen = list(dict.fromkeys(h for j, h in zip(found.tolist(), hashes.tolist(), strict=True) if j == k))
        assert len(chain) == (-(-len(seen) // 160) if seen else int(bool(texts[k])))
        for row, at in zip(chain, range(0, len(seen), 160), strict=False):
            bits = {(h >> 11 * i) & 2047 for h in seen[at : at + 160] for i in range(5)}
            assert set(np.flatnonzero(np.unpackbits(row.view(np.uint8)))) == bits


def test_likeness(texts):
    ranks = np.array(plain_ranks(texts))
    chains = fingerprints.chains(texts, ranks)
    for a in chains:
        assert fingerprints.likeness(a, a) == 1.0
        assert (fingerprints.read(fingerprints.write(a)) == a).all()
        for b in chains:
            assert 0 <= fingerprints.likeness(a, b) == fingerprints.likeness(b, a) <= 1
    assert fingerprints.likeness(chains[0], chains[6]) == 0.0
    long = texts[6]
    half = long[: len(long) // 2] + texts[5]
    assert 0.3 < fingerprints.likeness(*fingerprints.chains([long, half], ranks)) < 0.9
    assert fingerprints.likeness(chains[5], chains[6]) < 0.2


def check_pairs(rows, got, ranks=None):
    """Edited texts and likeness of neighbours; the order inside one doc_id is any that is one chain."""
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t or "")
    ids = sorted(by_id, key=lambda i: (i is not None, i or 0))
    assert Counter(r.doc_id for r in got) == Counter({i: len(t) for i, t in by_id.items()})
    for k, i in enumerate(ids):
        after = by_id[ids[(k + 1) % len(ids)]]
        allowed = Counter()
        for t in by_id[i]:
            for f in {*by_id[i], *after}:
                allowed[len(t), hashlib.sha256(fingerprints.edit(t, f).encode()).hexdigest()] += 1
        assert all((r.n_chars, r.edited_sha256) in allowed for r in got if r.doc_id == i)
        if len(by_id[i]) == 1 and len(after) == 1:
            (r,) = [r for r in got if r.doc_id == i]
            assert r.edited_sha256 == hashlib.sha256(fingerprints.edit(by_id[i][0], after[0]).encode()).hexdigest()


def test_query_against_brute_force(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"])
    rows = [(i, t or "") for i, t in sorted(zip(docs.doc_id.tolist(), docs.text, strict=True))]
    got = {r.doc_id: r for r in QUERIES["op13_fingerprints"](spark, FOLDER).collect()}
    ranks = fingerprints.rarity_ranks(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert ranks == plain_ranks([t.encode() for _, t in rows])
    assert len(got) == len(rows)
    chains = fingerprints.chains([t.encode() for _, t in rows], np.array(ranks))
    for k, (i, text) in enumerate(rows):
        other = (k + 1) % len(rows)
        edited = fingerprints.edit(text, rows[other][1])
        (changed,) = fingerprints.chains([edited.encode()], np.array(ranks))
        assert tuple(got[i]) == (
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.write(chains[k]), fingerprints.write(changed),
            fingerprints.likeness(chains[k], changed), fingerprints.likeness(chains[k], chains[other]))


def test_odd_texts_and_order(spark):
    table = documents(spark)
    got = fingerprints.fingerprint_documents(table).collect()
    check_pairs(DOCUMENTS, got)
    assert sorted(map(str, got)) == sorted(map(str, fingerprints.fingerprint_documents(table.repartition(7)).collect()))
    assert fingerprints.fingerprint_documents(documents(spark, [])).count() == 0
    (alone,) = fingerprints.fingerprint_documents(documents(spark, [(1, "abcdef")])).collect()
    assert (alone.near_next, alone.edited_sha256) == (1.0, hashlib.sha256(b"abcabc").hexdigest())


def test_one_id_may_hold_most_rows(spark):
    rng = random.Random(1)
    rows = [(5 if k % 3 else k, f"text {rng.random()} " * 5) for k in range(600)] + [(None, f"{k:04d} none") for k in range(300)]
    placed = fingerprints.in_order(documents(spark, rows), buckets=16).collect()
    heavy = Counter(r.bucket for r in placed if r.doc_id == 5 and not r.ahead)
    assert len(heavy) > 3 and max(heavy.values()) < 200
    own = sorted((r for r in placed if not r.ahead), key=lambda r: r.bucket)
    ids = [r.doc_id for r in own]
    assert Counter((r.doc_id, r.text) for r in own) == Counter(rows)
    groups = [[i for i in ids if i is None], sorted(i for i in ids if i is not None)]
    assert [i for g in groups for i in g] == sorted(ids, key=lambda i: (i is not None, i or 0))
    for a, b in zip(own, own[1:], strict=False):
        if a.bucket != b.bucket:
            assert max((-1 if r.doc_id is None else r.doc_id) for r in own if r.bucket == a.bucket) <= (-1 if b.doc_id is None else min(r.doc_id for r in own if r.bucket == b.bucket))
    got = fingerprints.fingerprint_documents(documents(spark, rows)).collect()
    check_pairs(rows, got)
    # one chain through the rows of an id: each text but one is another's next
    assert len({r.edited_sha256 for r in got}) == len(rows)
