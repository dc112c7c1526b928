"""Near copies where ids repeat: a node is a text, not an id."""

from collections import Counter

import numpy as np
from odd_tables import DOCUMENTS, documents

from faultline.llm import minhash


def near(words, rng, n):
    mine = list(words)
    for k in rng.integers(0, len(words), n):
        mine[k] = f"x{rng.integers(10**6)}"
    return " ".join(mine)


def test_one_id_with_unlike_texts_among_others(spark):
    rng = np.random.default_rng(1)
    a, u = [f"a{k}" for k in range(200)], [f"u{k}" for k in range(200)]
    rows = [(0, near(a, rng, 2)), (1, " ".join(a)), (1, " ".join(u)), (2, near(u, rng, 3)), (7, near(a, rng, 2)), (7, "alone in here are these few words")]
    # a bucket that other components share: many texts that have most of their words in common with both
    rows += [(100 + k, " ".join(a[:100] + u[100 : 100 + k] + [f"z{k}_{j}" for j in range(20)])) for k in range(40)]
    for order in (rows, rows[::-1]):
        docs = documents(spark, order).repartition(4)
        out = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
        want = Counter({(0, 0, True): 1, (1, 0, False): 1, (1, 1, True): 1, (2, 1, False): 1, (7, 0, False): 1, (7, 7, True): 1})
        assert Counter((i, c, k) for (i, _, c, k), n in out.items() for _ in range(n) if i < 100) == want
        stay = Counter((r.doc_id, r.text) for r in minhash.one_of_each(docs).collect() if r.doc_id < 100)
        assert stay == Counter([rows[0], rows[2], rows[5]])


def test_two_texts_of_the_smallest_id(spark):
    rng = np.random.default_rng(2)
    a = [f"a{k}" for k in range(300)]
    rows = [(3, near(a, rng, 1)), (3, near(a, rng, 1)), (3, " ".join(a)), (9, near(a, rng, 1))]
    first = minhash.one_of_each(documents(spark, rows)).collect()
    assert len(first) == 1 and first[0].doc_id == 3
    assert [r.text for r in first] == [r.text for r in minhash.one_of_each(documents(spark, rows[::-1]).repartition(3)).collect()]


def test_odd_rows(spark):
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark)).collect())
    assert sum(got.values()) == len(DOCUMENTS)
    assert got[None, True, None, True] == 3 and got[1, False, 1, True] == 1 and got[4, True, 4, True] == 3
    docs = documents(spark)
    stay = minhash.one_of_each(docs)
    assert stay.columns == docs.columns
    # the short tail makes 5 a near copy of 4 from 0.8 on, not the other text of 4
    assert Counter((r.doc_id, r.text) for r in stay.collect() if r.doc_id in (1, 2, 3, 4, None)) == Counter(dict.fromkeys(DOCUMENTS[:7], 1) | {DOCUMENTS[3]: 2, DOCUMENTS[8]: 1})
    assert minhash.one_of_each(documents(spark, [])).count() == 0
