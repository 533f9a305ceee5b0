"""Golden partitions: each letter is a mention, each word a cluster."""

from itertools import permutations

import numpy as np
import pytest

from clusterloom.operators import metrics

A = "a bc def"
GOLD = [  # key, response, MUC R P, B-cubed R P, CEAFe R P, LEA R P; None where none is given
    (A, "a bc def", (1, 1), (1, 1), (1, 1), (1, 1)),
    (A, "a de", (1 / 3, 1), (7 / 18, 1), (0.6, 0.9), (1 / 3, 1)),
    (A, "a bcx defy z", (1, 3 / 5), (1, 55 / 108), (0.88571, 0.66429), (1, 4 / 9)),
    (A, "a bcx dy z", (1 / 3, 1 / 3), (5 / 9, 17 / 42), (0.73333, 0.55), (1 / 2, 2 / 7)),
    (A, "a bcxB dy z", (1 / 3, 1 / 4), (5 / 9, 5 / 16), (0.68889, 0.51667), (1 / 2, 5 / 24)),
    (A, "a bcx dy Bz", (1 / 3, 1 / 4), (5 / 9, 17 / 48), (0.73333, 0.55), (1 / 2, 1 / 4)),
    (A, "a b c d e f", (0, 0), (1 / 2, 1), None, (1 / 6, 1 / 6)),
    (A, "abcdef", (1, 3 / 5), (1, 7 / 18), None, (5 / 6, 4 / 15)),
    (A, "a x y c d e z", (0, 0), (13 / 36, 4 / 7), None, (1 / 6, 1 / 7)),
    (A, "axycdez", (1 / 3, 1 / 6), (17 / 36, 6 / 49), None, (1 / 6, 1 / 21)),
    ("ab cde", "bcx de", None, None, None, (1 / 5, 2 / 5)),
    ("ab cde fg", "bcx de fg", None, None, None, (3 / 7, 4 / 7)),
    ("12345 67 89ABC", "12345 6789ABC", (1, 9 / 10), (1, 16 / 21), None, (1, (5 + 77 / 21) / 12)),
    ("12345 67 89ABC", "1234589ABC 67", (1, 9 / 10), (1, 7 / 12), None, (1, (10 * 20 / 45 + 2) / 12)),
    ("ABCD", "AB CD", (2 / 3, 1), None, None, (1 / 3, 1)),
    ("AB CD", "ABCD", (1, 2 / 3), None, None, (1, 1 / 3)),
    ("ABC", "AC", (1 / 2, 1), None, None, (1 / 3, 1)),
    ("BCDEGHJ", "ABC DEF GHI", (1 / 2, 1 / 2), None, None, (1 / 7, 1 / 3)),
    ("ABC DEFG", "AB CD FGH", (2 / 5, 1 / 2), None, None, ((1 + 2 / 3) / 7, 3 / 7)),
    ("abcdef", "a b c d e f", (0, 0), None, None, (0, 0)),
    ("abcdef", "ab cde f", None, None, None, (4 / 15, 5 / 6)),
    ("abcdef", "abcxyz", None, None, None, (1 / 5, 1 / 5)),
    ("abcdef", "ab cxy z", None, None, None, (1 / 15, 1 / 3)),
    ("a b c d e f", "a b c d e f", (0, 0), None, None, (1, 1)),
    ("a b c d e f", "ab cde f", None, None, None, (1 / 6, 1 / 6)),
    ("a b c d e f", "a b c x y z", None, None, None, (1 / 2, 1 / 2)),
    ("a b c d e f", "ab cxy z", None, None, None, (0, 0)),
]


def rows(doc, key, response):
    side = lambda text: {m: i for i, c in enumerate(text.split()) for m in c}
    k, s = side(key), side(response)
    return [(doc, m, k.get(m), s.get(m)) for m in sorted({*k, *s})]


def table(spark, cases):
    return spark.createDataFrame([r for i, c in enumerate(cases) for r in rows(i, c[0], c[1])], "doc int, mention string, key int, sys int")


def test_golden_partitions(spark):
    df = table(spark, GOLD)
    sums = {r["doc"]: r for r in metrics.per_document(df).collect()}
    ceaf = {r["doc"]: r for r in metrics.ceaf_sums(df).collect()}
    safe = lambda a, b: a / b if b else 0.0
    for i, (_, _, muc, b3, ceafe, lea) in enumerate(GOLD):
        for name, want in (("muc", muc), ("b3", b3), ("lea", lea)):
            if want:
                got = [safe(sums[i][f"{name}_{x}_num"], sums[i][f"{name}_{x}_den"]) for x in "rp"]
                assert got == pytest.approx(want, abs=1e-5), (GOLD[i][:2], name)
        if ceafe:
            assert [ceaf[i]["ceafe_num"] / ceaf[i][f"clusters_{x}"] for x in "rp"] == pytest.approx(ceafe, abs=1e-4)


def test_sides_swap(spark):
    df = table(spark, GOLD[:6])
    a = metrics.evaluate(df).collect()
    b = {r["metric"]: r for r in metrics.evaluate(df.selectExpr("doc", "mention", "sys as key", "key as sys")).collect()}
    for r in a:
        assert (r["recall"], r["precision"]) == pytest.approx((b[r["metric"]]["precision"], b[r["metric"]]["recall"]))


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        g = rng.random((n, m)).round(1)
        wide = g if n <= m else g.T
        best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert metrics.best_assignment(g) == pytest.approx(best)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc int, mention string, key int, sys int")
    assert [tuple(r)[1:] for r in metrics.evaluate(df).collect()] == [(0.0, 0.0, 0.0)] * 6
