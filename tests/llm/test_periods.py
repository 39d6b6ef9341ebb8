"""Periodic runs against a search of all stretches."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import DATA

from tallyloom.llm import periods


def brute(w):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(12, 2 * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 20])
        w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if n > 5 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(n)] = b"x"
        yield w


@pytest.mark.parametrize("heavy", [None, 3])
def test_runs_of_random_texts(monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(periods, "heavy_from", lambda n: heavy)
    every = list(texts(7, 1500))
    assert periods.find(every) == [brute(w) for w in every]


def test_counts_are_exact():
    rng = np.random.default_rng(3)
    own = [np.minimum(rng.zipf(1.3, n) - 1, 500) for n in (3000, 0, 1, 40)]
    for t, got in zip(own, periods.lag_counts(own)):
        assert got.tolist() == [0] + [int((t[:-q] == t[q:]).sum()) for q in range(1, len(t) // 2 + 1)]


def test_one_word_repeated_is_quick():
    assert periods.find([[b"the"] * 30000]) == [[(0, 30000, 1)]]


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 4000]
    got = {r[0]: tuple(r)[1:] for r in periods.digests(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    assert got == {i: expected(i, t) for i, t in short}
    assert sum(v[0] > 0 for v in got.values()) > len(short) / 20


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 40), (4, "a " * 40), (None, "b c " * 9), (9, "  \u0085 " * 10)]
    got = periods.digests(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, runs long")).collect()
    assert sorted(repr(tuple(r)) for r in got if r.doc_id is not None) == sorted(repr((i, *expected(i, t))) for i, t in docs if i is not None)
    assert [tuple(r)[1:6] for r in got if r.doc_id is None] == [(1, 0, 18, 2, 9000)]  # not rewritten
    assert periods.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_operator_keeps_rows(spark):
    got = periods.runs(spark.createDataFrame([(7, "x y z " * 5 + "end", "s")], "doc_id long, body string, runs string"), "body").collect()
    assert got[0].row.runs == "s" and [tuple(r) for r in got[0].runs] == [(0, 15, 3)]
