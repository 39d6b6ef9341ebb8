"""SpotSigs against plain Python, on the test table and on odd rows."""

import hashlib

import pytest
from conftest import DATA

from tallyloom.llm import spotsigs


def plain_words(text):
    out, now = [], []
    for b in (text or "").encode():
        c = bytes([b + 32 if 65 <= b <= 90 else b])
        if c.isalnum() or b >= 128:
            now.append(c)
        elif now:
            out.append(b"".join(now))
            now = []
    return out + ([b"".join(now)] if now else [])


def plain_sets(texts, anchors):
    """Signatures as tuples of words, for texts that have an anchor with a chain."""
    out = []
    for text in texts:
        w = plain_words(text)
        content = [i for i, x in enumerate(w) if x not in anchors]
        out.append({(w[i], *[w[j] for j in after[:3]]) for i in range(len(w)) if w[i] in anchors and len(after := [j for j in content if j > i]) >= 3})
    return out


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()), reverse=True)


def test_against_plain_python(spark, rows):
    from collections import Counter

    got = {r.doc_id: r for r in spotsigs.digests(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    counts = Counter(w for _, t in rows for w in plain_words(t))
    total = sum(counts.values())
    anchors = {w for w, n in counts.items() if n * spotsigs.COMMON >= total}
    texts = [t for _, t in rows]
    after = texts[1:] + texts[:1]
    changed = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, after)]
    sets, new, nexts = (plain_sets(x, anchors) for x in (texts, changed, after))
    assert len(got) == len(rows)
    checked = 0
    for (i, t), c, a, e, n in zip(rows, changed, sets, new, nexts):
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(c.encode()).hexdigest()
        if a and e and n:
            checked += 1
            assert len(got[i].fingerprint) == 8 * len(a) and len(got[i].edited_fingerprint) == 8 * len(e)
            assert got[i].near_edited == pytest.approx(like(a, e)) and got[i].near_next == pytest.approx(like(a, n))
    assert checked > 0.8 * len(rows)


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_next_over_any_ranges(spark, rows, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {r.doc_id: r.edited_sha256 for r in spotsigs.digests(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "edited_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {i: hashlib.sha256(spotsigs.edited(t, u).encode()).hexdigest() for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1])}
    assert got == want


def test_odd_rows(spark):
    docs = [(5, None), (4, ""), (3, "?!"), (3, "?!"), (2, "one two"), (2, "one  TWO"), (None, "the end of it all " * 9), (1, "é " * 50)]
    got = spotsigs.digests(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fingerprint string")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in docs)
    by = {r.doc_id: r for r in got}
    assert by[5].n_chars == 0 and by[5].fingerprint == "" and by[5].near_next == 1.0
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 1  # equal words
    last = by[None]
    assert last.edited_sha256 == hashlib.sha256(spotsigs.edited(docs[6][1], "").encode()).hexdigest()  # then the first, which is null
    (one,) = spotsigs.digests(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    assert spotsigs.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matches_find_every_pair(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    c = spotsigs.classes(spotsigs.fingerprints(docs).select("doc_id", "fingerprint"))
    sets = {r.class_id: {r.fingerprint[k : k + 8] for k in range(0, len(r.fingerprint), 8)} for r in c.collect()}
    for least in (0.8, 0.5):
        want = {(a, b): like(x, y) for a, x in sets.items() for b, y in sets.items() if like(x, y) >= least}
        got = {(r.left_class, r.right_class): r.likeness for r in spotsigs.matches(c, c, least).collect()}
        assert got == pytest.approx(want) and len(got) >= len(sets)


def test_edits_are_nearer_than_neighbours(spark):
    got = [r for r in spotsigs.digests(spark.read.parquet(f"{DATA}/documents.parquet")).collect() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)
