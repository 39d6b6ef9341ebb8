"""The operators against brute force, and on odd input: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, htmltext, language, linededup, minhash, passages, quality, sharding, warc
from tallyloom.llm._util import Scratch, components

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, n int, rep string"
r = random.Random(4)
VOCABULARY = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]


def prose(n, seed):
    x = random.Random(seed)
    return " ".join(x.choice(VOCABULARY) for _ in range(n))


LONG = prose(30_000, 77)
BASE = prose(120, 1)
EDITED = " ".join(w if i != 60 else "zzz" for i, w in enumerate(BASE.split()))
TEXTS = [BASE, BASE, EDITED, None, "", " \n\t ", "one", "one two three", LONG, prose(200, 2) + " " + " ".join(BASE.split()[20:100]), "a\nb c d e\n" + BASE, prose(80, 5) + "\n" + prose(20, 6), "é " * 40, BASE.upper(), "123 456"]


def documents(spark, texts=TEXTS):
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 3 else "s", len(t or ""), "x", 1, 2, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]] if rows else [], DOC)


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect())
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark):
    got = {x.doc_id: x for x in minhash.near_duplicates(documents(spark)).collect()}
    sets = [shingles(t) for t in TEXTS]
    parent = list(range(len(TEXTS)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(TEXTS)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), find(i), find(i) == i)
    assert minhash.near_duplicates(documents(spark)).count() == len(TEXTS) + 1
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    (row,) = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).collect()
    assert (row.component_id, row.kept) == (None, True)


def test_near_stage_against_brute_force(spark):
    import corpus_pipeline

    x, texts = random.Random(21), []
    for i in range(40):  # one to five of 120 words differ: similarities about the threshold
        p = prose(120, 8000 + i).split()
        at = x.sample(range(8, 112, 9), 1 + i % 5)
        texts += [" ".join(p), " ".join("new" if k in at else w for k, w in enumerate(p))]
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))
    between = 0
    for j in range(len(texts)):
        for i in range(j):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            between += 80 * b <= 100 * a < 85 * b
            if 100 * a >= 80 * b:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if z == high else z for z in parent]
    got = corpus_pipeline._near(spark, documents(spark, texts), "")
    assert between and {z.doc_id for z in got.collect()} == {i for i, z in enumerate(parent) if i == z}


def test_lines(spark, same):
    def sets(t):
        return [frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower())) for x in t.split("\n")] if t is not None else []

    lines = {(i, k): s for i, t in enumerate(TEXTS) for k, s in enumerate(sets(t)) if s}
    want = {at for at, s in lines.items() if any(b < at and len(s & z) * 100 >= 80 * len(s | z) for b, z in lines.items())}
    assert {tuple(x) for x in linededup.removed_lines(documents(spark)).collect()} == want
    got = {x.row.doc_id: x for x in linededup.deduplicate(documents(spark)).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i].rest is None
        else:
            assert got[i].rest == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)
    assert linededup.digests(documents(spark, [])).count() == 0


def test_random_lines(spark):
    x = random.Random(11)
    texts = ["\n".join(" ".join(x.choice(VOCABULARY[:40]) for _ in range(x.randint(1, 14))) for _ in range(12)) for _ in range(40)]
    lines = {(i, k): frozenset(y.split()) for i, t in enumerate(texts) for k, y in enumerate(t.split("\n"))}
    want = {at for at, s in lines.items() if any(b < at and len(s & z) * 100 >= 80 * len(s | z) for b, z in lines.items())}
    assert {tuple(y) for y in linededup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()} == want


def test_decontamination(spark):
    items = [(1, " ".join(BASE.split()[30:45])), (2, None), (3, "one two"), (4, "zzz yyy xxx"), (5, ""), (None, "three"), (6, " ".join(BASE.split()[30:41]))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    for block in (1 << 20, 60):
        got = {x.doc_id: x for x in decontaminate.contamination(documents(spark), bench, block_bytes=block).collect()}
        for i, t in enumerate(TEXTS):
            w, hit, found = words(t), set(), set()
            for item, text in items:
                p = words(text)
                k = min(10, len(p))
                wins = {tuple(p[j : j + k]) for j in range(len(p) - k + 1)} if k and item is not None else set()
                for j in range(len(w) - k + 1 if k else 0):
                    if tuple(w[j : j + k]) in wins:
                        hit.update(range(j, j + k))
                        found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(found), bool(hit))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        kept = decontaminate.clean(documents(spark), bench, block_bytes=block)
        assert sorted(x.doc_id for x in kept.collect()) == sorted([i for i in got if not got[i].contaminated] + [0] * (not got[0].contaminated))
        assert kept.columns == documents(spark).columns
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
    assert decontaminate.contamination(documents(spark), bench.limit(0)).where("contaminated").count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    v = bpe.Vocabulary(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    return bpe.Encoder(v, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_encoding_is_that_of_the_library(tokenizer):
    mine, theirs = tokenizer
    x = random.Random(2)
    odd = ["a", "the", "é", "ß", "中", "🙂", "½", "Ⅷ", "\x1c", "  ", "\n", "'ll", "=", "aaaa", "1", " "]
    for t in [*(t or "" for t in TEXTS), *("".join(x.choice(odd) for _ in range(x.randint(0, 50))) for _ in range(800)), "a" * 3000]:
        ids = mine.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_prefixes_append_and_edit(tokenizer):
    v = tokenizer[0].vocabulary
    x = random.Random(3)
    data = bytes(x.choice(b"thing andre") for _ in range(3000))
    p = bpe.Prefixes(v, data[:1000])
    p.append(data[1000:])
    assert p.ids() == list(v.encode(data)) and p.ids(777) == list(v.encode(data[:777]))
    before = p.computed
    p.replace(1500, 1510, b"xyz")
    data = data[:1500] + b"xyz" + data[1510:]
    assert p.ids() == list(v.encode(data))
    assert p.computed - before < 300


def test_digests(spark, tokenizer):
    import public_tokenizers as P

    got = {x.doc_id: x for x in bpe.digests(documents(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = tokenizer[1].encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right >= 0.97 * n
    odd = {x.doc_id: x for x in language.predict(documents(spark), language.fit(d)).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (3, 4, 5, 14))
    assert all(0 <= x.score <= 1 for x in odd.values())
    assert language.identify(documents(spark, [])).count() == 0
    nothing = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in language.identify(nothing).collect()} == {"und"}


def test_statistics(spark):
    got = {x.doc_id: x for x in quality.verdicts(documents(spark)).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen, twice = set(), set()
        for k in wins:
            (twice if k in seen else seen).add(k)
        covered = {p for k, x in enumerate(wins) if x in twice for p in range(k, k + 5)}
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (x.base_failed and x.kept)
    assert quality.report(documents(spark, [])).count() == 0


def test_outliers(spark):
    import numpy as np

    texts = [prose(60 + i % 90, i) for i in range(300)] + [" ".join(w + "##$$" for w in prose(80, i).split()) for i in range(6)]
    got = {x.doc_id: x for x in quality.verdicts(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].kept for i in range(300, 306))
    assert np.mean([got[i].kept for i in range(300)]) > 0.97


def test_quality_verdicts_by_numpy(spark):
    """Estimates by concentration steps in numpy, from the same starts, give the same verdicts."""
    import numpy as np

    got = [x.asDict() for x in quality.verdicts(spark.read.parquet(f"{DATA}/documents.parquet")).collect()]
    n = np.array([max(1, x["n_words"]) for x in got], float)
    chars = np.array([max(1, x["word_chars"]) for x in got], float)
    f = np.column_stack([np.log(n), 4 * np.log(chars / n), np.sqrt([x["n_symbols"] for x in got] / chars), np.sqrt([x["n_repeat_words"] for x in got] / n)])
    good = np.array([not x["base_failed"] for x in got])

    def quantile(d2, share):
        steps = np.sort(np.ceil(np.log(np.maximum(d2, 1e-6)) / np.log(quality.RATIO)))
        return quality.RATIO ** steps[int(np.ceil(share * len(steps) - 1e-9)) - 1]

    def middle(v):
        v = np.sort(np.round(v * 256), axis=0) / 256
        return v[int(np.ceil(0.5 * len(v) - 1e-9)) - 1]

    def distance(v, m, s):
        return np.einsum("ij,ij->i", (v - m) @ np.linalg.inv(s), v - m)

    def estimate(v):
        return v.mean(axis=0), np.cov(v.T, bias=True) + quality.FLOOR * np.eye(4)

    def fitted(v):
        m = middle(v)
        ends = []
        for m, s in ((m, np.diag((1.4826 * middle(abs(v - m))) ** 2 + quality.FLOOR)), estimate(v)):
            for _ in range(quality.STEPS):
                d2 = distance(v, m, s)
                m, s = estimate(v[d2 <= quantile(d2, quality.SHARE)])
            ends.append((np.linalg.slogdet(s)[1], m, s))
        return min(ends, key=lambda x: round(x[0], 6))[1:]

    models = {}
    for key in {(x["lang"], s) for x in got for s in (x["source"], "*")}:
        v = f[[g and x["lang"] == key[0] and key[1] in (x["source"], "*") for g, x in zip(good, got, strict=True)]]
        if len(v) >= quality.LEAST:
            m, s = fitted(v)
            models[key] = m, s, quantile(distance(v, m, s), 0.5)
    apart = 0
    for x, v, g in zip(got, f, good, strict=True):
        model = models.get((x["lang"], x["source"])) or models.get((x["lang"], "*"))
        d2 = distance(v[None], *model[:2])[0] * min(1, quality.MEDIAN / model[2]) if model else 0.0
        if g and model:
            assert abs(x["distance"] - d2) <= 0.05 * max(1, d2)
        if abs(d2 - quality.CUTOFF) > 1:
            assert x["kept"] == (bool(g) and d2 <= quality.CUTOFF)
            apart += 1
    assert apart > 0.9 * len(got)


def test_near_duplicates_of_a_cluster(spark):
    """Copies of a few texts that are near each other or just not, against all pairs."""
    rnd = random.Random(5)
    rows = []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(150)]
        for _ in range(60):
            mine = [w if rnd.random() > rnd.choice([0.01, 0.02, 0.04]) else f"x{rnd.randrange(6)}" for w in words]
            rows.append((len(rows), " ".join(mine)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(shingles[a] & shingles[b])
            if 100 * n >= 85 * (len(shingles[a]) + len(shingles[b]) - n):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert [got[i] for i in range(len(rows))] == label
    assert len(set(label)) > 10


def test_passages_odd_and_recall(spark):
    rnd = random.Random(9)
    new = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], {}
    for k in range(40):
        passage = new(60)
        edited = [w if rnd.random() > 0.1 else new(1)[0] for w in passage]
        rows += [(2 * k, " ".join(new(50) + passage + new(50)), None), (2 * k + 1, " ".join(new(30) + edited + new(70)), None)]
        planted[2 * k + 1] = 2 * k
    shared = new(80)
    # one id with two texts, a text that repeats itself, nulls
    rows += [(200, " ".join(shared), "a"), (200, " ".join(new(10) + shared[:70]), "b"), (201, " ".join(shared + new(5)), "c"), (202, "la " * 500, "d"), (203, "la " * 30 + " ".join(new(60)), "e"), (None, " ".join(shared), "f"), (204, None, "g"), (205, "", "h")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, doc string")).collect()
    found = {(x.doc_id, x.other_id) for x in got}
    assert sum((a, b) in found for a, b in planted.items()) >= 0.9 * len(planted)
    assert (201, 200) in found
    assert not {a for a, _ in found} & {202, 203, 204, 205} - {203}


def test_template_lines(spark):
    """Lines that differ in a word are compared with a few, not with each other; only the first stays."""
    for n in (100, 300):
        df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20)) + f" x{i}") for i in range(n)], "doc_id long, text string")
        assert linededup.removed_lines(df).count() == n - 1
        scratch = Scratch(spark, "template")
        words = F.transform("hashes", lambda h: F.shiftright(h, 32).cast("int")).alias("words")
        full = linededup._hashed(linededup._lines(df)).select(*linededup.PLACE, *linededup.KEY, words)
        classes = scratch.keep(linededup._classes(full, linededup._levels(full, scratch), 80), "classes")
        assert linededup._starred(classes, 80, scratch).count() <= linededup.SPREAD * n


def test_line_plans(spark):
    """Posts are shuffled once for both sides of the join."""
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(20)) + f" x{i}") for i in range(200)], "doc_id long, text string")
    scratch = Scratch(spark, "plans")
    words = F.transform("hashes", lambda h: F.shiftright(h, 32).cast("int")).alias("words")
    full = scratch.keep(linededup._hashed(linededup._lines(df)).select(*linededup.PLACE, *linededup.KEY, words), "full")
    classes = scratch.keep(linededup._classes(full, linededup._levels(full, scratch), 80), "classes")
    joined = linededup._joined(classes, classes.select(*linededup.PLACE).limit(20), 80)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shuffles = [y for y in plan.splitlines() if "REPARTITION_BY_COL" in y]
    assert len(shuffles) == 2 and sum("ReusedExchange" in y for y in shuffles) == 1


def test_long_and_short_lines(spark):
    """Sets on both sides of the size from which parities have 128 bits, with as many other words as are allowed and one more."""
    x = random.Random(31)
    texts = []
    for n in (4, 5, 9, 57, 60, 63, 64, 65, 72, 150):
        base = [f"b{n}x{i}" for i in range(n)]
        for k in range(n // 3 + 1):
            line = base[: n - k] + [f"o{n}y{k}z{i}" for i in range(x.choice([0, k]))]
            texts.append(" ".join(x.sample(line, len(line))))
    x.shuffle(texts)
    sets = [frozenset(y.split()) for y in texts]
    want = {(i, 0) for i, s in enumerate(sets) if any(len(s & z) * 100 >= 80 * len(s | z) for z in sets[:i])}
    got = linededup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {tuple(y) for y in got.collect()} == want and want


def test_language_of_one_sentence(spark):
    """No language or word is left out, however rare."""
    said = {"en": "the cat sat on the mat", "fr": "les enfants jouent dans la rue", "de": "wir gehen morgen nach Hause", "fi": "minulla on kaksi koiraa"}
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, text, lang) for i, (lang, text) in zip(ids, said.items(), strict=False)] + [(ids[9], "the dog ran", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in language.identify(df).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_warc(spark):
    magic = "xWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\nzz"
    html = ["a", "b", "a", None, "", magic, "WARC/1.", "é" * 500, "\r\n\r\n", magic, "WARC/1.1\r\n\r\n"]
    pages = spark.createDataFrame([(i, "http://u v", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest int").repartition(3)
    import base64

    for size in ("128m", "90"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {x.page_id: x for x in warc.round_trip(pages).collect()}
        for i, h in enumerate(html):
            data = (h or "").encode()
            first = next(k for k, x in enumerate(html) if (x or "").encode() == data)
            want = len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first
            x = got[i]
            assert (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) == want
        assert len(got) == len(html)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_other_splits(spark):
    """A result that is computed after the splits have changed has every page."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").repartition(2)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        found = warc.round_trip(pages)
        for n in ("6", "13"):
            spark.conf.set("spark.sql.files.minPartitionNum", n)
            assert found.count() == pages.count()
            assert found.select("page_id").distinct().count() == pages.count()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_odd_ids(spark):
    rows = [(None, "u", "a", "x"), (7, None, "a", "x"), (7, "u", "b", "x"), (7, "u", "a", "y"), (None, "u", "c", "x"), (None, "u", "c", "x")]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, payload string")).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert [x for x in got if x[0] == 7] == [(7, "response", None)] * 3
    assert len(got) == 6


def test_html_unmatched_ends_are_linear():
    import time

    began = time.process_time()
    htmltext.main_text("<b>" * 20_000 + "<p>text</p>" + "</i>" * 20_000)
    assert time.process_time() - began < 5


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        *((f"<body><nav><a href=x>x</a></nav>{a}<p>One paragraph has some words in it.</p><p>Another has more of them.</p>{b}</body>", "One paragraph has some words in it. Another has more of them.") for a, b in (
            ('<div class="content no-sidebar">', "</div>"), ('<article class="post has-comments">', "</article>"), ('<div id=page class="site footer-dark"><div>', "</div></div>"),
            ('<main class="side-by-side">', "</main>"), ('<div class="page header"><article>', '</article></div><div class="site-footer"><p>All rights</p></div>'),
            ('<div class="cookie-notice">We use cookies.</div><article>', '</article><section class="comments"><article class="comment"><p>I like it very much indeed.</p></article></section>'))),
        ("<article><header><h1>The head</h1></header><p class='share-price'>A price<p>of <a href=it's>this</a> and <a title=\"foo>that</a></article>", "The head A price of this and that"),
        ("<article><p>a\u3000\u2003b&nbsp;c</p></article>", "a b c"),
        ("<html><body><nav><a href=a>Home</a></nav></body></html>", ""),
        ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; two<br>three  \n four.</p><script>x('</p>')</script></article><footer>f</footer></body></html>", "Head One & two three four."),
        ("<body><div class='menu'><a href=x>a</a></div><div class=content><p>Many words stand here, one after the other, in a row.<p>And in a second paragraph &lt;too&gt; there are some.</div><div class=\"comments\"><p>I liked it</p></div></body>", "Many words stand here, one after the other, in a row. And in a second paragraph <too> there are some."),
    ],
)
def test_html(page, want):
    assert htmltext.main_text(page) == want


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>" + "word " * 50_000), (2, None, "<p>x")], "page_id long, url string, html string")
    assert sorted(x.n_chars for x in htmltext.extract(pages).collect()) == [0, 1, 249_999]


def test_passages(spark):
    passage = prose(70, 900).split()
    fuzzy = [w if i not in (20, 45) else "zzz" for i, w in enumerate(passage)]
    texts = [prose(100, 901), prose(40, 902) + " " + " ".join(passage) + " " + prose(40, 903), prose(30, 904) + " " + " ".join(passage) + " " + prose(9, 905), prose(50, 906) + " " + " ".join(fuzzy), prose(60, 907) + " " + " ".join(passage[:30]), None, "", prose(100, 901), "short text", prose(100, 908)]
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    assert {x.doc_id for x in rows} == {2, 3, 7}
    by = {x.doc_id: x for x in rows}
    assert (by[2].other_id, by[2].start_word, by[2].end_word, by[2].other_start, by[2].n_same) == (1, 30, 100, 40, 70)
    assert by[3].other_id == 1 and by[3].n_same >= 66 and by[7].other_id == 0
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def test_chains_equal_brute_force():
    x = random.Random(8)
    for _ in range(60):
        segs = sorted({(x.randint(0, 60), x.randint(0, 60), x.randint(12, 20)) for _ in range(7)})
        best = 0.0
        slack = passages.K - 1

        def grow(i, score, segs=segs, slack=slack):
            out = score
            a = segs[i]
            for j in range(i + 1, len(segs)):
                b = segs[j]
                if a[0] + a[2] <= b[0] + min(slack, b[2] - 1) and a[1] + a[2] <= b[1] + min(slack, b[2] - 1):
                    out = max(out, grow(j, score + b[2] - 0.1 * (b[0] + b[1] - a[0] - a[1] - 2 * a[2])))
            return out

        best = max(grow(i, float(s[2])) for i, s in enumerate(segs))
        first = passages.chains(segs, 0.1)[0]
        got = first[0][2] + sum(b[2] - 0.1 * (b[0] + b[1] - a[0] - a[1] - 2 * a[2]) for a, b in zip(first, first[1:], strict=False))
        assert abs(got - best) < 1e-9


def hashes(words):
    return passages.Words(pa.array([" ".join(words)]), passages.SPACED).hashes


def test_chain_below_identity_is_cut():
    p, q = prose(60, 910).split(), prose(60, 911).split()
    x, y = p + prose(100, 912).split() + q, p + prose(100, 913).split() + q
    got = passages.align([(0, 0, 60), (160, 160, 60)], hashes(x), hashes(y), 80)
    assert sorted((g[0] // 50, g[1] // 50) for g in got) == [(0, 1), (3, 4)] and all(g[4] >= 60 for g in got)


def test_passages_with_short_agreeing_stretches(spark):
    texts = []
    for i in range(30):  # every 12th word differs, so 11 words in a row agree at most
        p = prose(72, 2000 + i).split()
        q = [f"new{k}" if k % 12 == 11 else w for k, w in enumerate(p)]
        texts += [" ".join([prose(30, 3000 + i), *p, prose(20, 4000 + i)]), " ".join([prose(20, 5000 + i), *q, prose(30, 6000 + i)])]
    got = {x.doc_id: x for x in passages.repeated_passages(documents(spark, texts)).collect()}
    assert set(got) == set(range(1, 60, 2)) and all(got[i].other_id == i - 1 for i in got)


def test_ends_beyond_edits():
    p = prose(60, 914).split()
    q = [w if i not in (10, 49) else "new" for i, w in enumerate(p)]
    (got,) = passages.align([(30, 20, 30)], hashes(prose(15, 915).split() + p + prose(40, 916).split()), hashes(prose(5, 917).split() + q + prose(9, 918).split()), 80)
    assert got == (15, 75, 5, 65, 58)
    q = p[:5] + ["new"] + p[5:13] + p[15:50] + ["new", "more"] + p[50:]  # one more, two less, two more
    (got,) = passages.align([(20, 19, 25)], hashes(p), hashes(q), 80)
    assert got == (0, 60, 0, 61, 58)


def edited(p, rate, x):
    out = []
    for w in p:
        out += [w] if x.random() >= rate else x.choice([[], ["new"], [w, "new"]])
    return out


def common(a, b):
    row = [0] * (len(b) + 1)
    for u in a:
        before = 0
        for j, v in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if u == v else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize(("rate", "least"), [(0.05, 1.0), (0.1, 0.97), (0.15, 0.9)])
def test_recall_against_brute_force(spark, rate, least):
    x, texts, want = random.Random(5), [], set()
    for i in range(80):
        p = prose(60, 7000 + i).split()
        q = edited(p, rate, x)
        if 100 * common(p, q) >= 80 * max(len(p), len(q)) and len(q) >= 50:
            want.add(2 * i + 1)
        texts += [" ".join([prose(40, 7100 + i), *p, prose(40, 7200 + i)]), " ".join([prose(30, 7300 + i), *q, prose(50, 7400 + i)])]
    got = {x.doc_id for x in passages.repeated_passages(documents(spark, texts)).collect()}
    assert len(want) > 50 and len(want & got) >= least * len(want)


def test_large_gaps_are_aligned():
    p, q = prose(400, 920).split(), prose(400, 921).split()
    mid = prose(250, 922).split()
    changed = [w if i % 40 < 30 else "new" for i, w in enumerate(mid)]  # too many in a row for an extension
    (got,) = passages.align([(0, 0, 400), (650, 650, 400)], hashes(p + mid + q), hashes(p + changed + q), 80)
    assert got[:4] == (0, 1050, 0, 1050) and got[4] == 1050 - changed.count("new")
    x = random.Random(12)
    for _ in range(100):
        a, b = ([x.randint(0, 6) for _ in range(x.randint(0, 40))] for _ in "ab")
        assert passages._common(a, b) == common(a, b)


def test_store(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target=40_000, smallest=2_000)
    d = documents(spark, [prose(150, i) for i in range(120)]).repartition(6)
    for k in range(4):
        store.append(d.where(F.col("doc_id") % 4 == k))
        store.compact()
    assert sorted(x.doc_id for x in store.read().collect()) == sorted(x.doc_id for x in d.collect())
    assert store.read().columns == d.columns
    assert store.read(1).count() == d.where("doc_id % 4 = 0").count()
    m = store.manifest()
    assert not store.bins(m["shards"]) and sum(x["rows"] for x in m["shards"]) == d.count()
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(1), [], m["schema"])
    store.vacuum()
    assert store.versions() == [m["version"]] and store.read().count() == d.count()
    assert sharding.compacted(d.limit(0)).count() == 0
    assert sharding.compacted(documents(spark)).count() == len(TEXTS) + 1


def test_store_two_writers(spark, tmp_path):
    """Both arrivals stay, whoever commits first; a merge whose shards another has replaced is planned anew."""
    root = f"file://{tmp_path}/store"
    a, b = (sharding.Store(spark, root, target=1 << 20, fanout=4, smallest=1 << 12) for _ in range(2))
    a.append(spark.range(0, 10).coalesce(1))
    stale = b.manifest()
    a.append(spark.range(10, 20).coalesce(1))
    real, seen = b.manifest, []

    def late(version=None):
        seen.append(1)
        return stale if len(seen) == 1 else real(version)

    b.manifest = late
    b.append(spark.range(20, 30).coalesce(1))
    b.manifest = real
    assert sorted(r.id for r in b.read().collect()) == list(range(30)) and b.manifest()["version"] == 3
    assert b._committed({"shards/none"}, []) is None
    for k in range(3, 6):
        a.append(spark.range(10 * k, 10 * k + 10).coalesce(1))
    a.compact()
    b.vacuum(seconds=3600)
    assert sorted(r.id for r in a.read().collect()) == list(range(60))
    left = len(list((tmp_path / "store" / "shards").glob("*/part-*.parquet")))
    b.vacuum()
    assert len(list((tmp_path / "store" / "shards").glob("*/part-*.parquet"))) < left
    assert sorted(r.id for r in b.read().collect()) == list(range(60))


def test_bpe_looks_up_only_sizes_that_tokens_have():
    from tallyloom.llm import bpe

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"abababab": 258, b"ab" * 8: 259, b"ab" * 16: 260}
    v = bpe.Vocabulary(ranks)
    v.usable = Counted(v.usable)
    data = b"xyz" * 100 + b"ab" * 21 + b"q"
    ids = v.encode(data)
    assert b"".join(v.bytes[i] for i in ids) == data
    assert list(ids) == bpe.Prefixes(bpe.Vocabulary(ranks), data).ids()
    assert Counted.asked < 5 * len(data)
