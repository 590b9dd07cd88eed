import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import duckdb
from tidemark.llm import postings, queries, variants, whitening
from tidemark.llm.common import Shelf


# ---- whitening

def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, part string, n double")


def expected(rows, k):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows])
    n, mean = len(x), x.mean(axis=0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return x, (x - mean) @ vectors / np.sqrt(values), values / ((x - mean) ** 2).sum() * n


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(3)
    for m in (1, 2, 7, 40):
        d = np.sort(rng.random(m).round(1))  # many equal ones
        z = np.where(rng.random(m) < 0.3, 0.0, rng.normal(size=m))
        q = np.linalg.qr(rng.normal(size=(m, m)))[0]
        vectors, values = whitening.rank_one(q, d, z, 2.5)
        whole = q @ np.diag(d) @ q.T + 2.5 * np.outer(q @ z, q @ z)
        assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() < 1e-13 * (1 + np.abs(whole).max())
        assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-13 and (np.diff(values) >= 0).all()


def test_spectra_merge_to_the_whole_scatter():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 12)) * np.arange(1, 13) + 1e5
    x[:, 11] = x[:, 0]
    x[50:60] = x[50]
    whole = None
    for a, b in ((0, 5), (5, 6), (6, 50), (50, 90)):
        one = whitening.Spectrum(12)
        for r in x[a:b]:
            one.add(r)
        one = whitening.Spectrum.of(*one.row())
        whole = one if whole is None else whole.merge(one)
    weighted = whitening.Spectrum(12)
    for r, n in zip(*np.unique(x, axis=0, return_counts=True)):
        weighted.add(r, int(n))
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for s in (whole, weighted):
        assert s.n == 90 and np.abs(s.mean - x.mean(axis=0)).max() < 1e-8
        assert np.abs(s.q @ np.diag(s.d) @ s.q.T - scatter).max() < 1e-9 * np.abs(scatter).max()


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_against_a_dense_eigendecomposition(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=10) * np.linspace(3, 0.5, 10)).tolist()) for i in range(300)]
    rows += [(None, rows[0][1])] + [(7, rows[7][1])] * 150
    odd = [(901, None), (902, []), (903, [float("nan")] * 10), (904, [1.0] * 9 + [None]), (905, [1.0] * 9 + [float("inf")]), (906, [1e300] * 10), (907, [1.0, 2.0])]
    got = whitening.whiten(embeddings(spark, rows + odd).repartition(parts), 4).collect()
    x, white, explained = expected(rows, 4)
    sums, n = x.sum(axis=0), len(x)
    assert len(got) == 4 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    of = {i: k for k, (i, _) in enumerate(rows)}
    sign = {r.component: np.sign(r.whitened * white[0, r.component - 1]) for r in got if r.vec_id == 0}
    for r in got:
        k = of[r.vec_id]
        assert abs(r.whitened * sign[r.component] - white[k, r.component - 1]) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.deviation == int(((n * x[k] - sums) ** 2).sum())


def test_the_merged_spectrum_leads_the_refinement(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(400)]
    shelf = Shelf(spark, "test")
    vectors = whitening.integer_vectors(embeddings(spark, rows).repartition(5), shelf)
    assert whitening.components(vectors, shelf)["passes"] == 1
    real = whitening.spectrum

    def blind(v, s):
        whole, sums = real(v, s)
        whole.q = np.eye(40)
        return whole, sums
    monkeypatch.setattr(whitening, "spectrum", blind)
    assert whitening.components(vectors, shelf)["passes"] > 5


def test_whitening_without_spread_or_rows(spark):
    assert whitening.whiten(embeddings(spark, [])).collect() == []
    assert whitening.whiten(embeddings(spark, [(1, None)])).collect() == []
    got = whitening.whiten(embeddings(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in got)
    got = whitening.whiten(embeddings(spark, [(1, [0.5, 0.25]), (2, [1.5, 0.25])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened and abs(r.whitened), r.explained) for r in got) == [(1, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]
    assert whitening.whiten(embeddings(spark, [(1, [1e9, -1e9]), (2, [-1e9, 1e9]), (3, [0.0, 0.0])])).filter("vec_id = 1").first().deviation is None


# ---- postings

TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def decontaminated(docs, items, window):
    phrases = {}
    for i, t in items:
        w = terms(t)
        n = min(len(w), window)
        for a in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[a:a + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, ids = terms(t), set(), set()
        for n in {len(p) for p in phrases}:
            for a in range(len(w) - n + 1):
                of = phrases.get(tuple(w[a:a + n]))
                if of is not None:
                    hit.update(range(a, a + n))
                    ids |= of - {None}
        out.append((i, len(w), len(hit), sorted(map(str, ids))))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdé3") for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.randint(10, 40))) for i in range(12)] + [(50, "Aa-bb"), (51, "the  the"), (52, "only"), (53, None), (54, ""), (55, "?!"), (None, prose(15)), (3, prose(12)), (120, "new new new new new new new new new new new new")]
    items.append((60, items[0][1]))
    docs = [(i, prose(rng.randint(0, 80))) for i in range(60)] + [(None, items[1][1]), (None, None), (200, ""), (201, items[0][1].upper()), (201, items[0][1].upper()),
            (202, f"{prose(9)}, {items[2][1]}; {items[3][1]} {items[2][1]}"), (203, "new " * 40), (204, "the the the AA. bb only x"), (205, items[-3][1] or ""), (206, prose(5000) + " " + items[4][1])]
    for k in range(20):
        docs.append((300 + k, " ".join(terms(items[5][1])[k % 5:][:rng.randint(8, 12)])))
    return docs, items


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", "x", 1) for i, t in docs], "doc_id long, text string, term string, w string, row long").repartition(5),
            spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, words string, n long"))


@pytest.mark.parametrize("window", [10, 2, 1])
def test_decontamination_against_brute_force(spark, window):
    docs, items = corpus()
    got = postings.decontaminate(*tables(spark, docs, items), window).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got], key=repr) == decontaminated(docs, items, window)


def test_decontamination_sql(spark, folder):
    docs, items = corpus()
    d, b = tables(spark, docs, items)
    d.write.parquet(f"{folder}/documents.parquet")
    b.write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = queries.op12_decontaminate(spark, folder)
    told = con.sql(queries.DECONTAMINATE_SQL)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, told.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()))
    assert got.filter("n_items = 0 AND items_sha256 <> '" + hashlib.sha256(b"").hexdigest() + "'").isEmpty()


def test_decontamination_of_empty_tables(spark):
    docs, items = corpus()
    d, b = tables(spark, docs, items)
    assert postings.decontaminate(d.limit(0), b).collect() == []
    for none in (b.limit(0), b.filter("text IS NULL")):
        assert {(r.n_hit, tuple(r.item_ids)) for r in postings.decontaminate(d, none).collect()} == {(0, ())}


def test_proximity_against_brute_force(spark):
    docs, _ = corpus()
    rng = random.Random(2)
    texts = [t for _, t in docs if len(terms(t)) > 3]
    asked = [rng.sample(terms(rng.choice(texts)), 3) for _ in range(25)] + [["a"], ["zzz", "a"], ["a", "a"]]
    shelf = Shelf(spark, "test")
    index = postings.build_index(tables(spark, docs, [])[0], shelf)
    wanted = spark.createDataFrame(list(enumerate(asked)), "w long, words array<string>")
    where = {r.row: (r.doc_id, r.n_words) for r in index.documents.collect()}
    got = Counter((r.w, where[r.row][0], r.start, r.end) for r in postings.proximity_matches(index, wanted, 6, shelf).collect())
    freq, told = Counter(x for _, t in docs for x in terms(t)), Counter()
    for w, words in enumerate(asked):
        rare = min(dict.fromkeys(words), key=lambda x: (freq[x], list(dict.fromkeys(words)).index(x)))
        for i, t in docs:
            have, found = terms(t), set()
            for p, x in enumerate(have, 1):
                if x == rare:
                    fits = [(e - s + 1, s, e) for s in range(max(1, p - 5), p + 1) for e in range(p, min(len(have), s + 5) + 1) if set(words) <= set(have[s - 1:e])
                            and have[s - 1] in words]
                    if fits:
                        found.add(min(fits)[1:])
            told.update((w, i, *f) for f in found)
    assert sum(told.values()) > 20 and got == told


# ---- variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(docs):
    seen = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        form = near[0] if near and -near[0][0] >= 2 * n else None
        out[w] = (n, len(near), form and form[1], form and -form[0])
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return {w: (*v, root(w)) for w, v in out.items()}


def spelled():
    rng = random.Random(9)
    letters = "abeÉéß÷z"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaa", "aaaaaaa", "ababab", "bababa", "abcdef" * 20, "abcdef" * 20 + "g"]
    words = set(stems)
    for s in stems:
        for _ in range(8):
            i = rng.randrange(len(s))
            words |= {s[:i] + rng.choice(letters) + s[i + 1:], s[:i] + s[i + 1:], s[:i] + rng.choice(letters) + s[i:]}
    words = sorted(words)
    docs = [(i, "  ".join(w.capitalize() if rng.random() < 0.1 else w for w in rng.choices(words, weights=[1 + (k * 7) % 50 for k in range(len(words))], k=120)) + " it's 12x3yz_w") for i in range(150)]
    return docs + [(None, docs[0][1]), (3, None), (4, ""), (5, "12 345"), (7, docs[7][1]), (7, docs[7][1])]


@pytest.mark.parametrize("most", [2048, 40])
def test_variants_against_brute_force(spark, most, monkeypatch):
    docs = spelled()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(4)
    monkeypatch.setattr(variants.near_words, "__defaults__", (most, 100))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.variants(df).collect()}
    told = grouped(docs)
    assert sum(v[1] > 0 for v in told.values()) > 100 and sum(v[2] is not None and v[4] != v[2] for v in told.values()) > 3
    assert got == told


def test_variants_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(df).collect() == []
    assert [tuple(r) for r in variants.variants(spark.createDataFrame([(1, "alone alone alone")], "doc_id long, text string")).select("word", "n", "n_near", "form", "form_n", "root").collect()] == [("alone", 3, 0, None, None, "alone")]
