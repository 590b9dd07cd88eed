import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from tidemark.llm import jaccard
from tidemark.llm import simhash as S
from tidemark.llm.common import Shelf
from tidemark.llm.components import components


def test_masks_are_all_prefix_differences_within_the_budget():
    allowed = S.depth_budget(4, [13, 13, 13, 13, 12])
    assert S.masks(allowed, 13) == [0] and sorted(S.masks(allowed, 16)) == [0, 1, 2, 4]


def test_fingerprints_match_the_definition(documents, odd_rows):
    got = {(r.doc_id, r.fp % 2**64) for r in S.fingerprints(documents(odd_rows)).collect()}
    assert got == {(i, brute.simhash(t)) for i, t, *_ in odd_rows}


def test_components_of_odd_documents(documents, odd_rows):
    out = S.near_duplicates(documents(odd_rows))
    prints = [brute.simhash(t) for _, t, *_ in odd_rows]
    root = brute.classes(prints)
    least = {}
    for (i, *_), r in zip(odd_rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{p:016x}", least.get(r)) for (i, *_), p, r in zip(odd_rows, prints, root)), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want


def test_empty_table(documents):
    assert S.near_duplicates(documents([])).collect() == []
    assert S.representatives(documents([])).collect() == []


def test_representatives_keep_one_of_each_group(documents, odd_rows):
    kept = S.representatives(documents(odd_rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in kept.collect()]
    found = {r.doc_id: r.component_id for r in S.near_duplicates(documents(odd_rows), shingle=5, similarity=0.8).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(found.values()) - {None})
    assert sum(i is None for i in ids) == 1  # the other one is empty, like document 4


@pytest.mark.parametrize("budget, most", [(4, 1 << 15), (4, 20), (4, 1), (2, 1 << 15), (7, 30), (12, 8), (12, 1 << 15)])
def test_trie_join_against_all_pairs(spark, budget, most):
    rng = random.Random(budget + most)
    prints = {rng.getrandbits(64) for _ in range(150)}
    center = rng.getrandbits(64)
    for _ in range(250):  # a dense cloud that shares every part
        x = center
        for b in rng.sample(range(20), rng.randint(0, 6)):
            x ^= 1 << b
        prints.add(x)
    for x in list(prints)[:60]:
        y = x
        for b in rng.sample(range(64), rng.randint(1, budget + 2)):
            y ^= 1 << b
        prints.add(y)
    prints = sorted(prints | {0, 2**64 - 1})
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    pairs = S.links(df, Shelf(spark, "test"), budget, most)
    rows = pairs.collect()
    assert most < 1 << 15 or len(rows) <= (budget + 1) * len(prints)  # a forest per rotation, not all pairs
    roots = {r.id: r.root for r in components(pairs, Shelf(spark, "test")).collect()}
    assert brute.classes(prints, budget) == [roots.get(i, i) for i in range(len(prints))]


def test_similar_texts_are_linked_and_others_are_not(documents):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows, want = [], {}
    for g in range(25):
        words = [rng.choice(vocabulary) for _ in range(300)]
        half = [rng.choice(vocabulary) for _ in range(150)] + words[150:]
        for k in range(4):
            copy = list(words)
            for at in rng.sample(range(300), k):
                copy[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en", "a"))
            want[len(rows) - 1] = len(rows) - 1 - k
        rows.append((len(rows), " ".join(half), "en", "a"))  # similarity about a third
        want[len(rows) - 1] = len(rows) - 1
    got = {r.doc_id: r.component_id for r in S.near_duplicates(documents(rows), shingle=5, budget=12, similarity=0.8).collect()}
    assert sum(got[i] != want[i] for i in want) <= 2
    assert all(got[i] == i for i in range(4, len(rows), 5))


def test_equal_fingerprints_of_different_texts(spark):
    """Many rows of one key that the further words tell apart, and some that they do not."""
    rows = [(i, 5, 0, 0, -1 if i % 2 else 0) for i in range(300)]
    pairs = S.links(spark.createDataFrame(rows, "id long, fp long, fp1 long, fp2 long, fp3 long"), Shelf(spark, "test"), 12, similarity=0.8)
    roots = {r.id: r.root for r in components(pairs, Shelf(spark, "test")).collect()}
    assert [roots.get(i, i) for i in range(300)] == [i % 2 for i in range(300)]


def test_long_chain_of_components(spark):
    n = 200
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.id: r.root for r in components(edges, Shelf(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}


def _jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i:i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_just_above_the_similarity_are_linked(documents):
    """Every pair lies between 0.80 and 0.85, where estimates by bits miss many."""
    rng = random.Random(80)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        tail = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((18, 20)))]
        copy = words[:-len(tail)] + tail
        rows += [(2 * g, " ".join(words), "en", "a"), (2 * g + 1, " ".join(copy), "en", "a")]
    assert all(0.8 <= _jaccard(a[1], b[1]) <= 0.85 for a, b in zip(rows[::2], rows[1::2]))
    got = {r.doc_id: r.component_id for r in S.near_duplicates(documents(rows), shingle=5, similarity=0.8).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_buckets_of_many_unlike_members_are_tried_in_full(documents, monkeypatch):
    """Links that no hub has: chains of texts, each like its neighbours only, against all pairs."""
    rng = random.Random(81)
    rows = []
    for g in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        for k in range(12):  # a window that moves by 18 of 200 shingles, or by 24 now and then
            rows.append((len(rows), " ".join(words), "en", "a"))
            step = 24 if k % 4 == 3 else 18
            words = words[step:] + [f"w{rng.randrange(10**6)}" for _ in range(step)]
    prints = [t for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if _jaccard(prints[i], prints[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    order = list(range(len(rows)))
    rng.shuffle(order)
    for hubs, part in ((6, 4096), (1, 3)):
        monkeypatch.setattr(S.jaccard, "HUBS", hubs)
        monkeypatch.setattr(S.jaccard, "PART", part)
        got = {r.doc_id: r.component_id for r in S.near_duplicates(documents([rows[i] for i in order]), shingle=5, similarity=0.8).collect()}
        assert [got[i] for i in range(len(rows))] == root
    assert 4 < len(set(root)) < len(rows)


def test_shared_repeated_lines_link_nothing(documents):
    """One line ten to fifteen times and different remainders: much of the counted shingles, little of the sets."""
    rng = random.Random(82)
    rows = []
    for repeats, others in ((10, 120), (15, 200)):
        line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(10))
        for _ in range(15):
            rest = " ".join(f"w{rng.randrange(10**6)}" for _ in range(others))
            rows.append((len(rows), "\n".join([line] * repeats + [rest]), "en", "a"))
    assert max(_jaccard(rows[i][1], rows[j][1]) for i in range(30) for j in range(i)) < 0.1
    got = {r.doc_id: r.component_id for r in S.near_duplicates(documents(rows), shingle=5, budget=12, similarity=0.8).collect()}
    assert got == {i: i for i in range(30)}
    assert S.representatives(documents(rows), shingle=5, similarity=0.8).count() == 30


def test_pairs_of_a_group_close_to_one_text_but_not_to_each_other(documents, monkeypatch):
    """Twice the members give about twice the pairs: parities hold back what lies clearly under the similarity."""
    rng = random.Random(83)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    made = []
    real = Shelf.put

    def counted(self, df, label, codec="snappy"):
        out = real(self, df, label, codec)
        if label.startswith("pairs-"):
            made.append(out.count())
        return out
    monkeypatch.setattr(S.jaccard.Shelf, "put", counted)
    totals = []
    for n in (150, 300):
        rows = []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(0, 120, 8), 4):  # edits far apart: 20 of 116 shingles are its own
                words[at] = f"e{rng.randrange(10**9)}"
            rows.append((i, " ".join(words), "en", "a"))
        assert max(_jaccard(rows[i][1], rows[j][1]) for i in range(40) for j in range(i)) < 0.8
        made.clear()
        got = S.representatives(documents(rows), shingle=5, similarity=0.8)
        kept, told = got.count(), sum(made)
        totals.append(told)
        links = sum(_jaccard(rows[i][1], rows[j][1]) >= 0.8 for i in range(n) for j in range(i))
        assert kept >= n - links
    assert totals[1] <= 2.6 * totals[0] + 20, totals


def test_representatives_by_row(documents):
    """Unlike texts of one id all stay, one of each group; rows without an id are compared like any other."""
    rng = random.Random(84)
    def prose():
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, c, "en", "s"), (None, c, "en", "s"), (None, c + " z", "en", "s"), (None, d, None, None), (None, d, None, None),
            (3, b + " tail", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, "one two", "en", "s"), (6, "ONE  two", "en", "s")]
    for _ in range(2):
        got = S.representatives(documents(rows).repartition(3)).collect()
        assert sorted([(r.doc_id, (r.text or "").lower().replace("  ", " ")) for r in got], key=repr) == sorted([(1, a), (1, b), (2, c), (None, d), (4, ""), (6, "one two")], key=repr)
    assert S.representatives(documents([])).collect() == []


@pytest.mark.parametrize("text", [None, b"", b" \n", b"one", b"a b a b a b a b a b a b", b"A  b\tc d e f g a B c d e", b"x " * 3000])
def test_shingle_sets_are_sorted_distinct_hashes(text):
    words = (text or b"").lower().split()
    runs = {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    assert jaccard.hashed(text, 5).tolist() == sorted(xxhash.xxh64_intdigest(r) for r in runs)


def test_direct_links_are_pairs_within_the_budget(spark):
    """A chain of fingerprints one bit apart: members and roots differ in many bits, direct links in no more than the budget, and they span the chain."""
    prints = [(1 << n) - 1 for n in range(0, 60, 3)]
    distinct = spark.createDataFrame(list(enumerate(prints)), "id bigint, fp bigint")
    found = {(r.a, r.b) for r in S.links(distinct, Shelf(spark, "direct"), 4, direct=True).collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in found)
    assert {tuple(sorted(p)) for p in found} == {(n, n + 1) for n in range(19)}


def test_near_copies_go_through_the_trie_join(documents, monkeypatch):
    """What the trie join proposes is what is tried first; texts that differ in more bits are still found."""
    words = [f"word{n}" for n in range(300)]
    near, far = [*words], [*words]
    near[0] = "x"
    far[::70] = ["y"] * len(far[::70])
    rows = documents([(n, " ".join(w), "en", "s") for n, w in enumerate((words, near, far, words[::-1]))])
    given, real = [], jaccard.roots

    def roots(*args):
        given.extend(tuple(r) for r in args[5].collect())
        return real(*args)
    monkeypatch.setattr(jaccard, "roots", roots)
    kept = {r.doc_id for r in S.representatives(rows, 5, 0.8).collect()}
    assert len(given) == 1 and kept == {0, 3}


def test_no_text_is_shuffled_for_near_copies(documents, odd_rows, monkeypatch):
    """Fingerprints are made where the texts are read: no stored table of the run has a text in a shuffle."""
    shuffled, real = [], Shelf.put

    def put(self, df, label, *rest):
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        shuffled.extend((label, given) for given in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan))
        return real(self, df, label, *rest)
    monkeypatch.setattr(Shelf, "put", put)
    rows = documents([r for r in odd_rows if r[0] is not None])
    conf, name = rows.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(name)
    conf.set(name, "-1")
    try:
        assert S.representatives(rows, 5, 0.8).count() > 0
    finally:
        conf.set(name, before)
    assert shuffled and not [x for x in shuffled if "text#" in x[1]]


def test_sets_meet_in_pairs_with_and_without_a_broadcast(spark, monkeypatch):
    """Both routes give the same pairs; with a broadcast only the sets of pairs are shuffled."""
    sets = spark.createDataFrame([(n, list(range(n, n + 40 + n % 3))) for n in range(30)], "id bigint, hashes array<bigint>")
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(a + 1, min(30, a + 9))], "a bigint, b bigint")
    told = {(a, b) for a, b in ((r.a, r.b) for r in pairs.collect()) if _jaccard_of(set(range(a, a + 40 + a % 3)), set(range(b, b + 40 + b % 3))) >= 0.8}
    near = {(r.a, r.b) for r in jaccard.similar(pairs, sets, 0.8).collect()}
    monkeypatch.setattr(jaccard, "small", lambda df: df)
    assert near == told == {(r.a, r.b) for r in jaccard.similar(pairs, sets, 0.8).collect()} and told


def _jaccard_of(x, y):
    return len(x & y) / len(x | y)
