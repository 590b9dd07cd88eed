import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators.chunking import INDEX_SEPARATORS, split_text


def peaks_by_definition(x):
    """Walk left and right of every local maximum until a strictly higher sample."""
    need, found, i, n = 0.1 * (max(x) - min(x)), 0, 1, len(x)
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            sides = []
            for step, k in ((-1, i), (1, j)):
                low = x[i]
                while 0 <= k < n and x[k] <= x[i]:
                    low = min(low, x[k])
                    k += step
                sides.append(low)
            found += x[i] - max(sides) >= need
        i = max(j, i) + 1
    return found


series = st.lists(st.integers(0, 12), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(series)
def test_peaks_match_definition(values):
    x = np.array(values, dtype=float)
    got = S.flat_peaks(x, np.array([0]), np.array([len(x)]))[0]
    assert got == (peaks_by_definition(values) if len(values) > 2 else 0)


@settings(max_examples=300, deadline=None)
@given(series, st.integers(1, 15))
def test_blocks_fold_to_the_same_count(values, block):
    x = np.array(values, dtype=float)
    need = 0.1 * (x.max() - x.min())
    parts = [S.summarise(np.concatenate(([x[s - 1] if s else np.nan], x[s:s + block])), need) for s in range(0, len(x), block)]
    assert S.fold(parts, need) == S.flat_peaks(x, np.array([0]), np.array([len(x)]))[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5), min_size=1, max_size=30), min_size=1, max_size=4), st.sampled_from([10, 20]))
def test_smoothing_is_numpy_same(rows, width):
    lengths = np.array([len(r) for r in rows])
    ends = np.cumsum(lengths)
    full, begin, end = S.smooth(np.concatenate([np.array(r, dtype=float) for r in rows]), ends - lengths, ends, width)
    for r, b, e in zip(rows, begin, end):
        want = np.convolve(np.array(r, dtype=float), np.ones(width) / width, mode="same")
        assert len(want) == e - b == max(len(r), width)
        assert np.allclose(full[b:e], want)


def test_block_series_cover_the_whole():
    x = np.random.default_rng(1).normal(size=200)
    wanted = {"raw": x, "diff": np.diff(x), "diff2": np.diff(x, n=2), "smooth10": np.convolve(x, np.ones(10) / 10, "same"),
              "smooth20": np.convolve(x, np.ones(20) / 20, "same")}
    got = {n: [] for n in S.SERIES}
    for begin in range(0, 200, 64):
        first = max(0, begin - S.HALO)
        part = S.block_series(x[first:begin + 64 + S.HALO], first, begin, min(begin + 64, 200), 200)
        for n, v in part.items():
            got[n].append(v[1:])
            if begin:
                assert np.isclose(v[0], wanted[n][begin - 1])
    for n in S.SERIES:
        assert np.allclose(np.concatenate(got[n]), wanted[n])


def test_seconds_component():
    assert list(S.seconds_part(np.array([86400.0 + 5, 2.5, 3.5]), "round")) == [5.0, 2.0, 4.0]
    assert list(S.seconds_part(np.array([2.9, 90000.2]), "floor")) == [2.0, 3600.0]


def test_chunks_are_bounded_and_cover_the_words():
    text = "\n\n".join(" ".join(f"word{i}_{j}" for j in range(60)) + "." for i in range(12)) + "。" + "汉字" * 400
    for marks in (None, INDEX_SEPARATORS):
        chunks = split_text(text, 512, 50, marks)
        assert max(len(c) for c in chunks) <= 512
        joined = " ".join(chunks)
        assert all(w.rstrip(".") in joined for w in text.replace("。", " ").split() if len(w) < 20)
    assert split_text("", 512, 50) == []
    assert split_text("short", 512, 50) == ["short"]


def test_points_without_a_number_are_no_points_on_either_route(spark):
    from tidemark.operators.features import segment_features

    rng = np.random.default_rng(4)
    rows = [("A", f"s{s}", i, float(x)) for s in range(3) for i, x in enumerate(rng.normal(size=90))]
    holes = [("A", "s0", 1000 + i, None) for i in range(3)] + [("A", "s1", -1, float("nan"))]
    def table(r):
        d = spark.createDataFrame(r, "channel string, segment string, i int, value double")
        return d.select("channel", "segment", F.timestamp_seconds(F.col("i") + 10_000).alias("timestamp"), F.col("i").cast("long").alias("seq"), "value", F.lit(1).alias("sampling"))
    def answers(r, block):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in segment_features(table(r), block=block).collect())
    want = answers(rows, 65_536)
    assert answers(rows + holes, 65_536) == want and answers(rows + holes, 40) == want
