"""Isolation forests per group.

Rows of a group are thinned by hash to a pool that every tree samples from, so what is gathered for training is
bounded by ``psi * trees`` rows whatever the size of the group. One task builds one tree from at most
``psi`` rows. The forest is a table with one row per tree; scoring runs in Arrow batches where the rows are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.hashing import uniform
from tidemark.operators.quantiles import quantiles

MIN_FIT = 10
MIN_EVAL = 5
MAX_BROADCAST_TREES = 20_000
TABLE_ROWS, TABLE_WIDTH, TABLE_CELLS = 4096, 4, 1 << 17
EULER = 0.5772156649015329
TREE_TYPE = T.StructType([
    T.StructField("feature", T.ArrayType(T.IntegerType())), T.StructField("split", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("length", T.ArrayType(T.DoubleType())), T.StructField("psi", T.IntegerType()),
])
GRID = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def draw(tree: str, node: int, what: str) -> float:
    """Uniform number of a node: what a tree does depends on its name and its rows only, on any engine with md5."""
    return int(hashlib.md5(f"{tree}#{node}#{what}".encode()).hexdigest()[:8], 16) / 4294967296.0


def grow(rows: np.ndarray, name: str, limit: int) -> dict[str, list]:
    """One tree as parallel arrays; leaves have feature -1 and carry their path length. Node 1 is the root, 2k and 2k + 1 are the sides of k."""
    tree: dict[str, list] = {"feature": [], "split": [], "left": [], "right": [], "length": []}
    todo = [(rows, 1, 0, -1, "")]
    while todo:
        part, node, depth, parent, side = todo.pop()
        me = len(tree["feature"])
        if parent >= 0:
            tree[side][parent] = me
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        usable = np.flatnonzero(high > low) if len(part) > 1 and depth < limit else []
        if len(usable) == 0:
            values = (-1, 0.0, -1, -1, depth + average_path(len(part)))
        else:
            f = int(usable[int(draw(name, node, "f") * len(usable))])
            cut = float(low[f] + draw(name, node, "c") * (high[f] - low[f]))
            goes = part[:, f] <= cut
            values = (f, cut, -1, -1, 0.0)
            todo += [(part[~goes], 2 * node + 1, depth + 1, me, "right"), (part[goes], 2 * node, depth + 1, me, "left")]
        for column, v in zip(tree, values):
            tree[column].append(v)
    return tree


@F.pandas_udf(TREE_TYPE)
def _grow_batch(group: pd.Series, tree: pd.Series, seed: pd.Series, rows: pd.Series) -> pd.DataFrame:
    out = []
    for g, t, s, sample in zip(group, tree, seed, rows):
        matrix = np.stack([np.asarray(r, dtype=float) for r in sample])
        built = grow(matrix, f"{g}#{t}#{s}", max(1, math.ceil(math.log2(max(len(matrix), 2)))))
        out.append({**built, "psi": len(matrix)})
    return pd.DataFrame(out)


def fit(train: DataFrame, vector: Column, key: str = "segment", group: str | list[str] | None = "channel",
        trees: int | Column = 100, psi: int | Column = 128, seed: int = 42, min_fit: int = MIN_FIT) -> DataFrame:
    """Forest table (group, tree, arrays). ``group=None`` is one forest over everything.

    Groups with fewer than ``min_fit`` rows get no forest. ``trees`` and ``psi`` may be columns that are constant in a group. Tree t is the
    same in a forest of any size, so a larger forest holds the smaller ones.
    """
    name = F.lit("*") if group is None else F.concat_ws("|", *([group] if isinstance(group, str) else group))
    return _samples(train, name, vector, key, trees, psi, seed, min_fit).withColumn("t", _grow_batch("grp", "tree", F.lit(str(seed)), F.col("rows.x"))).select(
        "grp", "tree", "t.*")


def _samples(train: DataFrame, name: Column, vector: Column, key: str, trees: int | Column, psi: int | Column, seed: int, min_fit: int) -> DataFrame:
    """(grp, tree, rows): the rows that each tree of a group is grown from, as sorted structs (key, x)."""
    trees, psi = (F.lit(v) if isinstance(v, int) else v for v in (trees, psi))
    rows = train.select(name.alias("grp"), F.col(key).cast("string").alias("key"), vector.alias("x"), trees.alias("trees"), psi.alias("psi"))
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_fit)

    def lot(tree: Column) -> Column:
        return uniform(F.col("key"), F.concat_ws(":", F.lit(str(seed)), tree.cast("string")))

    # Every row may be drawn by every tree. A row leaves its task only for the trees in whose first lots it is: some more than
    # psi per tree, so that the psi smallest are among them but for a chance below 1e-9.
    enough = F.col("psi") + 6.0 * F.sqrt("psi") + 20.0
    # The numbers are exploded before the lots are drawn: compiled code draws them, a lambda over an array is interpreted.
    each = rows.join(sizes, "grp").select("grp", "key", "x", "psi", "n", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    each = each.filter(lot(F.col("tree")) * F.col("n") <= enough).drop("n").withColumn("u", lot(F.col("tree"))).withColumn(
        "_r", F.row_number().over(W.partitionBy("grp", "tree").orderBy("u", "key"))).filter(F.col("_r") <= F.col("psi"))
    return each.groupBy("grp", "tree").agg(F.sort_array(F.collect_list(F.struct("key", "x"))).alias("rows"))


def draws(train: DataFrame, vector: Column, key: str = "segment", group: str | None = None, trees: int = 100, psi: int = 128, seed: int = 42,
          min_fit: int = MIN_FIT) -> DataFrame:
    """(grp, tree, x): the vectors that tree t of every subset of columns is grown from; what a tree draws does not depend on its columns."""
    name = F.lit("") if group is None else F.coalesce(F.concat(F.lit("|"), F.col(group)), F.lit(""))
    return _samples(train, name, vector, key, trees, psi, seed, min_fit).select("grp", "tree", F.col("rows.x").alias("x"))


def grow_subsets(drawn: DataFrame, subsets: dict[str, list[int]], trees: int = 100, seed: int = 42) -> DataFrame:
    """Forest table of every subset from the rows of draws(); a task grows the trees of all subsets from a sample."""
    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        for batch in batches:
            for g, t, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                matrix = np.array(rows.as_py(), dtype=float)
                limit = max(1, math.ceil(math.log2(max(len(matrix), 2))))
                yield pa.RecordBatch.from_pylist(
                    [{"grp": s + g, "tree": t, **grow(matrix[:, places], f"{s}{g}#{t}#{seed}", limit), "psi": len(matrix)} for s, places in subsets.items()], kind)

    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("tree", T.IntegerType()), *TREE_TYPE.fields])
    return drawn.repartition(max(trees, 1), "grp", "tree").mapInArrow(grown, schema)


def fit_subsets(train: DataFrame, vector: Column, subsets: dict[str, list[int]], key: str = "segment", group: str | None = None,
                trees: int = 100, psi: int = 128, seed: int = 42, min_fit: int = MIN_FIT) -> DataFrame:
    """The forests that fit() gives rows repeated for every subset, named by subset, or by subset and group; subsets: name to places in the vector.

    Rows are drawn once for all subsets.
    """
    return grow_subsets(draws(train, vector, key, group, trees, psi, seed, min_fit), subsets, trees, seed)


def _walk(matrix: np.ndarray, tree: tuple, block: int = 8192) -> np.ndarray:
    """Path length of each row in a tree, level by level; a leaf is its own child."""
    feature, split, left, right, length, _ = tree
    inner, own = feature >= 0, np.arange(len(feature))
    asked = np.where(inner, feature, 0).astype(np.intp)
    kids = np.stack([np.where(inner, right, own), np.where(inner, left, own)], axis=1).astype(np.intp).ravel()
    level, depth = own[:1][inner[:1]], 0
    while level.size:
        level, depth = kids.reshape(-1, 2)[level].ravel(), depth + 1
        level = level[inner[level]]
    out = np.empty(len(matrix))
    for first in range(0, len(matrix), block):  # a block stays in the processor's cache
        part = matrix[first:first + block]
        flat, start, at = part.ravel(), np.arange(len(part)) * part.shape[1], np.zeros(len(part), dtype=np.intp)
        for _ in range(depth):
            at = kids.take(2 * at + (flat.take(start + asked.take(at)) <= split.take(at)))
        out[first:first + block] = length.take(at)
    return out


def _cells(tree: tuple, cuts: list[np.ndarray]) -> np.ndarray:
    """Path lengths by bins of the features: bin i of a feature lies above i of the tree's cuts, a node fills the box of bins that come to it."""
    feature, split, left, right, length, _ = (a.tolist() if isinstance(a, np.ndarray) else a for a in tree)
    table = np.empty([len(c) + 1 for c in cuts])
    places = [{c: i + 1 for i, c in enumerate(own.tolist())} for own in cuts]
    todo = [(0, tuple(slice(0, len(c) + 1) for c in cuts))]
    while todo:
        node, box = todo.pop()
        f = feature[node]
        if f < 0:
            table[box] = length[node]
        else:
            at, (a, b) = places[f][split[node]], (box[f].start, box[f].stop)
            todo += [(left[node], (*box[:f], slice(a, min(b, at)), *box[f + 1:])), (right[node], (*box[:f], slice(max(a, at), b), *box[f + 1:]))]
    return table


def _path_lengths(matrix: np.ndarray, forest: list) -> Iterator[np.ndarray]:
    """Path length of each row in one tree after the other.

    Where rows are many and features few, a tree is laid out as a table over the bins that its cuts make of the features, and rows are looked
    up: the features' ranks among all cuts of the forest are found once, and give the bins of every tree.
    """
    matrix = np.ascontiguousarray(matrix)
    wide = matrix.shape[1]
    tabled = len(matrix) >= TABLE_ROWS and wide <= TABLE_WIDTH
    if tabled:
        cuts = [np.unique(np.concatenate([tree[1][tree[0] == f] for tree in forest])) for f in range(wide)]
        ranks = [np.searchsorted(c, matrix[:, f]) for f, c in enumerate(cuts)]  # cuts below the value
    for tree in forest:
        own = [np.unique(tree[1][tree[0] == f]) for f in range(wide)] if tabled else []
        if not tabled or math.prod(len(c) + 1 for c in own) > TABLE_CELLS:
            yield _walk(matrix, tree)
            continue
        table = _cells(tree, own)
        cell = np.zeros(len(matrix), dtype=np.intp)
        for f, c in enumerate(own):
            if len(c):
                above = np.zeros(len(cuts[f]) + 1, dtype=np.intp)
                above[np.searchsorted(cuts[f], c) + 1] = table.strides[f] // table.itemsize
                cell += np.cumsum(above).take(ranks[f])
        yield table.ravel().take(cell)


def _descend(matrix: np.ndarray, forest: list, counts: list[int] | None = None) -> np.ndarray:
    """Mean path length of each row, normalised by the expected one: the score in (0, 1). counts: a column for each forest of the first so many trees."""
    if matrix.ndim == 2 and matrix.shape[1] == 1:
        # values between two neighbouring cuts of the forest go the same way in every tree
        cuts = np.unique(np.concatenate([tree[1][tree[0] >= 0] for tree in forest]))
        if len(matrix) > len(cuts) + 1:
            return _descend(np.append(cuts, np.inf)[:, None], forest, counts)[np.searchsorted(cuts, matrix[:, 0])]
    norm = average_path(forest[0][5])
    total, out = np.zeros(len(matrix)), {}
    for n, lengths in enumerate(_path_lengths(matrix, forest), 1):
        total += lengths
        if n == len(forest) or n in (counts or ()):
            out[n] = np.power(2.0, -(total / n) / norm) if norm > 0 else np.full(len(matrix), 0.5)
    return out[len(forest)] if counts is None else np.stack([out.get(c, np.full(len(matrix), np.nan)) for c in counts], axis=1)


def _unpack(forest: pa.Table) -> list[tuple]:
    """(group, tree, arrays, psi) of the rows of a forest table, in this order."""
    if not forest.num_rows:
        return []
    forest = forest.combine_chunks()
    cut = forest["feature"].chunk(0).offsets.to_numpy()
    flat = [forest[n].chunk(0).values.to_numpy() for n in ("feature", "split", "left", "right", "length")]
    names = zip(forest.column(0).to_pylist(), forest["tree"].to_pylist(), forest["psi"].to_pylist(), cut[:-1], cut[1:])
    return sorted(((g, t, (*(f[a:b] for f in flat), psi)) for g, t, psi, a, b in names), key=lambda r: r[:2])


def score(df: DataFrame, forest: DataFrame, vector: Column, group: str | list[str] | None = "channel",
          out: str = "score", max_broadcast: int = MAX_BROADCAST_TREES, salts: int = 64) -> DataFrame:
    """Adds the isolation score (0..1, higher is stranger); NULL where the group has no forest.

    Up to ``max_broadcast`` trees (each at most 2*psi nodes) travel to the executors as one broadcast. More trees
    are met group by group, with every group spread over ``salts`` tasks.
    """
    name = F.lit("*") if group is None else F.concat_ws("|", *([group] if isinstance(group, str) else group))
    rows = df.withColumn("_grp", name).withColumn("_x", vector)
    held = forest.limit(max_broadcast + 1).toArrow()
    if held.num_rows <= max_broadcast:
        by_group: dict[str, list] = {}
        for g, _, tree in _unpack(held):
            by_group.setdefault(g, []).append(tree)
        shared = df.sparkSession.sparkContext.broadcast(by_group)

        @F.pandas_udf("double")
        def isolation(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            forests = shared.value
            for groups, xs in batches:
                result = pd.Series(np.nan, index=groups.index)
                for g, index in groups.groupby(groups).groups.items():
                    if g in forests:
                        result[index] = _descend(np.stack(xs[index].to_list()), forests[g])
                yield result.where(result.notna(), None)

        return rows.withColumn(out, isolation("_grp", "_x")).drop("_grp", "_x")

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(salts)))
    copies = forest.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    schema = ", ".join(f"`{n}` {t}" for n, t in salted.dtypes if n not in ("_grp", "_x", "_salt")) + f", {out} double"
    types = [(n, t) for n, t in df.dtypes]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        trees = [tree for *_, tree in _unpack(right)]
        kept = {n: left.column(n) for n, _ in types}
        if left.num_rows and trees:
            xs = np.stack([np.asarray(x) for x in left.column("_x").to_pylist()])
            return pa.table(kept | {out: pa.array(_descend(xs, trees), pa.float64())})
        return pa.table(kept | {out: pa.nulls(left.num_rows, pa.float64())})

    return salted.groupBy("_grp", "_salt").cogroup(
        copies.withColumnRenamed("grp", "_grp").groupBy("_grp", "_salt")).applyInArrow(meet, schema)


def score_subsets(df: DataFrame, forest: DataFrame, vector: Column, subsets: dict[str, list[int]], key: str = "segment",
                  block: int = 8, part: int = 20_000) -> DataFrame:
    """(key, subset, score) of every row by every subset's forest of fit_subsets without a group; NULL where there is no forest.

    Subsets are dealt to blocks and rows to parts; every part meets the trees of every block in a task.
    """
    places = {s: (n // block, places) for n, (s, places) in enumerate(subsets.items())}
    blocks = -(-len(subsets) // block)
    rows = df.select(key, vector.alias("_x"))
    parts = max(1, -(-rows.count() // part))
    named = F.create_map(*[F.lit(v) for s, (n, _) in places.items() for v in (s, n)])
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    told = forest.withColumn("_block", named[F.col("grp")]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = dict(df.dtypes)[key]

    def meet(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        by_name: dict[str, list] = {}
        for g, _, tree in _unpack(right):
            by_name.setdefault(g, []).append(tree)
        matrix, found = np.array(left["_x"].to_pylist(), dtype=float).reshape(left.num_rows, -1), []
        for s, (n, columns) in places.items():
            if n == at[0].as_py() and left.num_rows:
                scores = pa.array(_descend(matrix[:, columns], by_name[s]), pa.float64()) if s in by_name else pa.nulls(left.num_rows, pa.float64())
                found.append(pa.table({key: left[key], "subset": pa.array([s] * left.num_rows), "score": scores}))
        return pa.concat_tables(found) if found else pa.table({key: left[key].slice(0, 0), "subset": pa.array([], pa.string()), "score": pa.array([], pa.float64())})

    return dealt.groupBy("_block", "_part").cogroup(told.groupBy("_block", "_part")).applyInArrow(meet, f"`{key}` {kind}, subset string, score double")


def subset_scores(df: DataFrame, forest: DataFrame, vector: Column, subsets: dict[str, list[int]], keep: list[str], trees: int = 100,
                  max_broadcast: int = MAX_BROADCAST_TREES, chunk: int = 65_536) -> DataFrame:
    """``keep`` and scores: per row an array with the score of every subset's forest of grow_subsets, in their order; NULL where there is none.

    Rows are scored in place, ``chunk`` of a task at a time. Forests travel as broadcasts of up to ``max_broadcast`` trees (one forest at least).
    """
    rows, names, block = df.select(*keep, vector.alias("_x"), F.array().cast("array<double>").alias("scores")), list(subsets), max(1, max_broadcast // max(1, trees))
    for first in range(0, len(names), block):
        some = names[first:first + block]
        by_name: dict[str, list] = {}
        for g, _, tree in _unpack(forest.filter(F.col("grp").isin(some)).toArrow()):
            by_name.setdefault(g, []).append(tree)
        rows = rows.mapInArrow(_scoring(df.sparkSession.sparkContext.broadcast(by_name), {s: subsets[s] for s in some}, chunk), rows.schema)
    return rows.drop("_x")


def _scoring(shared, subsets: dict[str, list[int]], chunk: int):
    """Appends the scores of the subsets to the array ``scores``."""
    def scored(table: pa.Table) -> pa.RecordBatch:
        held = table.combine_chunks().to_batches()[0]
        xs, before = (held.column(held.schema.get_field_index(n)).flatten().to_numpy().reshape(held.num_rows, -1) for n in ("_x", "scores"))
        found = [_descend(xs[:, places], shared.value[s]) if s in shared.value else np.full(len(xs), np.nan) for s, places in subsets.items()]
        every = np.column_stack([before, *found])
        ends = pa.array(np.arange(0, every.size + 1, every.shape[1], dtype=np.int32))
        scores = pa.ListArray.from_arrays(ends, pa.array(every.ravel(), pa.float64(), from_pandas=True))
        return held.set_column(held.schema.get_field_index("scores"), held.schema.field("scores"), scores.cast(held.schema.field("scores").type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting, n = [*waiting, batch], n + batch.num_rows
            if n >= chunk:
                yield scored(pa.Table.from_batches(waiting))
                waiting, n = [], 0
        if n:
            yield scored(pa.Table.from_batches(waiting))

    return run


def scores_by_size(df: DataFrame, forest: DataFrame, vector: Column, group: str, counts: list[int], salts: int = 8) -> DataFrame:
    """Per row and forest size: the plain columns of ``df``, trees, score. One descent answers every size; sizes that a group's forest has not are left out.

    Every group meets its trees in ``salts`` tasks.
    """
    rows = df.withColumn("_x", vector).withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(salts)).cast("int"))
    copies = forest.withColumnRenamed("grp", group).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    plain = [(n, t) for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    names = [n for n, _ in plain]
    schema = ", ".join(f"`{n}` {t}" for n, t in plain) + ", _scores array<double>"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = {n: left.column(n) for n in names}
        trees = [tree for *_, tree in _unpack(right)]
        if left.num_rows and trees:
            found = _descend(np.stack([np.asarray(x) for x in left.column("_x").to_pylist()]), trees, counts)
            return pa.table(kept | {"_scores": pa.array(list(found), pa.list_(pa.float64()))})
        return pa.table(kept | {"_scores": pa.nulls(left.num_rows, pa.list_(pa.float64()))})

    met = rows.groupBy(group, "_salt").cogroup(copies.groupBy(group, "_salt")).applyInArrow(meet, schema)
    sizes = F.explode(F.arrays_zip(F.array(*map(F.lit, counts)).alias("trees"), F.col("_scores").alias("score"))).alias("_s")
    return met.filter("_scores IS NOT NULL").select(*names, sizes).select(*names, "_s.trees", "_s.score").filter("NOT isnan(score)")


def nodes(forest: DataFrame) -> DataFrame:
    """Long node table: group, tree, node, feature index (-1 for a leaf), split."""
    return forest.select("grp", "tree", F.posexplode(F.arrays_zip("feature", "split", "length")).alias("node", "n")).select(
        "grp", "tree", "node", "n.feature", "n.split", "n.length")


def split_importance(forest: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    """How often each feature splits."""
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1)
    counted = nodes(forest).filter("feature >= 0").groupBy(label.alias("feature")).agg(F.count(F.lit(1)).alias("splits"))
    total = counted.agg(F.sum("splits").alias("_t"))
    ranked = counted.join(total).select("feature", "splits", (F.col("splits") / F.col("_t")).alias("share")).orderBy(
        F.col("splits").desc(), "feature")
    return ranked.limit(top) if top else ranked


def contamination_name(c: float) -> str:
    return f"c{round(c * 100):02d}"


def contamination_thresholds(train: DataFrame, grid: list[float] | None = None, group: str = "channel",
                             score_col: str = "score", largest: int | None = None) -> DataFrame:
    """(group, c, threshold): the 1-c quantile of the training scores, all c from one pass."""
    grid = grid or GRID
    names = {contamination_name(c): 1.0 - c for c in grid}
    wide = quantiles(train, [group], score_col, names, largest)
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(contamination_name(c)).alias("threshold")) for c in grid])).alias("e")
    return wide.select(group, entries).select(group, "e.*")


def display_scale(train: DataFrame, group: str = "channel", score_col: str = "score",
                  largest: int | None = None) -> DataFrame:
    """95th percentile and population deviation of training scores (a zero deviation reads 1)."""
    spread = train.groupBy(group).agg(F.stddev_pop(score_col).alias("_s"))
    cut = quantiles(train, [group], score_col, {"tau95": 0.95}, largest)
    return cut.join(spread, group).select(
        group, "tau95", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("score_std"))


def sufficient(fit_rows: DataFrame, eval_rows: DataFrame, group: str = "channel", min_fit: int = MIN_FIT,
               min_eval: int = MIN_EVAL) -> DataFrame:
    """Groups with enough rows to fit and to judge; others are predicted normal."""
    a = fit_rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_fit"))
    b = eval_rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_eval"))
    return a.join(b, group, "full_outer").select(
        group, F.coalesce("n_fit", F.lit(0)).alias("n_fit"), F.coalesce("n_eval", F.lit(0)).alias("n_eval"),
        ((F.coalesce("n_fit", F.lit(0)) >= min_fit) & (F.coalesce("n_eval", F.lit(0)) >= min_eval)).alias("enough"))
