"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by their number of tokens. Sums over the histogram from its long end up then answer, for every length as
a context limit: how many documents are longer, what all documents total, what they total when each is cut at the limit, and which
quantile of the documents the limit is.

Nulls and edges: a null text is empty and counts as a document of length 0; an empty table gives no rows; repeated rows count each.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf, running_total
from tidemark.llm.tokens import VOCABULARY, coder


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of whole texts."""
    kind = dict(docs.dtypes)["doc_id"]

    def count(batches):
        for batch in batches:
            code = coder(vocabulary)
            n = np.fromiter((len(code.ids(t.as_py() or "")) // 4 for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_tokens bigint")


def length_histogram(counts: DataFrame, per_slice: int = 4096) -> DataFrame:
    """Per length that occurs: n_docs, n_longer, total_tokens, tokens_longer, truncated_total, quantile. counts: n_tokens.

    per_slice: lengths that are summed in one task; the histogram has a row per length, and no task needs all of them.
    """
    shelf = Shelf(counts.sparkSession, "lengths")
    rows = shelf.put(counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")), "histogram")
    docs, tokens = rows.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0))).first()
    down = -(F.col("length") / per_slice).cast("bigint")
    one = rows.withColumn("all", F.lit(1))
    suffix = running_total(one, ["all"], down, [F.col("length").desc()], F.col("n_docs"), "n_longer")
    suffix = running_total(suffix, ["all"], down, [F.col("length").desc()], F.col("length") * F.col("n_docs"), "tokens_longer")
    total = F.lit(tokens).cast("bigint")
    return suffix.select(
        "length", "n_docs", "n_longer", "tokens_longer", total.alias("total_tokens"),
        (total - F.col("tokens_longer") + F.col("n_longer") * F.col("length")).alias("truncated_total"),
        ((F.lit(docs) - F.col("n_longer")) / F.lit(max(1, docs))).alias("quantile"))


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least this share of documents does not exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return histogram.join(F.broadcast(asked), F.col("quantile") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("length").alias("length"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_total: tokens of all documents when each is cut at the limit, whether that length occurs or not."""
    asked = histogram.sparkSession.createDataFrame([(int(n),) for n in limits], "limit bigint")
    cut = histogram.crossJoin(F.broadcast(asked)).groupBy("limit")  # a row per length and asked limit
    return cut.agg(F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_total"))
