"""The corpus queries, each applied to its whole table, beside SQL where SQL can say it.

A query keeps its operator's output and derives the digest columns that it returns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, lengths, media, mixing, packing, postings, quality, secrets, simhash, substrings, urls, variants, whitening
from tidemark.llm.common import table


class Entry(NamedTuple):
    name: str
    run: object
    sql: str | None = None


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, budget=4)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint").alias(f"n_{secrets.KINDS[rank]}")

    return found.select("doc_id", *map(count, range(4)), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the label of the document of its number: bad when toxic or of low quality."""
    bad = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")
    outcomes = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    found = urls.filter_urls(table(spark, sf_dir, "pages"), outcomes)
    return found.withColumn("bad_bound", F.round("bad_bound", 6))


def _level_sql(name: str, source: str) -> str:
    """Strength and posterior of one level, from rows (key, prior, n, bad)."""
    return f"""{name}_w AS (SELECT CASE WHEN spread <= chance THEN 1000.0 ELSE least(1000.0, greatest(2.0, room / (spread - chance) - 1)) END AS worth FROM
  (SELECT sum((bad - n * prior) * (bad - n * prior) / n) AS spread, sum(prior * (1 - prior)) AS chance, sum((n - 1) * prior * (1 - prior)) AS room FROM {source})),
{name} AS (SELECT *, prior * worth + bad AS a, (1 - prior) * worth + n - bad AS b FROM {source}, {name}_w)"""


def _bound_sql(level: str) -> str:
    return f"{level}.a / ({level}.a + {level}.b) - 1.645 * sqrt({level}.a * {level}.b / (({level}.a + {level}.b) * ({level}.a + {level}.b) * ({level}.a + {level}.b + 1)))"


def _domain_sql(host: str, names: int) -> str:
    """The last names of a host, one more under a public suffix of two names."""
    listed = ", ".join(f"'{x}'" for x in urls.SUFFIXES)
    last = f"array_to_string(list_slice(string_split({host}, '.'), -2, -1), '.')"
    take = f"CASE WHEN {last} IN ({listed}) THEN {names + 1} ELSE {names} END"
    return f"array_to_string(list_slice(string_split({host}, '.'), greatest(1, len(string_split({host}, '.')) - ({take}) + 1), len(string_split({host}, '.'))), '.')"


def _rules_sql(of_verdict: bool) -> str:
    longest = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if of_verdict else h + p}'" for v, h, p in longest) + " END"


URLS_SQL = f"""WITH o AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages),
r AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM u),
hs AS (SELECT host, count(*) AS n, sum(bad) AS bad, {_domain_sql('host', 2)} AS domain, {_domain_sql('host', 1)} AS suffix FROM r JOIN o USING (page_id) WHERE host <> '' GROUP BY host),
ds AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY ALL), ss AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM ds GROUP BY ALL),
s0 AS (SELECT ss.*, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM ss) AS prior FROM ss), {_level_sql('s', 's0')},
d0 AS (SELECT ds.*, s.a / (s.a + s.b) AS prior FROM ds JOIN s USING (suffix)), {_level_sql('d', 'd0')},
h0 AS (SELECT hs.*, d.a / (d.a + d.b) AS prior FROM hs JOIN d USING (domain)), {_level_sql('h', 'h0')},
k AS (SELECT DISTINCT host, {_domain_sql('host', 2)} AS domain, {_domain_sql('host', 1)} AS suffix FROM r WHERE host <> ''),
b AS (SELECT k.host, coalesce({_bound_sql('h')}, {_bound_sql('d')}, {_bound_sql('s')}) AS bound FROM k LEFT JOIN h ON h.host = k.host LEFT JOIN d ON d.domain = k.domain LEFT JOIN s ON s.suffix = k.suffix)
SELECT page_id, host, path, {_rules_sql(False)} AS rule, coalesce({_rules_sql(True)}, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bad_bound
FROM r LEFT JOIN b USING (host)"""


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "last_slot")


def op7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(lengths.token_counts(table(spark, sf_dir, "documents")))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, t FROM (SELECT doc_id, {_terms_sql('text')} AS t FROM documents)),
b AS (SELECT item_id, t, least(len(t), 10) AS n FROM (SELECT item_id, {_terms_sql('text')} AS t FROM benchmark) WHERE len(t) > 0),
p AS (SELECT DISTINCT item_id, n, t[i:i + n - 1] AS w FROM (SELECT *, unnest(generate_series(1, len(t) - n + 1)) AS i FROM b)),
s AS (SELECT r, n, i, t[i:i + n - 1] AS w FROM (SELECT r, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(t) >= n)),
m AS (SELECT r, i, n, item_id FROM s JOIN p USING (n, w)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS x FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


ENTRIES = [
    Entry("op1_simhash", op1_simhash),
    Entry("op2_language", op2_language),
    Entry("op3_secrets", op3_secrets),
    Entry("op4_urls", op4_urls, URLS_SQL),
    Entry("op5_media", op5_media),
    Entry("op6_mixing", op6_mixing),
    Entry("op7_lengths", op7_lengths),
    Entry("op8_substrings", op8_substrings),
    Entry("op9_packing", op9_packing),
    Entry("op10_quality", op10_quality),
    Entry("op11_whitening", op11_whitening),
    Entry("op12_decontaminate", op12_decontaminate, DECONTAMINATE_SQL),
    Entry("op13_variants", op13_variants),
]
