"""Secrets by fixed patterns and by tests of randomness, in DataFrame functions only.

Base spans are the matches of three patterns. The method adds tokens that look random: candidates are runs of 20 or more letters,
digits and ``+ / _ = -`` which mix letters and digits and lie outside base spans. The narrowest encoding that holds all of a candidate's
characters (hex, base 32, letters and digits, base 64) gives its alphabet, and three tests ask whether its characters could be
uniform draws from it:

* chi-squared of the character counts, against its exact mean and variance at this length,
* Wald-Wolfowitz runs of characters below and above the middle of the alphabet,
* serial correlation of neighbouring characters' places in the alphabet.

The three p-values are joined as three times the smallest. A candidate is given up as ordinary text when uniform draws are rejected
by a Benjamini-Hochberg procedure over the candidates of the whole table, weighted by length: a short candidate, whose tests see
little, gets a smaller share of the error rate and must be the more clearly ordinary. What is not rejected is reported as ``random``. The procedure
needs only counts of weighted p-values in fixed bins, so no ranking of all candidates takes place.

Nulls and edges: a null text is empty and has no spans; an empty table gives no rows; repeated rows are reported each; equal texts
get equal spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import DOCUMENT_COLUMNS

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_DIGITS = "0123456789abcdef"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from narrow to wide: characters in order. Base 64 counts its web variant's characters in the same places.
ENCODINGS = [HEX_DIGITS, "0123456789ABCDEF", UPPER + "234567", UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/"]
BINS = 2000


def _spans(text: Column, pattern: str, rank: int, least_value: int = 0) -> Column:
    """Matches as structs (start, rank, end, value), from the pieces between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        this = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["hit"].alias("value"))
        kept = F.array_append(s["found"], this)
        if least_value:
            kept = F.when(F.length(F.regexp_extract(x["hit"], pattern, 1)) >= least_value, kept).otherwise(s["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    found = F.aggregate(F.filter(cut, lambda x: x["hit"].isNotNull()), state, step)["found"]
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def candidates(text: Column, base: Column) -> Column:
    """Tokens outside base spans that mix letters and digits."""
    mixed = F.filter(_spans(text, CANDIDATE, 3), lambda c: F.rlike(c["value"], F.lit("[0-9]")) & F.rlike(c["value"], F.lit("[A-Za-z]")))
    return F.filter(mixed, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def _tail(z: Column) -> Column:
    """P(|Z| >= z) of a normal variable: the rational approximation 26.2.17 of Abramowitz and Stegun."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-x * x / 2) * poly)


def _with(array: Column, names: list[str], **fields) -> tuple[Column, list[str]]:
    """Structs of the array with further fields, each worked out once."""
    out = F.transform(array, lambda c: F.struct(*[c[n].alias(n) for n in names], *[make(c).alias(n) for n, make in fields.items()]))
    return out, names + list(fields)


def _alphabet(c: Column) -> Column:
    chars = F.lit(ENCODINGS[-1])
    for narrow, pattern in reversed(list(zip(ENCODINGS[:-1], ["^[0-9a-f]+$", "^[0-9A-F]+$", "^[A-Z2-7]+$", "^[A-Za-z0-9]+$"]))):
        chars = F.when(F.rlike(c["body"], F.lit(pattern)), F.lit(narrow)).otherwise(chars)
    return chars


def _squares(c: Column) -> Column:
    """Squared counts of the characters, summed. In sorted places, one seen for the r-th time adds 2r - 1."""
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))

    def step(s, x):
        again = x == s["last"]
        return F.struct(x.alias("last"), F.when(again, s["run"] + 1).otherwise(1.0).alias("run"), (s["squares"] + F.when(again, 2 * s["run"] + 1).otherwise(1.0)).alias("squares"))

    return F.aggregate(F.array_sort(c["places"]), start, step)["squares"]


def _walk(c: Column) -> Column:
    """upper: characters in the upper half; runs: of one half; product: of neighbours' distances from the middle."""
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("last", "upper", "runs", "product")])

    def step(s, x):
        first, half, middle = s["last"] == 0.0, c["k"] / 2, (c["k"] + 1) / 2
        high = (x > half).cast("double")
        begins = (first | (high != (s["last"] > half).cast("double"))).cast("double")
        product = F.when(first, 0.0).otherwise((s["last"] - middle) * (x - middle))
        return F.struct(x.alias("last"), (s["upper"] + high).alias("upper"), (s["runs"] + begins).alias("runs"), (s["product"] + product).alias("product"))

    return F.aggregate(c["places"], start, step)


def tested(found: Column) -> Column:
    """Candidates with ``p``, the joined p-value of "uniform draws from the encoding's alphabet"."""
    at, names = _with(found, ["start", "rank", "end", "value"], body=lambda c: F.regexp_replace(F.translate(c["value"], "_-", "/+"), "=+$", ""))
    at, names = _with(at, names, chars=_alphabet)
    at, names = _with(at, names, n=lambda c: F.length(c["body"]).cast("double"), k=lambda c: F.length(c["chars"]).cast("double"),
                      places=lambda c: F.transform(F.filter(F.split(c["body"], ""), lambda x: x != ""), lambda x: F.instr(c["chars"], x).cast("double")))
    at, names = _with(at, names, squares=_squares, walk=_walk)
    at, names = _with(at, names, a=lambda c: c["walk"]["upper"], b=lambda c: c["n"] - c["walk"]["upper"])
    at, names = _with(at, names, expected=lambda c: 1 + 2 * c["a"] * c["b"] / c["n"])
    at, names = _with(
        at, names,
        chi=lambda c: (c["squares"] * c["k"] / c["n"] - c["n"] - (c["k"] - 1)) / F.sqrt(2 * (c["k"] - 1) * (c["n"] - 1) / c["n"]),
        runs=lambda c: (c["walk"]["runs"] - c["expected"]) / F.sqrt(F.greatest((c["expected"] - 1) * (c["expected"] - 2) / F.greatest(c["n"] - 1, F.lit(1.0)), F.lit(1e-9))),
        serial=lambda c: c["walk"]["product"] / F.sqrt(c["n"] - 1) / ((c["k"] * c["k"] - 1) / 12))
    joined = lambda c: F.when(c["n"] < 8, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 3 * F.least(
        _tail(c["chi"]), F.when((c["a"] == 0) | (c["b"] == 0), F.pow(F.lit(2.0), 1 - c["n"])).otherwise(_tail(c["runs"])), _tail(c["serial"]))))
    return F.transform(at, lambda c: F.struct(c["start"], c["rank"], c["end"], c["value"], joined(c).alias("p")))


def _weighted(p: Column, value: Column) -> Column:
    """p over the length's weight: 1 at 40 characters, less for shorter ones, at most 2."""
    return p / F.least(F.lit(2.0), F.length(value) / 40.0)


def _bin(q: Column) -> Column:
    """Bins of -log10 in steps of 0.01, from 0 (q of 1) on."""
    return F.least(F.lit(BINS), F.floor(-100 * F.log10(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-20))))).cast("int")


def rejection_bin(scored: DataFrame, rate: float) -> DataFrame:
    """One row, ``cut``: candidates of this bin or beyond are ordinary text at the false-discovery rate. scored: column bin."""
    counts = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # at most BINS + 1 rows
    down = Window.orderBy(F.col("bin").desc())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = counts.withColumn("beyond", F.sum("n").over(down)).withColumn("m", F.sum("n").over(every))
    return met.filter(F.pow(F.lit(10.0), -F.col("bin") / 100) <= F.lit(rate) * F.col("beyond") / F.col("m")).agg(
        F.coalesce(F.min("bin"), F.lit(BINS + 1)).alias("cut"))


def scan(docs: DataFrame, rate: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id, text) and ``spans``: structs (start, rank, end, value) by start, then kind.

    rate: share of truly random tokens among those given up as ordinary.
    """
    keep = keep or ["doc_id", "text"]
    text = F.coalesce(F.col("text"), F.lit(""))

    def scored(df: DataFrame, columns: list) -> DataFrame:
        based = df.select(*columns, base_spans(text).alias("_base"), text.alias("_text"))
        found = based.withColumn("_found", tested(candidates(F.col("_text"), F.col("_base"))))
        return found.withColumn("_found", F.transform("_found", lambda c: F.struct(
            c["start"], c["rank"], c["end"], c["value"], _bin(_weighted(c["p"], c["value"])).alias("bin"))))

    bins = scored(docs.filter(F.rlike(text, F.lit(CANDIDATE))), []).select(F.explode("_found.bin").alias("bin"))
    cut = rejection_bin(bins, rate)  # one row
    random = F.transform(F.filter("_found", lambda c: c["bin"] < F.col("cut")), lambda c: F.struct(c["start"], c["rank"], c["end"], c["value"]))
    return scored(docs, [F.col(c) for c in keep]).crossJoin(F.broadcast(cut)).select(
        *keep, F.array_sort(F.concat("_base", random)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked_documents(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """Every stretch that spans cover, overlapping spans together, becomes the mask; n_chars follows. All documents stay."""
    found = scan(docs.select(*DOCUMENT_COLUMNS), keep=DOCUMENT_COLUMNS, **options)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        gap = F.col("text").substr(s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(
            s["out"], gap, F.when((x["start"] >= s["at"]) & ((x["start"] > s["at"]) | (s["at"] == 0)), mask).otherwise("")).alias("out"))

    done = F.aggregate("spans", start, step)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(done["out"], F.col("text").substr(done["at"] + 1, F.length("text"))))
    changed = found.withColumn("_masked", text)
    return changed.select("doc_id", F.col("_masked").alias("text"), "lang", "source",
                          F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("_masked").cast("bigint")).alias("n_chars"))
