"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords: runs of 2 or 3 letters of a lower-cased word, its edges
included, hashed into ``2**bits`` rows. A linear softmax over the average names the language. Both are trained together by
stochastic gradient descent in numpy, on a sample of labelled passages that is bounded per language. Since the
last layer is linear, prediction needs one number per row and language.

Scores are calibrated: a temperature is fitted on a fifth of the sample that training has not seen. A text is rejected when it
has no letter or its calibrated score is under ``min_score``.

Nulls and edges: a null, empty or letterless text is ``und`` with score 0 and rejected; labels null are not learned from;
with no label at all everything is ``und``; repeated rows are predicted alike. Long texts are read in blocks, whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (2, 3)
#: Odd factors that spread a letter's number by its place in the subword.
_FACTORS = [np.uint32(k) for k in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
BLOCK = 1 << 18
_LETTER: np.ndarray | None = None


class Model(NamedTuple):
    languages: list[str]
    columns: list[np.ndarray]  # of each language, 2**bits numbers: embedding times output weights
    bias: np.ndarray
    temperature: float
    min_score: float


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def subword_blocks(text: str, bits: int):
    """Rows of the text's subwords, block by block; nothing for a text without letters."""
    step = BLOCK - (max(SIZES) - 1)
    for at in range(0, max(1, len(text)), step):
        codes = np.frombuffer(f" {text[at:at + BLOCK]} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        codes = codes * letter
        spread = [codes * k for k in _FACTORS]
        for n in SIZES:
            m = len(codes) - n + 1
            if m < 1:
                continue
            keep = letter[:m] | letter[n - 1:]
            for j in range(1, n - 1):
                keep &= letter[j:j + m]
            h = spread[0][:m] + np.uint32(n)
            for j in range(1, n):
                h ^= spread[j][j:j + m]
            yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))[keep]


def subwords(text: str, bits: int) -> np.ndarray:
    found = list(subword_blocks(text, bits))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def train(passages: list[tuple[str, str]], bits: int = 15, size: int = 16, epochs: int = 4, rate: float = 0.5, min_score: float = 0.4, seed: int = 7) -> Model:
    """passages: (language, text). Every fifth passage of a language calibrates."""
    languages = sorted({lang for lang, _ in passages})
    if not languages:
        return Model([], [], np.zeros(0), 1.0, min_score)
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1 / size, 1 / size, (2**bits, size))
    out, bias = np.zeros((size, len(languages))), np.zeros(len(languages))
    seen, examples, held = dict.fromkeys(languages, 0), [], []
    for lang, text in passages:
        seen[lang] += 1
        # Scores are to be honest about short texts too: what calibrates is also cut to a few words.
        for cut in [text[:12], text[:40], text[:150], text] if seen[lang] % 5 == 0 else [text]:
            words = subwords(cut, bits)
            if len(words):
                (held if seen[lang] % 5 == 0 else examples).append((languages.index(lang), *np.unique(words, return_counts=True), len(words)))
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, at, count, n = examples[i]
            pull = (count / n)[:, None]
            hidden = (rows[at] * pull).sum(axis=0)
            error = _softmax(hidden @ out + bias)
            error[y] -= 1
            now = rate * (1 - done / steps)
            back = out @ error
            out -= now * np.outer(hidden, error)
            bias -= now * error
            rows[at] -= now * len(at) ** 0.5 * pull * back
            done += 1
    logits = np.array([(rows[at] * (count / n)[:, None]).sum(axis=0) @ out + bias for _, at, count, n in held or examples]).reshape(-1, len(languages))
    truth = np.array([y for y, *_ in held or examples], dtype=int)
    fits = [(-np.log(np.clip(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12, 1)).mean() if len(truth) else 0.0, t) for t in np.geomspace(0.05, 20, 60).tolist()]
    return Model(languages, list((rows @ out).T.astype(np.float32).copy()), bias, min(fits)[1] if len(truth) else 1.0, min_score)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 400, passage: int = 1500, **options) -> Model:
    """Learn from at most ``per_language`` passages of at most ``passage`` characters of each language.

    The passages are picked by a hash of doc_id, at hashed places of their texts; they are all that the driver gets.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count()
    picked = F.xxhash64("doc_id", F.lit("language"))
    share = F.lit(float(per_language)) / F.col("_n")
    sample = known.select("lang", "text", picked.alias("_h"), F.length("text").alias("_length")).join(
        F.broadcast(counts.select(F.col("lang").alias("_lang"), F.col("count").alias("_n"))), F.col("lang") == F.col("_lang")).filter(
        F.pmod("_h", F.lit(1 << 40)) < share * 1.2 * (1 << 40))
    place = F.pmod(F.xxhash64("_h"), F.greatest(F.col("_length") - passage, F.lit(0)) + 1).cast("int") + 1
    rows = sample.select("lang", "_h", F.substring("text", place, F.lit(passage)).alias("text")).collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["_h"], r["text"])):
        if len(of := kept.setdefault(r["lang"], [])) < per_language:
            of.append((r["lang"], r["text"]))
    return train([x for of in kept.values() for x in of], **options)


def judge(model: Model, text: str | None) -> tuple[str, float]:
    """(language, calibrated score) of a whole text."""
    if not text or not model.languages:
        return "und", 0.0
    bits, total, n = len(model.columns[0]).bit_length() - 1, np.zeros(len(model.languages)), 0
    for words in subword_blocks(text, bits):
        total += [column.take(words).sum(dtype=np.float64) for column in model.columns]
        n += len(words)
    if not n:
        return "und", 0.0
    p = _softmax((total / n + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns (text among them) with lang_pred, score and accepted; given columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "accepted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows: its size is a parameter

    def predict(batches):
        for batch in batches:
            found = [judge(sent.value, t.as_py()) for t in batch.column("text")]
            score = np.array([s for _, s in found], dtype=np.float64)
            named = np.array([name != "und" for name, _ in found], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array(score), pa.array(named & (score >= sent.value.min_score))],
                names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    return docs.mapInArrow(predict, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", lang_pred string, score double, accepted boolean")
