"""Text expressions: normalisation, tokens, quality, markers. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures, white space other than the line break, token and CJK patterns, punctuation, header scraps.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
INLINE_SPACE = r"[\t\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ANY_SPACE = INLINE_SPACE[:-1] + r"\n]"
SPACE_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b)) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[a-z](?:[a-z0-9_\-]*[a-z0-9])?|\p{Nd}+(?:\.\p{Nd}+)?"
CJK = r"[\x{4e00}-\x{9fff}]"
PUNCTUATION = " .,:;-–—_/\\()[]{}<>\"'`~@#$%^&*+=|\t\n"
HEADER_SCRAPS = ["returned due to non-completion"]
MIN_CHARS = 80
MAX_JUNK = 0.55


def spelled_out(text: Column) -> Column:
    """Without ligatures; NULL reads as empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalise_space(text: Column) -> Column:
    """Ligatures spelled out, runs of inline white space to one space, at most one empty line; NULL reads as empty."""
    out = F.regexp_replace(spelled_out(text), INLINE_SPACE + "+", " ")
    out = F.regexp_replace(out, " *\n *", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.btrim(out, F.lit(" \n"))


def strip(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def tokens(text: Column) -> Column:
    """Latin identifiers and numbers without trailing dashes, then the character pairs of every CJK run.

    Those of the normalised text: no token reaches over white space, so its kind and number need not be settled first.
    """
    def cut(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
        runs = F.regexp_extract_all(low, F.lit(CJK + "{2,}"), F.lit(0))
        pairs = F.flatten(F.transform(runs, lambda r: F.transform(
            F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
        return F.concat(words, pairs)

    # bound as a lambda variable, so that the text is spelled out once
    return F.get(F.transform(F.array(F.lower(spelled_out(text))), cut), F.lit(0))


def cjk_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, CJK, ""))


def effective_length(text: Column) -> Column:
    """A CJK character counts twice."""
    return F.length(text) + cjk_count(text)


def junk_ratio(text: Column) -> Column:
    kept = F.length(F.translate(text, PUNCTUATION, ""))
    return F.when(F.length(text) == 0, 1.0).otherwise((F.length(text) - kept) / F.length(text))


def low_quality(text: Column, min_chars: int = MIN_CHARS, max_junk: float = MAX_JUNK) -> Column:
    bare = strip(text)
    scraps = F.lit(False)
    for s in HEADER_SCRAPS:
        scraps = scraps | F.contains(F.lower(bare), F.lit(s))
    # characters are counted by kind only where their number leaves it open
    short = (F.length(bare) < min_chars) & (effective_length(bare) < min_chars)
    return (F.length(bare) == 0) | short | (junk_ratio(bare) > max_junk) | scraps


def token_cost(text: Column) -> Column:
    """Context budget estimate: two per CJK character, a quarter for any other."""
    cjk = cjk_count(text)
    return cjk * 2 + (F.length(text) - cjk) * 0.25


def found_terms(text: Column, terms: Column) -> Column:
    """Terms contained in the text, case ignored."""
    low = F.lower(text)
    return F.filter(terms, lambda t: F.contains(low, F.lower(t)))


def shorten(text: Column, n: int = 120) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Readable text of a web page: scripts, styles and tags out, white space normalised."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return normalise_space(bare)
