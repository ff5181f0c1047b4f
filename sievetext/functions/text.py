"""Text normalisation and tokenisation as Column expressions.

All of it runs in the JVM (regexp_replace / split / filter), so it stays in
whole-stage code generation up to the higher-order ``filter``.
"""

from __future__ import annotations

from typing import Callable, Iterator, Union

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------
# The 32 ASCII punctuation marks  !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~  as one
# regex character class (ranges 0x21-0x2F, 0x3A-0x40, 0x5B-0x60, 0x7B-0x7E).
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
# Unicode white space as Python's str.split()/strip() see it, written with
# escapes that both Java regex and RE2 accept.
WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CLASS = f"[{WS_CHARS}]"
# Treebank rules that still apply after punctuation is gone: contractions
# written without an apostrophe are split in two, typographic quotes are
# their own tokens.
TREEBANK_CONTRACTIONS = ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"]
TREEBANK_SPLITS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na",
                   "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}
TYPOGRAPHIC_QUOTES = "«»“”‘’„"
#: Characters of text whose tokens a user's tokeniser holds as Python objects.
SLICE_CHARS = 1 << 20
# --------------------------------------------------------------------------

ColumnOrName = Union[Column, str]
Tokenizer = Union[str, Callable[[Column], Column]]


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(text: ColumnOrName) -> Column:
    """lower-case, delete ASCII punctuation, strip white space at both ends."""
    no_punct = F.regexp_replace(F.lower(_c(text)), PUNCT_CLASS, "")
    return F.regexp_replace(no_punct, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def _blank_split(norm: Column) -> Column:
    # array_remove (not a lambda filter) keeps the expression in generated code
    return F.array_remove(F.split(norm, f"{WS_CLASS}+"), "")


def _treebank(norm: Column) -> Column:
    out = norm
    for word in TREEBANK_CONTRACTIONS:
        out = F.regexp_replace(out, f"(^|{WS_CLASS})({word})(?={WS_CLASS}|$)",
                               f"$1{TREEBANK_SPLITS[word]}")
    out = F.regexp_replace(out, f"([{TYPOGRAPHIC_QUOTES}])", " $1 ")
    return _blank_split(out)


def tokenize(text: ColumnOrName, tokenizer: Tokenizer = "blank",
             normalized: bool = False) -> Column:
    """Tokens of a text after :func:`normalize` (array<string>).

    ``tokenizer`` is ``"blank"`` (split on Unicode white space), ``"treebank"``
    (plus the two word_tokenize rules that survive normalisation) or a
    function Column -> array Column supplied by the user.
    """
    if normalized:
        norm = _c(text)
    elif tokenizer in ("blank", "treebank"):
        # the split drops empty tokens, so the strip of normalize() is not needed
        norm = F.regexp_replace(F.lower(_c(text)), PUNCT_CLASS, "")
    else:
        norm = normalize(text)
    if callable(tokenizer):
        return tokenizer(norm)
    if tokenizer == "blank":
        return _blank_split(norm)
    if tokenizer == "treebank":
        return _treebank(norm)
    raise ValueError(f"unknown tokenizer {tokenizer!r}")


def python_tokenizer(fn: Callable[[str], list]) -> Callable[[Column], Column]:
    """Wrap a plain Python ``str -> list[str]`` tokeniser as an Arrow-batched
    pandas UDF (slow path, for user tokenisers with no Column form).  The tokens
    of about ``SLICE_CHARS`` characters of text are Python objects at a time,
    however many texts a batch has."""
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def _tok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for part in _slices(s):
                yield part.map(lambda t: None if t is None else list(fn(t)))

    return _tok


def _slices(s: pd.Series) -> Iterator[pd.Series]:
    """Consecutive parts of a series of texts, each of ``SLICE_CHARS`` characters or
    one text more; at least one."""
    start = held = 0
    for i, t in enumerate(s):
        held += 0 if t is None else len(t)
        if held >= SLICE_CHARS:
            yield s.iloc[start:i + 1]
            start, held = i + 1, 0
    if start < len(s) or not len(s):
        yield s.iloc[start:]


# ---- SQL (DuckDB) counterparts ------------------------------------------

def sql_normalize(expr: str) -> str:
    no_punct = f"regexp_replace(lower({expr}), '{PUNCT_CLASS}', '', 'g')"
    return f"regexp_replace({no_punct}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def sql_tokenize(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array({sql_normalize(expr)}, '{WS_CLASS}+'),"
            f" lambda t: t <> '')")
