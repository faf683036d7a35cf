"""The few functions that Spark has no expression for, over Arrow batches.  NULL in, NULL out."""

import hashlib
import hmac
import unicodedata

import pandas as pd

from lakeloom.functions.stem import stem


def _each(f, *columns):
    return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)


def normalize(text: pd.Series, form: pd.Series) -> pd.Series:
    return _each(lambda x, f: unicodedata.normalize(f, x), text, form)


def blake2s(data: pd.Series) -> pd.Series:
    return _each(lambda x: hashlib.blake2s(bytes(x)).digest(), data)


def blake2b(data: pd.Series) -> pd.Series:
    return _each(lambda x: hashlib.blake2b(bytes(x)).digest(), data)


def hmac_sha256(text: pd.Series, key: pd.Series) -> pd.Series:
    return _each(lambda x, k: hmac.new(k.encode(), x.encode(), hashlib.sha256).hexdigest(), text, key)


def word_stem(word: pd.Series, lang: pd.Series) -> pd.Series:
    return _each(stem, word, lang)


#: Functions and the types of their results.
FUNCTIONS = {"normalize": (normalize, "string"), "blake2s": (blake2s, "binary"), "blake2b": (blake2b, "binary"), "hmac_sha256": (hmac_sha256, "string"), "word_stem": (word_stem, "string")}
