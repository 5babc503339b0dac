"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are interned to integers, n-grams are rolling hashes of them in numpy, and the
n-grams found twice or more mark the words, and so the characters, they cover.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.shingles import mix

#: Greatest share of a text's word characters that may lie in duplicated n-grams of each length.
MOST_COVERED = {5: 0.40, 7: 0.35, 10: 0.30}
#: Greatest share of word characters in lines equal to an earlier line, and of symbols a word.
MOST_IN_LINES = 0.30
MOST_SYMBOLS = 0.10
MIN_WORDS = 50
MOST_REPEAT_WORDS = 50  # per cent of words in repeated 3-word windows
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in MOST_COVERED)]
SCHEMA = ", ".join(f"{f} long" for f in FIELDS)
_K = np.uint64(0xBF58476D1CE4E5B9)


def covered(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it lies in an n-word window that occurs twice or more."""
    windows = len(hashes) - n + 1
    mark = np.zeros(len(hashes) + 1, np.int64)
    if windows > 1:
        with np.errstate(over="ignore"):
            rolled = hashes[:windows].copy()
            for k in range(1, n):
                rolled = rolled * _K + hashes[k : k + windows]
        _, which, times = np.unique(rolled, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + n, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(text: str | None) -> tuple[int, ...]:
    """The values of FIELDS for one whole text; a null text is an empty one."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes split at space and \x09-\x0d alone
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lengths = np.fromiter((len(w.decode("utf-8")) for w in known), np.int64, len(known))
    chars = lengths[ids] if len(ids) else ids
    hashes = mix(ids.astype(np.uint64))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    again, in_lines = 0, 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                again += 1
                in_lines += len(line) - sum(map(line.count, _SPACES))
            seen.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    inside = [int(chars[covered(hashes, n)].sum()) for n in MOST_COVERED]
    return len(words), int(chars.sum()), symbols, again, int(covered(hashes, 3).sum()), in_lines, *inside


def measures(text: Column) -> Column:
    """Struct of FIELDS."""

    @F.pandas_udf(SCHEMA)
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=FIELDS, dtype="int64")

    return udf(text.cast("string"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_WORDS * m["n_words"])


def reasons(m: Column) -> Column:
    """Names of the rules that a text breaks, as a sorted array."""
    chars = F.greatest(m["word_chars"], F.lit(1))
    rules = {"few_words": m["n_words"] < MIN_WORDS, "repeat_words": 100 * m["n_repeat_words"] > MOST_REPEAT_WORDS * m["n_words"]}
    rules |= {"symbols": m["n_symbols"] > MOST_SYMBOLS * m["n_words"], "dup_lines": m["dup_line_chars"] > MOST_IN_LINES * chars}
    rules |= {f"dup_{n}grams": m[f"dup_{n}gram_chars"] > most * chars for n, most in MOST_COVERED.items()}
    return F.array_sort(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, FIELDS, base_failed, reasons, kept for every row of ``docs``.

    Words are runs of characters other than space and \\x09-\\x0d; a line counts if it has
    a word. A null or empty text has zeros everywhere and fails for its few words. Rows
    are independent: repeated rows and null ids are scored like any other, an empty table
    gives an empty result, and other columns are not read.
    """
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    return m.select("doc_id", "m.*", base_failed(F.col("m")).alias("base_failed"), reasons(F.col("m")).alias("reasons")).withColumn("kept", F.size("reasons") == 0)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with their own columns. No shuffle."""
    return docs.where(F.size(reasons(measures(F.col(text_col)))) == 0)
