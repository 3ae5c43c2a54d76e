"""Quality rules by repetition coverage: rolling n-gram hashes of several lengths in numpy.

Cases: null and empty texts have no words and fail the base rule. Every input row gives one output row. Columns other than
doc_id and text are ignored. Work and memory are linear in a text's length.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Batches, table

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
LEAST_WORDS = 10
WINDOW = 5
#: Of 100 words, most in 5-word windows that occur twice or more.
MOST_REPEATED = 20
#: Most of the characters that may lie in n-grams that occur twice or more, by n; longer repeats are rarer in sound text.
COVERED = {2: 0.85, 3: 0.55, 5: 0.20, 8: 0.18, 12: 0.16}
#: Most of the characters that may lie in lines equal to an earlier line.
COVERED_LINES = 0.30

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_coverage double, coverage array<double>, base_failed boolean, kept boolean"


def _mixed(ids: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated(words: list[str], lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length, a mask of the words that lie in an n-gram found twice or more (all its places count, the first too).

    The hash of an n-gram is rolled from the (n-1)-gram at the same place: H(n, i) = H(n-1, i) * base + h(i + n - 1).
    """
    out = {n: np.zeros(len(words), bool) for n in lengths}
    if not words:
        return out
    seen: dict[str, int] = {}
    h = _mixed(np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64))
    base, rolled = np.uint64(0xD1342543DE82EF95), h.copy()
    for n in range(2, min(max(lengths), len(words)) + 1):
        rolled = rolled[:-1] * base + h[n - 1 :]
        if n in out:
            order = np.argsort(rolled, kind="stable")
            same = rolled[order][1:] == rolled[order][:-1]
            hit = np.zeros(len(rolled), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.flatnonzero(hit), 1)
            np.add.at(edge, np.flatnonzero(hit) + n, -1)
            out[n] = np.cumsum(edge[:-1]) > 0
    return out


def measure(text: str | None, covered: dict[int, float] | None = None, covered_lines: float = COVERED_LINES) -> tuple:
    """The fields of RESULT for one text."""
    covered = COVERED if covered is None else covered
    text = text or ""
    words = _WORD.findall(text)
    sizes = np.array([len(w) for w in words], np.int64)
    chars = int(sizes.sum())
    masks = repeated(words, sorted({WINDOW, *covered}))
    again = int(masks[WINDOW].sum())
    earlier: set[str] = set()
    dup = dup_chars = 0
    for line in text.split("\n"):
        if line in earlier:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, _WORD.findall(line)))
        elif _WORD.search(line):
            earlier.add(line)
    coverage = [float(sizes[masks[n]].sum()) / chars if chars else 0.0 for n in covered]
    lines = dup_chars / chars if chars else 0.0
    failed = len(words) < LEAST_WORDS or 100 * again > MOST_REPEATED * len(words)
    kept = not failed and lines <= covered_lines and all(c <= most for c, most in zip(coverage, covered.values(), strict=True))
    return len(words), chars, len(_SYMBOL.findall(text)), dup, again, lines, coverage, failed, kept


def judge(docs: DataFrame, text: str = "text", out: str = "quality_rules", covered: dict[int, float] | None = None, covered_lines: float = COVERED_LINES) -> DataFrame:
    """docs with a struct column `out` of the fields of RESULT."""
    Batches.small(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]

    @F.pandas_udf(RESULT)
    def rules(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, covered, covered_lines) for t in texts], columns=names)

    return docs.withColumn(out, rules(F.col(text)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), out="q")
    return d.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_coverage", "base_failed", "kept")])
