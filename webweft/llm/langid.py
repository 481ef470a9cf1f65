"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit of the codewords, a binary naive-Bayes classifier
over character n-grams says how strongly a text looks like the languages whose bit is set.
Decoding adds up each bit's loss against each codeword, weighted by how far the bit can be
trusted, and takes the codeword with the smallest loss. A text whose two best codewords lose
nearly the same is flagged as ambiguous.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, named

UNDETERMINED = "und"
#: Training rows for each language in expectation, and characters of each; with many languages fewer
#: of both, for MOST_ROWS and MOST_CHARS bound what the driver collects to fit the classifiers.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
MOST_ROWS, MOST_CHARS = 80_000, 64_000_000
#: n-grams of 1 to ORDERS characters fall into 2^HASH_BITS cells.
ORDERS, HASH_BITS = 4, 16
#: Words of the snippets that are cut from training texts, for short texts to be calibrated too.
SNIPPETS = (1, 2, 4, 8, 16, 64)
#: Difference of the two smallest losses, as a share of all bits' weight, that is ambiguous below.
AMBIGUOUS = 0.02
HOLDOUT = 5

_OTHER = re.compile(r"[\W\d_]+")
_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def cells(text: str) -> np.ndarray:
    """Cells of all n-grams of the lower-cased letters, other runs counting as one space."""
    plain = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4")
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * _STEP ^ codes[n - 1 :]
        out.append((h * _MIX + np.uint32(n) * _STEP) * _MIX >> np.uint32(32 - HASH_BITS))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n classes. Up to 7 classes get every split of the classes
    once (the exhaustive code), more get the best separated of several pseudo-random codes."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, np.int8).T.copy()
    best, apart = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, 63))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # cell x bit: log odds of the bit
    scale: np.ndarray  # bit: margin of a mean log odds of 1
    trust: np.ndarray  # bit

    def mean_odds(self, text: str) -> np.ndarray:
        found = cells(text)
        total = np.zeros(self.weights.shape[1], np.float64)
        for a in range(0, len(found), 65_536):
            total += self.weights[found[a : a + 65_536]].sum(axis=0, dtype=np.float64)
        return total / max(1, len(found))

    def losses(self, odds: np.ndarray) -> np.ndarray:
        """Trust-weighted logistic loss of each language's codeword."""
        return (self.trust * np.logaddexp(0, -self.code * (self.scale * odds))).sum(axis=-1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, ambiguous or not."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(self.mean_odds(text))
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]))
        gap = (loss[order[1]] - loss[order[0]]) / self.trust.sum()
        return self.languages[order[0]], float(1 / share.sum()), bool(gap < AMBIGUOUS)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Fit the bit classifiers to (text, language) rows; texts without a letter are passed over."""
    rows = sorted((lang, text) for text, lang in rows if has_letter(text))
    languages = sorted({lang for lang, _ in rows})
    code, size = codewords(len(languages)), 1 << HASH_BITS
    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), size))
    for lang, text in rows:
        c = np.bincount(cells(text), minlength=size)
        counts[number[lang]] += c / c.sum()  # a long text counts as much as a short one
    rates = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-12)
    smooth = 1e-6
    weights = np.zeros((size, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        on, off = rates[code[:, b] > 0].mean(axis=0), rates[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log((on + smooth) / (off + smooth))
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    if len(languages) < 2:
        return model
    odds, truth = [], []
    for lang, text in rows:
        words = text.split()
        at = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        for piece in [text, *(" ".join(words[(k := at % max(1, len(words) - n)) : k + n]) for n in SNIPPETS if n < len(words))]:
            if has_letter(piece):
                odds.append(model.mean_odds(piece))
                truth.append(number[lang])
    odds, signs = np.array(odds), code[np.array(truth)]
    # The scale that fits each bit's margins best, and how much better than chance the bit then is.
    grid = np.geomspace(0.25, 64, 33)
    for b in range(code.shape[1]):
        fits = [np.logaddexp(0, -signs[:, b] * s * odds[:, b]).mean() for s in grid]
        model.scale[b] = grid[int(np.argmin(fits))]
        model.trust[b] = max(0.05, 1 - min(fits) / np.log(2))
    return model


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % HOLDOUT == 0


def sample_bounds(languages: int) -> tuple[int, int]:
    """Rows for each of so many languages, and characters of each row."""
    rows = max(1, min(SAMPLE_ROWS, MOST_ROWS // languages))
    return rows, max(1, min(SAMPLE_CHARS, MOST_CHARS // (rows * languages)))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit a model to a sample of the labelled rows that are not held out.

    Every language is sampled, its rows by a hash of id and text, within :func:`sample_bounds` in
    expectation; of a longer text a piece is taken, from a place that the hash says. Rows without
    text, letter or label teach nothing. The driver gets a count of each label and the sample.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"))
    rows = rows.filter("text <> '' and lang is not null").filter(~held_out(F.col("id")))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return fit([])
    each, chars = sample_bounds(len(counts))
    whole = 1 << 62
    draw = F.xxhash64("id", "text").bitwiseAND(F.lit(whole - 1))
    share = None
    for r in counts:
        most = min(whole, -(-whole * each // r["count"]))
        share = (F if share is None else share).when(F.col("lang") == r["lang"], F.lit(most))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    picked = rows.filter(draw < share.otherwise(0)).select(F.col("text").substr(at.cast("int"), F.lit(chars)).alias("text"), "lang")
    return fit([(r["text"], r["lang"]) for r in picked.collect()])


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", score: str = "score", ambiguous: str = "ambiguous") -> DataFrame:
    """``df``'s rows with language, score and flag of ambiguity of their whole text.

    A map without shuffle. A null text or one without a letter is ``und`` with score 0, flagged.
    Repeated rows stay, an empty table gives an empty one; columns of ``df`` that have one of
    the new names give way to them.
    """

    @F.pandas_udf(f"{out} string, {score} double, {ambiguous} boolean")
    def classify(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=[out, score, ambiguous])

    found = fresh_name(df, "_found")
    made = df.withColumn(found, classify(named(text_col).cast("string")))
    taken = {c.lower() for c in (out, score, ambiguous)}
    return made.select(*(named(c) for c in df.columns if c.lower() not in taken), f"{found}.*")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row, learnt from the others' labels.

    Neither label, source nor id enters a prediction. Null texts and texts without a letter are
    ``und``; a null id counts as the empty text, whose CRC is 0, and so is held out; repeated rows
    stay; an empty table gives an empty result; without any label all are ``und``.
    """
    model = train(df, id_col, text_col, lang_col)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), held_out(df[id_col]).alias("held_out"), df[text_col].cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
