"""Language of a text by error-correcting output codes over hashed n-grams of characters.

Every language has a codeword of +1 and -1. One binary classifier per place of the codewords, a logistic regression on
n-gram shares, says how strongly a text has +1 there. Decoding adds up, for every language, the logistic losses of all
places against its codeword, each weighted by how far its classifier is to be trusted, and takes the language with the
least loss. If the next best is nearly as good, the text is flagged as ambiguous.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.sources.sinks import stage_table

#: Hashed n-grams, longest n-gram, training texts per language and in all, and characters hashed at a time.
FEATURES, LONGEST, TEXTS_PER_LANG, TEXTS, BLOCK = 4096, 3, 500, 12_000, 1 << 18
#: How loss turns into a share of belief, and the least share of the best language that is not ambiguous.
SHARPNESS, CLEAR = 2.0, 0.6
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def codes(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of ``n`` languages; no place is constant and no two places ask the same.

    Up to seven languages get every possible place. More get random places, the best of many draws by least distance.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        places = [[1.0] + [1.0 if mask >> k & 1 else -1.0 for k in range(n - 1)] for mask in range(2 ** (n - 1) - 1)]
        return np.array(places).T
    source = random.Random(n)
    length = 12 * (n - 1).bit_length()
    best, best_distance = None, -1
    while best is None or source.random() > 0.01:
        drawn = np.array([[source.choice((-1.0, 1.0)) for _ in range(length)] for _ in range(n)])
        products = drawn @ drawn.T
        distance = int((length - products[~np.eye(n, dtype=bool)].max()) / 2)
        if distance > best_distance and (np.abs(drawn.sum(0)) < n).all():
            best, best_distance = drawn, distance
    return best


def grams(text: str | None) -> np.ndarray | None:
    """Shares of the hashed n-grams of the letters of the whole text, scaled to length 1; None without a letter."""
    counts = np.zeros(FEATURES)
    any_letter = False
    text = (text or "").lower()
    for i in range(0, len(text), BLOCK):
        points = np.frombuffer(text[max(0, i - LONGEST + 1) : i + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(points, 0xFFFF)
        letter = _LETTER[low]
        for k in np.flatnonzero(points > 0xFFFF):
            letter[k] = chr(points[k]).isalpha()
        if not letter.any():
            continue
        any_letter = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        own = np.where(letter, points, np.uint32(32))[keep]
        own = np.concatenate((np.array([32], np.uint32), own)) if i == 0 else own
        mixed = np.zeros(len(own), np.uint32)
        for n in range(LONGEST):
            mixed = mixed[: len(own) - n] * _FACTORS[1] + own[n:] * _FACTORS[0] + np.uint32(n)
            if not len(mixed):
                break
            slot = (mixed ^ mixed >> np.uint32(15)) * _FACTORS[2] >> np.uint32(20)
            counts += np.bincount(slot.astype(np.int64), minlength=FEATURES)
    if not any_letter:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        """Language, share of belief, and whether it is ambiguous."""
        if not self.langs:
            return UNKNOWN, 0.0, True
        margin = x @ self.weights + self.bias
        loss = (np.logaddexp(0.0, -self.code * margin) * self.trust).sum(1)
        belief = np.exp(-SHARPNESS * (loss - loss.min()))
        best = int(loss.argmin())
        share = float(belief[best] / belief.sum())
        return self.langs[best], share, share < CLEAR


def fit_rows(langs: list[str], rows: np.ndarray, lang: np.ndarray, rounds: int = 300) -> Model:
    """Logistic regressions for all places of the code at once; every language weighs the same.

    ``rows`` may be in half precision; they are widened a block at a time.
    """
    code = codes(len(langs))
    wanted = code[lang] > 0
    share = (1.0 / np.bincount(lang, minlength=len(langs)))[lang]
    share = share / share.sum()
    blocks = [slice(i, i + 1024) for i in range(0, len(rows), 1024)]
    weights, bias = np.zeros((rows.shape[1], code.shape[1])), np.zeros(code.shape[1])
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rounds):
        pull_w, pull_b = 1e-5 * weights, np.zeros_like(bias)
        narrow = weights.astype(np.float32)
        for b in blocks:
            x = rows[b].astype(np.float32)
            off = (1 / (1 + np.exp(-(x @ narrow + bias))) - wanted[b]) * share[b, None]
            pull_w += x.T @ off.astype(np.float32)
            pull_b += off.sum(0)
        speed_w = 0.9 * speed_w - 20.0 * pull_w
        speed_b = 0.9 * speed_b - 2.0 * pull_b
        weights, bias = weights + speed_w, bias + speed_b
    right = sum((((rows[b].astype(float) @ weights + bias > 0) == wanted[b]) * share[b, None]).sum(0) for b in blocks)
    trust = np.clip(2 * right - 1, 0.01, 1.0)
    return Model(langs, code, weights, bias, trust / trust.mean() / max(1, code.shape[1]) * 7)


def _is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 != 1


def fit(documents: DataFrame) -> Model:
    """Learn from about ``TEXTS_PER_LANG`` whole texts, or all if there are fewer, of every language.

    If that comes to more than ``TEXTS`` texts, every language gets an equal share of these, but one at least; so the
    sample is bounded by the number of languages, and none is left out. Rows whose crc32(doc_id) mod 3 is 1 and rows
    with a null id, text or language are not used. Texts are picked by a hash of the id, so the choice does not depend on
    the order of rows. Shares of n-grams reach the driver in half precision, 8 KB for a text.
    Without a usable row every text is ``und``.
    """
    usable = documents.where("doc_id is not null and lang is not null and text is not null")
    usable = usable.where(_is_training(F.col("doc_id")))
    of_lang = stage_table(usable.groupBy("lang").count(), "langid-counts")
    each = max(1, min(TEXTS_PER_LANG, TEXTS // max(1, of_lang.count())))
    part = F.least(F.lit(1.0), each / F.col("count"))
    ids = usable.select("doc_id", "lang").join(of_lang, "lang")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # The least draw of a language is always in, so that a language with few texts picked is not lost.
    least = ids.groupBy("lang").agg(F.min(F.struct(drawn.alias("d"), "doc_id")).alias("first"))
    chosen = ids.where(drawn < part * 1_000_000).select("doc_id", "lang").union(least.select("first.doc_id", "lang"))
    chosen = stage_table(chosen.distinct(), "langid-sample")
    texts = usable.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, x) for lang, text in zip(batch["lang"], batch["text"]) if (x := grams(text)) is not None]
            found = [x.astype("<f2").tobytes() for _, x in rows]
            yield pd.DataFrame({"lang": [lang for lang, _ in rows], "x": pd.Series(found, dtype=object)})

    sample = texts.select("lang", "text").mapInPandas(features, "lang string, x binary").orderBy("lang", "x").toArrow()
    names = sample["lang"].to_pylist()
    langs = sorted(set(names))
    rows = np.empty((len(names), FEATURES), np.float16)
    for i, x in enumerate(sample["x"]):
        rows[i] = np.frombuffer(x.as_buffer(), "<f2")
    return fit_rows(langs, rows, np.array([langs.index(n) for n in names], np.int64))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """``row``, a struct of all columns of ``documents``, and ``found``, a struct of ``lang``, ``score``, ``ambiguous``.

    Whole texts are read. A null text or one without a letter is ``und`` with score 0 and ambiguous. Nothing but the
    text is looked at. The model has a bounded size and goes out as a broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            found = [(UNKNOWN, 0.0, True) if (x := grams(t)) is None else own.decode(x) for t in texts]
            yield pd.DataFrame(found, columns=["lang", "score", "ambiguous"])

    return documents.select(F.struct("*").alias("row"), score("text").alias("found"))


def judged(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row; a null id is not held out."""
    return scored(documents.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(~_is_training(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.ambiguous").alias("ambiguous"),
    )


def with_known_language(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` in a language that is not ``und`` nor ambiguous, with the columns they came with."""
    found = scored(documents, fit(documents))
    return found.where(~F.col("found.ambiguous")).select("row.*")
