"""Language identification by a string kernel, Nystroem landmarks and ridge regression."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, stored

#: Labelled texts that the classifier is fitted on, over all languages, and landmarks of them.
FIT_ROWS = 4096
LANDMARKS = 512
RIDGE = 1e-3
UNDETERMINED = "und"
#: Letter classes: 0 stands for anything between words, 1 for a letter that is not among the
#: most frequent. An n-gram of up to three classes is an address below 2^21 + 2^14 + 2^7.
CLASSES = 128
LONGEST = 3
_SPACE = sum(CLASSES**n for n in range(1, LONGEST + 1))


def letter_classes(frequent: list[int]) -> np.ndarray:
    """The class of each code point."""
    table = np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.int32, 0x110000
    )
    table[frequent] = np.arange(2, 2 + len(frequent))
    return table


class Spectrum:
    """The blended spectrum of a text: which n-grams of 1 to 3 letter classes it has."""

    def __init__(self, frequent: list[int]):
        self.classes = letter_classes(frequent)
        self.last = np.zeros(_SPACE, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        """Addresses of the distinct n-grams, none if the text has no letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        found = self.classes[codes]
        if not found.any():
            return np.zeros(0, np.int32)
        padded = np.zeros(len(found) + 2, np.int32)
        padded[1:-1] = found
        padded = padded[np.r_[True, (padded[1:] != 0) | (padded[:-1] != 0)]]
        grams, offset, value = [], 0, np.zeros(len(padded), np.int32)
        for n in range(1, LONGEST + 1):
            value = value[: len(padded) - n + 1] * CLASSES + padded[n - 1 :]
            grams.append(value + offset)
            offset += CLASSES**n
        grams = np.concatenate(grams)
        place = np.arange(len(grams), dtype=np.int32)
        self.last[grams] = place  # of equal addresses one place stays
        return grams[self.last[grams] == place]


@dataclass
class Model:
    """Weights of the n-grams that landmarks have, one column for each language."""

    languages: list[str]
    frequent: list[int]
    addresses: np.ndarray
    weights: np.ndarray

    def scores(self, spectra: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest outputs of a batch, as one matrix product.

        The kernel of a text and a landmark is the number of n-grams both have over the root
        of the product of their own numbers. Summed over landmarks with their coefficients,
        that is a product of the text's presence vector and the weights folded at fit.
        """
        present = np.zeros((len(spectra), len(self.addresses)), np.float32)
        for row, grams in zip(present, spectra):
            at = self.where[grams]
            row[at[at >= 0]] = 1
        norms = np.sqrt([max(1, len(grams)) for grams in spectra])
        return present @ self.weights / norms[:, None]

    @property
    def where(self) -> np.ndarray:
        if "_where" not in self.__dict__:
            self._where = np.full(_SPACE, -1, np.int32)
            self._where[self.addresses] = np.arange(len(self.addresses))
        return self._where

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_where"}


def ridge_weights(
    spectra: list[np.ndarray], labels: np.ndarray, languages: int, landmarks: int, ridge: float
) -> tuple[np.ndarray, np.ndarray]:
    """``addresses, weights`` of a one-versus-rest kernel ridge regression on landmarks.

    Rows come in an order that has nothing to do with their texts; the first rows of each
    language in turn are landmarks. Each language weighs the same.
    """
    nth = np.zeros(len(labels), int)
    for label in range(languages):
        nth[labels == label] = np.arange((labels == label).sum())
    chosen = np.lexsort((labels, nth))[:landmarks]
    addresses = np.unique(np.concatenate([spectra[i] for i in chosen]))
    where = np.full(_SPACE, -1, np.int32)
    where[addresses] = np.arange(len(addresses))

    def present(rows):
        out = np.zeros((len(rows), len(addresses)), np.float32)
        for row, i in zip(out, rows):
            at = where[spectra[i]]
            row[at[at >= 0]] = 1 / np.sqrt(len(spectra[i]))
        return out

    marks = present(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    gram = np.zeros((half.shape[1],) * 2)
    right = np.zeros((half.shape[1], languages))
    share = 1 / np.bincount(labels, minlength=languages)
    for begin in range(0, len(spectra), 256):
        rows = range(begin, min(begin + 256, len(spectra)))
        feature = (present(rows) @ marks.T).astype(float) @ half
        label = labels[begin : begin + len(rows)]
        weight = share[label][:, None] / languages
        gram += feature.T @ (feature * weight)
        right += (feature * weight).T @ np.where(label[:, None] == np.arange(languages), 1.0, -1.0)
    solved = half @ np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
    return addresses, (marks.T @ solved.astype(np.float32))


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        codes = [
            np.frombuffer(t.as_py().lower().encode("utf-32-le", "replace"), np.uint32)
            for t in batch["text"]
        ]
        found, counts = np.unique(np.concatenate(codes or [[]]), return_counts=True)
        letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in found], bool)
        yield pa.record_batch(
            {
                "code": pa.array(found[letter], pa.int64()),
                "n": pa.array(counts[letter], pa.int64()),
            }
        )


def fit(labelled: DataFrame, rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on at most ``rows`` of the texts of ``text, lang``, the same number per language.

    The sample is the texts with the least hashes, each different text once; rows with a null
    in either column take no part. Without a labelled text with letters there is no model.
    Only the sample's letters and n-gram addresses reach the driver.
    """
    digest = F.xxhash64("text").alias("digest")
    keys = labelled.dropna(subset=["text", "lang"]).select("lang", digest).distinct()
    languages = keys.select("lang").distinct().count()
    if not languages:
        return None
    order = Window.partitionBy("lang").orderBy("digest")
    some = keys.withColumn("nth", F.row_number().over(order))
    some = some.filter(F.col("nth") <= max(2, rows // languages)).select("lang", "digest")
    sample = labelled.dropna(subset=["text", "lang"]).select("text", "lang", digest)
    sample = stored(
        sample.join(F.broadcast(some), ["lang", "digest"]).dropDuplicates(["lang", "digest"]),
        "sample",
    )
    letters = sample.select("text").mapInArrow(_letters, "code bigint, n bigint")
    letters = letters.groupBy("code").agg(F.sum("n").alias("n"))
    top = letters.orderBy(F.col("n").desc(), "code").limit(CLASSES - 2).collect()
    frequent = [r["code"] for r in top]

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(frequent)
        for batch in slices(batches):
            found = [spectrum(t.as_py()).tobytes() for t in batch["text"]]
            yield pa.record_batch(
                {"lang": batch["lang"], "digest": batch["digest"], "grams": pa.array(found, pa.binary())}
            )

    found = sample.mapInArrow(spectra, "lang string, digest bigint, grams binary")
    found = found.filter(F.octet_length("grams") > 0).orderBy("digest", "lang").collect()
    if not found:
        return None
    names = sorted({r["lang"] for r in found})
    labels = np.array([names.index(r["lang"]) for r in found])
    grams = [np.frombuffer(r["grams"], np.int32) for r in found]
    return Model(names, frequent, *ridge_weights(grams, labels, len(names), landmarks, RIDGE))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred, score, has_letters`` to the rows; only ``text`` is looked at.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if there is
    no model. ``score`` is the language's share after a softmax of the outputs. Ties go to
    the first language by name. Other columns pass unchanged; a column of one of the three
    names is replaced.
    """
    added = ("lang_pred", "score", "has_letters")
    small_batches(docs.sparkSession)
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        spectrum = Spectrum(model.frequent if model else [])
        for batch in slices(batches, 32):
            grams = [spectrum(text) for text in batch["text"].to_pylist()]
            letters = [len(x) > 0 for x in grams]
            if model is None:
                names, scores = [UNDETERMINED] * len(grams), [0.0] * len(grams)
            else:
                outputs = model.scores(grams).astype(float)
                share = np.exp(4 * (outputs - outputs.max(axis=1, keepdims=True)))
                best = [model.languages[i] for i in outputs.argmax(axis=1)]
                names = [n if ok else UNDETERMINED for n, ok in zip(best, letters)]
                scores = np.where(letters, 1 / share.sum(axis=1), 0.0).tolist()
            columns = {name: batch[name] for name in batch.schema.names}
            columns["lang_pred"] = pa.array(names, pa.string())
            columns["score"] = pa.array(scores, pa.float64())
            columns["has_letters"] = pa.array(letters, pa.bool_())
            yield pa.record_batch(columns)

    schema = docs.withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0), "has_letters": F.lit(True)}
    ).schema
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4.

    A null id is not held out.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
