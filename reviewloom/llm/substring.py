"""Repeated passages: matching statistics against suffix automata of reference shards.

Every document is reference for every other one, so neither the reference nor all automata fit
a broadcast with a bound. Instead, documents and reference shards meet by content. Each window
of ``window`` words has an anchor: of the runs of ``ANCHOR`` words in it, the one with the least
hash. Equal windows have equal anchors, so only windows with one anchor can be equal. Successive
windows with the same anchor form a segment, and a segment goes to the shard of its anchor:

1. an anchor that occurs once has no repeated window; most end here, without their words;
2. if all segments of an anchor are equal, all their windows are repeated;
3. the other anchors' different segments, each once, are dealt to shards by anchor. A shard
   builds a suffix automaton of its segments and streams them through it: where at least
   ``window`` words match and these occur twice, the window is repeated;
4. an anchor with more different segments than a shard should hold (a common line between
   ever different words) is counted by whole windows, which is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_partitions, slices, stored
from .word_hashes import mixed, word_hashes

#: Words of an anchor.
ANCHOR = 12
#: Different segments of one anchor that a shard takes, and words that a shard should have.
SEGMENTS = 1000
SHARD_WORDS = 100_000
_BASE = 0x9E3779B97F4A7C15
_BASES = (np.uint64(_BASE), np.uint64(0xD6E8FEB86659FD93))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _BASES)


def text_words(text: str | None) -> list[bytes]:
    """Words as they are; ASCII white space splits."""
    return (text or "").encode().split()


class Runs:
    """Hashes of runs of words, from running sums of powers modulo 2^64."""

    def __init__(self, hashes: np.ndarray, which: int):
        n = len(hashes)
        powers = np.full(n, _BASES[which], np.uint64)
        inverse = np.full(n, _INVERSES[which], np.uint64)
        if n:
            powers[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        terms = mixed(hashes ^ _BASES[which]) * np.cumprod(powers, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + mixed((end - begin).astype(np.uint64)))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each stretch of ``width``, in a few arrays of memory."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        have += step
    return place


def segments(hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """``first window, windows, anchor hash, segment hash`` of each segment of a document."""
    total = len(hashes) - window + 1
    if total <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    size = min(ANCHOR, window)
    starts = np.arange(len(hashes) - size + 1)
    grams = Runs(hashes, 0)(starts, starts + size)
    anchor = least_places(grams, window - size + 1)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, total])
    whole = Runs(hashes, 1)(first, first + count + window - 1)
    return first, count, grams[anchor[first]].view(np.int64), whole.view(np.int64)


class Automaton:
    """Suffix automaton of several sequences, with the number of occurrences of each state."""

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.length, self.link, self.step, self.count = [0], [-1], [{}], [0]
        for nth, (sequence, weight) in enumerate(zip(sequences, weights)):
            last = 0 if not nth else self._add(last, -nth, 0)
            for symbol in sequence:
                last = self._add(last, symbol, weight)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _add(self, last: int, symbol: int, weight: int) -> int:
        length, link, step = self.length, self.link, self.step
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        self.count.append(weight)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = step[at][symbol]
            if length[target] != length[at] + 1:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[target])
                step.append(step[target].copy())
                self.count.append(0)
                while at >= 0 and step[at].get(symbol) == target:
                    step[at][symbol] = copy
                    at = link[at]
                link[target] = copy
                target = copy
            link[new] = target
        return new

    def occurrences(self, sequence: list[int], window: int) -> Iterator[int]:
        """For each position, how often the ``window`` symbols that end there occur.

        The matching statistic is kept no longer than ``window``: the state is that of the
        longest match of at most so many symbols. Shorter matches give 0.
        """
        state = matched = 0
        length, link = self.length, self.link
        for symbol in sequence:
            while state and symbol not in self.step[state]:
                state = link[state]
                matched = length[state]
            state = self.step[state].get(symbol, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= window:
                state = link[state]
            matched = min(matched, length[state])
            yield self.count[state] if matched >= window else 0


def _segment_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [segments(word_hashes(t.as_py()), window) for t in batch["text"]]
            row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            at, n, anchor, whole = (np.concatenate(x) for x in zip(*found)) if found else [[]] * 4
            yield pa.record_batch(
                {
                    "uid": batch["uid"].take(pa.array(row, pa.int64())),
                    "at": pa.array(at, pa.int32()),
                    "n": pa.array(n, pa.int32()),
                    "anchor": pa.array(anchor, pa.int64()),
                    "segment": pa.array(whole, pa.int64()),
                }
            )

    return run


def _word_rows(window: int):
    """The words (as hashes) of wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, wanted in zip(batch["text"], batch["wanted"].to_pylist()):
                hashes = word_hashes(text.as_py())
                for x in wanted:
                    words = hashes[x["at"] : x["at"] + x["n"] + window - 1].tobytes()
                    rows.append({k: x[k] for k in ("anchor", "segment", "copies")} | {"words": words})
            yield pa.RecordBatch.from_pylist(rows, schema=_WORDS)

    return run


_WORDS = pa.schema(
    [("anchor", pa.int64()), ("segment", pa.int64()), ("copies", pa.int64()), ("words", pa.binary())]
)


def _match(window: int):
    """One reference shard: which windows of its segments occur twice in it, as bits."""

    def run(shard: pa.Table) -> pa.Table:
        rows = {(r["anchor"], r["segment"]): r for r in shard.to_pylist()}.values()
        hashes = [np.frombuffer(r["words"], np.uint64) for r in rows]
        symbols = np.unique(np.concatenate(hashes), return_inverse=True)[1].tolist()
        sequences, begin = [], 0
        for x in hashes:
            sequences.append(symbols[begin : begin + len(x)])
            begin += len(x)
        automaton = Automaton(sequences, [r["copies"] for r in rows])
        masks = []
        for sequence in sequences:
            twice = [c > 1 for c in automaton.occurrences(sequence, window)][window - 1 :]
            masks.append(sum(1 << i for i, x in enumerate(twice) if x))
        return pa.table(
            {
                "anchor": pa.array([r["anchor"] for r in rows], pa.int64()),
                "segment": pa.array([r["segment"] for r in rows], pa.int64()),
                "mask": pa.array(masks, pa.int64()),
            }
        )

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [np.frombuffer(x.as_py(), np.uint64) for x in batch["words"]]
            counts = [len(x) - window + 1 for x in hashes]
            row = pa.array(np.repeat(np.arange(len(hashes)), counts), pa.int64())
            nth = [np.arange(n) for n in counts]
            whole = [Runs(x, 1)(i, i + window).view(np.int64) for x, i in zip(hashes, nth)]
            yield pa.record_batch(
                {
                    "anchor": batch["anchor"].take(row),
                    "segment": batch["segment"].take(row),
                    "copies": batch["copies"].take(row),
                    "nth": pa.array(np.concatenate(nth) if nth else [], pa.int32()),
                    "whole": pa.array(np.concatenate(whole) if whole else [], pa.int64()),
                }
            )

    return run


def _row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """``uid, spans`` for rows ``doc_id, text`` that have a repeated window.

    ``spans`` is an array of ``at, n, mask``: of the windows at, at + 1, ... at + n - 1, those
    whose bit is set in mask are repeated, or all if mask is null. ``uid`` is a hash of doc_id
    and text; rows that are equal in both have the same spans.
    """
    if not ANCHOR <= window < ANCHOR + 63:
        raise ValueError(f"windows have {ANCHOR} to {ANCHOR + 62} words")
    spark = docs.sparkSession
    rows = docs.select(_row_id().alias("uid"), "text")
    found = rows.mapInArrow(
        _segment_rows(window), "uid bigint, at int, n int, anchor bigint, segment bigint"
    )
    found = stored(found, "segments")
    anchors = found.groupBy("anchor").agg(
        F.count("*").alias("c"), F.min("segment").alias("lo"), F.max("segment").alias("hi")
    )
    anchors = stored(
        anchors.filter("c > 1").select("anchor", (F.col("lo") < F.col("hi")).alias("differ")),
        "anchors",
    )
    shared = stored(found.join(anchors, "anchor"), "shared")
    place = F.struct("uid", "at", "n")
    each = shared.filter("differ").groupBy("anchor", "segment")
    each = stored(each.agg(F.min(place).alias("one"), F.count("*").alias("copies")), "each")
    per_anchor = each.groupBy("anchor").agg(F.count("*").alias("segments"))
    each = each.join(per_anchor, "anchor").withColumn("common", F.col("segments") > SEGMENTS)
    wanted = each.groupBy(F.col("one.uid").alias("uid"), "common").agg(
        F.collect_list(F.struct("one.at", "one.n", "anchor", "segment", "copies")).alias("wanted")
    )
    words = rows.join(wanted, "uid").select("common", "text", "wanted")
    kinds = "anchor bigint, segment bigint, copies bigint, words binary"

    def words_of(common: bool) -> DataFrame:
        return stored(words.filter(F.col("common") == common).mapInArrow(_word_rows(window), kinds), "words")

    few = words_of(False)
    length = few.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), length // (8 * SHARD_WORDS) + 1)
    matched = (
        few.withColumn("shard", bucket_of(shards, "anchor"))
        .groupBy("shard")
        .applyInArrow(
            lambda shard: _match(window)(shard), "anchor bigint, segment bigint, mask bigint"
        )
    )
    windows = words_of(True).distinct().mapInArrow(
        _window_rows(window),
        "anchor bigint, segment bigint, copies bigint, nth int, whole bigint",
    )
    windows = stored(windows, "windows")
    twice = windows.groupBy("anchor", "whole").agg(F.sum("copies").alias("c")).filter("c > 1")
    counted = (
        windows.join(twice.drop("c"), ["anchor", "whole"])
        .groupBy("anchor", "segment")
        .agg(F.sum(F.expr("shiftleft(1L, nth)")).alias("mask"))
    )
    masks = stored(matched.union(counted).filter("mask <> 0"), "masks")
    differ = shared.filter("differ").join(masks, ["anchor", "segment"])
    same = shared.filter("not differ").withColumn("mask", F.lit(None).cast("bigint"))
    spans = differ.select("uid", "at", "n", "mask").union(same.select("uid", "at", "n", "mask"))
    return spans.groupBy("uid").agg(F.collect_set(F.struct("at", "n", "mask")).alias("spans"))


def covered_words(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of ``n`` words are in a repeated window."""
    change = np.zeros(n + 1, np.int64)
    for x in spans or ():
        at = x["at"] + np.arange(x["n"])
        if x["mask"] is not None:
            at = at[(x["mask"] >> np.arange(x["n"])) & 1 == 1]
        np.add.at(change, at, 1)
        np.add.at(change, np.minimum(at + window, n), -1)
    return np.cumsum(change)[:-1] > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals, removed, kept = [], [], []
            for text, spans in zip(batch["text"], batch["spans"].to_pylist()):
                words = text_words(text.as_py())
                gone = covered_words(len(words), spans, window)
                totals.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            columns = {name: batch[name] for name in batch.schema.names if name != "spans"}
            columns["n_words"] = pa.array(totals, pa.int64())
            columns["n_removed"] = pa.array(removed, pa.int64())
            columns["kept"] = pa.array(kept, pa.string())
            yield pa.record_batch(columns)

    return run


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, text, n_words, n_removed, kept`` for each row of ``doc_id, text``.

    A window is ``window`` consecutive words of one document. Each word covered by a window
    whose words also start anywhere else, in another row or in the same document, is removed;
    windows are judged on the input. ``kept`` joins the other words by one space. A null or
    short text has no windows and keeps all its words; repeated rows repeat each other; a null
    doc_id is like any other; an empty table gives no rows.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    spans = repeated_windows(rows, window).withColumnRenamed("uid", "uid_of_spans")
    joined = rows.join(spans, _row_id() == F.col("uid_of_spans"), "left").drop("uid_of_spans")
    return joined.mapInArrow(
        _cut(window), "doc_id bigint, text string, n_words bigint, n_removed bigint, kept string"
    )


def cut_documents(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all columns stay.

    A text without repeated passages is left as it is; of others the kept words are joined by
    one space. ``n_chars``, if there, is the new length of a changed text.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    keyed = plain.withColumns(
        {"doc_id": F.col(at["doc_id"]).cast("bigint"), "text": F.col(at["text"])}
    ).withColumn("uid", _row_id())
    spans = repeated_windows(keyed.select("doc_id", "text"), window)
    joined = keyed.join(spans, "uid", "left").drop("uid", "doc_id", at["text"])
    schema = joined.drop("spans").selectExpr("*", "0L n_words", "0L n_removed", "'' kept").schema
    found = joined.mapInArrow(_cut(window), schema)
    changed = F.col("n_removed") > 0
    found = found.withColumn(at["text"], F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in at:
        length = F.length("kept").cast(dict(docs.dtypes)["n_chars"])
        found = found.withColumn(
            at["n_chars"], F.when(changed, length).otherwise(F.col(at["n_chars"]))
        )
    return found.select(*[F.col(at[c]).alias(c) for c in docs.columns])
