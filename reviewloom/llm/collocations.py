"""Phrases whose words come together: counts of n-grams in weighted acyclic automata.

Every place in a piece of a text is the beginning of a window, the longest run of at most four
words from there on. The count of an n-gram is the sum over the windows that begin with it, so
one window for each place has the counts of all lengths.

1. Words are counted per language. A word below the least count is in no candidate, nor is a pair
   of words. Bit sets of fixed size tell what is frequent; what they let through costs work only.
   So pairs of frequent words are counted first, and then windows of three words or four in which
   each pair is frequent.
2. A chunk of words gives its windows sorted by prefix range, and each range becomes an automaton
   (``Automaton``): states are made as the sorted windows leave their prefix, and equal last
   states are kept once.
3. The automata of a prefix range are united and their weights added. Ranges are stretches of a
   hash of the first words (two of a pair, else three), so that a frequent pair is spread.
4. The counts of a phrase's parts lie on its path: those of its first words in the automaton of all
   frequent n-grams that begin alike, those of its last words in the one that reads backwards.

Words are told apart by two 64-bit hashes when they are counted, and by one from there on, after
a look that no two words share it; else another seed is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_ranked
from .common import bucket_of, shuffle_partitions, stored
from .word_hashes import mixed

#: Bytes of texts and number of words that are worked on at a time.
BLOCK_BYTES = 1 << 20
CHUNK_WORDS = 1 << 20
#: Occurrences of words that a prefix range should have, and windows that a union holds at once.
RANGE_WORDS = 1 << 21
UNION_ROWS = 1 << 21
#: The sets of frequent words and pairs have 2 to this power bits.
SET_BITS = 27
#: Longer words are hashed one by one.
LONG_WORD = 1 << 12
#: Words of the longest candidate.
LONGEST = 4
_RANK_BITS = 21
_SEPARATORS = rb"\x20\x09.,;:!?\x0A-\x0D"
_WORD = re.compile(rb"[^" + _SEPARATORS + rb"]+")
_SEPARATOR = re.compile(rb"[" + _SEPARATORS + rb"]")
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)])
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


class Hasher:
    """Two 64-bit hashes of each word; A-Z count as a-z."""

    def __init__(self, seed: int):
        numbers = np.random.default_rng(seed).integers(0, 2**64, (2, 256 + LONG_WORD), np.uint64)
        numbers |= np.uint64(1)
        self.seed = seed
        self.of_byte = numbers[:, :256][:, _LOWER]
        self.of_place = numbers[:, 256:]

    def __call__(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        part = np.frombuffer(data, np.uint8)
        lengths = end - begin
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        at = place + np.repeat(begin, lengths)
        np.minimum(place, LONG_WORD - 1, out=place)
        letters = part[at]
        long = np.flatnonzero(lengths > LONG_WORD)
        out = []
        for which in range(2):
            terms = self.of_byte[which][letters] * self.of_place[which][place]
            sums = np.add.reduceat(terms, first) if len(first) else np.zeros(0, np.uint64)
            hashes = mixed(sums + lengths.astype(np.uint64))
            for i in long:
                word = data[begin[i] : end[i]].lower()
                hashes[i] = xxhash.xxh3_64_intdigest(word, seed=2 * self.seed + which)
            out.append(hashes)
        return out


def blocks(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int], int]]:
    """``data, begins, numbers, own``: texts put together with line feeds between them.

    ``begins`` and ``numbers`` say where which text begins. Words from byte ``own`` on belong to
    the next block: a long text comes in parts, and each shows the next three words.
    """
    held: list[int] = []
    begins: list[int] = []
    total = 0
    for number, text in enumerate(texts):
        if len(text) > BLOCK_BYTES:
            at = 0
            while at < len(text):
                found = _SEPARATOR.search(text, at + BLOCK_BYTES)
                end = look = found.start() if found else len(text)
                for word in islice(_WORD.finditer(text, end), LONGEST - 1):
                    look = word.end()
                yield text[at:look], [0], [number], end - at
                at = end
            continue
        held.append(number)
        begins.append(total)
        total += len(text) + 1
        if total >= BLOCK_BYTES:
            yield b"\n".join(texts[i] for i in held), begins, held, total
            held, begins, total = [], [], 0
    if held:
        yield b"\n".join(texts[i] for i in held), begins, held, total


class Chunk:
    """Words of many texts: codes, second hashes, pieces, and where their bytes are."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.data: list[bytes] = []
        self.langs: list[str] = []
        self.words = self.pieces = 0

    def add(self, hasher: Hasher, data: bytes, begins: list[int], langs: list[str], own: int) -> None:
        """A block of texts that begin at ``begins`` and have these languages."""
        salt = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=7) for x in langs], np.uint64)
        kind = _KIND[np.frombuffer(data, np.uint8)]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        code, check = hasher(data, begin, end)
        text = np.searchsorted(begins, begin, "right") - 1
        code = mixed(code ^ salt[text])
        code[code == 0] = 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), begin) + self.pieces
        self.pieces += int((kind == 2).sum()) + 1
        block = np.full(len(begin), len(self.data))
        where = [x.astype(np.int32) for x in (block, begin, end, text + len(self.langs))]
        self.parts.append((code, begin < own, piece, check, *where))
        self.langs.extend(langs)
        self.data.append(data)
        self.words += len(begin)

    def columns(self, count: int) -> list[np.ndarray]:
        """The first of: code, own, piece, second hash, block, begin, end, text."""
        return [np.concatenate(x) for x in zip(*[part[:count] for part in self.parts])]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages, some megabytes at a time."""
    for batch in batches:
        texts: list[bytes] = []
        langs: list[str] = []
        size = 0
        for text, lang in zip(batch["text"], batch["lang"]):
            texts.append((text.as_py() or "").encode())
            langs.append(lang.as_py())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield texts, langs
                texts, langs, size = [], [], 0
        yield texts, langs


def chunks(batches: Iterator[pa.RecordBatch], hasher: Hasher) -> Iterator[Chunk]:
    """Chunks of about ``CHUNK_WORDS`` words from batches with ``text, lang``."""
    chunk = Chunk()
    for texts, langs in _texts(batches):
        for data, begins, numbers, own in blocks(texts):
            chunk.add(hasher, data, begins, [langs[i] for i in numbers], own)
            if chunk.words >= CHUNK_WORDS:
                yield chunk
                chunk = Chunk()
    if chunk.words:
        yield chunk


def _word_rows(seed: int):
    """Distinct words of each chunk with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, Hasher(seed)):
            code, own, _, check, block, begin, end, text = chunk.columns(8)
            mine = np.flatnonzero(own)
            order = mine[np.lexsort((check[mine], code[mine]))]
            new = (np.diff(code[order], prepend=0) != 0) | (np.diff(check[order], prepend=0) != 0)
            new[:1] = True
            first = np.flatnonzero(new)
            counts = np.diff(first, append=len(order))
            one = order[first]
            found = zip(block[one].tolist(), begin[one].tolist(), end[one].tolist())
            words = [chunk.data[b][i:j].lower().decode() for b, i, j in found]
            yield pa.record_batch(
                {
                    "lang": pa.array([chunk.langs[t] for t in text[one].tolist()], pa.string()),
                    "code": pa.array(code[one].view(np.int64)),
                    "word": pa.array(words, pa.string()),
                    "f": pa.array(counts, pa.int64()),
                }
            )

    return run


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers, each in the smallest type that holds it."""
    head, body = [], []
    for array in arrays:
        top = int(array.max()) if len(array) else 0
        kind = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k))
        head.append(np.array([kind, len(array)], "<u4").tobytes())
        body.append(array.astype(f"<u{kind}").tobytes())
    return b"".join(head + body)


def _unpacked(data: bytes, count: int) -> list[np.ndarray]:
    at, out = 8 * count, []
    for kind, length in np.frombuffer(data, "<u4", 2 * count).reshape(count, 2).tolist():
        out.append(np.frombuffer(data, f"<u{kind}", length, at).astype(np.int64 if kind < 8 else np.uint64))
        at += kind * length
    return out


class Automaton:
    """Windows of up to four words with their counts, as an acyclic automaton.

    Words have labels from 1 in the order of their codes; label 0 ends a shorter window. The
    first three labels of sorted windows form a tree: an array of labels for each depth and the
    number of arcs that leave each state. The states behind the third label are kept once each:
    their arcs carry the fourth label and the count.
    """

    ARRAYS = 10

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays

    @classmethod
    def build(cls, codes: np.ndarray, labels: list[np.ndarray], counts: np.ndarray) -> Automaton:
        """From different windows, sorted by their four labels, which are indexes into ``codes``."""
        used = np.unique(np.concatenate([x for x in labels]))
        used = used[used > 0]
        short = [np.searchsorted(used, x) + (x > 0) for x in labels]
        new = np.zeros(len(counts), bool)
        new[:1] = True
        starts = []
        for label in short[:3]:
            new = new.copy()
            new[1:] |= label[1:] != label[:-1]
            starts.append(np.flatnonzero(new))
        fans = [np.diff(np.searchsorted(starts[d + 1], starts[d]), append=len(starts[d + 1])) for d in (0, 1)]
        fan = np.diff(starts[2], append=len(counts))
        state, arcs, fan_of = cls._register(starts[2], fan, short[3], counts)
        return cls(
            [codes[used - 1].astype(np.uint64), short[0][starts[0]], fans[0], short[1][starts[1]], fans[1],
             short[2][starts[2]], state, fan_of, *arcs]
        )

    @staticmethod
    def _register(start: np.ndarray, fan: np.ndarray, label: np.ndarray, count: np.ndarray):
        """Number of the state behind each third label, and the arcs of the different states."""
        state = np.zeros(len(start), np.int64)
        single = np.flatnonzero((fan == 1) & (count[start] < 1 << 32))
        keys = label[start[single]] << 32 | count[start[single]]
        unique, state[single] = np.unique(keys, return_inverse=True)
        register: dict[bytes, int] = {}
        labels, counts, fans = [unique >> 32], [unique & 0xFFFFFFFF], [np.ones(len(unique), np.int64)]
        done = np.zeros(len(start), bool)
        done[single] = True
        for i in np.flatnonzero(~done).tolist():
            part = slice(start[i], start[i] + fan[i])
            key = label[part].tobytes() + count[part].tobytes()
            number = register.get(key)
            if number is None:
                number = register[key] = len(unique) + len(register)
                labels.append(label[part])
                counts.append(count[part])
                fans.append(fan[i : i + 1])
            state[i] = number
        return state, (np.concatenate(labels), np.concatenate(counts)), np.concatenate(fans)

    def windows(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """``codes``, the four labels of each window, and counts."""
        codes, one, fan1, two, fan2, three, state, fan, label, count = self.arrays
        begin = np.cumsum(fan) - fan
        each = fan[state]
        arc = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[state], each)
        of3 = np.repeat(np.arange(len(three)), each)
        of2 = np.repeat(np.arange(len(two)), fan2)[of3]
        of1 = np.repeat(np.arange(len(one)), fan1)[of2]
        return codes, [one[of1], two[of2], three[of3], label[arc]], count[arc]

    def size(self) -> int:
        return int(self.arrays[7][self.arrays[6]].sum())

    def to_bytes(self) -> bytes:
        return _packed(self.arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        arrays = _unpacked(data, cls.ARRAYS)
        arrays[0] = arrays[0].astype(np.uint64)
        return cls(arrays)


def _sorted_sums(labels: list[np.ndarray], counts: np.ndarray, above: np.ndarray | None = None):
    """Different windows in order (behind ``above``, if given) and the sums of their counts."""
    high = labels[0].astype(np.int64) << _RANK_BITS | labels[1]
    low = labels[2].astype(np.int64) << _RANK_BITS | labels[3]
    if above is not None:
        high |= above.astype(np.int64) << (2 * _RANK_BITS)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    high, low = high[first], low[first]
    mask = (1 << _RANK_BITS) - 1
    split = [high >> _RANK_BITS & mask, high & mask, low >> _RANK_BITS, low & mask]
    return split, sums, high >> (2 * _RANK_BITS)


def united(automata: list[Automaton]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Windows of several automata in order, with the sums of their weights."""
    parts = [a.windows() for a in automata]
    codes = np.unique(np.concatenate([p[0] for p in parts]))
    if len(codes) >= 1 << _RANK_BITS:
        return _united_wide(codes, parts)
    labels: list[list[np.ndarray]] = [[], [], [], []]
    for own, local, _ in parts:
        to = np.concatenate([[0], np.searchsorted(codes, own) + 1])
        for depth in range(4):
            labels[depth].append(to[local[depth]])
    joined = [np.concatenate(x) for x in labels]
    split, sums, _ = _sorted_sums(joined, np.concatenate([p[2] for p in parts]))
    return codes, split, sums


def _united_wide(codes: np.ndarray, parts: list) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """As ``united``, for more words than a packed label can tell."""
    maps = [np.concatenate([[0], np.searchsorted(codes, own) + 1]) for own, *_ in parts]
    labels = [np.concatenate([to[p[1][depth]] for to, p in zip(maps, parts)]) for depth in range(4)]
    counts = np.concatenate([p[2] for p in parts])
    order = np.lexsort(labels[::-1])
    labels = [x[order] for x in labels]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in labels])
    first = np.flatnonzero(new)
    return codes, [x[first] for x in labels], np.add.reduceat(counts[order], first)


def _hash(codes: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(codes[0]), np.uint64)
    for code in codes:
        total = mixed(total * _MULTIPLY + code)
    return total


def _range_of(codes: list[np.ndarray], ranges: int) -> np.ndarray:
    """Number of the stretch of hashes that the hash of some codes lies in."""
    return ((_hash(codes) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _in_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - SET_BITS)
    return bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


def _by_range(codes: np.ndarray, labels: list[np.ndarray], counts: np.ndarray, ranges: np.ndarray) -> pa.RecordBatch:
    """An automaton for each range of windows that are sorted by range."""
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    made = []
    for begin, end in zip(first.tolist(), np.append(first[1:], len(ranges)).tolist()):
        part = slice(begin, end)
        made.append(Automaton.build(codes, [x[part] for x in labels], counts[part]).to_bytes())
    return pa.record_batch(
        {"range": pa.array(ranges[first], pa.int32()), "automaton": pa.array(made, pa.binary())}
    )


def _window_rows(seed: int, bits: bytes, ranges: int, pairs: bool):
    """Automata of the windows of each chunk, by prefix range.

    With ``pairs`` windows have two words, which are in the set ``bits``; without it three or
    four, and each two that follow each other are in the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(bits, np.uint8)
        for chunk in chunks(batches, Hasher(seed)):
            code, own, piece = chunk.columns(3)
            del chunk
            link = np.zeros(len(code) + 2, bool)
            if pairs:
                known = _in_set(frequent, code)
                known = known[:-1] & known[1:]
            else:
                known = _in_set(frequent, _hash([code[:-1], code[1:]]))
            link[: len(code) - 1] = known & (piece[1:] == piece[:-1])
            at = np.flatnonzero(link[: len(code)] & own)
            if not pairs:
                at = at[link[at + 1]]
            if not len(at):
                continue
            codes, label = np.unique(code, return_inverse=True)
            label = np.concatenate([label + 1, [0, 0, 0]])
            labels = [label[at], label[at + 1]]
            if pairs:
                labels += [np.zeros(len(at), np.int64)] * 2
            else:
                labels += [label[at + 2], np.where(link[at + 2], label[at + 3], 0)]
            where = _range_of([codes[x - 1] for x in labels[: 2 if pairs else 3]], ranges)
            split, sums, where = _sorted_sums(labels, np.ones(len(at), np.int64), where)
            yield _by_range(codes, split, sums, where)

    return run


def _starts(labels: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows begin to differ in the given labels."""
    new = np.zeros(len(labels[0]), bool)
    new[:1] = True
    for x in labels:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _gram_batch(codes: np.ndarray, labels: list[np.ndarray], f: np.ndarray) -> pa.RecordBatch:
    padded = np.concatenate([np.zeros(1, np.uint64), codes])
    words = [padded[x] for x in labels] + [np.zeros(len(f), np.uint64)] * (LONGEST - len(labels))
    columns = {"n": pa.array(np.full(len(f), len(labels), np.int32))}
    columns |= {f"w{i + 1}": pa.array(x.view(np.int64)) for i, x in enumerate(words)}
    columns |= {"f": pa.array(f, pa.int64()), "hash": pa.array(_hash(words[:2]).view(np.int64))}
    return pa.record_batch(columns)


GRAMS = "n int, w1 bigint, w2 bigint, w3 bigint, w4 bigint, f bigint"


def _union_rows(least: int, pairs: bool):
    """Frequent n-grams of each prefix range, of two words, or of three and four.

    Rows are sorted by range; what a union holds is united whenever ``UNION_ROWS`` windows have
    come to it.
    """

    def finish(held: list[Automaton]) -> Iterator[pa.RecordBatch]:
        codes, labels, counts = united(held)
        for depth in (2,) if pairs else (3, 4):
            first = _starts(labels[:depth])
            f = np.add.reduceat(counts, first)
            often = (f >= least) & (labels[depth - 1][first] > 0)
            yield _gram_batch(codes, [x[first][often] for x in labels[:depth]], f[often])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Automaton] = []
        now, rows = None, 0
        for batch in batches:
            for number, data in zip(batch["range"].to_pylist(), batch["automaton"]):
                if number != now and held:
                    yield from finish(held)
                    held, rows = [], 0
                now = number
                held.append(Automaton.from_bytes(data.as_py()))
                rows += held[-1].size()
                if rows > UNION_ROWS and len(held) > 1:
                    held = [Automaton.build(*united(held))]
                    rows = 0  # the union is not counted, or a large one would be made anew each time
        if held:
            yield from finish(held)

    return run


def _dealt(automata: DataFrame, ranges: int) -> DataFrame:
    return automata.repartition(ranges, "range").sortWithinPartitions("range")


def all_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """``lang, code, word, f`` for all words of ``text, lang``, and the seed of their codes."""
    for seed in range(1, 100):
        rows = docs.mapInArrow(_word_rows(seed), "lang string, code bigint, word string, f bigint")
        words = rows.groupBy("code").agg(
            F.min("lang").alias("lang"), F.max("lang").alias("_lang"),
            F.min("word").alias("word"), F.max("word").alias("_word"), F.sum("f").alias("f"),
        )
        words = stored(words, "words")
        if words.filter("lang <> _lang or word <> _word").isEmpty():
            return words.select("lang", "code", "word", "f"), seed
    raise RuntimeError("no seed gives every word a code of its own")


def _bit_set(hashes: DataFrame) -> bytes:
    """Bits of the leading ``SET_BITS`` bits of hashes; its size does not depend on the rows."""
    place = F.shiftrightunsigned("hash", 64 - SET_BITS) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = bytearray(1 << (SET_BITS - 3))
    for row in rows.collect():  # at most 2^(SET_BITS - 15) rows of 4096 bytes
        begin = (row["bucket"] - 1) * 4096
        out[begin : begin + len(row["bits"])] = row["bits"]
    return bytes(out)


def frequent_grams(docs: DataFrame, codes: DataFrame, seed: int, words: int, least: int) -> DataFrame:
    """``n, w1, w2, w3, w4, f``: all n-grams of two to four words with a count of ``least``.

    Words are codes, 0 stands for none. ``codes`` are those of frequent words, ``words`` is the
    number of words of all texts.
    """
    ranges = max(shuffle_partitions(docs.sparkSession), words // RANGE_WORDS + 1)
    ranges = min(ranges, (1 << _RANK_BITS) - 1)

    def counted(hashes: DataFrame, pairs: bool) -> DataFrame:
        windows = _window_rows(seed, _bit_set(hashes), ranges, pairs)
        made = docs.mapInArrow(windows, "range int, automaton binary")
        grams = _dealt(made, ranges).mapInArrow(_union_rows(least, pairs), f"{GRAMS}, hash bigint")
        return stored(grams, "grams")

    pairs = counted(codes.withColumnRenamed("code", "hash"), True)
    longer = counted(pairs.select("hash"), False)
    return pairs.union(longer).drop("hash")


def path_counts(words: list[np.ndarray], f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts that lie on the path of each n-gram behind its second and its third word.

    The n-grams, with 0 for no word, hold each other's beginnings of two words and more. They
    are put into an automaton, in which a beginning is a window that ends there, and each is
    followed through it.
    """
    codes = np.unique(np.concatenate(words))
    codes = codes[codes != 0]
    labels = [np.where(w == 0, 0, np.searchsorted(codes, w) + 1) for w in words]
    order = np.lexsort(labels[::-1])
    automaton = Automaton.build(codes, [x[order] for x in labels], f[order])
    _, path, weight = automaton.windows()
    here = np.arange(len(weight))
    two = np.maximum.accumulate(np.where(path[2] == 0, here, 0))
    three = np.maximum.accumulate(np.where((path[2] > 0) & (path[3] == 0), here, 0))
    back = np.empty(len(order), np.int64)
    back[order] = here
    return weight[two][back], weight[three][back]


def _path_rows(backward: bool):
    """Add the counts behind two and three words, read from the front or from the back."""
    names = ("r2", "r3") if backward else ("l2", "l3")

    def run(grams: pa.Table) -> pa.Table:
        words = [grams[f"w{i}"].to_numpy().view(np.uint64) for i in range(1, LONGEST + 1)]
        if backward:
            n = grams["n"].to_numpy()
            rows = np.arange(len(n))
            stacked = np.stack([*words, np.zeros(len(n), np.uint64)])
            words = [stacked[np.where(n > i, n - 1 - i, LONGEST), rows] for i in range(LONGEST)]
        for name, found in zip(names, path_counts(words, grams["f"].to_numpy())):
            grams = grams.append_column(name, pa.array(found, pa.int64()))
        return grams

    return run


def with_part_counts(grams: DataFrame) -> DataFrame:
    """``grams`` with ``l2, l3, r2, r3``: counts of their first and last two and three words.

    A count that is no real part's (as many words as the n-gram has, or more) is of no use.
    """
    buckets = max(shuffle_partitions(grams.sparkSession), grams.count() // 200_000 + 1)
    last, before = (
        F.when(F.col("n") == 2, F.col(two)).when(F.col("n") == 3, F.col(three)).otherwise(F.col(four))
        for two, three, four in (("w2", "w3", "w4"), ("w1", "w2", "w3"))
    )
    fore = grams.groupBy(bucket_of(buckets, "w1", "w2").alias("bucket"))
    fore = fore.applyInArrow(lambda t: _path_rows(False)(t), f"{GRAMS}, l2 bigint, l3 bigint")
    back = fore.groupBy(bucket_of(buckets, last, before).alias("bucket"))
    return back.applyInArrow(
        lambda t: _path_rows(True)(t), f"{GRAMS}, l2 bigint, l3 bigint, r2 bigint, r3 bigint"
    )


def _lowest_cut() -> Column:
    """``score, k, l, r`` of the lowest-scoring cut; ties go to the smallest k."""
    left, right = [F.col(f"l{i}") for i in (1, 2, 3)], [F.col(f"r{i}") for i in (1, 2, 3)]
    product = F.col("f").cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)")

    def cut(n: int, k: int) -> Column:
        l, r = left[k - 1], right[n - k - 1]
        score = F.call_function("div", product, (l + r).cast("decimal(20,0)"))
        return F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    cuts = F.when(F.col("n") == 2, F.array(cut(2, 1)))
    cuts = cuts.when(F.col("n") == 3, F.array(cut(3, 1), cut(3, 2)))
    return F.array_min(cuts.otherwise(F.array(cut(4, 1), cut(4, 2), cut(4, 3))))


def held_by_longer(grams: DataFrame, share: int = 80) -> DataFrame:
    """``w1, w2, w3, w4`` of n-grams that a longer one has, at ``share`` % of their count or more."""
    none = F.lit(0).cast("bigint")
    w = [F.col(f"w{i}") for i in range(1, 5)]

    def inner(begin: int, length: int) -> Column:
        words = [*w[begin : begin + length], none, none][:3]
        return F.struct(*[x.alias(f"w{i + 1}") for i, x in enumerate(words)])

    triples = F.array(inner(0, 2), inner(1, 2))
    fours = F.array(inner(0, 2), inner(1, 2), inner(2, 2), inner(0, 3), inner(1, 3))
    parts = grams.filter("n > 2").select(
        F.explode(F.when(F.col("n") == 3, triples).otherwise(fours)).alias("part"), "f"
    )
    most = parts.groupBy("part").agg(F.max("f").alias("most")).select("part.*", "most")
    same = grams.filter("n < 4").select("w1", "w2", "w3", "f").join(most, ["w1", "w2", "w3"])
    return same.filter(F.col("most") * 100 >= F.col("f") * share).select("w1", "w2", "w3")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language.

    ``docs`` has ``text`` and ``lang``. Texts are lower-cased (A-Z) and split into pieces at
    ``[.,;:!?\\x0A-\\x0D]``, and these into words ``[^\\x20\\x09]+``. A phrase has 2 to 4 words and a
    count ``a`` of ``least`` or more within pieces of its language; ``n`` is the number of words of
    the language, ``l`` and ``r`` are the counts of its two parts at the cut that scores lowest,
    2000000 * a / (l + r). Phrases in a longer candidate with ``share`` % of their count are dropped. A
    null text is empty, a null language is ``und``; repeated rows count each time, an empty table
    gives no rows, other columns are ignored.
    """
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    words, seed = all_words(rows)
    sizes = stored(words.groupBy("lang").agg(F.sum("f").alias("n_words")), "sizes")
    total = sizes.agg(F.sum("n_words")).first()[0] or 0
    known = stored(words.filter(F.col("f") >= least), "known")
    grams = frequent_grams(rows, known.select("code"), seed, total, least)
    found = with_part_counts(grams)
    dropped = stored(held_by_longer(grams, share), "dropped")
    # A dropped phrase has three words at most, so w4 is 0.
    out = found.join(dropped.withColumn("w4", F.lit(0).cast("bigint")), ["w1", "w2", "w3", "w4"], "left_anti")
    last = F.when(F.col("n") == 2, F.col("w2")).when(F.col("n") == 3, F.col("w3")).otherwise(F.col("w4"))
    out = out.withColumn("last", last)
    for column, how in (("w1", "inner"), ("last", "inner"), ("w2", "left"), ("w3", "left")):
        names = {"code": column, "word": f"word_{column}"}
        if column == "w1":
            names |= {"f": "l1", "lang": "lang"}
        if column == "last":
            names |= {"f": "r1"}
        of = known.select(*[F.col(k).alias(v) for k, v in names.items()])
        out = out.join(of, column, how)
    inner = F.array("word_w1", F.when(F.col("n") > 2, F.col("word_w2")),
                    F.when(F.col("n") > 3, F.col("word_w3")), "word_last")
    out = out.withColumn("phrase", F.array_join(inner, " ")).withColumn("cut", _lowest_cut())
    out = out.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = ["score desc", "a desc", "phrase"]
    best = top_ranked(stored(out, "scored"), ["lang"], order, top)
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"
    )
