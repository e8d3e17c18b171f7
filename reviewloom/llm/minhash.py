"""Near-duplicates: universal hash minima, banding, verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_partitions, slices, stored
from .components import connected_components
from .word_hashes import mixed, word_hashes

#: 40 bands of 5 minima: two sets with similarity 0.8 meet in no band once in 8 million times.
BANDS, ROWS = 40, 5
#: Agreement of two signatures from which a pair is compared. For a similarity of 0.8 the
#: agreement of 200 minima is below this once in 50,000 times.
AGREEMENT = 0.68
#: Nodes, and bytes of their texts (and one text more), in a part of a family; one task compares
#: two parts at most.
TILE_ROWS = 2048
TILE_BYTES = 1 << 25
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _coefficients(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64) | np.uint64(1)


_A = _coefficients(BANDS * ROWS, 1)[:, None]
_B = _coefficients(BANDS * ROWS, 2)[:, None]
_ROW = _coefficients(ROWS, 3)
_BAND = _coefficients(BANDS, 4)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes, so other letters stay and ASCII space splits."""
    return (text or "").encode().lower().split()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a short text is one shingle, an empty one none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * _MIX + hashes[i : n - size + 1 + i])
    return np.unique(total)


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def signature(found: np.ndarray) -> np.ndarray:
    """The 200 minima (32 bits each) of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for begin in range(0, len(found), 256):
        part = found[begin : begin + 256]
        np.minimum(least, (_A * part + _B).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.astype(np.uint64).reshape(BANDS, ROWS)
    return mixed(mixed(rows * _ROW).sum(axis=1, dtype=np.uint64) * _MIX + _BAND).view(np.int64)


def _featurize(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, counts, keys = [], [], []
            for text in batch["text"]:
                found = shingle_hashes(word_hashes(text.as_py(), lower=True), size)
                counts.append(len(found))
                if len(found):
                    digest = xxhash.xxh3_64_intdigest(found.tobytes())
                    nodes.append(digest - 2**63)
                    keys.append(band_keys(signature(found)))
                else:
                    nodes.append(None)
                    keys.append(None)
            yield pa.record_batch(
                {
                    "uid": batch["uid"],
                    "doc_id": batch["doc_id"],
                    "n_shingles": pa.array(counts, pa.int64()),
                    "node": pa.array(nodes, pa.int64()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                }
            )

    return run


#: Shingles of the sets that verification keeps at hand, beside the two it compares.
MEMO_SHINGLES = 1 << 17


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, set] = {}
        held = 0

        def of(node, text):
            nonlocal held
            if node not in memo:
                if held > MEMO_SHINGLES:
                    memo.clear()
                    held = 0
                memo[node] = shingles(words_of(text), size)
                held += len(memo[node])
            return memo[node]

        for batch in slices(batches):
            rows = zip(*(batch[c] for c in ("u", "v", "u_text", "v_text")))
            keep = []
            for u, v, u_text, v_text in rows:
                one, other = of(u.as_py(), u_text.as_py()), of(v.as_py(), v_text.as_py())
                both = len(one & other)
                keep.append(100 * both >= percent * (len(one) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch({"u": batch["u"].filter(keep), "v": batch["v"].filter(keep)})

    return run


def _cross_links(size: int, percent: int):
    """Links between the components of a tile; members of one component are not compared.

    Signatures tell which pairs may be similar enough; all of these are compared on full sets
    (as sorted 64-bit hashes), one node with all its partners at a time, until a link joins the
    two components.
    """

    def run(tile: pa.Table) -> pa.Table:
        nodes, labels = tile["node"].to_numpy(), tile["label"].to_numpy()
        main = tile["main"].to_numpy(zero_copy_only=False)
        sets, signs = [], np.zeros((len(nodes), BANDS * ROWS), np.uint8)
        for i, text in enumerate(tile["text"]):
            sets.append(shingle_hashes(word_hashes(text.as_py(), lower=True), size))
            signs[i] = signature(sets[-1])
        sizes = np.array([len(x) for x in sets])
        parent = {label: label for label in labels.tolist()}

        def root(label):
            while parent[label] != label:
                label = parent[label]
            return label

        links = []
        asks = np.flatnonzero(~main)
        others = np.flatnonzero(main) if main.any() else asks
        for i in asks.tolist():
            near = others[(signs[others] == signs[i]).mean(axis=1) >= AGREEMENT]
            mine = root(labels[i])
            near = near[[root(label) != mine for label in labels[near].tolist()]] if len(near) else near
            if not len(near):
                continue
            members = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(sets[i], members), sizes[i] - 1)
            hits = np.r_[0, np.cumsum(sets[i][at] == members)]
            ends = np.cumsum(sizes[near])
            both = hits[ends] - hits[ends - sizes[near]]
            alike = near[100 * both >= percent * (sizes[near] + sizes[i] - both)]
            for j in alike.tolist():
                one, other = root(labels[i]), root(labels[j])
                if one != other:
                    parent[one] = other
                    links.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(found[:, 0]), "v": pa.array(found[:, 1])})

    return run


class _Linker:
    """Candidate pairs of one table of documents, compared in full and grouped."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")
        features = rows.mapInArrow(
            _featurize(size),
            "uid bigint, doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>",
        )
        self.features = stored(features, "features")
        members = self.features.filter("node is not null").select(
            F.explode("keys").alias("key"), "node"
        )
        # Buckets of more than one set; copies of a set are one node and need no bucket.
        buckets = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
        buckets = stored(buckets.filter("lo < hi").select("key", "lo"), "buckets")
        self.members = stored(members.join(buckets, "key").distinct(), "members")
        candidates = self.members.select("node").distinct()
        first = self.features.groupBy("node").agg(F.min("uid").alias("uid"))
        wanted = candidates.join(first, "node")
        texts = rows.select("uid", "text").join(wanted, "uid").dropDuplicates(["node"])
        size_of = F.octet_length("text").cast("bigint").alias("bytes")
        self.texts = stored(texts.select("node", "text", size_of), "texts")
        self.labels: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        """Renew the components with more links ``u, v``."""
        if self.labels is not None:  # what is connected already, as stars
            links = links.union(self.labels.select("node", "component"))
        self.labels = stored(connected_components(links), "components")

    def compare(self, pairs: DataFrame) -> None:
        """Compare pairs ``u, v`` on full sets and add those that are links."""
        text = F.col("text")
        both = pairs.join(
            self.texts.select(F.col("node").alias("u"), text.alias("u_text")), "u"
        ).join(self.texts.select(F.col("node").alias("v"), text.alias("v_text")), "v")
        self.add(both.mapInArrow(_verify(self.size, self.percent), "u bigint, v bigint"))

    def labelled(self, nodes: DataFrame, name: str = "node", label: str = "label") -> DataFrame:
        """Add the component so far; a node without links is its own."""
        if self.labels is None:
            return nodes.withColumn(label, F.col(name))
        found = self.labels.select(F.col("node").alias(name), F.col("component").alias("_c"))
        return (
            nodes.join(found, name, "left")
            .withColumn(label, F.coalesce("_c", name))
            .drop("_c")
        )

    def across(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose ends are still in different components."""
        both = self.labelled(self.labelled(pairs, "u", "lu"), "v", "lv")
        return both.filter("lu <> lv").select("u", "v")

    def stars(self) -> DataFrame:
        """Each node with the smallest node of each of its buckets."""
        return (
            self.members.filter("node <> lo")
            .select(F.col("node").alias("u"), F.col("lo").alias("v"))
            .distinct()
        )

    def tiles(self) -> DataFrame:
        """Families of nodes in which components may still have to be joined, as tiles.

        A family is what shared buckets connect, as far as these hold several components and
        more than two nodes (stars have compared the one pair of others); each node is in one
        family. The members of a family's largest component are dealt over parts of bounded
        size, and all others over parts of their own. Each part of the largest meets each part
        of the others in a tile, and so do any two parts of the others.
        """
        rows = self.labelled(self.members)
        mixed_up = rows.groupBy("key").agg(
            F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")
        )
        rows = rows.join(mixed_up.filter("a < b and n > 2").select("key"), "key")
        rows = stored(rows.select("node", "lo", "label").distinct(), "unresolved")
        family = connected_components(rows.select(F.col("node").alias("u"), F.col("lo").alias("v")))
        rows = rows.select("node", "label").distinct().join(family, "node")
        rows = stored(rows.withColumnRenamed("component", "family"), "families")
        counts = rows.groupBy("family", "label").agg(F.count("*").alias("n"))
        largest = counts.groupBy("family").agg(F.max(F.struct("n", "label")).alias("most"))
        rows = rows.join(largest.select("family", F.col("most.label").alias("largest")), "family")
        rows = rows.withColumn("main", F.col("label") == F.col("largest")).drop("largest")
        rows = self.parts(rows)
        most = [F.max(F.when(F.col("main") == main, F.col("part"))) + 1 for main in (True, False)]
        counts = rows.groupBy("family").agg(most[0].alias("own"), most[1].alias("other"))
        rows = rows.join(counts, "family")
        own, other, part = F.col("own"), F.col("other"), F.col("part")
        each = F.sequence(F.lit(0).cast("bigint"), other - 1)
        of_main = F.transform(each, lambda j: part * other + j)
        to_main = F.transform(
            F.sequence(F.lit(0).cast("bigint"), own - 1), lambda i: i * other + part
        )
        to_others = F.transform(
            each, lambda j: -1 - F.least(part, j) * other - F.greatest(part, j)
        )
        tile = F.when(F.col("main"), of_main).otherwise(F.concat(to_main, to_others))
        dealt = rows.select("family", F.explode(tile).alias("tile"), "node", "label", "main")
        return dealt.join(self.texts.select("node", "text"), "node")

    def parts(self, rows: DataFrame) -> DataFrame:
        """Add ``part`` (from 0): the members of ``family, main`` in turn, as far as a part holds.

        A running sum of bytes is cut in even steps; a short text weighs as much as lets
        TILE_ROWS of them fill a step. Each bucket of nodes is added up by itself, so that a
        family may have any share of the rows.
        """
        weight = F.greatest(F.lit(-(-TILE_BYTES // TILE_ROWS)), F.least(F.lit(TILE_BYTES), "bytes"))
        rows = rows.join(self.texts.select("node", "bytes"), "node")
        bucket = bucket_of(shuffle_partitions(rows.sparkSession), "node")
        rows = rows.withColumns({"weight": weight.cast("bigint"), "bucket": bucket})
        own = ["family", "main", "bucket"]
        before = lambda w: F.coalesce(
            F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        base = rows.groupBy(*own).agg(F.sum("weight").alias("weight"))
        base = base.select(*own, before(Window.partitionBy("family", "main").orderBy("bucket")).alias("base"))
        rows = rows.withColumn("at", before(Window.partitionBy(*own).orderBy("node")))
        part = F.floor((F.col("base") + F.col("at")) / F.lit(TILE_BYTES)).cast("bigint")
        rows = rows.join(base, own).withColumn("part", part)
        return stored(rows.select("family", "node", "label", "main", "part"), "parts")

    def link(self) -> None:
        stars = stored(self.stars(), "stars")
        # First one pair for each node; what these leave apart then, which is much less.
        self.compare(stars.groupBy("u").agg(F.min("v").alias("v")))
        self.compare(self.across(stars))
        links = _cross_links(self.size, self.percent)
        found = self.tiles().groupBy("family", "tile").applyInArrow(
            lambda tile: links(tile), "u bigint, v bigint"
        )
        self.add(found)


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``uid, doc_id, n_shingles, label`` for each row of ``doc_id, text``.

    ``label`` is the component's own key, whatever ids its rows have; null without words. See
    ``near_duplicates`` for what is linked.
    """
    linker = _Linker(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), size, percent)
    linker.link()
    return linker.labelled(linker.features.drop("keys"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``uid, doc_id, n_shingles, component_id, kept`` for each row of ``doc_id, text``.

    Two documents are linked if the sets of their word shingles have a Jaccard similarity of
    ``percent`` hundredths or more. Words are split at ASCII white space and A-Z are lower-cased;
    fewer words than ``size`` are one shingle; a null or empty text has none, is linked with
    nothing and is its own component. ``component_id`` is the smallest doc_id that links lead
    to and ``kept`` says that it is the row's own. Rows that share a doc_id are documents of
    their own; a null doc_id is larger than all others. ``uid`` is a hash of doc_id and text.

    Equal sets are one node, found by a digest; buckets link nodes. Every link is confirmed on
    the full sets. Stars around the smallest node of each bucket come first; where buckets still
    hold several components, all pairs between these that agree in enough minima are compared
    in place, so no group is written out as pairs, and none is cut short.
    """
    rows = grouped(docs, size, percent)
    groups = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("_least"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return (
        rows.join(groups, "label", "left")
        .select("uid", "doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
