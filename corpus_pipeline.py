"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet
in the cluster's shared folder and the next stage reads that table. All but the last return the
columns of documents, extra ones too. An empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import langid, minhash, mixing, packing, substring
from reviewloom.llm.common import stored
from reviewloom.llm.queries import tokenizer_path

WINDOW = 4096


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns as c0, c1, ..., so that a stage's own columns clash with none; and which is which."""
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at


def _named(rows: DataFrame, at: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(number).alias(name) for name, number in at.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those whose text is null or has no letter.

    For the others ``lang`` becomes the predicted language, if any language could be learned;
    the model drops nothing.
    """
    columns = docs.columns
    model = langid.fit(docs.filter(~langid.held_out()).select("text", "lang"))
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    text, lang = (f"c{columns.index(c)}" for c in ("text", "lang"))
    found = langid.predict(plain.withColumn("text", F.col(text)).drop(text), model)
    found = found.filter("has_letters").withColumn(text, F.col("text"))
    if model is not None:
        found = found.withColumn(lang, F.col("lang_pred"))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Five-word shingles, similarity 0.8 or more. Texts without words are in no group and stay.
    Of rows that share the smallest doc_id of a group one stays. A null doc_id is larger than all
    others; documents that share an id, or have none, and are not near-duplicates all stay.
    """
    found = minhash.grouped(docs)
    alone = F.col("label").isNull()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    least = found.filter(~alone).groupBy("label").agg(first).select("first.uid")
    stay = stored(least.union(found.filter(alone).select("uid")).distinct(), "stay")
    plain, at = _numbered(docs)
    text = at["text"]
    plain = plain.withColumn("uid", F.xxhash64(F.col(at["doc_id"]).cast("bigint"), text))
    plain = plain.join(stay, "uid", "left_semi")
    words = F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = plain.filter(words).dropDuplicates(["uid"]).union(plain.filter(~words))
    return _named(kept, at)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that occur elsewhere too are cut out.

    A text without such passages stays as it is; in others the kept words are joined by one
    space. ``n_chars`` follows the text. A document may end up empty, and stays.
    """
    return substring.cut_documents(docs, window=35)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to weights 5, 2, 1: documents are dropped or repeated to fit.

    A document that the mix takes twice or three times gives as many rows.
    """
    plain, at = _numbered(docs)
    words = mixing.word_count(F.col(at["text"])).alias("size")
    # Maps have no hash of their own.
    parts = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in plain.dtypes]
    sized = plain.withColumn("uid", F.xxhash64(*parts))
    sizes = sized.select(F.col("uid").alias("doc_id"), F.col(at["source"]).alias("source"), words)
    taken = mixing.mix(sizes).filter("copies > 0").select(F.col("doc_id").alias("uid"), "copies")
    # Equal rows share a hash; each takes its own share of their copies.
    taken = taken.groupBy("uid").agg(F.sum("copies").alias("copies"))
    both = sized.dropDuplicates(["uid"]).join(taken, "uid")
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("again")
    return _named(both.select(*at.values(), again), at)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 token ids, as pieces of documents with their places."""
    return packing.pack(docs, tokenizer_path(), end_id=2, window=WINDOW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: Tokenizers, kernels and near-duplicates by signatures are beyond SQL; tests compare each
#: stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
