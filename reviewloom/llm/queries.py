"""One query per operator over the given tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path
from . import (
    ann_tree,
    collocations,
    conversations,
    exact_topk,
    html_extract,
    interleave,
    langid,
    minhash,
    mixing,
    packing,
    rans,
    substring,
    warc,
)
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    rans.write_archive(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return rans.read_archive(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op2_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op3_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").filter(exact_topk.usable(F.col("embedding")))
    whole = vectors.select(
        "vec_id",
        F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double"))).alias("vector"),
    )
    return exact_topk.exact_top_k(whole, F.col("vec_id") % 50 == 0, 5)


ORACLES["op7_exact_top_k"] = """
    WITH whole AS (
        SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
        FROM embeddings
        WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), scores AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0
    ), ranks AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                       AS INTEGER) AS rank
        FROM scores
    )
    SELECT query_id, rank, vec_id, score FROM ranks WHERE rank <= 5"""


@query
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op8_warc_revisits"] = """
    WITH records AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), firsts AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM records
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
               AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM firsts"""


@query
def op9_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann_tree.nearest_neighbours(vectors, F.col("vec_id") % 100 == 0, 10)


@query
def op10_boosted_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages.select("html")))


@query
def op12_integer_weight_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_report(rows, stored(conversations.audits(rows), "audits"))


#: Shards and seed of ``op13_interleaved_shards``.
SHARDS, SHARD_SEED = 16, 13


@query
def op13_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    dealt = interleave.deal(rows, SHARDS, SHARD_SEED, ["doc_id", "text_crc32", "size"])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# DuckDB has no crc32: one table entry for each byte value, and a fold over the bytes of a text.
_CRC_TABLE = """crc_table AS MATERIALIZED (
        SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1
                    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc
        FROM (SELECT unnest(range(256)) AS b))"""


def _sql_crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``; needs ``crc_table`` in scope."""
    at = f"instr('0123456789ABCDEF', substr(hex(encode({text})), %s, 1)) - 1"
    octets = f"[16 * ({at % '2 * i - 1'}) + {at % '2 * i'} FOR i IN range(1, strlen({text}) + 1)]"
    return (
        f"xor(list_reduce({octets}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8),"
        " 4294967295), 4294967295)"
    )


ORACLES["op13_interleaved_shards"] = f"""
    WITH {_CRC_TABLE}, sized AS (
        SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
               CAST({_sql_crc("coalesce(text, '')")} AS BIGINT) AS text_crc32
        FROM documents, crc_table
    ), hashed AS (
        SELECT *, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''),
                                CAST(text_crc32 AS VARCHAR), CAST(size AS VARCHAR), '{SHARD_SEED}')) AS h
        FROM sized
    ), placed AS (
        SELECT *, CAST(2 * row_number() OVER (PARTITION BY source
                           ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS DOUBLE)
                  / (2 * count(*) OVER (PARTITION BY source)) AS fraction
        FROM hashed
    ), numbered AS (
        SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, h,
                                     doc_id NULLS FIRST, text_crc32, size) - 1 AS place,
               count(*) OVER () AS n
        FROM placed
    ), cut AS (SELECT *, place * {SHARDS} // n AS s FROM numbered)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(s AS INTEGER) AS shard,
           CAST(place - (s * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
           CAST(NULL AS INTEGER) AS grown_shard
    FROM cut"""


def _sql_edge(node: str, letter: str, cost: str, line: str | None) -> str:
    """A path one edit longer: key (nine digits of cost, then the audit) and repaired lines."""
    key = (f"lpad(CAST(CAST(substr({node}.k, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0')"
           f" || substr({node}.k, 10) || '{letter}'")
    lines = f"{node}.t" if line is None else f"list_append({node}.t, {line})"
    return f"CASE WHEN {node} IS NOT NULL THEN {{'k': {key}, 't': {lines}}} END"


def _sql_paths() -> str:
    """Cheapest paths to the four states of the pattern, row by row of each conversation."""
    u, a = "'user:'", "'assistant:'"
    into_u = ", ".join(_sql_edge(x, "I", "5", u) for x in "nsa")
    keep = {x: f"CASE WHEN r.i = '{x}' THEN 0 END" for x in "sua"}

    def after(state: str, sources: str, role: str | None) -> str:
        found = [_sql_edge(state, "D", "2", None)]
        for x in sources:
            kept = _sql_edge(x, "K", "r.more", "r.role || ':' || r.text")
            found.append(f"CASE WHEN r.usable AND {keep[state]} = 0 THEN {kept} END")
            if role:
                made = _sql_edge(x, "R", "r.more + 1", f"'{role}:' || r.text")
                found.append(f"CASE WHEN r.usable THEN {made} END")
        return f"list_min([{', '.join(found)}])"

    inserted = (f"SELECT * REPLACE (list_min([a, {_sql_edge('u', 'I', '5', a)}]) AS a) FROM"
                f" (SELECT * REPLACE (list_min([u, {into_u}]) AS u) FROM %s)")
    return f"""paths AS (
        SELECT conv_id, rows, 0 AS i, {{'k': '000000000', 't': CAST([] AS VARCHAR[])}} AS n,
               CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])) AS s,
               CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])) AS u,
               CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])) AS a
        FROM conversation
        UNION ALL
        SELECT conv_id, rows, i + 1, {_sql_edge('n', 'D', '2', None)},
               {after('s', 'n', None)}, {after('u', 'nsa', 'user')}, {after('a', 'u', 'assistant')}
        FROM (SELECT *, rows[i + 1] AS r FROM ({inserted % 'paths'}))
        WHERE i < len(rows)
    ), best AS (
        SELECT conv_id, list_min([n, a]) AS b FROM ({inserted % 'paths'}) WHERE i = len(rows)
    )"""


ORACLES["op12_integer_weight_repair"] = f"""
    WITH RECURSIVE {_CRC_TABLE}, hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':',
                      coalesce(CAST(turn AS VARCHAR), ' ')) AS key
        FROM conversations
    ), kinds AS (
        SELECT *, {_sql_crc("key")} % 20 AS kind FROM hashed, crc_table
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                         ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM kinds WHERE kind <> 0
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                                     sha256(text), copy) AS nth,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
        FROM damaged
    ), faulty AS (
        SELECT *, CASE WHEN shown = '' THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1
                       THEN 'duplicate'
                       WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated'
                       ELSE 'none' END AS fault,
               left(lag(role) OVER (PARTITION BY conv_id ORDER BY nth), 1) || left(role, 1) AS pair
        FROM numbered
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
               list({{'i': left(role, 1), 'role': role, 'text': text,
                      'usable': fault NOT IN ('blank', 'duplicate'),
                      'more': CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END}} ORDER BY nth) AS rows
        FROM faulty GROUP BY conv_id
    ), conversation AS (
        SELECT conv_id, rows FROM counted
    ), {_sql_paths()}
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps,
           coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(CAST(substr(b.k, 1, 9) AS INT), 0) AS BIGINT) AS cost,
           coalesce(substr(b.k, 10), '') AS audit,
           sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN counted t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best p ON p.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query
def op11_automaton_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


# Parts and inner phrases of a candidate are as frequent as it is, so rarer phrases are not needed.
ORACLES["op11_automaton_collocations"] = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), words AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), sizes AS (
        SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
    ), places AS (
        SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
    ), occurrences AS (
        SELECT lang, k, CASE WHEN i + k - 1 <= len(w) THEN array_to_string(w[i : i + k - 1], ' ') END AS phrase
        FROM places, (SELECT unnest([1, 2, 3, 4]) AS k)
    ), grams AS (
        SELECT lang, k, phrase, count(*) AS f FROM occurrences WHERE phrase IS NOT NULL
        GROUP BY ALL HAVING count(*) >= 30
    ), candidates AS (
        SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1
    ), cuts AS (
        SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS p1, array_to_string(w[c + 1 : k], ' ') AS p2
        FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
    ), scores AS (
        SELECT s.lang, s.phrase, s.a, x.f AS l, y.f AS r,
               CAST(2000000 * CAST(s.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
        FROM cuts s
        JOIN grams x ON x.lang = s.lang AND x.phrase = s.p1
        JOIN grams y ON y.lang = s.lang AND y.phrase = s.p2
        QUALIFY row_number() OVER (PARTITION BY s.lang, s.phrase ORDER BY score, c) = 1
    ), inner_phrases AS (
        SELECT DISTINCT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i
              FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
    ), kept AS (
        SELECT * FROM scores s WHERE NOT EXISTS (
            SELECT 1 FROM inner_phrases i
            WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 80 * s.a)
    ), ranks AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
        FROM kept
    )
    SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score
    FROM ranks r JOIN sizes s ON s.lang = r.lang WHERE r.rank <= 2000""".replace("\\\\x", "\\x")
