import gzip
import hashlib
from collections import defaultdict

import pytest

from reviewloom.llm import warc

PAGES = "page_id BIGINT, url STRING, html STRING, record_type STRING"
LONG = "<p>" + "text " * 60 + "</p>"
ROWS = [(5, "http://a/", LONG, "z"), (3, "http://b/", LONG, "z"), (8, None, LONG, None), (3, "http://c/", LONG, "z"),
        (1, "http://d/", "short", "z"), (2, "http://e/", "short", "z"), (4, "http://f\r\nX: y/", None, "z"), (6, "u", "", "z"),
        (None, "http://g/", LONG, "z"), (None, "h", "only null " * 20, "z"), (None, "i", "only null " * 20, "z"),
        (9, "http://j/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "z"),
        (10, "http://k/", "é\U0001f600\x00" * 50, "z"), (2**60 + 1, "l", "x" * 3_000_000, "z")]


def expected(rows):
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for payload, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            revisit = len(payload) >= 100 and first is not None and i != first
            out.append((i, len(payload), hashlib.sha256(payload).hexdigest(),
                        "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(ROWS, PAGES).repartition(4), path)
    read = warc.read_archives(spark, path)
    assert found(read) == expected(ROWS)
    bodies = sorted((r.payload for r in read.collect() if r.record_type == "response"))
    wanted = [(r[0], r[2] or "") for r in ROWS]
    types = {(e[0], e[2]): e[3] for e in expected(ROWS)}
    assert bodies == sorted(t for i, t in wanted if types[i, hashlib.sha256(t.encode()).hexdigest()] == "response")


def test_many_copies_and_empty(spark, tmp_path):
    rows = [(i, "u", LONG if i % 3 else f"{i} {LONG}", "z") for i in range(2000)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    assert found(warc.read_archives(spark, str(tmp_path / "w"))) == expected(rows)
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert found(warc.read_archives(spark, str(tmp_path / "e"))) == []


def test_damage_is_found():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def test_payloads_move_once(spark, plan_of, tmp_path):
    """Of the exchanges only the one that deals records by key has payloads."""
    rows = [(i % 700, "u", LONG if i % 3 else f"{i} {LONG}", "z") for i in range(2000)]
    rows += [(None, "u", LONG, "z")] * 700
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    headers = pages.select("page_id", "html").selectExpr(
        "page_id", "sha2(cast(html as binary), 256) payload_digest", "cast(octet_length(html) as bigint) payload_bytes")
    assert "html" not in plan_of(warc.revisits(headers)).split("Exchange", 1)[0]
    found = warc.revisits(headers)
    assert found.count() == found.select("record_key").distinct().count() < 800
    warc.write_archives(pages, str(tmp_path / "w"))
    assert found_rows(spark, tmp_path) == expected(rows)
    dates = {h["warc-date"] for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse(gzip.decompress(f.read_bytes()))}
    assert len(dates) == 1 and dates.pop() > "2024-01-01T00:00:00Z"


def found_rows(spark, tmp_path):
    return found(warc.read_archives(spark, str(tmp_path / "w")))
