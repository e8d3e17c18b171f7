import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewloom import functions as fn
from reviewloom.functions.text import WHITESPACE_CODE_POINTS, has_words

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def py_id(text, asin):
    words = " ".join(re.split(r"\s+", (text or "").strip()))
    return hashlib.sha1(f"{words.lower()}\x01{(asin or '').strip().lower()}".encode()).hexdigest()


def test_whitespace_set_is_pythons():
    assert [ord(c) for c in SPACES] == WHITESPACE_CODE_POINTS


def _texts():
    texts = [None, "", " ", "plain", "İstanbul ΟΔΟΣ ß", "ΑΣ ΣΑΣ", "Same  Text", "sAME text", "a᠎b",
             "a​b", "x\x00y", "tail \t\n"]
    for space in SPACES:
        texts += [f"a{space}b", f"{space}a b{space}", f"a{space}{space} b", space * 3]
    return texts


def test_id_words_and_strip_match_python(spark):
    rows = [(i, t, a) for i, t in enumerate(_texts()) for a in (None, "B01", " b01　")]
    df = spark.createDataFrame(rows, "n INT, text STRING, asin STRING")
    out = df.select(
        "text", "asin",
        fn.stable_id().alias("id"),
        fn.word_count("text").alias("words"),
        fn.strip_ws("text").alias("stripped"),
        fn.collapse_ws("text").alias("flat"),
    ).collect()
    assert len(out) == len(rows)
    for row in out:
        assert row.id == py_id(row.text, row.asin), repr(row.text)
        assert row.words == len((row.text or "").split())
        if row.text is not None:
            assert row.stripped == row.text.strip()
            assert row.flat == " ".join(row.text.split())


def test_has_words_agrees_with_word_count(spark):
    texts = _texts() + ["w " * n for n in range(25)] + [" " + " w" * n for n in range(25)]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    checks = [has_words("text", n).alias(f"n{n}") for n in (1, 2, 3, 16, 17, 20)]
    for row in df.select(fn.word_count("text").alias("words"), *checks).collect():
        for n in (1, 2, 3, 16, 17, 20):
            assert row[f"n{n}"] == (row.words >= n)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aBé") + SPACES), max_size=12), min_size=1,
                max_size=40))
def test_random_texts(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    for row in df.select("text", fn.stable_id("text", F.lit("A")).alias("id")).collect():
        assert row.id == py_id(row.text, "A")


def test_sql_functions_equal_columns(spark):
    fn.register_functions(spark)
    df = spark.createDataFrame([(t,) for t in _texts()], "text STRING")
    df.createOrReplaceTempView("some_texts")
    sql = spark.sql(
        "SELECT text, stable_id(text, 'A') AS id, word_count(text) AS words,"
        " strip_ws(text) AS stripped FROM some_texts"
    )
    for row in sql.collect():
        assert row.id == py_id(row.text, "A")
        assert row.words == len((row.text or "").split())
        assert row.stripped == (None if row.text is None else row.text.strip())


def test_display_text(spark):
    rows = [(" T ", " body ", "T  body"), (None, "body", "body"), ("T", None, "T"),
            ("", "x" * 30, "x" * 20 + " ..."), ("", "x" * 20, "x" * 20)]
    df = spark.createDataFrame(rows, "title STRING, text STRING, want STRING")
    for row in df.withColumn("got", fn.display_text(max_len=20)).collect():
        assert row.got == row.want


def test_text_functions_stay_native(spark, plan_of):
    df = spark.createDataFrame([("a", "b")], "text STRING, asin STRING")
    plan = plan_of(df.select(fn.stable_id(), fn.word_count("text"), fn.display_text("asin")))
    assert "Python" not in plan
