import pytest


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True, scope="session")
def checkpoint_dir(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        folder = f"file://{tmp_path_factory.mktemp('shared')}"
        spark.conf.set("spark.checkpoint.dir", folder)
