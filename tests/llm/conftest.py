import re

import pytest

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"

BASE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river "
        "and count the stars that rise above distant hills one by one until the morning light returns")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and a null id twice.
EDGES = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.upper(), "en", "b", 1),
    (4, BASE.replace("seven", "eight"), "en", None, None), (5, None, "en", "a", 0), (6, "", None, "a", 0), (7, " \t\n ", "en", "a", 4),
    (8, "word", "en", "b", 4), (9, "Ünïcode wörter über alle Ländergrenzen und zurück", "de", "b", 9), (None, "no id here at all", "en", None, 1),
    (None, None, None, None, None), (10, "lang " * 30_000, "de", "a", 150_000), (11, "x" * 200_000, "en", "b", 200_000),
    (12, "12345 !!! 678", "en", "a", 13), (13, "der die das und ist nicht mit von zu auf", "de", "a", 1),
    (14, "password=e3b3ed3cc8548923d6 4193369542294721 token = \"8c2c33f34dd8d92efc35b359ecc7eb9ef7c2ae0c\" mykeypassword=a1b2c3d4e5f6a7b8", "en", "t", 1),
]


@pytest.fixture(scope="session")
def session(spark):
    from cartloom.llm.registry import prepare

    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def edges(session):
    return session.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edges):
    """The same rows with columns of the names that operators add."""
    from pyspark.sql import functions as F

    names = ["lang_pred", "score", "size", "shard", "slot", "law", "rate", "copy", "n_copies", "order_key", "n_tokens", "perplexity", "n_words", "digest", "kept",
             "_id", "_key", "_digest", "_text", "_lang", "_n", "_copy", "_order", "_at", "_slot", "_shard", "first_position",
             "_source", "_rate", "_cdf", "_u"]
    return edges.withColumns({n: F.lit("taken") for n in names})


@pytest.fixture(scope="session")
def empty(session):
    return session.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(session):
    return session.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(session):
    return session.read.parquet(f"{FOLDER}/benchmark.parquet")
