import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, node long, hash long, bucket long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with gaps, empty and very long texts, repeats, and columns named like those of operators."""
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"
    long_text = " ".join(f"word{i % 977} and" for i in range(30_000))
    texts = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "b"),
             (5, "  \n\n ", "en", "b"), (6, long_text, "en", "c"), (7, long_text + " more", "en", "c"), (None, base, "en", "a"),
             (None, None, None, None), (8, "Ünïcödé ▁ text\twith\x1fodd   spaces\r\n<s> <|endoftext|> 日本語 🙂", "xx", "é"),
             (9, "short one", "en", "a"), (10, base.upper() + "!", "en", None), (11, "12 34 !!", "en", "a"), (12, "a\nb\na\nb\n" + base + "\nc", "en", "b")]
    return spark.createDataFrame([(i, t, l, s, None, 1, 2, 3, 4, 5) for i, t, l, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
