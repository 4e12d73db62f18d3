import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; a caller's columns may have them too.
CLASHES = ["hash", "pos", "rep", "root", "s0", "kept", "band", "octave", "cluster", "n_tokens", "shard", "cell", "bin_id", "score", "start_word", "at", "kind", "home", "good", "run", "v", "a", "b", "docs"]


def sentence(rng: random.Random, n: int, words: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with all that may go wrong, and columns of clashing names."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    long_ = sentence(rng, 20000)
    same = sentence(rng, 120)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", None, None, None),
        (4, "!!! ??? ...", "en", "a", 11),
        (5, "one", None, "b", 3),
        (6, same, "en", "a", len(same)),
        (7, same, "en", "b", len(same)),
        (8, same, None, None, None),
        (8, same, None, None, None),
        (9, long_, "en", "a", len(long_)),
        (None, same, "en", "a", 5),
        (None, None, None, None, None),
        (10, "É" * 5000, "fr", "c", 5000),
        (11, "x" * 100_000, "zz", "c", 100_000),
        (12, sentence(rng, 120) + " \U0001f600   　 中文字符", "zh", "d", None),
        (13, sentence(rng, 100), "en", "a", 600),
        (13, sentence(rng, 90), "en", "a", 500),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"clash{i}"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
