import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of trouble, and columns that clash with names the operators use inside."""
    import numpy as np

    rng = np.random.default_rng(5)
    long = prose(rng, 30_000)
    texts = [None, "", " ", "\n\n", "a", "the same text", "the same text", "ünï cödé 中文 🙂 ▁", "x" * 5000, "tab\tand\r\nline\x00nul", long, long[:-5] + "other", "don't 'quote' it's", "0 1 22 333", prose(rng, 400), "0" * 5000 + ".1.1.1 and 1.2.3." + "0" * 4400, "go <|endoftext|> on <|startoftext|>"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "src", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", None, None, 5), (None, None, None, None, None), (2**62, "big id", "de", "s", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["id", "digest", "keep_id", "n", "fp", "h", "ph", "start", "strings", "score", "ids", "part", "label", "piece", "length", "key", "component", "offset", "low", "__group"]
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
