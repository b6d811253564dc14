import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, size=300):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empties, white space alone, short and very long texts, copies, near copies and repeated rows."""
    r = random.Random(3)
    out = []
    base = [words(r, 60) for _ in range(12)]
    for i, t in enumerate(base):
        out.append((i, t, "en", f"s{i % 3}", len(t)))
        out.append((100 + i, t.replace(" ", "\n\t", 3), "en", f"s{i % 2}", len(t)))  # equal but for white space
        w = t.split()
        w[i] = "CHANGED"
        out.append((200 + i, " ".join(w), "en", None, len(t)))
        out.append((300 + i, " ".join(w[:40]) + " " + words(r, 20), "de", "s0", len(t)))
    out += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \n ", "en", "s1", 3), (403, "one", "en", "é", 3), (404, "one two three", "en", "é", 13), (404, "one two three", "en", "é", 13)]
    out += [(405, words(r, 9000, 4000), "en", "s2", 1), (None, "no id here at all", "en", "s2", 1), (406, "Ärger ÉCOLE <|endoftext|> don't I'LL x\x85y   ́a 12.5!!", "fr", "s2", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def crowded(docs):
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("row", "digest", "hash", "n", "size", "rows", "comp", "list", "shard", "slot", "vslot", "score", "word", "ids", "part", "dim", "block", "first")})
