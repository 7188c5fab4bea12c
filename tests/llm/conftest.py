import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edge_documents():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    passage = prose("passage", 60)
    long = prose("long", 6000)
    base = prose("base", 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (5, prose(5, 80) + " " + passage, "en", "a"),
        (6, passage + " " + prose(6, 30), "en", "a"),
        (7, prose(7, 10) + "\n" + passage.replace(" ", "\t", 3), "de", "b"),
        (8, base, "en", "b"),
        (9, base, "en", "b"),
        (9, base, "en", "b"),
        (10, " ".join(near), "en", "c"),
        (11, None, "en", "c"),
        (12, "", None, "c"),
        (13, "   \n\t ", "en", None),
        (14, "one two", "en", None),
        (15, "one two", "fr", None),
        (16, long, "en", "a"),
        (17, long + " tail", "en", "a"),
        (18, "same " * 300, "en", "b"),
        (19, "same " * 200, "en", "b"),
        (None, passage, "en", "d"),
        (None, "no id here", None, None),
        (20, "Ünïcode ß ẞ İ é x́ 漢字 \U0001F600 <|endoftext|> don't it's 3.14 A.B", "xx", "e"),
        (21, "x" * 30000, "en", "e"),
        (22, base, "en", "a"),
        (22, prose("other", 70), "en", "a"),
    ]
    rows += [(100 + k, f"Shared Line \n{prose(k, 12)}\n  shared LINE\nrare {k % 4}\n\n", "en", "s") for k in range(12)]
    return rows


#: columns whose names an operator uses inside
CLASHING = ("size", "row_key", "batch", "task", "key", "id", "a", "b", "n", "bucket", "target", "kept", "_doc", "_key")


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_documents(), "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
