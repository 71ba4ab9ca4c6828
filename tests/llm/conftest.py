import random

import pytest

# Columns that operators use inside, as further columns of the input.
CLASHING = "row long, size long, whole string, h string, site string, fp long, key string, _row long, base long, cell long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def document(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), 7, 7, "w", "h", "s", 7, "k", 7, 7, 7)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """Documents with every odd case: NULLs, blanks, a very long text, copies, near copies, repeated rows and ids."""
    rng = random.Random(5)
    rows = [document(i, prose(rng, rng.randrange(1, 200)), rng.choice(["a", "b", "c", "é"])) for i in range(60)]
    long_text = prose(rng, 400)
    words = long_text.split()
    rows += [document(100 + i, long_text, "ab"[i % 2]) for i in range(12)]  # copies
    for i in range(25):  # near copies
        changed = list(words)
        changed[i * 3] = "changed"
        rows.append(document(200 + i, " ".join(changed), "c"))
    rows += [
        document(300, None),
        document(301, ""),
        document(302, " \t\n\x0b\x0c\r "),
        document(303, "x" * 70_000),
        document(304, " " * 70_000),
        document(305, "one"),
        document(306, "Two Words", None),
        document(None, "no id at all", "b"),
        document(307, None, None),
        document(308, "Σίσυφος ΟΔΟΣ é naïve İstanbul 東京タワー <|endoftext|> it's I'LL 42 　x\x1cy\u0085z"),
        document(309, "line one\nline two\nline one\n\n line one \nend"),
        document(310, prose(rng, 20_000), "d"),
    ]
    rows += [rows[3], rows[3], document(3, "same id, other text", "b")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
