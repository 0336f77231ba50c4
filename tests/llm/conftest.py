import random

import pytest

from vacantia.llm.common import tune_arrow

DOC_SCHEMA = "doc_id bigint, text string, lang string, score string, _row int, N_TOKENS string"


def prose(rng, count, words=None):
    words = words or [a + b for a in ("ka", "lo", "mi", "ter", "san", "vu", "re", "pol") for b in ("na", "ti", "ro", "mus", "el", "da", "go", "chi")]
    return " ".join(rng.choice(words) for _ in range(count))


@pytest.fixture(scope="session")
def session(spark):
    return tune_arrow(spark)


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, chains, nulls, empty, short and very long texts, and repeated rows."""
    rng = random.Random(7)
    out = []
    for i in range(40):
        out.append((i, prose(rng, rng.choice([3, 8, 40, 120]))))
    base = prose(rng, 150)
    for i in range(40, 60):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{i}"
        out.append((i, " ".join(w)))
    chain = prose(rng, 90).split()
    for i in range(60, 75):
        chain[5 * (i - 60)] = f"y{i}"
        out.append((i, " ".join(chain)))
    out += [(80, None), (81, ""), (82, " \t\n "), (83, "one"), (84, "One"), (85, "one two three four"), (86, "one\ttwo  three\x0bfour ")]
    out += [(87, prose(rng, 30_000)), (88, "a" * 200_000), (89, "Ünï çødé 日本語 😀 <|endoftext|> tail"), (None, base), (None, None)]
    out += [(90, base.upper()), (91, base.replace(" ", "\n")), (3, out[3][1]), (92, "12345 67 !!! ??")]
    return out


@pytest.fixture(scope="session")
def docs(session, rows):
    """The rows as a table with columns that clash with internal and output names."""
    return session.createDataFrame([(i, t, "en", "clash", 1, "x") for i, t in rows], DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(session):
    return session.createDataFrame([], DOC_SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
