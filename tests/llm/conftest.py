import random

import pytest

#: Names that the operators use inside; a table may hold them too.
CLASHING = ["id", "k1", "k2", "hash", "digest", "fp", "row", "key1", "key2", "words", "html", "good", "c0", "rank", "shard_key"]


def table(spark, rows, kind="doc_id bigint, text string"):
    """Rows with further columns whose names clash with the operators' own, some of them null."""
    extra = ", ".join(f"{name} string" for name in CLASHING)
    full = [(*row, *[None if (i + j) % 3 else f"x{j}" for j in range(len(CLASHING))]) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, f"{kind}, {extra}")


WORDS = "river stone Under cloud seven lamp Quiet market bridge yellow storm paper garden copper window".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, nulls, blanks, one long text, repeated rows and null ids."""
    rng = random.Random(4)
    base = ["\n".join(sentence(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + i, t) for i, t in enumerate(base[:9])]
    rows += [(200 + i, t.replace("river", "valley", 1)) for i, t in enumerate(base[5:12])]
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "é ﬁ 日本語 " * 30), (304, " ".join(base) * 20)]
    rows += [(300, None), (7, base[7]), (None, base[3]), (None, "alone here with a null id"), (None, None)]
    return rows


@pytest.fixture()
def docs(spark, texts):
    return table(spark, texts)


@pytest.fixture()
def none(spark):
    """The same columns, no rows."""
    return table(spark, [(1, "x")]).where("false")
