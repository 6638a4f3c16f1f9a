import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empty, very long and repeated rows."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 40))
    base = words(rng, 120)
    rows: list[tuple[int | None, str | None]] = []
    for i in range(60):
        rows.append((i, " ".join(words(rng, rng.randrange(1, 150)))))
    for i in range(60, 90):
        near = list(base)
        near[rng.randrange(len(near))] = f"x{i}"
        rows.append((i, " ".join(near) if i % 3 else " ".join(base).upper()))
    for i in range(90, 120):
        rows.append((i, f"{' '.join(words(rng, rng.randrange(0, 20)))}\n{passage}\t{' '.join(words(rng, rng.randrange(0, 60)))}"))
    rows += [(120, None), (121, ""), (122, " \n"), (123, "a b"), (124, "A  b"), (125, "same " * 3000), (126, "same " * 50), (127, " ".join(words(rng, 9000)))]
    rows += [(60, rows[60][1]), (3, "another text of the same id with enough words to hold a window of its own here"), (None, passage), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
