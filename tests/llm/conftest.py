import random

import pytest

EXTRA = "lang string, source string, n_chars long, ids int, spans string, version string, line string, gram long, key long, page int, score double, language string, at int, removed int, class_id long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 120)) for _ in range(25)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    for k in range(12):  # near copies: one word changed
        parts = base[k % 6].split(" ")
        parts[len(parts) // 2] = "changed"
        rows.append((100 + k, " ".join(parts)))
    rows += [(200, base[0]), (201, base[0]), (202, base[1] + "\n" + base[2]), (203, base[2] + "\n" + base[1] + "x")]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "\n\n"), (304, "12345 !!! 67"), (305, "x"), (None, base[3]), (None, None)]
    rows += [(5, base[5]), (5, base[5]), (306, words(rng, 30_000)), (307, "ab" * 5_000), (308, "𝒳🙂 " * 200), (309, base[4] * 3)]
    return rows


def table(spark, rows):
    """The rows as documents, with columns whose names clash with those of results."""
    full = [(i, t, "en" if k % 2 else "fr", "s", 3, 1, "a", "b", "c", 4, 5, 6, 0.5, "d", 7, 8, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])


@pytest.fixture(scope="session", autouse=True)
def settings(spark):
    from tendero.llm.common import prepare

    prepare(spark)
