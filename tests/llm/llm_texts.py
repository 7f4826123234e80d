"""Texts and frames for the tests of this folder."""

import random

import pytest

WORDS = ["the", "of", "and", "Rain", "river", "stone", "wind", "über", "日本", "don't", "42", "a,b", "x!"]


def prose(seed: int, n: int, line: int = 12) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", f"{rng.randrange(50)}"]) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + line]) for k in range(0, n, line))


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, odd white space."""
    base = prose(1, 120)
    return [
        (1, base), (2, None), (3, ""), (4, " \n\t \n"), (5, prose(2, 20_000)), (6, base), (7, base + "\nend"),
        (8, "日本 é\n  two  spaces \x0b\x0c tab\t"), (9, prose(3, 60) + "\n" + base), (None, base), (None, None),
        (10, "one"), (10, "one"), (-5, prose(4, 80)), (1 << 60, "far <|endoftext|> away"),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    """The rows with extra columns whose names the operators might use themselves."""
    extra = ["block", "row", "key", "word", "score", "component", "place", "region", "n", "k", "rank", "x"]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in edge_rows()], schema).repartition(3)


@pytest.fixture(scope="session")
def none(edges):
    return edges.where("1 = 0")
