"""Small document tables with awkward rows, shared by the operators' tests."""

import random

WORDS = ["alpha", "Beta", "gamma", "der", "la", "niño", "Éa", "x|y", "#tag", "1.2.3.4", "don't", "日本", "a", "of", "the"]


def text(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ".", str(rng.randrange(1000))]))
        out.append(rng.choice([" ", " ", " ", " ", "\n", "  ", "\t"]))
    return "".join(out)


def rows(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    made = [(i, text(rng, rng.randrange(0, 200)), "en", f"s{i % 3}", 0) for i in range(n)]
    long = text(rng, 30_000)
    return [
        *made,
        (n, None, None, None, None),
        (n + 1, "", "en", "s0", 0),
        (n + 2, "\n\n \t\n", "en", "s0", 0),
        (n + 3, long, "en", "s1", 0),
        (n + 4, long, "en", "s1", 0),
        (None, made[0][1], "en", "s0", 0),
        (0, made[0][1], "en", "s0", 0),
        (n + 5, "x" * 5000, "en", "s2", 0),
        (n + 6, "aaaa aaaa aaaaaaa\naaaa <|endoftext|> aaaa", "en", "s2", 0),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, data=None, parts: int = 3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)
