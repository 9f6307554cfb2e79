"""Small tables with the odd rows that every operator has to stand."""

import os
import random

WORDS = "the of and to in erly blend shonnd antion hawre ouble stth".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def odd_documents(spark, n: int = 60, seed: int = 1):
    """Copies, near copies, nulls, empty and blank texts, a very long text, repeated rows, null ids, a clashing and an extra column."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 3, 30, 200])) for _ in range(n)]
    rows = [(i, t, rng.choice(["a", "b", "b", None])) for i, t in enumerate(texts)]
    rows += [(n + k, texts[k % 7].replace(" ", rng.choice([" ", "  ", "\n", "\t "])), "b") for k in range(12)]
    rows += [(n + 20 + k, texts[k] + " tail", "c") for k in range(4)]
    rows += [(n + 30, None, "a"), (n + 31, "", "a"), (n + 32, " \n\t", None), (n + 33, "x" * 50_000, "a"), (n + 34, prose(rng, 20_000), "b")]
    rows += [(n + 40, "same row", "a")] * 3 + [(None, "no id", "a"), (None, texts[0], "a"), (n + 50, "Ünïcödé 日本語 🙂 don't <|endoftext|> 123", "c")]
    data = [(i, t, s, 7, "extra", None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, kept int, Score string, n_chars bigint").repartition(5)


def data(name: str) -> str:
    return f"/root/testdata/{name}"


def there(name: str) -> bool:
    return os.path.isdir(data(name))
