"""Rows that every operator has to take: nulls, empty and very long texts, ties, repeats, clashing column names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest_ string, v string, th string, key string, block bigint, cid bigint, kept boolean"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(words))


def odd_rows():
    a, b = prose(1, 300), prose(2, 120)
    near = a.replace(a.split()[50], "changed", 1)
    texts = [a, b, a, near, None, "", "   ", "one two", "One TWO", "Ünïcode ß 日本語 Σ", prose(3, 30_000), "x" * 50_000, a + " " + b, b, "tab\tline\n\nbreak  two", "<|endoftext|> <|startoftext|>"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (None, b, None, None, None), (None, None, None, None, None), (3, "same id, other text than the row before has", "de", "s", 1)]
    return [(*r, "x", "y", "z", "w", 7, 8, True) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(docs, *names):
    """docs with its extra columns from the sixth on renamed, to names that an operator may use itself."""
    return docs.withColumnsRenamed(dict(zip(docs.columns[5:], names, strict=False)))
