import random
import re
import string
from collections import defaultdict

import pytest
from common import empty, odd, odd_rows, prose

from orelode.llm import near_dedup
from orelode.llm.common import Scratch
from orelode.llm.near_dedup import components, keep_one_of_each_group, near_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        least = min((d for d in ids[find(i)] if d is not None), default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(rows)


def edited(text, share, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"w{r.randrange(10**6)}"
    return " ".join(w)


def test_odd_rows_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert sorted(map(tuple, near_duplicates(odd(spark)).collect()), key=str) == brute(rows)
    assert near_duplicates(empty(spark)).count() == 0


def test_hot_groups_match_brute_force(spark, monkeypatch):
    """Lists over the limit: a large group of near copies of one text, and a passage that most texts share."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base, passage = prose(100, 120), prose(101, 60)
    texts = [edited(base, 0.012 * (i % 4), i) for i in range(40)] + [f"{prose(200 + i, 8 + 4 * (i % 12))} {passage}" for i in range(40)] + [prose(300 + i // 2, 50 + i % 2) for i in range(10)]
    check(spark, [(i * 3, t) for i, t in enumerate(texts)])


def test_a_tail_of_unshared_values_does_not_hide_a_link(spark, monkeypatch):
    """43 of the 96 retained values of the second text are in its tail; all of the bare template's are hot."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", 6)
    template = prose(400, 1200)
    texts = [template, f"{template} {prose(10832, 392)}"] + [f"{template} {prose(500 + i, 660)}" for i in range(40)]
    assert [c for _, _, c, _ in brute(list(enumerate(texts)))].count(0) == 2
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_kept_documents_have_all_columns(spark):
    docs = odd(spark).withColumnRenamed("v", "of").withColumnRenamed("th", "hashed")
    kept = keep_one_of_each_group(docs)
    assert kept.dtypes == docs.dtypes
    assert {(r["of"], r["hashed"], r["cid"]) for r in kept.collect()} == {("y", "z", 8)}
    expected = sorted(str(d) for d, _, _, keep in brute([(r[0], r[1]) for r in odd_rows()]) if keep)
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected
