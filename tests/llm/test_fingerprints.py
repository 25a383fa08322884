import hashlib
import re

from common import empty, odd, odd_rows, prose
from pyspark.sql import functions as F

from orelode.llm.fingerprints import add_sketch, containment, distinct_count, fingerprint_edits, merge_groups, resemblance, with_next


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_estimates_follow_true_values(spark):
    texts = [r[1] for r in odd_rows() if r[1] is not None]
    pairs = [(a, b) for a in texts[:4] + texts[9:12] for b in texts[:4] + texts[9:13]]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = resemblance(add_sketch(add_sketch(df, "a", "sa"), "b", "sb"), "sa", "sb", "near")
    df = df.withColumn("inside", containment(F.col("sa"), F.col("sb"), F.col("near"))).withColumn("n", distinct_count(F.col("sa")))
    for r in df.collect():
        a, b = shingles(r.a), shingles(r.b)
        assert abs(r.near - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
        assert abs(r.n - len(a)) <= 0.3 * len(a)
        assert abs(r.inside - (len(a & b) / len(a) if a else 1)) < 0.3


def in_order(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [(r, order[(k + 1) % len(order)]) for k, r in enumerate(order)]


def test_next_document_wraps_over_blocks(spark):
    far = 2**33
    rows = [(i * 300 - 5000, f"t{i}") for i in range(40)] + [(None, "null"), (10**15, "far"), (7, "dup a"), (7, "dup b"), (far, "x"), (far + 1, "y"), (far + 4000, "z")]
    found = with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.text): r.next_text for r in found} == {a: b[1] for a, b in in_order(rows)}
    one = with_next(spark.createDataFrame([(1, "only")], "doc_id bigint, text string")).first()
    assert one.next_text == "only"


def test_whole_query_matches_brute_force(spark):
    """Every edited text, and likeness within the error of 256 values; with null, empty, long, repeated and odd rows."""
    rows = [(r[0], r[1] or "") for r in odd_rows()] + [(5000 + 700 * i, prose(i, 30 + 40 * i)) for i in range(20)]
    found = fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    expected = []
    for (doc, text), (_, following) in in_order(rows):
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        expected.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    key = lambda r: (str(r[0]), r[1], r[2])
    prints = {}
    for r, (doc, n, digest, *texts) in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc, n, digest)
        own, edited, following = map(shingles, texts)
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            assert abs(near - (len(own & other) / len(own | other) if own | other else 1)) < 0.13
        assert prints.setdefault(texts[0], r.fingerprint) == r.fingerprint
        assert prints.setdefault(texts[1], r.edited_fingerprint) == r.edited_fingerprint
    assert not any(set("\r\n") & set(p) for p in prints.values())
    assert fingerprint_edits(empty(spark)).count() == 0


def test_sketches_of_parts_merge_to_the_whole(spark):
    parts = add_sketch(odd(spark).withColumn("text", F.coalesce("text", F.lit(""))), "text", "s", 16)
    merged = merge_groups(parts.withColumn("g", F.lit(1)), ["g"], "s", 16).first().s
    values = sorted({x for r in parts.select("s").collect() for x in r.s})
    assert merged == values[:16]
    assert add_sketch(empty(spark), "text", "s").count() == 0
