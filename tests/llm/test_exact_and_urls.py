import hashlib
from collections import defaultdict

from common import clash, empty, odd, odd_rows

from orelode.llm.exact_dedup import DigestIndex, keep_one_of_each
from orelode.llm.url_filter import judge, rule_table


def test_decisions_match_brute_force(spark):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[r[1] or ""].append(r[0])
    found = DigestIndex(spark).deduplicate(odd(spark)).collect()
    assert len(found) == len(odd_rows())
    expected = []
    for r in odd_rows():
        ids = [i for i in groups[r[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        expected.append((r[0], keep, len(groups[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    key = lambda x: str(x)
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(expected, key=key)
    assert DigestIndex(spark).deduplicate(empty(spark)).count() == 0


def test_second_batch_is_judged_by_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    second = spark.createDataFrame([(4, "a"), (5, "c"), (6, "c")], "doc_id bigint, text string")
    assert {r.doc_id for r in index.deduplicate(first).where("kept").collect()} == {2, 3}
    judged = {r.doc_id: (r.keep_id, r.kept) for r in index.deduplicate(second).collect()}
    assert judged == {4: (3, False), 5: (6, False), 6: (6, True)}
    assert index.read().count() == 3
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert told["Num Buckets"] == "4" and told["Sort Columns"] == "[`digest`]"
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_two_halves_are_judged_as_one_table(spark):
    rows = [(r[0], r[1] or "") for r in odd_rows()]
    ids = {t: [i for i, u in rows if u == t and i is not None] for _, t in rows}
    expected = [(i, max(ids[t], default=None), sum(u == t for _, u in rows), i == max(ids[t], default=None), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    found = DigestIndex(spark).deduplicate_whole(odd(spark)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert DigestIndex(spark).deduplicate_whole(empty(spark)).count() == 0


def test_kept_documents_have_all_columns(spark):
    docs = clash(odd(spark), "digest", "win", "times", "DIGEST_")
    kept = keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes and {tuple(r[5:9]) for r in kept.collect()} == {("x", "y", "z", "w")}
    assert sorted(r.text or "" for r in kept.collect()) == sorted({r[1] or "" for r in odd_rows()})
    assert keep_one_of_each(empty(spark)).count() == 0


URLS = ["http://a.net/x", "HTTP://Sub.EXAMPLE.net/en/x?q#f", "http://example.net/en", "https://example.com/de/", "https://www.example.com/de/a/b?c", "http://x.org/fr/z", "http://x.org/FR/z",
        "http://net/", "http://net", "http://notexample.com/de/", "no scheme", "", None, "://", "http://a.net:80/x", "http://u@b.net/", "http://" + "a." * 3000 + "net/" + "b/" * 3000, "http://a.net/x"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for h, p, action in [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return host, path, best and best[0], best[1] if best else "allow"


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y", "z", 1, 2) for i, u in enumerate(URLS)], "page_id bigint, url string, host string, of string, action string, act int, url_ int")
    found = judge(pages, rule_table(spark))
    assert found.columns == ["page_id", "url", "of", "action", "act", "url_", "host", "path", "rule", "verdict"] and {tuple(r[2:6]) for r in found.collect()} == {("y", "z", 1, 2)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {i: plain(u) for i, u in enumerate(URLS)}
    assert judge(pages.limit(0), rule_table(spark)).count() == 0


def test_rules_without_trailing_slash_and_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/dir/file.html"), (2, "http://b.c/dir/f")], "page_id bigint, url string")
    rules = spark.createDataFrame([("b.c", "/dir/fi", "block"), ("c", "/dir", "allow"), ("b.c", "", "block")], "rule_host string, rule_path string, action string")
    found = {r.page_id: (r.rule, r.verdict) for r in judge(pages, rules).collect()}
    assert found == {1: ("b.c/dir/fi", "block"), 2: ("c/dir", "allow")}
    none = judge(pages, rules.limit(0), default="block").collect()
    assert {r.verdict for r in none} == {"block"} and {r.rule for r in none} == {None}
