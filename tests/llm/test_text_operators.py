import hashlib
import itertools
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from common import clash, empty, odd, odd_rows, prose
from pyspark.sql import functions as F

from orelode.llm import langid, pii, suffix_dedup
from orelode.llm.pii import Surrogates, luhn, replace_all
from orelode.llm.suffix_dedup import remove_repeats, repeated_windows, suffix_order

WORDS = {"en": "the and of is that which water house stone river winter under", "de": "der und die nicht schön wasser haus stein fluss über größe zwischen", "fr": "le et la être où maison pierre rivière été sous français entre"}


def labelled(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang if i % 7 else None, "s"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_language_of_held_out_documents(spark):
    docs = labelled(spark)
    model = langid.train(docs)
    found = langid.predict(docs.withColumn("score", F.lit("clash")), model)
    assert found.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    rows = found.withColumn("held_out", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == ["en", "de", "fr"][r.doc_id % 3] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    edge = {r.text: (r.lang_pred, r.score) for r in langid.predict(odd(spark), model).collect()}
    assert edge[None] == edge[""] == edge["   "] == ("und", 0.0)
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.train(empty(spark)) is None and {r.lang_pred for r in langid.predict(odd(spark), None).collect()} == {"und"}
    clashing = clash(odd(spark), "judged", "told", "lang_pred", "score")
    assert langid.keep_identified(clashing, model).dtypes == clashing.dtypes
    assert all(r[c] == v for r in langid.keep_identified(clashing, model).collect() for c, v in zip(clashing.columns[5:9], ("x", "y", "z", "w"), strict=True))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab"]
    probs = {"▁": 0.1, "▁a": 0.2, "a": 0.3, "b": 0.15, "ab": 0.05, "▁ab": 0.2}
    model = langid.Model(["x"], pieces, np.array([[probs[p]] for p in pieces]), np.array([1e-3]))

    def total(text):
        return 1.0 if not text else sum(total(text[n:]) * (probs[text[:n]] if text[:n] in probs else 1e-3 if n == 1 else 0.0) for n in range(1, len(text) + 1))

    for word in ("ab", "aba", "cab", "bbbbabab"):
        assert np.isclose(model.score_words([word])[0, 0], np.log(total("▁" + word)))
    for word in ("ab" * 31 + "a", "ab" * 32, "cab" * 700):  # the sums themselves are too small for floats
        sums, logs = [1.0], 0.0
        whole = "▁" + word
        for stop in range(1, len(whole) + 1):
            sums.append(sum(sums[-n] * (probs[whole[stop - n : stop]] if whole[stop - n : stop] in probs else 1e-3 if n == 1 else 0.0) for n in range(1, min(3, stop) + 1)))
            logs, sums = logs + np.log(sums[-1]), [x / sums[-1] for x in sums[-4:]]
        assert np.isclose(model.score_words([word])[0, 0], logs)


def test_long_pieces_and_tails_of_long_words_inform_the_model():
    vocabulary = langid.vocabulary(langid.default_vocabulary())
    assert max(map(len, vocabulary)) > 8
    pieces = ["a", "b", "▁a", "abcdefghijkl"]
    model = langid.Model.fit([("a" * 80 + "b" * 20, "x", 5), ("abcdefghijkl", "y", 5)], pieces)
    p = {piece: model.probs[i] for i, piece in enumerate(model.pieces)}
    assert p["b"][0] > 10 * p["b"][1] and p["abcdefghijkl"][1] > 10 * p["abcdefghijkl"][0]


def test_surrogates_are_distinct_and_stable():
    s = Surrogates(b"k")
    emails = [f"user{i}.x@mail{i % 3}.example.com" for i in range(300)]
    for kind, values in (("email", emails), ("ip", [f"10.{a}.{b}.7" for a in range(20) for b in range(20)]), ("phone", [f"+1 (2{i:02d}) 555-0{i:03d}" for i in range(100)]), ("name", ["Annah", "Hanna", "Marta", "Li", "Wu", "Mariq"]), ("ssn", [f"{i:03d}-12-3456" for i in range(100)]), ("secret", [f"{i:020x}" for i in range(200)])):
        new = [s.of(kind, v) for v in values]
        assert len(set(new)) == len(values) and all(a != b for a, b in zip(values, new, strict=True))
        assert new == [Surrogates(b"k").of(kind, v) for v in values]
        if kind == "secret":  # a hex digit may become any other
            continue
        assert [re.sub(r"[a-z]", "a", re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", v))) for v in new] == [re.sub(r"[a-z]", "a", re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", v))) for v in values]
    assert s.of("email", "BOB.1@Mail.com").lower() == s.of("email", "bob.1@mail.com")
    card = s.of("card", "4041894974608795")
    assert luhn(card) and card == s.of("card", "4041-8949-7460-8795").replace("-", "") != "4041894974608795"
    account = s.of("iban", "DE89 3704 0044 0532 0130 00")
    assert pii.iban_ok(account) and account != "DE89 3704 0044 0532 0130 00" and account.replace(" ", "") == s.of("iban", "DE89370400440532013000")
    for names in pii.GIVEN.values():  # a given name becomes another of its gender and script
        new = [s.of("name", n.capitalize()) for n in names.split()]
        assert sorted(x.lower() for x in new) == sorted(names.split()) and all(a.lower() != b for a, b in zip(new, names.split(), strict=True))
    words = ["".join(w) for w in itertools.product("ab", "eno", "nra", "oa")]  # short words, some of which could become listed names
    new = [s.of("name", w.capitalize()).lower() for w in words]
    assert len(set(new)) == len(new) and all((w in pii._lists()) == (x in pii._lists()) for w, x in zip(words, new, strict=True))
    text, n = replace_all("Version 3.0, CC BY-NC 4.0, on 2024-05-05 at 12:30, 4041894974608796 and 1.2.3.4.5", s)
    assert text.startswith("Version 3.0, CC BY-NC 4.0, on 2024-05-05 at 12:30, 4041894974608796") and not any(n.values())


def test_each_rule_passes_the_prefilter_alone():
    words = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "API-KEY", "PWD", "\u017fecret"]
    texts = [f"{w} = correcthorse" for w in words] + [f"{t} Smith" for t in pii.TITLES]
    texts += ["AKIA" + "Q" * 16, "ASIA" + "Q" * 16, "ghp_" + "a" * 30, "sk-" + "a" * 20, "sk_" + "a" * 20, "a@b.org", "8.8.8.8", "+49 30 1234567", "+\u0664\u0669 \u0663\u0660 \u0661\u0662\u0663\u0664"]
    assert all(len(pii.entities(t)) == 1 for t in texts)
    assert pc.match_substring_regex(pa.array(texts), pii.MAYBE, ignore_case=True).to_pylist() == [True] * len(texts)


def test_no_entity_of_any_script_stays():
    s = Surrogates(b"k")
    names = ["王小明", "田中", "タナカ", "김철수", "محمد علي", "משה כהן", "สมชาย", "Ořechová", "Kovács Győző", "Erdoğan", "Ionăscu", "Аннушка", "Σας", "Գրիգոր", "გიორგი", "µx", "Ⅷx", "ßa", "ǅa"]
    values = {"name": names, "email": [f"{n.split()[0]}@example.com" for n in names] + ["__@example.com"], "secret": [n * 6 for n in names] + ["!!!!!!"],
              "phone": ["+\u0664\u0669 \u0663\u0660 \u0661\u0662\u0663\u0664", "+49 555"]}
    for kind, texts in values.items():
        new = [s.of(kind, t) for t in texts]
        assert all(a != b and len(a) == len(b) for a, b in zip(texts, new, strict=True)) and len(set(new)) == len(new)
    for n in names[:15]:  # each word changes, and each letter keeps its script and case
        for a, b in zip(n.split(), s.of("name", n).split(), strict=True):
            assert a != b and [(unicodedata.name(c).split()[0].split("-")[0], c.isupper()) for c in a] == [(unicodedata.name(c).split()[0].split("-")[0], c.isupper()) for c in b]
    text, n = replace_all("Dr. 王小明, Mr محمد علي", s)
    assert n["name"] == 2 and not any(w in text for w in ("王小", "محمد", "علي"))
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isdecimal()]
    assert all(len(pii.letters_of(pii._plain(c)) or "") > 1 for c in letters)


def test_names_are_replaced_wherever_they_stand():
    s = Surrogates(b"k")
    text, n = replace_all("Smith said: Mr John Smith came. Smith left; Smithson and blacksmith stayed. John's hat.", s)
    john, smith = s.of("name", "John"), s.of("name", "Smith")
    assert text == f"{smith} said: Mr {john} {smith} came. {smith} left; Smithson and blacksmith stayed. {john}'s hat." and n["name"] == 4
    assert s.of("email", "王@example.com") != "王@example.com" and replace_all("Green tea", s)[0] == "Green tea"


def test_query_matches_text_by_text(spark):
    """Every text as replace_all() gives it alone, and over the whole table no two entities with one surrogate."""
    texts = [r[1] for r in odd_rows()] + [f"Mrs {n.capitalize()} {w}, {w.lower()}{i}@site{i % 7}.org, +1 202 555 01{i:02d}, 078-05-{1000 + i}, 10.0.{i}.9" for i, (n, w) in enumerate(itertools.product("anna maria lena".split(), ["Braun", "Kovac", "Novak", "Ruiz"]))]
    s = Surrogates(pii.KEY)
    found = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    pairs = {}
    for i, t in enumerate(texts):
        new, count = (None, dict.fromkeys(pii.KINDS, 0)) if t is None else replace_all(t, s)
        assert found[i].text == new and all(found[i][f"n_{k}"] == v for k, v in count.items())
        for a, b, kind in pii.entities(t or ""):
            for w in re.findall(r"[^\W\d_]+", t[a:b]) if kind == "name" else [t[a:b]]:
                pairs.setdefault(kind, {}).setdefault(w.lower(), s.of(kind, w).lower())
    assert set(pairs) >= {"name", "email", "phone", "ssn", "ip"}
    assert all(len(set(m.values())) == len(m) and all(k != v for k, v in m.items()) for m in pairs.values())


def test_pseudonymise_keeps_rows_and_columns(spark):
    clashing = clash(odd(spark), "judged", "judged_", "JUDGED__", "n_x")
    assert pii.pseudonymise(clashing, counts=False).dtypes == clashing.dtypes
    assert {tuple(r[5:9]) for r in pii.pseudonymise(clashing, counts=False).collect()} == {("x", "y", "z", "w")}
    found = pii.pseudonymise(odd(spark).withColumn("n_ip", F.lit("clash")))
    assert found.count() == len(odd_rows())
    same = {r.doc_id: r.text for r in pii.pseudonymise(odd(spark), counts=False).collect()}
    assert same[10] == odd_rows()[10][1] and pii.pseudonymise(odd(spark), counts=False).columns == odd(spark).columns
    rows = [(1, "mail a.b@c.org and 8.8.8.8"), (2, "again A.B@c.org"), (3, None)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert "a.b@c.org" not in got[1].text and got[1].n_email == got[1].n_ip == 1 and got[3].text is None
    assert got[2].text.split()[1].lower() == got[1].text.split()[1]
    assert pii.pseudonymise(empty(spark)).count() == 0


def test_suffix_order_and_windows():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 400):
        for letters in (b"ab", b"abcde"):
            t = bytes(rng.choice(list(letters), n).astype(np.uint8).tolist())
            assert suffix_order(t, n + 1).tolist() == sorted(range(n), key=lambda i: t[i:])
            parts = [t[i : i + 30] for i in range(0, n, 13)]
            for length in (3, 8, 11):
                count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
                for p, hit in zip(parts, repeated_windows(parts, length), strict=True):
                    assert hit.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def expected_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("kinds", [512, 1])
def test_removal_matches_brute_force(spark, monkeypatch, kinds):
    """kinds 1 sends every anchor with different segments through the path for hot ones."""
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    passage = prose(50, 40)
    texts = [r[1] for r in odd_rows() if r[1] is None or len(r[1]) < 40_000]
    texts += [f"{prose(60 + i, 20)} {passage} {prose(90 + i, 15)}" for i in range(12)] + ["ab" * 400, "x" * 700, passage[:150], "日本" * 90]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 120).collect()}
    for (i, _), e in zip(rows, expected_removal(texts, 120), strict=True):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == e


def test_removal_of_odd_rows_matches_brute_force_at_the_contracts_length(spark):
    rows = [(r[0], r[1]) for r in odd_rows() if r[1] is None or len(r[1]) < 40_000]
    long = prose(700, 200)
    rows += [(100 + i, f"{prose(800 + i, 30)}|{long[7 : 7 + n]}|{prose(900 + i, 30)}") for i, n in enumerate((399, 400, 401, 900, 900))]
    found = sorted((tuple(r)[1:5] for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert found == sorted(expected_removal([t for _, t in rows], 400), key=str) and sum(x[1] > 0 for x in found) >= 8
    assert remove_repeats(empty(spark)).count() == 0
