import zlib

import corpus_pipeline
import numpy as np
from common import empty, odd, prose
from test_near import brute

from orelode.llm import pii
from orelode.llm.tokens import default_tokenizer


def test_stages_keep_the_columns_and_pack_the_rest(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        kinds = docs.dtypes
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.dtypes == kinds
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0 and "sequence_id" in docs.columns


def test_empty_table_goes_through(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_matches_brute_force(spark, tmp_path):
    """One language, so all with letters stay; then of copies the last, of near copies the first, and their tokens in pieces."""
    from tokenizers import Tokenizer

    base = prose(1, 90)
    texts = [base, base, base.replace(base.split()[40], "other", 1), prose(2, 60) + " mail a.b@site.org to Mr John Braun", None, "", "12 34", "one two", prose(3, 2000), "one two"]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    left = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    left = [(i, t) for i, t in left if i == max(j for j, u in left if u == t)]
    kept = {i for i, _, _, keep in brute(left) if keep}
    assert kept == {1, 3, 8, 9}
    surrogates, library = pii.Surrogates(pii.KEY), Tokenizer.from_file(default_tokenizer())
    library.no_truncation()
    ids = {i: [*library.encode(pii.replace_all(t, surrogates)[0], add_special_tokens=False).ids, 0] for i, t in left if i in kept}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for doc, own in ids.items():
        mine = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))] and sum(p.length for p in mine) == len(own) == mine[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], dtype="<u4").tobytes()) for p in mine)
    assert {p.doc_id for p in pieces} == kept
    for number in {p.sequence_id for p in pieces}:
        inside = sorted((p.offset, p.length) for p in pieces if p.sequence_id == number)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))] and sum(n for _, n in inside) <= 1024
