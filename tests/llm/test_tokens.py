import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from common import empty, odd, odd_rows
from tokenizers import Tokenizer

from orelode.llm import bpe
from orelode.llm.packing import SumOfSquares, close, pack, pack_stream
from orelode.llm.token_output import BestFit, pack_block, packed, segments, write_packed
from orelode.llm.tokens import Encoder, default_tokenizer

EXTRA = ["", "a  b", "x\n\ny\n", " lead", "tail ", "\n", "a\t b", "<|endoftext|>hi <|endoftext|>", "it's  don't\n I'll", "日本 語 です", "a \n b", "é x y", "x\r\n y z", "　 a", "12 345 !! a_b", None,
         "<|ENDOFTEXT|> ΣΑΣ İst é \x1c x\x0bq", "aaaa aaaaa aaa " + "a" * 50, "bananananana", "'s's''", "ab" * 300]
TEXTS = EXTRA + [r[1] for r in odd_rows()]


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(default_tokenizer())
    found = Encoder(default_tokenizer()).encode_many(pa.array(TEXTS))
    for text, ids in zip(TEXTS, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert Encoder(default_tokenizer()).encode_many(pa.array([], pa.string())) == []


def test_bpe_matches_the_library_both_ways(spark):
    library, own = Tokenizer.from_file(bpe.default_tokenizer()), bpe.WordBPE(bpe.default_tokenizer())
    for text in TEXTS:
        if text is not None and len(text) < 10_000:
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text) == ids
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    import hashlib

    rows = bpe.digests(odd(spark)).collect()
    expected = []
    for r in odd_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert bpe.digests(empty(spark)).count() == 0


def check_pieces(rows, library):
    """Every id in exactly one piece, sequences without gaps, at most 1024."""
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return docs, places


def test_packing_is_whole(spark):
    library = Tokenizer.from_file(default_tokenizer())
    rows = pack(odd(spark).repartition(2)).collect()
    docs, places = check_pieces(rows, library)
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_rows())
    assert sum(r.length for r in rows) == total
    ids = np.array([*library.encode(odd_rows()[10][1], add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
    for r in docs[10]:
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids) // 4
    fills = [sum(n for _, n in p) for p in places.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in fills)
    assert pack(empty(spark)).count() == 0


def test_sum_of_squares_against_a_plain_one():
    rng = np.random.default_rng(5)
    fast, levels, size = SumOfSquares(16), defaultdict(int), 16
    for n in rng.integers(1, 17, 500).tolist():
        choices = []
        for h in [0, *(h for h, c in levels.items() if c and h)]:
            if h + n <= size:
                new = dict(levels)
                if h:
                    new[h] -= 1
                if h + n < size:
                    new[h + n] = new.get(h + n, 0) + 1
                choices.append((sum(c * c for c in new.values()), -h, new))
        levels = defaultdict(int, min(choices, key=lambda x: x[:2])[2])
        fast.add("x", n)
        assert {h: int(c) for h, c in enumerate(fast.counts) if c} == {h: c for h, c in levels.items() if c}
    assert [sum(x[2] for x in w) for w in close([[("a", 0, 5)], [("b", 0, 6)], [("c", 0, 8)]], 8)] == [8, 8, 2, 1]
    assert list(pack_stream(iter([]), 8)) == []


def test_best_fit_decreasing_against_a_plain_one():
    rng = np.random.default_rng(6)
    docs = [(i, np.arange(n)) for i, n in enumerate(rng.integers(1, 60, 300).tolist())]
    found = pack_block(docs, 32)
    items = sorted(((i, s, min(32, len(d) - s)) for i, d in docs for s in range(0, len(d), 32)), key=lambda x: -x[2])
    bins = []
    for item in items:
        room = [b for b in bins if b[0] >= item[2]]
        best = min((b[0] for b in room), default=None)
        if best is None:
            bins.append([32 - item[2], [item]])
        else:
            b = next(b for b in reversed(bins) if b[0] == best)
            b[0] -= item[2]
            b[1].append(item)
    assert len(found) == len(bins) and sorted(sum(x[2] for x in b) for b in found) == sorted(32 - b[0] for b in bins)
    fit = BestFit(4)
    fit.add("a", 4)
    assert fit.find(1) == -1


def test_token_matrix_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(default_tokenizer())
    path = str(tmp_path / "matrix")
    write_packed(odd(spark), path)
    matrix = spark.read.parquet(path)
    texts = defaultdict(dict)
    for r in matrix.collect():
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 1024 and r.cu_seqlens[0] == 0 and not ids[r.cu_seqlens[-1] :].any()
        for i, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[i], r.cu_seqlens[i + 1]
            assert positions[a:b].tolist() == list(range(b - a))
            texts[doc].setdefault(start, []).append(ids[a:b].tolist())
    long = [x for s in sorted(texts[10]) for x in texts[10][s][0]]
    assert long == [*library.encode(odd_rows()[10][1], add_special_tokens=False).ids, 0]
    total = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_rows())
    rows = segments(matrix).collect()
    assert sum(r.length for r in rows) == total and all(r.restarts for r in rows)
    assert packed(empty(spark)).count() == 0
