"""BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a batch lie in one flat array of symbols. Each round looks all neighbouring pairs up by binary
search over sorted pair keys, finds the lowest rank in each word and merges its occurrences, until no word has a pair.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from orelode.llm.common import text_or_empty, with_workers
from orelode.llm.tokens import batches_of, byte_letters

NONE = np.int64(2**62)
ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBPE:
    """A tokenizer file with NFC, white space and lower-case normalisation, a split pattern, byte letters and word ends."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        end = model["end_of_word_suffix"] or ""
        letters = sorted(byte_letters().items(), key=lambda x: x[1])
        self.inner = np.array([vocab[c] for c, _ in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c, _ in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = max(self.tokens) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def parts(self, word: str) -> list[bytes]:
        """The pieces of a word, normalised, that merges stay within."""
        if word.isascii():
            word = word.lower()
            if word.isalpha():
                return [word.encode()]
        else:
            word = "".join(c.lower() for c in unicodedata.normalize("NFC", word))
            if word.isalpha() and word.lower() == word and not word.isascii() and max(word) < "ɐ":
                return [word.encode()]
        return [p.encode() for p in self.pattern.findall(word)]

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all parts one after another, and where each begins (and the end)."""
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(parts)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            same = owner[1:] == owner[:-1]
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, starts)
            of = np.repeat(least, np.diff(starts, append=len(symbols)))
            hit = (rank == of) & (of != NONE)
            if (twice := hit[1:] & hit[:-1]).any():  # like "aaa": every second pair of a run, from its left
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
                hit &= (place - run) % 2 == 0
            alive = of != NONE
            if not alive.all():
                done_symbols.append(symbols[~alive])
                done_owner.append(owner[~alive])
            where = np.flatnonzero(hit)
            symbols[where] = self.made[at[where]]
            alive[where + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        if not done_symbols:
            return np.empty(0, dtype=np.int64), np.zeros(len(parts) + 1, dtype=np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(parts)))])

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """ids of each word; a word has no plain spaces, and is a special string or holds none."""
        parts: list[bytes] = []
        ends = [0]
        for w in words:
            if w not in self.special:
                parts += self.parts(w)
            ends.append(len(parts))
        ids, at = self.merge(parts)
        cuts = at[np.array(ends)].tolist()
        return [np.array([self.special[w]]) if w in self.special else ids[a:b] for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids) -> str:
        """Tokens joined by spaces, as the library does for a file without a decoder; special tokens stay."""
        return " ".join(self.tokens[i] for i in ids)

    def split(self, texts: pa.Array) -> pa.Array:
        """Lists of words. Special strings, found first and in their exact form, stand alone."""
        texts = pc.fill_null(texts, "")
        for s in sorted(self.special, key=len, reverse=True):
            texts = pc.replace_substring(texts, s, f" {s} ")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def encode(self, text: str) -> list[int]:
        words = self.split(pa.array([text]))[0].as_py()
        return [int(i) for ids in self.encode_words(words) for i in ids]


_models: dict[str, WordBPE] = {}


def model(path: str) -> WordBPE:
    if path not in _models:
        _models[path] = WordBPE(path)
    return _models[path]


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): the number of ids, and SHA-256 of the ids in decimal and of what they decode to.

    Null and empty texts have no ids and the digest of nothing. Repeated rows and null ids stay as they are; other columns
    are not read.
    """
    spark = with_workers(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for whole in batches:
            for batch in batches_of(whole):
                lists = bpe.split(batch.column(1))
                coded = lists.flatten().dictionary_encode()
                ids = bpe.encode_words(coded.dictionary.to_pylist())
                number = np.array([len(x) for x in ids], dtype=np.int64)
                texts = [" ".join(map(str, x.tolist())) for x in ids]
                back = [bpe.decode(x.tolist()) for x in ids]
                words = coded.indices.to_numpy()
                ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
                kept = number[words] > 0
                cum = np.concatenate([[0], np.cumsum(kept)])[ends].tolist()
                count = np.concatenate([[0], np.cumsum(number[words])])[ends]
                order = words[kept].tolist()
                a, b = [], []
                for start, stop in zip(cum[:-1], cum[1:], strict=True):
                    own = order[start:stop]
                    a.append(hashlib.sha256(" ".join([texts[i] for i in own]).encode()).hexdigest())
                    b.append(hashlib.sha256(" ".join([back[i] for i in own]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(count)), pa.array(a), pa.array(b)], schema=ROWS)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
