"""Token ids of whole texts by a byte-level BPE file; the distinct words of a batch are encoded once.

A text is cut where its split pattern always cuts: before a space or a line feed that stands between other characters.
A text whose white space makes such cuts unsafe is encoded as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = re.compile(r"\s")
_ODD = re.compile(r"[^\S \n]|[^ ]\n|\n[ \n]|\n$|  | $")  # in words joined by spaces: white space that isn't a word's first line feed
_RARE = re.compile("[^\x00-\u024f]")  # left to the library, whose character classes count


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Ids as the tokenizers library gives them, without added special tokens; special strings in a text are their ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(self.size, dtype=bool)  # tokens that a word begins with
        self.opens[[i for t, i in ranks.items() if t[:1] in (b" ", b"\n")]] = True

    def _whole(self, text: str) -> bytes:
        if _RARE.search(text) or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of distinct words one after another, where each begins (and the end), and which have unsafe white space."""
        unsafe = np.zeros(len(words), dtype=bool)
        joined = " " + " ".join(words)
        if _ODD.search(joined) or _RARE.search(joined):
            unsafe = np.array([not w or w == "\n" or bool(_SPACE.search(w, w[:1] == "\n") or _RARE.search(w)) for w in words], dtype=bool)
            words = [w for w, odd in zip(words, unsafe, strict=True) if not odd]
            joined = " " + " ".join(words) if words else ""
        ids = np.array(self.fast.encode_ordinary(joined.replace(" \n", "\n")), dtype="<u4")
        starts = np.flatnonzero(self.opens[ids])
        assert len(starts) == len(words), "a word has more than one part"
        lengths = np.zeros(len(unsafe), dtype=np.int64)
        lengths[~unsafe] = np.diff(starts, append=len(ids))
        return ids, np.concatenate([[0], np.cumsum(lengths)]), unsafe

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; null is empty. Distinct words are encoded once."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.indices.to_numpy()
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        special = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        ids, at, odd = self._words(coded.dictionary.to_pylist())
        lengths = np.diff(at)[words]
        lengths[ends[:-1]] = 0  # a text's first word has no space before it
        cum = np.concatenate([[0], np.cumsum(lengths)])
        data = ids[np.repeat(at[words] - cum[:-1], lengths) + np.arange(cum[-1])].tobytes()
        whole = special | np.logical_or.reduceat(odd[words], ends[:-1]) if len(texts) else special
        firsts = coded.dictionary.take(pa.array(words[ends[:-1]])).to_pylist()
        cum = cum[ends] * 4
        out = []
        for i, (first, alone, a, b) in enumerate(zip(firsts, whole.tolist(), cum[:-1].tolist(), cum[1:].tolist(), strict=True)):
            if alone or first[:1] == "\n":
                out.append(self._whole(texts[i].as_py()))
            else:
                out.append(self._whole(first) + data[a:b])
        return out


def batches_of(batch: pa.RecordBatch, size: int = 8_000_000):
    """Slices of a batch with about `size` bytes at most, or one row."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
