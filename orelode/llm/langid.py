"""Language identification by unigram piece models with all segmentations summed.

The vocabulary is a fixed public one. For each language expectation maximisation fits the probabilities of its pieces, and
a forward algorithm gives a word's probability as the sum over all ways to cut it into pieces. Pieces don't cross words, so
a text's likelihood is the product over its words, and each distinct word of a batch is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.common import text_or_empty, unused, with_workers
from orelode.llm.tokens import batches_of

UNKNOWN = "und"
SAMPLE = 400  # training documents of each language, about; the bound of what the model is fitted on
ROUNDS = 3
LETTERS_CUT = 64  # longer words are fitted in runs of so many letters, all of them, and scored one by one
MARK = "▁"
PRIME = np.uint64(1_000_003)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """Lower-cased pieces of letters, perhaps after the mark of a word's begin, of any length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == MARK or p.lstrip(MARK).isalpha() and MARK not in p[1:]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def words_of(texts: pa.Array) -> pa.Array:
    """Lists of lower-cased runs of letters, with empty strings between."""
    return pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " "), " ")


class Lattice:
    """Words of one length as arrays, and the piece (or -1) that each of their parts is."""

    def __init__(self, words: list[str], hashes: np.ndarray, longest: int):
        n = len(words[0])
        self.longest = longest
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(-1, n).T.astype(np.uint64)
        self.n, self.count, self.parts = n, len(words), {}
        for i in range(n):
            code = np.zeros(self.count, dtype=np.uint64)
            for stop in range(i + 1, min(n, i + longest) + 1):
                code = code * PRIME + self.letters[stop - 1]
                at = np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)
                self.parts[i, stop] = np.where(hashes[at] == code, at, -1)


def piece_hash(pieces: list[str]) -> np.ndarray:
    out = []
    for p in pieces:
        code = 0
        for c in p:
            code = (code * int(PRIME) + ord(c)) % 2**64
        out.append(code)
    return np.array(out, dtype=np.uint64)


def forward(lattice: Lattice, probs: np.ndarray, single: np.ndarray) -> list[np.ndarray]:
    """Summed probability of every prefix, for each word and language. probs: piece x language, its last row zeros."""
    alpha = [np.ones((lattice.count, probs.shape[1]))]
    for stop in range(1, lattice.n + 1):
        total = np.zeros_like(alpha[0])
        for i in range(max(0, stop - lattice.longest), stop):
            part = lattice.parts[i, stop]
            p = probs[part]
            if stop == i + 1:  # a letter that is no piece has a small probability of its own
                p = np.where((part < 0)[:, None], single, p)
            total += alpha[i] * p
        alpha.append(total)
    return alpha


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        for i in range(0, len(run), 100_000):
            if len(run):
                yield run[i : i + 100_000]


class Model:
    """Languages and the piece probabilities of each; fit() makes it from (word, language, count) rows."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray, single: np.ndarray):
        order = np.argsort(piece_hash(pieces), kind="stable")
        self.languages, self.pieces, self.hashes = languages, [pieces[i] for i in order], piece_hash(pieces)[order]
        self.probs = np.vstack([probs[order], np.zeros((1, len(languages)))])
        self.single, self.longest, self.table = single, max(map(len, pieces), default=1), None

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
        languages = sorted({c[1] for c in counts})
        size = len(pieces)
        model = cls(languages, pieces, np.full((size, len(languages)), 1.0 / size), np.full(len(languages), 1e-7))
        words = sorted({c[0] for c in counts})
        place, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(languages)}
        seen = np.zeros((len(words), len(languages)))
        for word, language, number in counts:
            seen[place[word], column[language]] += number
        cut = [(i, (MARK + w)[j : j + LETTERS_CUT]) for i, w in enumerate(words) for j in range(0, len(w) + 1, LETTERS_CUT)]
        seen, texts = seen[[i for i, _ in cut]], [t for _, t in cut]
        runs = [(run, Lattice([texts[i] for i in run], model.hashes, model.longest)) for run in by_length(texts)]
        for _ in range(rounds):
            expected = np.zeros_like(model.probs)
            letters = np.zeros(len(languages))
            for run, lattice in runs:
                alpha = forward(lattice, model.probs, model.single)
                beta = [np.zeros_like(alpha[0])] * lattice.n + [np.ones_like(alpha[0])]
                scale = seen[run] / np.maximum(alpha[-1], 1e-300)
                for i in range(lattice.n - 1, -1, -1):
                    total = np.zeros_like(alpha[0])
                    for stop in range(i + 1, min(lattice.n, i + lattice.longest) + 1):
                        part = lattice.parts[i, stop]
                        p = model.probs[part]
                        if stop == i + 1:
                            p = np.where((part < 0)[:, None], model.single, p)
                        flow = p * beta[stop]
                        total += flow
                        weight = alpha[i] * flow * scale
                        np.add.at(expected, part, weight)
                    beta[i] = total
            letters = expected[-1].copy()
            expected[-1] = 0
            total = expected.sum(0) + letters + 0.05 * size + 1
            model.probs[:-1] = (expected[:-1] + 0.05) / total
            model.single = 0.01 * (letters + 1) / total
        return model

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language; an empty word has 0."""
        out = np.zeros((len(words), len(self.languages)))
        texts, owner = [], []
        for i, w in enumerate(words):
            if len(w) >= LETTERS_CUT:
                out[i] = self.score_long(MARK + w)
            elif w:
                texts.append(MARK + w)
                owner.append(i)
        if texts:
            owner = np.array(owner)
            for run in by_length(texts):
                value = np.log(np.maximum(forward(Lattice([texts[i] for i in run], self.hashes, self.longest), self.probs, self.single)[-1], 1e-300))
                np.add.at(out, owner[run], value)
        return out


    def score_long(self, word: str) -> np.ndarray:
        """As score_words() for one word of any length: the last sums alone are held, and scaled as they become small."""
        if self.table is None:
            self.table = dict(zip(self.pieces, self.probs, strict=False))
        last, logs = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for stop in range(1, len(word) + 1):
            total = np.zeros(len(self.languages))
            for size in range(1, min(len(last), self.longest) + 1):
                p = self.table.get(word[stop - size : stop], self.single if size == 1 else None)
                if p is not None:
                    total = total + last[-size] * p
            last = [*last[-self.longest + 1 :], total] if self.longest > 1 else [total]
            if stop % 16 == 0:
                scale = np.maximum(np.max(last, axis=0), 1e-300)
                last, logs = [x / scale for x in last], logs + np.log(scale)
        return logs + np.log(np.maximum(last[-1], 1e-300))


def train(docs: DataFrame, vocab: str | None = None, sample: int = SAMPLE) -> Model | None:
    """Fit on about `sample` labelled documents of each language that are not held out; None if there are none.

    The sample is a fixed fraction by a hash of doc_id, taken in the scan. Counting is distributed, and the counts of the
    sample's different words, all of them, come to the driver: that many documents bound them.
    """
    spark = with_workers(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n)))), F.col("lang"))
    part = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                lists = words_of(batch.column(1))
                parents = pc.list_parent_indices(lists)
                table = pa.table({"lang": batch.column(0).take(parents), "word": lists.flatten()})
                table = table.filter(pc.not_equal(table["word"], "")).group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    counts = part.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = sorted((r["word"], r["lang"], r["n"]) for r in counts.collect())
    return Model.fit(rows, vocabulary(vocab or default_vocabulary())) if rows else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and score to docs, from text alone.

    score is the probability of the language among the learned ones, all equally likely before. Null texts, texts without
    letters, and all texts if nothing could be learned, get `und` and 0. Ties go to the first language in order. Whole texts
    are read however long; an empty table stays empty; columns of docs named lang_pred or score are replaced.
    """
    spark = with_workers(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts):
        import pandas as pd

        m = held.value
        return pd.concat([_judge(m, texts.iloc[i : i + 2000]) for i in range(0, len(texts), 2000)] or [_judge(m, texts)])

    (judged,) = unused(docs.columns, "judged")
    rows = docs.withColumn(judged, judge(text_or_empty()))
    return rows.select(*docs.columns, F.col(judged)["lang_pred"].alias("lang_pred"), F.col(judged)["score"].alias("score"))


def _judge(model: Model | None, texts):
    import pandas as pd

    if model is None or not len(texts):
        return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
    lists = words_of(pa.array(texts, pa.string()))
    coded = lists.flatten().dictionary_encode()
    value = model.score_words(coded.dictionary.to_pylist())
    words, ends = coded.indices.to_numpy(), np.asarray(lists.offsets)
    logs = np.add.reduceat(value[words], ends[:-1])
    some = np.add.reduceat((value[words, 0] != 0).astype(np.int64), ends[:-1]) > 0
    best = logs.argmax(1)
    score = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
    names = np.array(model.languages, dtype=object)[best]
    names[~some] = UNKNOWN
    return pd.DataFrame({"lang_pred": names, "score": np.where(some, score, 0.0)})


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The documents whose language could be told: not `und`, and a score of at least `least`; all columns as in docs.

    Null texts and texts without letters go. Repeated rows stay or go together; an empty table stays empty.
    """
    told, score = unused(docs.columns, "told", "score")
    judged = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model).withColumnsRenamed({"lang_pred": told, "score": score})
    return judged.where((F.col(told) != UNKNOWN) & (F.col(score) >= least)).select("row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
