"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; per language only their probabilities are learned
(expectation-maximisation over word counts). A word's probability is the sum over all its segmentations
into pieces, by the forward algorithm; pieces do not cross words, so a text's is the product over its words,
and each distinct word is scored once per worker. Learning reads a bounded sample of labelled rows, chosen
by hash: ``sample_docs`` whole documents per language. Prediction covers all rows and whole texts.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, row_key, worker_model

UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}+")
START = "▁"  # word start, as the vocabulary writes it
#: longer words are scored in blocks of so many letters (no piece crosses a block)
BLOCK = 40
#: probability of a letter that is no piece, in every language
UNKNOWN = 1e-7
SMOOTHING = 0.05
ROUNDS = 3
SAMPLE_DOCS = 1000
CACHE_WORDS = 400_000
TEXTS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of letters, found by a rolling hash of their code points."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        h = np.array([self.hash_one(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order
        assert len(np.unique(h)) == len(h)

    @staticmethod
    def hash_one(piece: str) -> int:
        h = 0
        for ch in piece:
            h = ((h + ord(ch) + 1) * int(MIX)) % (1 << 64)
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, len(pieces) where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], len(self.pieces))

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: (start, length) -> piece number of each word's slice."""
        n = len(words[0])
        chars = np.array([list(map(ord, w)) for w in words], np.uint64).reshape(len(words), n)
        out, roll = {}, np.zeros((len(words), n), np.uint64)
        for size in range(1, min(self.longest, n) + 1):
            roll = (roll[:, :n - size + 1] + chars[:, size - 1:] + np.uint64(1)) * MIX
            found = self.find(roll)
            for s in range(n - size + 1):
                out[s, size] = found[:, s]
        return out


def load_vocabulary(model_path: str) -> list[str]:
    """The letter pieces (with or without word start) of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    letters = {p for p in pieces if LETTERS.fullmatch(p.removeprefix(START).lower() or "a") and p == p.lower()}
    return sorted(letters)


def vocabulary(model_path: str) -> Vocabulary:
    """One vocabulary a worker process; the path must be readable on every executor."""
    return worker_model(("pieces", model_path), lambda: Vocabulary(load_vocabulary(model_path)))


def words_of(text: str) -> list[str]:
    """Lower-cased letter runs with their word start, long ones in blocks."""
    found = LETTERS.findall(text.lower())
    if any(len(w) > BLOCK for w in found):
        return [w[i:i + BLOCK] if i else START + w[:BLOCK] for w in found for i in range(0, len(w), BLOCK)]
    return [START + w for w in found]


def _by_length(words: list[str]):
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(len(w), []).append(i)
    return ((n, x[i:i + 20_000]) for n, x in at.items() for i in range(0, len(x), 20_000))


def _weights(vocab, lattice, probs):
    """(start, length) -> probability of that slice, [words, languages]; single letters that are no piece get UNKNOWN."""
    out = {}
    for (s, size), ids in lattice.items():
        p = probs[ids]
        if size == 1:
            p = np.where((ids == len(vocab.pieces))[:, None], UNKNOWN, p)
        out[s, size] = p
    return out


def forward(vocab: Vocabulary, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the sum over all segmentations, [words, languages]. probs: [pieces + 1, languages], last row 0."""
    out = np.zeros((len(words), probs.shape[1]))
    for n, at in _by_length(words):
        w = _weights(vocab, vocab.lattice([words[i] for i in at]), probs)
        alpha = [np.ones((len(at), probs.shape[1]))]
        for j in range(1, n + 1):
            alpha.append(sum(alpha[j - size] * w[j - size, size] for size in range(1, min(vocab.longest, j) + 1)))
        out[at] = np.log(alpha[n])
    return out


def expected_counts(vocab: Vocabulary, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over ``words`` (forward-backward); probs: [pieces + 1, 1]."""
    out = np.zeros(len(vocab.pieces) + 1)
    for n, at in _by_length(words):
        lattice = vocab.lattice([words[i] for i in at])
        w = {k: v[:, 0] for k, v in _weights(vocab, lattice, probs).items()}
        sizes = range(1, min(vocab.longest, n) + 1)
        alpha, beta = [np.ones(len(at))], {n: np.ones(len(at))}
        for j in range(1, n + 1):
            alpha.append(sum(alpha[j - z] * w[j - z, z] for z in sizes if z <= j))
        for j in range(n - 1, -1, -1):
            beta[j] = sum(beta[j + z] * w[j, z] for z in sizes if j + z <= n)
        share = counts[at] / alpha[n]
        for (s, z), ids in lattice.items():
            np.add.at(out, ids, alpha[s] * w[s, z] * beta[s + z] * share)
    out[-1] = 0
    return out


def _normalised(counts: np.ndarray) -> np.ndarray:
    p = (counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts))
    return np.append(p, 0.0)


def learn(docs: DataFrame, vocab_path: str, train: Column, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, probabilities [pieces + 1, languages]) from the rows where ``train`` holds, text and language are
    not null. Per language the ``sample_docs`` rows of least hash, whole texts. The model holds one number per
    piece and language, whatever the input."""
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    # only rows whose hash is small enough for about four times the sample meet in a task
    ids = rows.select(*row_key(id_col, text_col), F.col(lang_col).alias("_l")).withColumn(
        "_u", F.expr("shiftrightunsigned(xxhash64(_id, _th), 11) / 9007199254740992D"))
    sizes = materialize(ids.groupBy("_l").agg(F.count(F.lit(1)).alias("_size")), "languages")
    order = Window.partitionBy("_l").orderBy("_u", "_id", "_th")
    chosen = (ids.join(F.broadcast(sizes), "_l").where(F.col("_u") * F.col("_size") < 4 * sample_docs)
              .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_docs).select("_id", "_th").distinct())
    sample = (rows.select(*row_key(id_col, text_col), F.col(lang_col).alias("_l"), F.col(text_col).alias("_text"))
              .join(F.broadcast(chosen), ["_id", "_th"]).select("_l", "_text"))  # at most sample_docs ids a language

    def count(batches):
        for b in batches:
            total: dict[tuple[str, str], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_of(text):
                    total[lang, w] = total.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in total], "word": [k[1] for k in total],
                                              "n": pa.array(list(total.values()), pa.int64())},
                                             schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    words = materialize(sample.mapInArrow(count, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition("lang", "word"), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())  # the label set
    vocab = vocabulary(vocab_path)
    size = len(vocab.pieces)
    model = {lang: _normalised(np.ones(size)) for lang in langs}

    for _ in range(rounds):
        def expect(batches, model=model):
            voc = vocabulary(vocab_path)
            for b in batches:
                lang, word, n = (np.array(c.to_pylist(), dtype=object) for c in b.columns)
                for x in dict.fromkeys(lang):
                    at = np.flatnonzero(lang == x)
                    got = expected_counts(voc, model[x][:, None], word[at].tolist(), n[at].astype(float))
                    ids = np.flatnonzero(got > 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(ids), pa.string()), pa.array(ids), pa.array(got[ids])],
                                                     names=["lang", "piece", "c"])

        got = words.mapInArrow(expect, "lang string, piece long, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c"))
        counts = {lang: np.zeros(size) for lang in langs}
        for r in got.collect():  # at most pieces x languages
            counts[r.lang][r.piece] = r.c
        model = {lang: _normalised(c) for lang, c in counts.items()}
    return langs, np.stack([model[x] for x in langs], axis=1) if langs else np.zeros((size + 1, 0))


class Scorer:
    """Texts to (language, posterior), with a bounded memory of words."""

    def __init__(self, vocab: Vocabulary, langs: list[str], probs: np.ndarray):
        self.vocab, self.langs, self.probs = vocab, langs, probs
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def rows(self, words: list[str]) -> np.ndarray:
        distinct = dict.fromkeys(words)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.table, new = {}, self.table[:0], list(distinct)
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
            if len(self.known) > len(self.table):
                room = np.zeros((max(2 * len(self.table), len(self.known)) - len(self.table), len(self.langs)))
                self.table = np.concatenate([self.table, room])
            self.table[at:at + len(new)] = forward(self.vocab, self.probs, new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = [], []
        for i in range(0, len(texts), TEXTS):
            words = [words_of(t or "") for t in texts[i:i + TEXTS]]
            rows = self.rows(list(itertools.chain.from_iterable(words)))
            ends = np.cumsum([len(w) for w in words])
            for w, end in zip(words, ends.tolist()):
                if not w or not self.langs:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                log = self.table[rows[end - len(w):end]].sum(axis=0)
                best = int(log.argmax())  # the first of equal ones
                pred.append(self.langs[best])
                score.append(float(1 / np.exp(log - log[best]).sum()))
        return pred, score


def scorer(vocab_path: str, key: str, model) -> Scorer:
    """One scorer a worker process and model: its words last over tasks."""
    return worker_model(("scorer", key), lambda: Scorer(Vocabulary(load_vocabulary(vocab_path)), *model.value))


def predict(docs: DataFrame, vocab_path: str, langs: list[str], probs: np.ndarray, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_score`` added (whole texts; nothing is shuffled)."""
    model = docs.sparkSession.sparkContext.broadcast((langs, probs))  # pieces x languages numbers
    key = uuid.uuid4().hex

    def run(batches):
        own = scorer(vocab_path, key, model)
        for b in batches:
            pred, score = own.predict(b.column(0).field(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["_row", "_lang_pred", "_score"])

    kind = f"_row {docs.schema.simpleString()}, _lang_pred string, _score double"
    return (docs.select(F.struct("*").alias("_row"))
            .mapInArrow(run, kind).select("_row.*", "_lang_pred", "_score"))


def language_id(docs: DataFrame, vocab_path: str, train: Column, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id",
                text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``_lang_pred`` (a learned language, or ``und``) and ``_score`` (its posterior, 0 to 1) added.

    Learned only from text and language of the rows where ``train`` holds; prediction reads the text alone. Null text
    and text without a letter is ``und`` with score 0, and so is everything if there is nothing to learn from. Ties go to
    the first language in order. Repeated rows get the same result each; rows without an id are told apart by their
    text; an empty table gives an empty result; columns of other names pass through."""
    langs, probs = learn(docs, vocab_path, train, sample_docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, vocab_path, langs, probs, id_col, text_col)
