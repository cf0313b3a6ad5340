"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary (a sentencepiece model file; only its piece strings are used) have a probability
for each language. A word's probability under a language is the sum over all its segmentations into pieces of the
product of their probabilities, computed by a forward recursion; a text's is the product over its words. Words are
lower-cased runs of letters with the vocabulary's mark in front; a run of more than ``BLOCK`` characters is learned
and scored in blocks of that length. A character that no piece covers has a fixed small probability.

Probabilities are learned by expectation maximisation (forward-backward over all segmentations) from word counts of a
bounded sample of labelled rows: about ``sample_docs`` documents of each language, chosen by the hash of their id and
text, with all their words. Scoring covers whole texts of all documents in one pass, without a shuffle; a task remembers the words
it met, up to ``REMEMBERED``.

A text that is null or without letters is ``und`` with score 0; so is every text if nothing could be learned. Ties go
to the language that sorts first. The score is the posterior under equal priors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release_memory, small

UNDETERMINED = "und"
BLOCK = 48
REMEMBERED = 100_000
#: Words whose segmentations are summed at once.
TOGETHER = 4_000
MARK = "▁"
#: Keeps products of up to BLOCK + 1 characters in a double's range; cancels between languages.
SCALE = 24.0
STRAY = 1e-6
#: Runs of letters and of the numbers that count as word characters (such as ½); the latter part words as all else does.
LETTERS = re.compile(r"[^\W\d_]+")


def split_words(text: str) -> list[str]:
    """The lower-cased runs of letters (general category L)."""
    words = LETTERS.findall(text.lower())
    if not words or "".join(words).isalpha():
        return words
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Pieces:
    """The vocabulary as a trie in an open-addressing table: (node, character) -> node."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        edges: dict[tuple[int, int], int] = {}
        ends = {0: -1}
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = edges.setdefault((node, ord(c)), len(edges) + 1)
                ends.setdefault(node, -1)
            ends[node] = i
        self.end = np.array([ends[n] for n in range(len(edges) + 1)], np.int32)
        self.longest = max(map(len, pieces), default=1)
        size = 1 << max(4, (len(edges) * 4).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.probes = 1
        places = self.place(np.array([(n << 21) | c for n, c in edges], np.int64)).tolist() if edges else []
        for (n, c), node, at in zip(edges, edges.values(), places, strict=True):
            for k in range(size):
                if self.keys[(at + k) % size] < 0:
                    self.keys[(at + k) % size], self.to[(at + k) % size] = (n << 21) | c, node
                    self.probes = max(self.probes, k + 1)
                    break

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def go(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by a character, or -1; -1 stays."""
        keys = (nodes.astype(np.int64) << 21) | chars
        at, out = self.place(keys), np.full(len(nodes), -1, np.int32)
        open_ = np.flatnonzero(nodes >= 0)
        for k in range(self.probes):
            if not len(open_):
                break
            where = (at[open_] + k) & (len(self.keys) - 1)
            held = self.keys[where]
            hit = held == keys[open_]
            out[open_[hit]] = self.to[where[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids by (length - 1, word, start), -1 for none, of marked words of one length; and the characters."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
        n, size = chars.shape
        found = np.full((min(self.longest, size), n, size), -1, np.int32)
        node = np.zeros((n, size), np.int32)
        for k in range(len(found)):
            last = size - k
            node = self.go(node[:, :last].ravel(), chars[:, k:].ravel()).reshape(n, last)
            found[k, :, :last] = np.where(node >= 0, self.end[node], -1)
            if (node < 0).all():
                return found[: k + 1], chars
        return found, chars


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and marked words of each length, in parts of bounded size."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), TOGETHER):
            part = at[k : k + TOGETHER]
            yield part, [MARK + words[i] for i in part]


def forward(found: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """(position, word, language): the scaled sum over all segmentations of the first characters."""
    lengths, n, size = found.shape
    total = np.zeros((size + 1, n, prob.shape[1]))
    total[0] = 1.0
    for t in range(1, size + 1):
        for k in range(min(lengths, t)):
            piece = found[k, :, t - k - 1]
            if k == 0:
                total[t] += total[t - 1] * np.where(piece[:, None] >= 0, prob[piece] * SCALE, STRAY * SCALE)
            elif len(hit := np.flatnonzero(piece >= 0)):
                total[t, hit] += total[t - k - 1, hit] * prob[piece[hit]] * SCALE ** (k + 1)
    return total


def backward(found: np.ndarray, prob: np.ndarray) -> np.ndarray:
    lengths, n, size = found.shape
    total = np.zeros((size + 1, n, prob.shape[1]))
    total[size] = 1.0
    for t in range(size - 1, -1, -1):
        for k in range(min(lengths, size - t)):
            piece = found[k, :, t]
            if k == 0:
                total[t] += total[t + 1] * np.where(piece[:, None] >= 0, prob[piece] * SCALE, STRAY * SCALE)
            elif len(hit := np.flatnonzero(piece >= 0)):
                total[t, hit] += total[t + k + 1, hit] * prob[piece[hit]] * SCALE ** (k + 1)
    return total


def word_scores(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probabilities (word, language), up to a constant for each word."""
    out = np.zeros((len(words), prob.shape[1]))
    blocks, owner = [], []
    for i, w in enumerate(words):
        for k in range(0, len(w), BLOCK):
            blocks.append(w[k : k + BLOCK])
            owner.append(i)
    for at, part in by_length(blocks):
        found, _ = pieces.spans(part)
        with np.errstate(divide="ignore"):
            np.add.at(out, np.array(owner)[at], np.log(forward(found, prob)[-1]))
    return out


def fit(pieces: Pieces, counts: pd.DataFrame, languages: list[str], rounds: int = 3) -> np.ndarray:
    """(piece, language) probabilities from rows (lang, word, n) by expectation maximisation."""
    prob = np.full((len(pieces.pieces), len(languages)), 1.0 / max(1, len(pieces.pieces)))
    for j, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        blocks = [(w[k : k + BLOCK], n) for w, n in zip(own["word"], own["n"], strict=True) for k in range(0, len(w), BLOCK)]
        words, weight = [w for w, _ in blocks], np.array([n for _, n in blocks], float)
        parts = [(at, pieces.spans(part)[0]) for at, part in by_length(words)]
        p = prob[:, j : j + 1].copy()
        for _ in range(rounds):
            seen = np.zeros(len(p))
            for at, found in parts:
                ahead, behind = forward(found, p), backward(found, p)
                scale = weight[at] / ahead[-1][:, 0]
                for k in range(len(found)):
                    for t in range(found.shape[2] - k):
                        hit = np.flatnonzero(found[k, :, t] >= 0)
                        piece = found[k, hit, t]
                        use = ahead[t, hit, 0] * p[piece, 0] * SCALE ** (k + 1) * behind[t + k + 1, hit, 0]
                        np.add.at(seen, piece, use * scale[hit])
            p = ((seen + 0.05) / (seen.sum() + 0.05 * len(p)))[:, None]
        prob[:, j] = p[:, 0]
    return prob


def read_pieces(vocabulary: str) -> list[str]:
    """The lower-case ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)}
    return sorted(p for p in pieces if p == p.lower() and LETTERS.fullmatch(p.removeprefix(MARK) or "a") and MARK not in p[1:])


def train(labelled: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 400) -> dict:
    """A model from the rows of ``labelled`` with text and language; ``sample_docs`` bounds the sample of each language."""
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    sizes = known.groupBy("__lang").agg(F.count("*").alias("__n"))
    rate = F.lit(float(sample_docs)) / F.col("__n")
    uniform = F.pmod(F.xxhash64("__id", "__text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = materialize(sizes)
    sample = known.join(small(sizes, sizes.count()), "__lang").where(uniform < rate)
    word = F.regexp_extract_all(F.lower("__text"), F.lit(r"(\p{L}+)"), F.lit(1))
    counts = (
        sample.select(F.col("__lang").alias("lang"), F.explode(word).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .toPandas()  # the words of the bounded sample
        .sort_values(["lang", "word"], ignore_index=True)
    )
    languages = sorted(counts["lang"].unique().tolist())
    pieces = read_pieces(vocabulary)
    prob = fit(Pieces(pieces), counts, languages) if languages else np.zeros((len(pieces), 0))
    return {"pieces": pieces, "languages": languages, "prob": prob.astype(np.float32)}


class Scorer:
    """Scores texts, remembering words."""

    def __init__(self, model: dict) -> None:
        self.pieces, self.languages, self.prob = Pieces(model["pieces"]), model["languages"], model["prob"].astype(float)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Summed log-probabilities (text, language); NaN for texts without letters."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number, ids, sizes = self.number, [], []
        for t in texts:
            words = split_words(t) if t else []
            sizes.append(len(words))
            ids += [number.setdefault(w, len(number)) for w in words]
        new = list(number)[len(self.scores) :] if len(number) > len(self.scores) else []
        if new:
            self.scores = np.concatenate([self.scores, word_scores(self.pieces, self.prob, new)])
        total = np.full((len(texts), len(self.languages)), np.nan)
        sizes = np.array(sizes)
        if ids:
            some = np.flatnonzero(sizes)
            total[some] = np.add.reduceat(self.scores[np.array(ids)], (np.cumsum(sizes) - sizes)[some])
        return total

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": np.zeros(len(texts))})
        out = [self.texts(texts[k : k + 500]) for k in range(0, len(texts), 500)]
        total = np.concatenate(out) if out else np.zeros((0, len(self.languages)))
        none = np.isnan(total).any(axis=1)
        total[none] = 0.0
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(axis=1)
        named = np.array(self.languages, object)[best]
        named[none] = UNDETERMINED
        return pd.DataFrame({"lang_pred": named, "score": np.where(none, 0.0, score)})


_scorers: dict[int, Scorer] = {}


def predicted(text: Column, model: dict) -> Column:
    """The struct (lang_pred, score) of a text."""
    key = hash((tuple(model["languages"]), model["prob"].tobytes()))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(model)
        for texts in batches:
            yield _scorers[key].predict(list(texts))
        _scorers[key].forget()
        release_memory()

    return predict(text)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id's text falls in the fold that training leaves out; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def identify(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learned from its own labelled rows outside the held-out fold."""
    out = held_out(F.col(doc_id))
    model = train(docs.where(~out), vocabulary, doc_id=doc_id, text=text, lang=lang, **bounds)
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    scored = docs.select(*kept, out.alias("held_out"), predicted(F.col(text), model).alias("__p"))
    return scored.select(*kept, "held_out", F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))
