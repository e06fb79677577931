"""Word-level language identification by a linear-chain conditional random field.

Every word of a text gets a distribution over languages by forward-backward, so a text that switches language is labelled
word by word. Emission scores add the weights of a word's features: affixes, character n-grams, and whether a learned
lexicon holds the word. Transitions between the languages of neighbouring words are learned with them. A document's
language is the one with the largest mean marginal, and that mean is its score.

The field is fitted on the driver from a bounded sample (``PER_LANGUAGE`` documents of each language, ``SAMPLE_WORDS`` words
of each); prediction covers every word of every text, row-locally, and needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the training sample.
PER_LANGUAGE, SAMPLE_WORDS = 400, 400
# Words of a training sequence; a sequence is made of runs, each from one document.
SEQUENCE = 40
# Lexicon entries per language, and the documents that a word must be in.
LEXICON, LEXICON_DOCS = 2000, 3
# Words that one step of forward-backward takes together.
BLOCK = 64
# Characters of the texts that are predicted together.
CHARS = 1 << 20
# Words whose scores a worker remembers, and their longest; the memo is emptied when full.
MEMO, LONGEST = 1 << 20, 64

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
ASCII = re.compile(r"[A-Za-z]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text: runs of letters with their marks. Numerals are no letters."""
    if not text:
        return []
    return ASCII(text.lower()) if text.isascii() else list(map(str.lower, LETTERS(text)))


def features(word: str) -> list[str]:
    """Names of a word's affix and n-gram features; every character of a word counts, however long it is."""
    w = f"^{word}$"
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    return [*grams, *word, "p" + word[:2], "q" + word[:3], "s" + word[-2:], "t" + word[-3:], "u" + word[-4:]]


class Field:
    """A fitted field; ``memo`` maps a lower-case word to its row in ``scores``, the emission scores."""

    def __init__(self, languages: list[str], names: dict[str, int], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, int]):
        self.languages, self.names, self.weights, self.moves, self.lexicon = languages, names, weights, moves, lexicon
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)), np.float32)

    def __reduce__(self):
        return Field, (self.languages, self.names, self.weights, self.moves, self.lexicon)

    def rows(self, word: str) -> list[int]:
        found = [self.names[f] for f in features(word) if f in self.names]
        if word in self.lexicon:
            found.append(self.names[f"lexicon {self.lexicon[word]}"])
        return found

    def __getitem__(self, word: str) -> np.ndarray:
        """Emission scores of one lower-case word."""
        return self.weights[self.rows(word)].sum(0)

    def learn(self, words: list[str]) -> None:
        """Score words that are not yet known, all at once."""
        rows = [self.rows(w) for w in words]
        # Each word also takes the last weight, which is zero, so that none has no feature.
        flat = np.fromiter((i for row in rows for i in (*row, len(self.weights))), np.int64)
        starts = np.cumsum([0, *(len(row) + 1 for row in rows[:-1])])
        padded = np.vstack([self.weights, np.zeros_like(self.weights[:1])])
        first = len(self.memo)
        fresh = np.add.reduceat(padded[flat], starts, axis=0)
        if first + len(words) > len(self.scores):
            self.scores = np.vstack([self.scores[:first], np.zeros((first + 2 * len(words) + 1024, len(self.languages)), np.float32)])
        self.scores[first : first + len(words)] = fresh
        self.memo.update(zip(words, range(first, first + len(words))))

    def predict(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """Language and score of each text; ``(None, 0.0)`` for a text without letters."""
        found = list(map(words_of, texts))
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        some = [i for i, words in enumerate(found) if words]
        if not some:
            return out
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = sorted(set().union(*found).difference(self.memo), key=len)
        if new:
            self.learn(new)
        sizes = np.array([len(found[i]) for i in some])
        at = np.fromiter((r for i in some for r in map(self.memo.__getitem__, found[i])), np.int64, int(sizes.sum()))
        sums = marginal_sums(self.scores[at], self.moves, sizes)
        # Long words are the newest and the last ones of them; their rows are free again.
        for word in reversed(new):
            if len(word) <= LONGEST:
                break
            del self.memo[word]
        share = sums / sizes[:, None]
        best = share.argmax(1)
        for i, k, row in zip(some, best.tolist(), share):
            out[i] = self.languages[k], float(min(1.0, row[k]))
        return out


def marginal_sums(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over each sequence's words of their marginals; ``scores`` holds the sequences one after another.

    Forward-backward in blocks: every block's transfer matrix first, then the messages between the blocks of a
    sequence, then the words within all blocks at once.
    """
    k = moves.shape[0]
    step = np.exp(moves - moves.max())
    counts = -(-sizes // BLOCK)
    blocks = int(counts.sum())
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    within = np.arange(blocks) - first[owner]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    begin = starts[owner] + within * BLOCK
    length = np.minimum(BLOCK, sizes[owner] - within * BLOCK)
    emit = np.exp(scores - scores.max(1, keepdims=True))
    steps = range(int(length.max()))

    # A row of a transfer matrix: weights after a block that was entered in one state. Entering has a move, but for the first word.
    transfer = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    starting = within == 0
    for t in steps:
        on = np.flatnonzero(length > t)
        now = transfer[on]
        if t:
            now = now @ step
        else:
            now[~starting[on]] = now[~starting[on]] @ step
        now *= emit[begin[on] + t][:, None, :]
        transfer[on] = now / now.sum((1, 2), keepdims=True)

    into = np.full((blocks, k), 1.0 / k)
    after = np.full((blocks, k), 1.0 / k)
    for b in range(1, int(counts.max())):
        here = first[counts > b] + b
        passed = np.einsum("nk,nkj->nj", into[here - 1], transfer[here - 1])
        into[here] = passed / passed.sum(1, keepdims=True)
    for b in range(int(counts.max()) - 2, -1, -1):
        here = first[counts > b + 1] + b
        passed = np.einsum("nkj,nj->nk", transfer[here + 1], after[here + 1])
        after[here] = passed / passed.sum(1, keepdims=True)

    ahead = np.empty((len(steps), blocks, k))
    state = into
    for t in steps:
        on = np.flatnonzero(length > t)
        now = state[on]
        moved = now @ step if t else np.where(starting[on, None], now, now @ step)
        moved = moved * emit[begin[on] + t]
        state = state.copy()
        state[on] = moved / moved.sum(1, keepdims=True)
        ahead[t] = state
    total = np.zeros((blocks, k))
    state = after
    for t in reversed(steps):
        on = np.flatnonzero(length > t)
        both = ahead[t][on] * state[on]
        total[on] += both / both.sum(1, keepdims=True)
        back = (state[on] * emit[begin[on] + t]) @ step.T
        state = state.copy()
        state[on] = back / back.sum(1, keepdims=True)
    return np.add.reduceat(total, first, axis=0)


def pairwise(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected moves of sequences of one length, (n, t, k) scores."""
    step = np.exp(moves)
    e = np.exp(emit - emit.max(2, keepdims=True))
    n, t, _ = e.shape
    ahead, behind = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        now = (ahead[:, i - 1] @ step) * e[:, i]
        ahead[:, i] = now / now.sum(1, keepdims=True)
    moved = np.zeros_like(moves)
    for i in range(t - 2, -1, -1):
        right = behind[:, i + 1] * e[:, i + 1]
        joint = ahead[:, i][:, :, None] * step * right[:, None, :]
        moved += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        now = right @ step.T
        behind[:, i] = now / now.sum(1, keepdims=True)
    both = ahead * behind
    return both / both.sum(2, keepdims=True), moved


def train(rows: list[tuple[str, str]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Field:
    """Fit the field to (text, language) rows.

    Training sequences are runs of 5 to 40 words from documents of changing languages, so that moves are learned where
    language switches. The result depends on the set of rows only, not their order. Without rows there is no language.
    """
    random = np.random.default_rng(seed)
    texts = [(words_of(t), lang) for t, lang in sorted(set(rows))]
    texts = [(words, lang) for words, lang in texts if words]
    languages = sorted({lang for _, lang in texts})
    if not texts:
        return Field([], {}, np.zeros((0, 0)), np.zeros((0, 0)), {})
    counted = {lang: Counter(w for words, of in texts if of == lang for w in set(words)) for lang in languages}
    lexicon: dict[str, int] = {}
    for k, lang in enumerate(languages):
        most = sorted(counted[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]
        for word, n in most:
            if n >= LEXICON_DOCS and n > max((counted[o][word] for o in languages if o != lang), default=0) * 3:
                lexicon[word] = k
    names: dict[str, int] = {f"lexicon {k}": k for k in range(len(languages))}
    field = Field(languages, names, np.zeros((0, 0)), np.zeros((0, 0)), lexicon)

    runs = []
    for words, lang in texts:
        at = 0
        while at < len(words):
            size = int(random.integers(5, SEQUENCE + 1))
            runs.append((words[at : at + size], languages.index(lang)))
            at += size
    order = random.permutation(len(runs))
    stream = [(w, k) for i in order for w in runs[i][0] for k in (runs[i][1],)]
    for word in sorted({w for w, _ in stream}):
        for f in features(word):
            names.setdefault(f, len(names))
    rows_of = {w: field.rows(w) for w in {w for w, _ in stream}}
    size, k = len(names), len(languages)
    weights, moves = np.zeros((size, k)), np.zeros((k, k))
    seen_w, seen_m = np.full((size, k), 1e-6), np.full((k, k), 1e-6)
    sequences = [stream[i : i + SEQUENCE] for i in range(0, len(stream), SEQUENCE)]
    for _ in range(rounds):
        for start in range(0, len(sequences), 64):
            part = sequences[start : start + 64]
            for length in sorted({len(s) for s in part}):
                same = [s for s in part if len(s) == length]
                flat = [rows_of[w] for s in same for w, _ in s]
                ids = np.fromiter((i for r in flat for i in r), int)
                word = np.repeat(np.arange(len(flat)), [len(r) for r in flat])
                emit = np.zeros((len(flat), k))
                np.add.at(emit, word, weights[ids])
                gold = np.array([y for s in same for _, y in s])
                share, moved = pairwise(emit.reshape(len(same), length, k), moves)
                short = -share.reshape(-1, k)
                short[np.arange(len(gold)), gold] += 1
                pushed = np.zeros((size, k))
                np.add.at(pushed, ids, short[word])
                touched = np.unique(ids)
                pushed = pushed[touched] / len(same) - decay * weights[touched]
                seen_w[touched] += pushed**2
                weights[touched] += rate * pushed / np.sqrt(seen_w[touched])
                y = gold.reshape(len(same), length)
                had = np.zeros((k, k))
                np.add.at(had, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
                push = (had - moved) / len(same) - decay * moves
                seen_m += push**2
                moves += rate * push / np.sqrt(seen_m)
    field.weights, field.moves = weights.astype(np.float32), moves
    return field


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The bounded sample: of each language the documents with the smallest hash of key, ``SAMPLE_WORDS`` words of each.

    Documents are drawn by their keys alone; texts are read for the drawn ones, whose number is bounded. The words start at a
    place that the hash decides. Rows without text, language or key are no training rows; of a repeated key one text counts.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("k is not null and t is not null and l is not null")
    order = Window.partitionBy("l").orderBy("h", "k")
    keys = rows.select("l", "k", F.xxhash64("k").alias("h"))
    drawn = keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_LANGUAGE).select("l", "k").distinct()
    words = F.split("t", r"[\x20\x09-\x0D]+")
    room = F.greatest(F.size("w") - SAMPLE_WORDS, F.lit(0)) + 1
    cut = F.array_join(F.slice("w", F.pmod(F.xxhash64("k"), room).cast("int") + 1, SAMPLE_WORDS), " ")
    found = rows.join(F.broadcast(drawn), ["l", "k"]).select("l", "k", words.alias("w")).select("l", "k", cut.alias("text"))
    return found.groupBy("l", "k").agg(F.min("text").alias("text")).select("text", F.col("l").alias("lang"))


def held_out(key: str = "doc_id") -> Column:
    """The third of the documents that nothing is learned from; a null key is not held out, nor learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Field:
    sample = training_rows(docs.where(~held_out(key)), key, text, lang)
    return train([(r[0], r[1]) for r in sample.collect()])


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts that are predicted together: up to ``CHARS`` characters, or one text that has more."""
    part, held = [], 0
    for text in texts:
        size = len(text or "")
        if part and held + size > CHARS:
            yield part
            part, held = [], 0
        part.append(text)
        held += size
    if part:
        yield part


def identify(docs: DataFrame, field: Field, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with a predicted language and score of each whole text, row by row.

    A text that is null or has no letter, and any text if no language was learned, is ``und`` with score 0. Equal
    means go to the language that sorts first. Repeated rows get the same answer; columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("struct<lang:string,score:double>")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            out = []
            values = texts.tolist()
            for part in portions(values):
                out += model.predict(part) if model.languages else [(None, 0.0)] * len(part)
            yield pd.DataFrame({"lang": [x or "und" for x, _ in out], "score": [s for _, s in out]})

    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named(F.col(f"`{text}`")).alias("named"))
    rows = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (lang, score)]
    return told.select(*rows, F.col("named.lang").alias(lang), F.col("named.score").alias(score))
