"""Language of review notes: a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from groundcheck.llm.common import map_text

EDGES = ".,;:!?\"'()[]{}<>*#%&-_/\\0123456789@=+|~^$"
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
_MEMORY, _WORDS_AT_ONCE = 1_000_000, 400_000


def word_features(word: str, dims: int) -> list[int]:
    """Hashed features of a lower-case word: itself (lexicon), affixes and letter n-grams; none without a letter."""
    core = word.strip(EDGES)
    if not LETTER.search(core):
        return []
    names = [f"w{core}"]
    for n in (1, 2, 3):
        names += [f"p{core[:n]}", f"s{core[-n:]}"]
    edged = f"^{core}$"
    for n in (2, 3):
        names += [edged[i:i + n] for i in range(len(edged) - n + 1)]
    return sorted({zlib.crc32(x.encode("utf-8", "replace")) % dims for x in names})


@dataclass
class LanguageModel:
    """Weights of word features per language and of moves between the languages of neighbouring words."""

    languages: list[str]
    dims: int
    features: np.ndarray  # dims x languages
    moves: np.ndarray  # languages x languages
    start: np.ndarray


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences sorted by falling length: how many are alive at each step, and where the steps begin."""
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    return alive, np.concatenate([[0], np.cumsum(alive)])


def forward_backward(scores: np.ndarray, alive: np.ndarray, begins: np.ndarray, moves: np.ndarray,
                     start: np.ndarray, pairs: bool = False):
    """Posterior of each word's language, for many sequences in step; optionally the expected moves.

    ``scores`` holds the words step by step: the first words of all sequences, then the second ones, ...
    """
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    t, ahead = np.exp(moves), np.empty_like(local)
    steps = len(alive)
    for i in range(steps):
        a, b = begins[i], begins[i + 1]
        x = local[a:b] * (np.exp(start) if i == 0 else ahead[begins[i - 1]:begins[i - 1] + alive[i]] @ t)
        ahead[a:b] = x / x.sum(axis=1, keepdims=True)
    post, back = np.empty_like(local), None
    expected = np.zeros_like(moves)
    for i in range(steps - 1, -1, -1):
        a, b = begins[i], begins[i + 1]
        behind = np.ones((alive[i], local.shape[1]), local.dtype)
        if i + 1 < steps:
            n, c = alive[i + 1], begins[i + 1]
            out = local[c:c + n] * back
            behind[:n] = out @ t.T
            if pairs:
                joint = ahead[a:a + n, :, None] * t[None] * out[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = behind / behind.sum(axis=1, keepdims=True)
        x = ahead[a:b] * back
        post[a:b] = x / x.sum(axis=1, keepdims=True)
    return (post, expected) if pairs else post


def train(notes: list[str], langs: list[str], dims: int = 1 << 16, steps: int = 40, rate: float = 0.15,
          decay: float = 1e-5, seed: int = 11) -> LanguageModel:
    """Fit by maximum conditional likelihood (Adam, full batch).

    The notes are cut in runs of 4 to 40 words; runs of all languages are chained at random to sequences
    of about 60 words, so the moves are learned from switches of language.
    """
    languages = sorted(set(langs))
    n = len(languages)
    if not n:
        return LanguageModel([], dims, np.zeros((dims, 0)), np.zeros((0, 0)), np.zeros(0))
    rng, place, runs = np.random.default_rng(seed), {}, []
    for note, lang in zip(notes, langs):
        words = [place.setdefault(w, len(place)) for w in note.lower().split()]
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 41))
            runs.append((words[at:at + size], languages.index(lang)))
            at += size
    sequences, labels, words, marks = [], [], [], []
    for i in rng.permutation(len(runs)):
        words = words + runs[i][0]
        marks = marks + [runs[i][1]] * len(runs[i][0])
        if len(words) >= 60:
            sequences.append(words)
            labels.append(marks)
            words, marks = [], []
    if words:
        sequences.append(words)
        labels.append(marks)
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sizes = np.array([len(sequences[i]) for i in order])
    alive, begins = _layout(sizes)
    token, gold = np.empty(begins[-1], np.int64), np.empty(begins[-1], np.int64)
    for j, i in enumerate(order):
        at = begins[:len(sequences[i])] + j
        token[at], gold[at] = sequences[i], labels[i]
    per = [word_features(w, dims) for w in place]
    flat = np.array([f for fs in per for f in fs], np.int64)
    owner = np.repeat(np.arange(len(per)), [len(fs) for fs in per])
    used, flat = np.unique(flat, return_inverse=True)
    truth = np.eye(n)[gold]
    true_moves = np.zeros((n, n))
    for i in range(len(alive) - 1):
        np.add.at(true_moves, (gold[begins[i]:begins[i] + alive[i + 1]], gold[begins[i + 1]:begins[i + 2]]), 1)
    state = [np.zeros((len(used), n)), np.zeros((n, n)), np.zeros(n)]
    one, two = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for step in range(1, steps + 1):
        kinds = np.stack([np.bincount(owner, state[0][flat, k], len(per)) for k in range(n)], axis=1)
        post, expected = forward_backward(kinds[token], alive, begins, state[1], state[2], pairs=True)
        miss = post - truth
        kind_miss = np.stack([np.bincount(token, miss[:, k], len(per)) for k in range(n)], axis=1)
        grads = [np.stack([np.bincount(flat, kind_miss[owner, k], len(used)) for k in range(n)], axis=1),
                 expected - true_moves, miss[:alive[0]].sum(axis=0)]
        for i, p in enumerate(state):
            g = grads[i] / len(token) + decay * p
            one[i] = 0.9 * one[i] + 0.1 * g
            two[i] = 0.99 * two[i] + 0.01 * g * g
            p -= rate * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.99**step)) + 1e-10)
    features = np.zeros((dims, n))
    features[used] = state[0]
    return LanguageModel(languages, dims, features, state[1], state[2])


class Tagger:
    """Word posteriors of whole notes, many notes in step."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows, self.used = {}, 1
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)

    def _row(self, word: str) -> int:
        ids = word_features(word, self.model.dims)
        if not ids:
            self.rows[word] = 0
            return 0
        if self.used == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.used] = self.model.features[ids].sum(axis=0)
        self.rows[word] = self.used
        self.used += 1
        return self.used - 1

    def posteriors(self, notes: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word posteriors step by step, whether a word has letters, the steps' layout and the notes' order."""
        if len(self.rows) > _MEMORY:
            self.reset()
        order = np.argsort([-len(w) for w in notes], kind="stable")
        sizes = np.array([len(notes[i]) for i in order], np.int64)
        alive, begins = _layout(sizes)
        token, get = np.empty(begins[-1], np.int64), self.rows.get
        for j, i in enumerate(order):
            rows = list(map(get, notes[i]))
            if None in rows:
                rows = [self._row(w) if r is None else r for w, r in zip(notes[i], rows)]
            token[begins[:len(rows)] + j] = rows
        post = forward_backward(self.scores[token], alive, begins, self.model.moves.astype(np.float32),
                                self.model.start.astype(np.float32))
        return post, token > 0, alive, begins, order

    def shares(self, notes: list[list[str]]) -> np.ndarray:
        """Mean posterior of each language over a note's words with letters."""
        post, held, alive, begins, order = self.posteriors(notes)
        total, count = np.zeros((len(notes), post.shape[1])), np.zeros(len(notes))
        for i, n in enumerate(alive):
            a = begins[i]
            on = held[a:a + n, None]
            total[order[:n]] += post[a:a + n] * on
            count[order[:n]] += on[:, 0]
        return total / np.maximum(count, 1)[:, None]


def tag_words(model: LanguageModel, note: str) -> list[tuple[str, str]]:
    """The most likely language of every word of one note."""
    words = note.lower().split()
    if not words:
        return []
    post = Tagger(model).posteriors([words])[0]
    return [(w, model.languages[int(p.argmax())]) for w, p in zip(note.split(), post)]


def fit_language(events: DataFrame, key: str = "event_id", text: str = "notes", lang: str = "lang",
                 rows: int = 150, dims: int = 1 << 16) -> LanguageModel:
    """Learn from at most ``rows`` events of each language (those of the smallest key hash).

    Null languages and texts without a letter teach nothing.  Only the sample reaches the driver.
    """
    known = events.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"))
    first = Window.partitionBy("lang").orderBy("h", "k")
    sample = known.withColumn("h", F.xxhash64("k")).withColumn("r", F.row_number().over(first)).filter(
        F.col("r") <= rows).select("k", "lang").distinct()
    # ``rows`` keys for each language at most
    held = events.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"),
                         F.col(text).cast("string").alias("t")).filter("t is not null").join(
        F.broadcast(sample), ["k", "lang"]).dropDuplicates(["k", "lang"])
    got = held.toPandas().sort_values(["lang", "k"])
    got = got[[bool(LETTER.search(t)) for t in got["t"]]] if len(got) else got
    return train(list(got["t"]), list(got["lang"]), dims)


def predict_language(events: DataFrame, model: LanguageModel, key: str = "event_id",
                     text: str = "notes") -> DataFrame:
    """The language that most of a whole note's words are in: ``key, lang_pred, score``.

    Words are labelled by forward-backward over the whole note; ``score`` is the mean posterior of the
    predicted language over the words with letters.  A null note, a note without a letter, and every note
    under a model without languages is ``und`` with score 0.  Ties go to the first language in
    alphabetical order; repeated rows are predicted each; an empty table gives no rows.
    """
    held = events.sparkSession.sparkContext.broadcast(model)

    def predictor():
        tagger = Tagger(held.value)
        names = held.value.languages

        def run(texts):
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            part, words = [], 0

            def settle():
                for (i, _), p in zip(part, tagger.shares([w for _, w in part])):
                    best = int(p.argmax())
                    lang[i], score[i] = names[best], min(1.0, float(p[best]))

            # notes of like length go together, so few steps have few notes
            for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or "")):
                t = texts[i]
                if not t or not names or not LETTER.search(t):
                    continue
                part.append((i, t.lower().split()))
                words += len(part[-1][1])
                if words > _WORDS_AT_ONCE:
                    settle()
                    part, words = [], 0
            if part:
                settle()
            return [lang, score], None

        return run

    return map_text(events.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), "t", predictor,
                    "lang_pred string, score double", rows=10_000).withColumnRenamed("k", key)
