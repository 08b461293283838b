"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A word's subwords are its character n-grams (1 to 4, with word marks) and the word itself, hashed into a fixed number of
buckets. A run of over ``LONGEST`` characters (as in scripts without spaces) counts as overlapping words of that length, so that
all of its n-grams are read. A text is the average of its subwords' embeddings; a linear layer and softmax give the language, the
first by name where two are equally likely. Since averaging is linear, embeddings and layer are multiplied once after training: a
text's logits are the mean of its words' rows, and words are remembered. Temperature is fitted on a fold of the training sample
that training does not see; so is the score under which a prediction counts as rejected (the given quantile of the scores of right
predictions).

Only text and non-null lang of the rows outside the held-out fold are learned from: of each language the ``per_lang`` distinct texts
(or fewer, where there are more than ``most_rows`` / ``per_lang`` languages) of smallest hash; each gives ``words`` and again
``short_words`` words from places all over its text. A text counts once however often its rows are repeated. Every language that
has a text is learned, and the model has a column for each.

A null text, or one without a letter (Unicode's category L), is ``und`` with score 0. With nothing to learn from, every text is ``und``. Every row gives
one row; equal texts have equal results.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import Remembered, arrow_map, crc_fold

LONGEST = 64
#: Digits and marks that end a word; all are ASCII, so they can be replaced in UTF-8.
_BLANKED = b"0123456789.,;:!?\"'()[]{}<>|#*$%&/\\@+=_-~^`\n\t\r"
_SPACES = bytes.maketrans(_BLANKED, b" " * len(_BLANKED))


class Subwords(Remembered):
    """Buckets of n-grams, remembered but for those of whole words: most words are rare, and would drive the n-grams out."""

    def __init__(self, buckets: int):
        super().__init__(lambda gram: zlib.crc32(gram.encode("utf-8", "surrogatepass")) % buckets)

    def of(self, word: str) -> list[int]:
        marked = f"<{word}>"
        n = len(marked)
        grams = [*word, *[marked[i : i + 2] for i in range(n - 1)], *[marked[i : i + 3] for i in range(n - 2)], *[marked[i : i + 4] for i in range(n - 3)]]
        return [self.f(marked), *map(self.__getitem__, grams)]


def words_of(text: str) -> list[str]:
    words = text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).decode("utf-8", "surrogatepass").split()
    if words and max(map(len, words)) > LONGEST:
        # parts that overlap by three characters hold every n-gram
        return [part for w in words for part in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - 3, LONGEST - 3)])]
    return words


class LanguageModel:
    def __init__(self, langs: list[str], table: np.ndarray, temperature: float, floor: float, remembered: int = 300_000):
        self.langs, self.table, self.temperature, self.floor = langs, table, temperature, floor
        self.rows = np.empty((remembered + 1, table.shape[1] + 1), np.float32)  # a word's summed rows and their number
        self.word, self.subwords = Remembered(self._word, remembered), Subwords(len(table))
        self.new: list[str] = []  # words that have a number, but no row yet
        self.window = Remembered(self._window)
        self.grams = np.empty((self.window.most + 1, 4), np.int32)  # a window's n-grams
        self.padded = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])  # the last row stands for no n-gram

    def _word(self, word: str) -> int:
        self.new.append(word)
        return len(self.word)

    def _window(self, window: str) -> int:
        """A window is four characters of a marked word, or fewer at its end: its n-grams are those that begin it."""
        at = len(self.window)
        grams = [window[:n] for n in range(1 if window[0] != "<" else 2, len(window) + 1)]  # no word holds a mark, and a mark alone is no n-gram
        self.grams[at] = len(self.table)
        self.grams[at, : len(grams)] = list(map(self.subwords.__getitem__, grams))
        return at

    def _numbers(self, words: list[str]) -> list[int]:
        """The words' places in rows; the rows of all new ones are summed at once."""
        numbers = list(map(self.word.__getitem__, words))
        if self.new:
            marked = [f"<{w}>" for w in self.new]
            sizes = np.array(list(map(len, marked))) - 1
            if len(self.window) + sizes.sum() > self.window.most:
                self.window.clear()  # here, so that no number of these windows is given twice
            windows = list(map(self.window.__getitem__, [m[i : i + 4] for m in marked for i in range(len(m) - 1)]))
            rows = self.rows[len(self.word) - len(marked) : len(self.word)]
            rows[:, :-1] = self.table[list(map(self.subwords.f, marked))] + np.add.reduceat(self.padded[self.grams[windows].ravel()], 4 * (np.cumsum(sizes) - sizes), axis=0)
            rows[:, -1] = 4 * sizes - 3
            self.new.clear()
        return numbers

    def probabilities(self, text: str) -> np.ndarray:
        z = np.zeros(self.rows.shape[1])
        words = words_of(text)
        for i in range(0, len(words), 2_000):  # few enough for their windows to be remembered at once
            part = words[i : i + 2_000]
            if len(self.word) + len(part) > self.word.most:
                self.word.clear()  # here, so that no number of this part is given twice
            z += self.rows[self._numbers(part)].sum(axis=0)
        z = z[:-1] / max(1.0, z[-1])
        e = np.exp((z - z.max()) * self.temperature)
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        p = self.probabilities(text)
        i = int(p.argmax())
        return self.langs[i], float(p[i]), bool(p[i] < self.floor)


def fit(samples: list[tuple[list[str], str]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 4, rate: float = 20.0, reject: float = 0.005, seed: int = 3) -> LanguageModel:
    """Trains on samples (words, lang)."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return LanguageModel([], np.zeros((buckets, 1), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    subwords = Subwords(buckets)
    bags, ys, number = [], [], {lang: i for i, lang in enumerate(langs)}
    for words, lang in sorted(samples):
        if words:
            at, n = np.unique(np.array([x for w in words for x in subwords.of(w)]), return_counts=True)
            bags.append((at, (n / n.sum()).astype(np.float32)))
            ys.append(number[lang])
    if not bags:
        return LanguageModel(langs, np.zeros((buckets, len(langs)), np.float32), 1.0, 0.0)
    embed = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, len(langs)), np.float32)
    fold = np.arange(len(bags)) % 10 == 0
    train = np.flatnonzero(~fold) if len(bags) >= 20 else np.arange(len(bags))
    steps, total = 0, epochs * len(train)
    for _ in range(epochs):
        for i in rng.permutation(train):
            lr = rate * (1 - steps / total) / 100
            steps += 1
            at, share = bags[i]
            h = share @ embed[at]
            z = h @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[ys[i]] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            embed[at] -= np.outer(lr * share, back)
    table = embed @ out
    check = np.flatnonzero(fold) if len(bags) >= 20 else train
    z = np.array([bags[i][1] @ table[bags[i][0]] for i in check])
    y = np.array([ys[i] for i in check])

    def loss(t: float) -> float:
        e = (z - z.max(axis=1, keepdims=True)) * t
        return float(-(e[np.arange(len(y)), y] - np.log(np.exp(e).sum(axis=1))).mean())

    temperature = min((float(t) for t in np.geomspace(0.25, 8, 41)), key=loss)
    e = np.exp((z - z.max(axis=1, keepdims=True)) * temperature)
    p = e / e.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return LanguageModel(langs, table.astype(np.float32), temperature, float(np.quantile(right, reject)) if len(right) else 0.0)


def sample(docs: DataFrame, per_lang: int = 600, most_rows: int = 12_000, words: int = 300, short_words: int = 12) -> list[tuple[list[str], str]]:
    """The bounded training sample (words, lang), brought to the driver: two rows for each sampled text.

    One pass counts each language's distinct texts, one reads those whose hash is small; their words are drawn inside the tasks.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id")) != 2))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row for each language
    if not counts:
        return []
    most = max(1, min(per_lang, most_rows // len(counts)))
    # four times as many as needed, as hashes are spread, and distinct ones counted, only roughly
    limits = [(r["lang"], min(2**63 - 1, int(-(2**63) + 4.0 * most / max(1, r["n"]) * 2**64))) for r in counts]
    small = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below long"))
    some = rows.join(small, "lang").where(F.col("h") <= F.col("below")).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def start():
        def f(lang, h, text):
            out = [[], []]
            for t, seed in zip(text, h):
                own, rng = words_of(t), np.random.default_rng(seed & (2**63 - 1))
                for bag, size in zip(out, (words, short_words)):  # short samples, so that short texts are known too
                    bag.append(own if len(own) <= size else [own[i] for i in rng.integers(0, len(own), size)])
            return [lang, h, *out]

        return f

    bags = arrow_map(some.select("lang", "h", "text"), start, "lang string, h long, long array<string>, short array<string>")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    found = bags.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "long", "short").collect()  # at most most_rows, or one for each language
    return [(bag, r["lang"]) for r in found for bag in (r["long"], r["short"])]


def predict_language(docs: DataFrame, per_lang: int = 600, most_rows: int = 12_000, **training) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    model = fit(sample(docs, per_lang, most_rows), **training)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.temperature, model.floor))

    def start():
        own = LanguageModel(*shared.value)

        def f(doc_id, held_out, text):
            rows = [own.predict(t) for t in text]
            return [doc_id, held_out, *([x[i] for x in rows] for i in range(3))]

        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, start, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
