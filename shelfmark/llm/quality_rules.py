"""Quality rules with adaptive thresholds: quantile sketches for each language and source, then a joined filter.

Metrics of every whole text come first (one pass, a small table). Fixed base rules reject very short or repetitive texts.
For the others, each (lang, source) group has a mergeable quantile sketch (``percentile_approx``) for each metric, built
partly in each task and merged, so a hot source is no single task's work. A group's fence is read from the tail of its own
sketch: where the widest gap between neighbouring quantiles (0.9, 0.9025, ..., 0.9975) is wider than all that lies between the
median and the gap, values beyond it are a population of their own, and the fence stands in its middle; else the fence stands as far
beyond the 0.99 quantile as that is from the 0.9 one. Short words have the second kind of fence alone, as texts with shorter words than
most (verse, talk) are no fault. A group's fence is the mean of this one, weighted with the group's rows, and
its language's, weighted with ``prior`` rows; a language's is drawn towards that of all rows in the same way. So no group needs a
least size, and small ones differ little from their language. A share counts as beyond a fence only if it is so by more than its
standard error (a few symbols in a text may be chance). Documents beyond a fence are not kept.

Null texts have no words and fail the base rules; null lang or source are groups of their own. Empty tables give no rows;
repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Remembered, arrow_map, written

#: Metrics, and what a share is a share of; word_length has a lower fence too.
METRICS = {"word_length": None, "symbol_share": "word_chars", "dup_line_share": "n_lines", "repeat_share": "n_words"}
#: The tail of a sketch: the median and 40 quantiles above 0.9.
LEVELS = [0.5, *(round(0.9 + i / 400, 4) for i in range(40))]


class TextMetrics:
    def __init__(self):
        self.number = Remembered(lambda w: len(self.number), 500_000)

    def of(self, text: str) -> tuple[int, int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word)."""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # bytes split on exactly the six ASCII white-space characters
        joined = b"".join(words)
        chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
        symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
        dup, n_lines = 0, int(bool(words))
        if b"\n" in data:
            lines = [x for x in data.split(b"\n") if x and not x.isspace()]
            dup, n_lines = len(lines) - len(set(lines)), len(lines)
        return len(words), chars, symbols, dup, self.repeated(words), n_lines

    def repeated(self, words: list[bytes]) -> int:
        """Words that lie in a three-word window found at least twice."""
        if len(words) < 4:
            return 0
        if max(map(len, words)) > self.number.longest:  # a digest stands for a very long word
            words = [w if len(w) <= self.number.longest else b"\0" + hashlib.blake2b(w, digest_size=24).digest() for w in words]
        if len(self.number) + len(words) > self.number.most:
            self.number.clear()
        if len(words) > self.number.most:  # numbers must stay the same within a text
            own: dict[bytes, int] = {}
            ids = np.array([own.setdefault(w, len(own)) for w in words], np.uint64)
        else:
            ids = np.array([self.number[w] for w in words], np.uint64)
        # 21 bits a word: windows are compared exactly
        if int(ids.max()) >= 1 << 21:
            _, ids = np.unique(ids, return_inverse=True)
            ids = ids.astype(np.uint64)
        three = (ids[:-2] << np.uint64(42)) | (ids[1:-1] << np.uint64(21)) | ids[2:] if int(ids.max()) < 1 << 21 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1]
        order = np.sort(three)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        at = np.flatnonzero(np.isin(three, twice))
        covered = np.zeros(len(words), bool)
        covered[at] = covered[at + 1] = covered[at + 2] = True
        return int(covered.sum())


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the metrics of every row."""

    def start():
        m = TextMetrics()

        def f(doc_id, lang, source, text):
            rows = [m.of(t or "") for t in text]
            return [doc_id, lang, source, *([x[i] for x in rows] for i in range(6))]

        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, start, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def far_fence(quantiles: Column) -> Column:
    """As far beyond the 0.99 quantile as that is from the 0.9 one."""
    start, far = (F.get(quantiles, F.lit(LEVELS.index(p))) for p in (0.9, 0.99))
    return far + (far - start)


def fence(quantiles: Column) -> Column:
    """The upper fence of a metric from its quantiles at LEVELS."""
    tail = F.slice(quantiles, 2, len(LEVELS) - 1)
    gaps = F.transform(F.sequence(F.lit(1), F.lit(len(LEVELS) - 2)), lambda i: F.struct((F.get(tail, i) - F.get(tail, i - 1)).alias("gap"), (-i).alias("first"), F.get(tail, i - 1).alias("low")))
    middle = F.get(quantiles, F.lit(0))
    widest = F.array_max(gaps)
    return F.when(widest["gap"] > widest["low"] - middle, widest["low"] + widest["gap"] / 2).otherwise(far_fence(quantiles))


def fences(good: DataFrame, by: list[str], accuracy: int) -> DataFrame:
    """For each group its rows and a fence for each metric: what its own rows say."""
    sides = {**{m: F.col(m) for m in METRICS}, "short_words": -F.col("word_length")}
    sketches = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.percentile_approx(c, LEVELS, accuracy).alias(m) for m, c in sides.items()))
    return sketches.select(*by, "n_rows", F.struct(*((fence if m in METRICS else far_fence)(F.col(m)).alias(m) for m in sides)).alias("own"))


def drawn(own: str, parent: Column, prior: float) -> Column:
    """A group's fences drawn towards its parent's."""
    both = lambda m: ((F.col("n_rows") * F.col(f"{own}.{m}") + prior * parent[m]) / (F.col("n_rows") + prior)).alias(m)
    return F.struct(*(both(m) for m in (*METRICS, "short_words")))


def group_fences(good: DataFrame, prior: float, accuracy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fences of each (lang, source), of each lang and of all rows, each drawn towards the wider group's."""
    whole = written(fences(good, [], accuracy).select(F.col("own").alias("of_all")))  # one row
    langs = written(fences(good, ["lang"], accuracy).join(F.broadcast(whole)).select(F.col("lang").alias("of"), drawn("own", F.col("of_all"), prior).alias("of_lang")))
    groups = fences(good, ["lang", "source"], accuracy).join(langs, F.col("lang").eqNullSafe(F.col("of")))
    return groups.select(F.col("lang").alias("its_lang"), F.col("source").alias("its_source"), drawn("own", F.col("of_lang"), prior).alias("of_group")), langs, whole


def judge(docs: DataFrame, prior: float = 1000.0, accuracy: int = 10_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and reasons."""
    rows = metrics(docs)
    words = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
    })
    rows = written(rows)
    groups, langs, whole = group_fences(rows.where(~F.col("base_failed")), prior, accuracy)
    joined = (
        rows.join(groups, F.col("lang").eqNullSafe(F.col("its_lang")) & F.col("source").eqNullSafe(F.col("its_source")), "left")
        .join(langs, F.col("lang").eqNullSafe(F.col("of")), "left")
        .join(F.broadcast(whole))  # one row
    )
    hi = F.coalesce("of_group", "of_lang", "of_all")

    def beyond(m: str, of: str | None) -> Column:
        x = F.col(m)
        if of is None:
            return (x > hi[m]) | (-x > hi["short_words"])
        return x - F.sqrt(x * (1 - x) / F.greatest(F.col(of), F.lit(1))) > hi[m]

    out = [F.when(beyond(m, of), F.lit(m)) for m, of in METRICS.items()]
    return (
        joined.withColumn("reasons", F.concat_ws(",", F.when(F.col("base_failed"), F.lit("base")), *out))
        .withColumn("kept", ~F.col("base_failed") & (F.col("reasons") == ""))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")
    )
