"""Secret scans with DataFrame functions only.

Base spans come from three fixed patterns. The method adds spans: long tokens whose characters a Markov model of random
strings explains better than one of ordinary identifiers. Both models are first-order chains over 66 characters and one class
for all others, counted from labelled samples (a fixed number of digests in several alphabets; words of a bounded sample of
documents, joined as identifiers are) with add-one smoothing. A token's score is its mean log-likelihood ratio; the threshold
lies half way between the score that ``false_share`` of the ordinary samples exceed and the one that as many of the random ones
miss (not under the former, where the two cross). Model tables have a fixed size (67 x 67).

Places of matches: text is split at the matches of a pattern, and lengths are added up; so each row is done by itself, with
no shuffle. Running sums and maxima go over chunks of about the root of an array's size, so that a text of very many matches
takes n**1.5 small steps, and redaction reads a text in blocks. Null texts count as empty; every row gives one row, repeated rows
too. Places are in code points, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, their patterns, the capturing group and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so the least length may stand in the pattern
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once even where lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running results of step over an array of ints."""
    none = F.array().cast("array<int>")

    def over(v: Column) -> Column:
        return F.aggregate(v, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(step(F.get(acc, F.size(acc) - 1), x)))))

    def deal(v: Column) -> Column:
        chunk = F.ceil(F.sqrt(F.size(v))).cast("int")
        at = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))
        return _let(F.transform(at, lambda c: over(F.slice(v, c * chunk + 1, chunk))), lambda parts: _let(over(F.transform(parts, lambda x: F.get(x, F.size(x) - 1))), lambda ends: F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: step(F.get(ends, i - 1), y)))))))

    return _let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(deal(v)))


def _spans(text: Column, pattern: str, found: Column, kind: int) -> Column:
    """Places of the matches: lengths of the gaps and of the matches, added up."""
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, own: F.length(gap) + F.length(own))
    spans = F.zip_with(_running(steps, lambda a, b: a + b), found, lambda stop, own: F.struct((stop - F.length(own)).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by pair, random against ordinary, from rows (text, label: 1 random)."""
    chars = samples.select("label", F.filter(F.split("text", ""), lambda c: c != "").alias("cs"))
    pairs = chars.select("label", F.explode(F.arrays_zip(F.slice("cs", 1, F.size("cs") - 1).alias("a"), F.slice("cs", 2, F.size("cs")).alias("b"))).alias("p"))
    counted = pairs.groupBy("label", F.expr(f"instr('{CHARS}', p.a)").alias("a"), F.expr(f"instr('{CHARS}', p.b)").alias("b")).count().collect()  # at most 2 x 67 x 67 rows
    n = len(CHARS) + 1
    table = [[1.0] * (n * n) for _ in (0, 1)]
    for r in counted:
        table[r["label"]][r["a"] * n + r["b"]] += r["count"]
    p = [[x / sum(t[i // n * n : i // n * n + n]) for i, x in enumerate(t)] for t in table]
    return [math.log(x / y) for x, y in zip(p[1], p[0])]


def mean_ratio(token: Column, llr: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's pairs of characters."""
    n = len(CHARS) + 1
    model = F.split(F.lit(",".join(f"{x:.6f}" for x in llr)), ",").cast("array<double>")  # folded to a constant
    codes = F.transform(F.split(token, ""), _code)
    total = F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(model, acc["last"] * n + c))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def _code(c: Column) -> Column:
    return F.position(c, F.lit(CHARS))


def samples(docs: DataFrame, most_docs: int = 400, most_words: int = 400, longest_word: int = 14, most_random: int = 3000) -> DataFrame:
    """Labelled samples (text, label): digests in several alphabets, and identifiers made of words.

    Texts and words are those of the smallest hashes: at most most_docs distinct texts (a text counts once however often its rows
    are repeated), and of each at most most_words distinct words of two to longest_word letters from all over it.
    """
    spark = docs.sparkSession
    ids = spark.range(most_random).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("hex"))
    b64 = F.base64(F.unhex("hex"))
    random = ids.select(F.explode(F.array(F.substring("hex", 1, 40), F.substring(b64, 1, 32), F.upper(F.substring(b64, 5, 24)), F.regexp_replace(F.substring(b64, 1, 36), "[+/=]", "x"))).alias("text"), F.lit(1).alias("label"))
    # the texts of a small range of hashes, some eight times as many as needed, each once; only their words move on
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    distinct = texts.agg(F.approx_count_distinct("h")).first()[0]
    below = min(2**63 - 1, int(-(2**63) + 8.0 * most_docs / max(1, distinct) * 2**64))
    some = texts.where(F.col("h") <= below).groupBy("h").agg(F.first("text").alias("text"))
    own = F.array_distinct(F.regexp_extract_all("text", F.lit(f"[A-Za-z]{{2,{longest_word}}}"), F.lit(0)))
    own = F.transform(F.slice(F.array_sort(F.transform(own, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), 1, most_words), lambda x: x["w"])
    words = some.select("h", own.alias("ws")).orderBy("h").limit(most_docs).select("ws").where(F.size("ws") > 3)
    three = words.select(F.posexplode("ws").alias("at", "a"), "ws").select("at", "a", F.get("ws", F.col("at") + 1).alias("b"), F.get("ws", F.col("at") + 2).alias("c")).where(F.col("c").isNotNull())
    forms = F.element_at(
        F.array(
            F.concat("a", "b", "c"),
            F.concat_ws("_", "a", "b", "c"),
            F.concat("a", F.initcap("b"), F.initcap("c")),
            F.concat_ws("-", "a", "b", "c"),
            F.concat_ws("/", "a", "b", "c"),
            F.upper(F.concat_ws("_", "a", "b", "c")),
            F.concat(F.concat_ws("-", "a", "b"), F.lit("-20"), (F.col("at") % 90 + 10).cast("string")),
            F.concat_ws("=", "a", F.concat("b", "c")),
        ),
        F.col("at") % 8 + 1,
    )
    return random.unionAll(three.select(forms.alias("text"), F.lit(0).alias("label")))


def train(docs: DataFrame, false_share: float = 0.0005, **sizes) -> tuple[list[float], float]:
    """The pair table and the threshold."""
    rows = samples(docs, **sizes)
    llr = ratios(rows)
    scored = rows.where(F.length("text") >= 20).select("label", mean_ratio(F.col("text"), llr).alias("s"))
    ends = scored.select(*(F.percentile_approx(F.when(F.col("label") == label, F.col("s")), at, 10_000).alias(f"t{label}") for label, at in ((0, 1 - false_share), (1, false_share)))).first()
    ordinary, random = ends["t0"], ends["t1"]
    return llr, random if ordinary is None else max(ordinary, (ordinary + random) / 2)


def with_spans(docs: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """docs in a struct ``row``, with ``base`` and ``spans``: arrays of (start, kind number, stop), sorted."""
    llr, threshold = model
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("txt"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": TOKEN}
    rows = rows.select("row", "txt", *(F.regexp_extract_all("txt", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()))
    rows = rows.select("row", "txt", *(f"m_{k}" for k in patterns), *(_spans(F.col("txt"), p, F.col(f"m_{k}"), i).alias(f"s_{k}") for i, (k, p) in enumerate(patterns.items())))
    # an assigned value shorter than six characters takes part in the matching, but is dropped
    long_ones = F.array_compact(F.zip_with("s_assign", "m_assign", lambda s, m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, s)))
    rows = rows.withColumn("base", F.array_sort(F.concat(long_ones, "s_access", "s_hex")))
    # a token that reaches beyond a base span is scored as a whole; base kinds sort first, so the furthest stop so far tells
    scored = F.zip_with("s_markov", "m_markov", lambda s, m: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), mean_ratio(m, llr).alias("score")))
    others = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(0.0).alias("score")))
    is_base = lambda s: s["kind"] < len(KINDS) - 1

    def chosen(both: Column) -> Column:
        reach = _running(F.transform(both, lambda s: F.when(is_base(s), s["stop"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        found = F.zip_with(both, reach, lambda s, r: F.when(is_base(s) | (s["stop"] > r) & (s["score"] > threshold), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
        return F.array_compact(found)

    return rows.withColumn("spans", F.when(F.size("s_markov") == 0, F.col("base")).otherwise(_let(F.array_sort(F.concat(others, scored)), chosen)))


def _text_of(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_markov of every row."""
    rows = with_spans(docs.select("doc_id", "text"), model or train(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(_text_of("base"), 256).alias("base_sha256"), _text_of("spans").alias("spans"), count("markov"))


def _between(blocks: Column, a: Column, b: Column, width: int) -> Column:
    """The text from place a to place b, from its blocks of ``width`` characters."""
    i, j = F.floor(a / width).cast("int"), F.floor(b / width).cast("int")
    block = lambda n: F.coalesce(F.get(blocks, n), F.lit(""))
    across = F.concat(F.substr(block(i), a % width + 1), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(block(j), F.lit(1), b % width))
    return F.when(i == j, F.substr(block(i), a % width + 1, b - a)).otherwise(across)


def redact(docs: DataFrame, model: tuple[list[float], float] | None = None, mark: str = "[SECRET]", width: int = 1000) -> DataFrame:
    """The rows in all their columns, every span in text replaced by a mark; n_chars follows where there is such a column."""
    rows = with_spans(docs, model or train(docs))

    def cut(blocks: Column) -> Column:
        """A mark for each span that begins at or after the end of those before it; others only lengthen the last."""

        def joined(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
            parts = F.zip_with("spans", before, lambda s, at: F.when(s["start"] >= at, F.concat(_between(blocks, at, s["start"], width), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), _between(blocks, F.get(reach, F.size(reach) - 1), F.length("txt"), width))

        return _let(_running(F.transform("spans", lambda s: s["stop"]), lambda a, b: F.greatest(a, b)), joined)

    blocks = F.regexp_extract_all("txt", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    rows = rows.withColumn("new", F.when(F.size("spans") > 0, _let(blocks, cut)).otherwise(F.col("row.text")))
    out = {"text": F.col("new"), "n_chars": F.when(F.size("spans") > 0, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(out[c].alias(c) if out.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns))
