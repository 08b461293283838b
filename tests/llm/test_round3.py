"""Vector codes, spelling variants and URL filters against brute force, on rows with every oddity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import language_id, quality_rules, secret_scan, spelling, url_filter, vector_codes

# 11


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = [(i, label, v) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    rows = [r for r in rows if len(r[2]) == len(rows[0][2])]
    ints = [[math.floor(256 * x) for x in v] for _, _, v in rows]
    width = -(-len(ints[0]) // parts)
    ints = [v + [0] * (width * parts - len(v)) for v in ints]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(p, c[p])[1], []).append(c[p])
            new.append([[sum(z) // len(z) for z in zip(*held[i])] if i in held else e for i, e in enumerate(books[p])])
        books = new
    out, sums = [], Counter()
    for (i, label, _), c in zip(rows, cut):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{at:02x}" for _, at in best), sum(d for d, _ in best)))
        sums[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, sums[label], digest) for i, label, code, error in out)


def vectors(n, length, seed=1):
    r = random.Random(seed)
    return [(r.randrange(10 * n), r.choice([None, 1, 2, 3]), [r.gauss(0, 0.2) for _ in range(length)]) for _ in range(n)]


@pytest.mark.parametrize("n,length", [(150, 32), (20, 16), (90, 19), (1, 3)])
def test_codes_equal_brute_force(spark, n, length):
    rows = vectors(n, length)
    whole = [0.5] * length
    rows += [(5, 1, whole)] * 30 + [(None, None, whole), (None, 2, None), (7, 2, []), (8, 2, [None] * length), (9, 2, whole[1:] + [float("nan")]), (10, 2, whole[1:] + [float("inf")]), (10**6, 4, whole + [0.1])]
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows], "vec_id long, label int, embedding array<double>, part string, code int").repartition(3)
    got = Counter(tuple(r) for r in vector_codes.code_digests(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows)


def test_codes_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>")
    assert vector_codes.code_digests(df).collect() == [] and vector_codes.code_digests(df.limit(0)).collect() == []


def test_huge_components_do_not_overflow(spark):
    df = spark.createDataFrame([(i, 0, [x] * 16) for i, x in enumerate([3e38, -3e38, 0.0])], "vec_id long, label int, embedding array<double>")
    got = vector_codes.code_digests(df, entries=1, rounds=0).orderBy("vec_id").collect()
    assert [r["error"] for r in got] == [0, 16 * (2 * vector_codes.MOST) ** 2, 16 * vector_codes.MOST**2]


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_bounds_hold_and_spare_distances(bits):
    rng = np.random.default_rng(bits)
    for k, width in ((64, 4), (64, 1), (1, 5), (7, 3)):
        entries, queries = rng.integers(-60, 60, (k, width)), rng.integers(-70, 70, (500, width))
        entries[-1] = entries[0]
        file = vector_codes.VAFile(entries, bits)
        d = ((queries[:, None] - entries) ** 2).sum(axis=2)
        lower, upper = file.bounds(queries)
        assert (lower <= d).all() and (d <= upper).all()
        index, error, refined = file.nearest(queries, at_once=64)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        assert 500 <= refined and (k < 64 or width == 1 or bits < 3 or refined < 0.5 * d.size)


def test_decoded_vectors_are_near(spark):
    rows = [(i, 0, [((i % 8) + j) / 8 for j in range(16)]) for i in range(64)]
    books, coded = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    found = coded.orderBy("vec_id").collect()
    assert np.abs(vector_codes.decoded(np.array([list(r["code"]) for r in found]), books) - np.array([v for _, _, v in rows])).max() == 0


# 12


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in map(low, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    others = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in others.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(others[w]), n[form[w]] if w in form else None) for w in n}


def misspelt(word, r):
    i, c = r.randrange(len(word) + 1), r.choice("abeüÿ×")
    return [word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]][r.randrange(3)]


def spelt(seed=5):
    r = random.Random(seed)
    words = ["abcdefg", "aaaaaaaa", "interna", "International", "Überraschung", "zzzzzzzzzzz", "abababab", *("".join(r.choice("abé") for _ in range(r.randrange(7, 10))) for _ in range(12))]
    words += [misspelt(w, r) for w in words for _ in range(6)]
    words += [misspelt(w, r) for w in words for _ in range(2)]
    weights = [10 ** r.randrange(4) for _ in words]
    rows = [(i if i % 7 else None, " ,3".join(r.choices(words, weights, k=300)), "x", 2) for i in range(60)]
    long = "".join(r.choice("abcd") for _ in range(3000))
    rows += [(100, f"{long} {long[:5]}x{long[5:]}", "x", 2)] * 12 + [(101, f"{long}1{long[:2999]}", "x", 2)] * 3
    return rows + [(200, None, None, None), (201, "", None, None), (None, None, None, None), (202, "short of 7 words", "x", 1)]


@pytest.mark.parametrize("how", [{}, {"most_in_group": 5, "words_in_task": 20}])
def test_variants_equal_brute_force(spark, how):
    rows = spelt()
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.variants(df, **how).collect()
    want = brute_variants([r[:2] for r in rows])
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(f and root != f for _, f, root, *_ in want)


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert spelling.variants(df).collect() == [] and spelling.variants(df.limit(0)).collect() == []


def test_equal_hashes_change_nothing(monkeypatch):
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(2, 6))) for _ in range(40)})
    want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b))
    for values in (spelling._values, lambda codes: np.zeros(codes.shape, np.uint64)):
        monkeypatch.setattr(spelling, "_values", values)
        for at_once in (1, 1 << 20):
            got = sorted((int(i), int(j)) for x, y in spelling.Vocabulary(words).near(words, 0, None, at_once) for i, j in zip(x, y))
            assert got == want


# 13


def brute_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    host = low(host)
    fits = [((len(h) + len(p), len(h), v), h + p, v) for h, p, v in rules if h and p is not None and v and (host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(None, None, default), key=lambda f: f[0])
    return host, path, low(rule) if rule and low(rule.split("/")[0]) != rule.split("/")[0] else rule, verdict


URLS = ["http://a.net/", "http://A.NET", "https://net/x", "x://www.example.net/en/1?q=http://b.org/fr/", "http://example.net/en", "http://example.net/EN/", "http://xexample.net/en/", "http://de.example.com/de/a#b", "http://h.example.com#/de/", "//example.com/de/", "example.com/de/", "://org/fr/", "http:///de/", "http://", "http://a..net/", "http://.net/", "http://net./", "http://user@a.net:80/", "http://a.b.org/fr/x/y/z", "http://b.org/fr", "http://ÀÉ.org/fr/é", "http://n.net\n/x", "", None, "http://" + "a." * 3000 + "net/" + "b/" * 3000]


def test_fixed_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "mine") for i, u in enumerate(URLS * 2)] + [(None, URLS[0], None, None)], "page_id long, url string, html string, host string").repartition(3)
    got = Counter(tuple(r) for r in url_filter.judge_pages(df).collect())
    assert got == Counter([(i, *brute_judge(u, url_filter.RULES)) for i, u in enumerate(URLS * 2)] + [(None, *brute_judge(URLS[0], url_filter.RULES))])
    assert url_filter.judge_pages(df.limit(0)).collect() == []


@pytest.mark.parametrize("most_broadcast", [1000, 0])
def test_random_rules_equal_brute_force(spark, most_broadcast):
    r = random.Random(9)
    part = lambda n: "".join(r.choice("ab") for _ in range(r.randrange(n)))
    host = lambda: ".".join(part(2) or "a" for _ in range(r.randrange(1, 4)))
    path = lambda: "".join("/" + part(3) for _ in range(r.randrange(4)))
    rules = {(host(), path(), r.choice(["allow", "block"])) for _ in range(60)} | {("b.a", "/a", "allow"), ("b.a", "/a", "block"), ("B.b", "/", "allow")}
    odd = [(None, "/", "block"), ("a", None, "block"), ("b", "/", None), ("", "/", "block")]
    urls = [(i, f"http://{host()}{path()}{r.choice(['', '?/a', '#b'])}", "kept") for i in range(400)] + [(-1, None, None)]
    kept = url_filter.judged(spark.createDataFrame(urls, "page_id long, url string, rule string").withColumnRenamed("rule", "extra"), spark.createDataFrame([*rules, *odd], "host string, path string, verdict string"), "none", most_broadcast)
    assert kept.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    got = {(x["page_id"], x["extra"], x["host"], x["path"], x["rule"], x["verdict"]) for x in kept.collect()}
    assert got == {(i, e, *brute_judge(u, rules, "none")) for i, u, e in urls}


def test_no_rules(spark):
    df = spark.createDataFrame([("http://a.net/x",)], "url string")
    assert [tuple(r) for r in url_filter.judged(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()] == [("http://a.net/x", "a.net", "/x", None, "allow")]


# 10


def brute_fence(values, gaps=True):
    values = sorted(values)
    q = [values[max(0, math.ceil(p * len(values)) - 1)] for p in quality_rules.LEVELS]
    tail = q[1:]
    gap, low = max(((b - a, -i), a) for i, (a, b) in enumerate(zip(tail, tail[1:])))
    far = q[quality_rules.LEVELS.index(0.99)]
    return low + gap[0] / 2 if gaps and gap[0] > low - q[0] else far + (far - tail[0])


METRICS = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "short_words"]


def brute_fences(rows, prior):
    """Fences of each group from (lang, source, values by metric)."""

    def own(some):
        return {m: brute_fence([-v["word_length"] if m == "short_words" else v[m] for v in some], m != "short_words") for m in METRICS}

    def mixed(some, parent):
        return {m: (len(some) * x + prior * parent[m]) / (len(some) + prior) for m, x in own(some).items()}

    whole = own([v for *_, v in rows])
    langs = {a: mixed([v for x, _, v in rows if x == a], whole) for a in {x for x, *_ in rows}}
    groups = {(a, s): mixed([v for x, y, v in rows if (x, y) == (a, s)], langs[a]) for a, s in {(x, y) for x, y, _ in rows}}
    return groups, langs, whole


@pytest.mark.parametrize("prior", [0.0, 50.0])
def test_fences_equal_exact_quantiles(spark, prior):
    r = random.Random(12)
    rows = []
    for lang, source, n, junk in (("en", "a", 400, 0.05), ("en", "b", 3, 0), ("en", None, 90, 0.5), (None, "a", 150, 0.02), ("de", "c", 700, 0)):
        for _ in range(n):
            bad = r.random() < junk
            rows.append((lang, source, {"word_length": r.gauss(5, 0.3) + 3 * bad, "symbol_share": r.uniform(0.3, 0.4) if bad else 0.0, "dup_line_share": r.choice([0.0] * 30 + [0.02, 0.05]), "repeat_share": r.expovariate(30)}))
    df = spark.createDataFrame([(a, s, *v.values()) for a, s, v in rows], f"lang string, source string, {', '.join(f'{m} double' for m in METRICS[:4])}").repartition(4)
    groups, langs, whole = brute_fences(rows, prior)
    got, got_langs, got_whole = quality_rules.group_fences(df, prior, 10_000)
    found = {(x["its_lang"], x["its_source"]): x["of_group"].asDict() for x in got.collect()}
    assert found.keys() == groups.keys() and all(found[k] == pytest.approx(groups[k]) for k in groups)
    assert {x["of"]: x["of_lang"]["repeat_share"] for x in got_langs.collect()} == pytest.approx({k: x["repeat_share"] for k, x in langs.items()})
    assert got_whole.first()["of_all"].asDict() == pytest.approx(whole)
    assert 0.1 < groups["en", "a"]["symbol_share"] < 0.3 and len({x["repeat_share"] for x in groups.values()}) == 5


def test_verdicts_equal_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))

    def text(kind):
        lines = [" ".join(word() for _ in range(9)) for _ in range(r.randrange(8, 30))]
        if kind == 1:
            lines = [x.replace(" ", "### ") for x in lines]
        if kind == 2:
            lines += r.choices(lines[:3], k=len(lines) // 3)
        return "\n".join(lines)

    rows = [(i, text(r.choice([0] * 18 + [1, 2])), r.choice(["en", "en", "de", None]), r.choice(["s", "s", "t", None])) for i in range(500)]
    rows += [(600, None, "en", "s"), (601, "", "xx", None), (602, rows[0][1], "new", "new"), (None, rows[1][1], None, None), (603, " ".join(word() for _ in range(60_000)), "en", "s"), (604, "x" * 200_000 + " y" * 3, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    m = quality_rules.TextMetrics()
    facts = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeat, lines = m.of(t or "")
        failed = n < 50 or 100 * repeat > 50 * n
        values = {"word_length": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "dup_line_share": dup / max(lines, 1), "repeat_share": repeat / max(n, 1)}
        facts.append((i, lang, source, failed, values, {"symbol_share": chars, "dup_line_share": lines, "repeat_share": n}))
    groups, langs, whole = brute_fences([(a, s, v) for _, a, s, failed, v, _ in facts if not failed], 1000.0)
    want = Counter()
    for i, lang, source, failed, v, of in facts:
        hi = groups.get((lang, source)) or langs.get(lang) or whole
        bad = v["word_length"] > hi["word_length"] or -v["word_length"] > hi["short_words"]
        bad |= any(v[k] - math.sqrt(v[k] * (1 - v[k]) / max(n, 1)) > hi[k] for k, n in of.items())
        want[i, failed, not failed and not bad] += 1
    got = Counter((x["doc_id"], x["base_failed"], x["kept"]) for x in quality_rules.judge(df).collect())
    assert got == want and 10 < sum(n for (_, failed, kept), n in want.items() if not failed and not kept) < 100


def test_fences_differ_between_groups(spark):
    """On the given documents the fences come from the groups' own sketches."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality_rules.judge(docs)
    assert out.where("reasons like '%symbol_share%' and not base_failed").count() > 10 and out.where("kept").count() > 0.8 * docs.count()


# 2 and 8 where rows repeat


def invented(seed, alphabet, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_repeated_texts_are_learned(spark):
    """A language whose rows are repeated thousands of times, one of null texts alone, and letters by their category."""
    rows = [(i, invented(i, "aeioustrn", 60), "en") for i in range(100)] + [(1000 + i, invented(i, "äöüßchkwz", 60), "de") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = df.where("lang = 'de'").crossJoin(spark.range(2000).select()).unionByName(df.where("lang = 'en'"))
    more = more.unionByName(spark.createDataFrame([(5000, None, "xx"), (5001, "½ ² Ⅷ ① 12", None), (5002, None, None), (5003, invented(7, "äöüßchkwz", 40), None)], df.schema))
    samples = language_id.sample(more)
    assert Counter(lang for _, lang in samples).keys() == {"en", "de"} and min(Counter(lang for _, lang in samples).values()) > 100
    out = {(x["doc_id"], x["lang_pred"]) for x in language_id.predict_language(more).select("doc_id", "lang_pred").distinct().collect()}
    assert sum(p == ("en" if i < 1000 else "de") for i, p in out if i < 5000) >= 198 and {(5000, "und"), (5001, "und"), (5002, "und"), (5003, "de")} <= out


def test_secrets_are_learned_from_repeated_texts(spark):
    texts = [(i, invented(i, "aeioustrnlm", 300)) for i in range(41)] + [(50, "getUserAccountSettingsByName internationalization/configuration/management")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    repeated = df.crossJoin(spark.range(3000).select())
    assert secret_scan.samples(repeated).where("label = 0").count() == secret_scan.samples(df).where("label = 0").count() > 1000
    llr, threshold = secret_scan.train(repeated)
    once = secret_scan.train(df)
    assert llr == pytest.approx(once[0]) and threshold == pytest.approx(once[1])
    found = secret_scan.scan_secrets(df, (llr, threshold)).where("doc_id = 50").first()
    assert found["n_markov"] == 0


def test_language_rows_of_words():
    """A text's probabilities are those of a plain sum over its words' n-grams, however few words and windows are remembered; whole words drive no n-gram out."""
    rng = np.random.default_rng(5)
    table = rng.normal(0, 1, (1 << 10, 3)).astype(np.float32)
    model = language_id.LanguageModel(["a", "b", "c"], table, 1.5, 0.0, remembered=3_000)
    model.window.most = 2_000 * 65  # the most that one part can need
    letters = list("abcdeéßж漢字😀İ")
    texts = ["x", "A<b>c", "日本" * 100, "a b 1c2d-e_f", *(" ".join("".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(n)) for n in (1, 7, 2_000, 9_000)), "x"]
    for text in texts:
        words = text.lower().translate({ord(c): " " for c in "0123456789.,;:!?\"'()[]{}<>|#*$%&/\\@+=_-~^`\n\t\r"}).split()
        assert language_id.words_of(text) == words or max(map(len, words)) > language_id.LONGEST
        bag = [x for w in language_id.words_of(text) for x in language_id.Subwords(len(table)).of(w)]
        z = table[bag].astype(float).mean(axis=0)
        e = np.exp((z - z.max()) * 1.5)
        assert np.allclose(model.probabilities(text), e / e.sum(), atol=1e-5)
    assert model.subwords and max(map(len, model.subwords)) <= 4
