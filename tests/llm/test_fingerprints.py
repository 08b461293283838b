"""Fingerprints by a plain version: whole k-mers, counted in a dict, ranked by sorting."""

import hashlib
import random

import numpy as np
import pytest

from shelfmark.llm import order_minhash

M64 = 2**64
BASE, STEP, CHAIN = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F


def mixed(x: int) -> int:
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 % M64
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D % M64
    return x ^ x >> 33


def hash_of(part: str, start: int = 0) -> int:
    for c in part:
        start = (start * BASE + ord(c) + 1) % M64
    return start


def plain_fingerprint(text: str, odd: list[int], k: int = 8, l: int = 2) -> list[int]:
    if not text:
        return [0] * len(odd)
    kmers = [text[i : i + k] for i in range(len(text) - k + 1)] or [text]
    seen, numbered = {}, []
    for x in kmers:
        n = seen[x] = seen.get(x, -1) + 1
        h = mixed(hash_of(x) if len(text) >= k else hash_of(x, len(x)))
        numbered.append(mixed((h + n * STEP) % M64) if n else h)
    out = []
    for o in odd:
        least = sorted(range(len(numbered)), key=lambda i: (numbered[i] * o % M64, i))[:l]
        h = 0
        for i in sorted(least):
            h = mixed((h * CHAIN + numbered[i]) % M64)
        out.append(mixed((h + o) % M64) >> 32)
    return out


def odd_numbers(m: int = 32, seed: int = 17) -> list[int]:
    return [int(x) * 2 % M64 + 1 for x in np.random.default_rng(seed).integers(1, 2**63, m, dtype=np.uint64)]


def some_texts() -> list[str]:
    r = random.Random(1)
    words = ["lorem", "ipsum", "dolor", "日本語", "😀", "a", "\n"]
    return ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 40, "x\0y" * 9, *(" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(30))]


@pytest.mark.parametrize("k", [1, 4, 8])
def test_fingerprints_equal_plain_ones(k):
    omh, odd = order_minhash.OrderMinHash(k=k), odd_numbers()
    for t in some_texts():
        assert omh.fingerprint(t).tolist() == plain_fingerprint(t, odd, k)


def test_query_equals_plain_version(spark):
    """Null and repeated ids and texts, ties, and blocks of any size; every value of every row."""
    texts, odd = some_texts(), odd_numbers()
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(3, texts[1]), (3, texts[1]), (1000, None), (1001, ""), (-5, "below zero " * 9)]
    distinct = sorted(rows, key=lambda x: x[0], reverse=True)  # equal rows are alike, so their order makes no difference
    want = []
    for at, (i, t) in enumerate(distinct):
        t, following = t or "", distinct[(at + 1) % len(distinct)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        a, b, c = (plain_fingerprint(x, odd) for x in (t, edited, following))
        hexed = lambda x: b"".join(v.to_bytes(4, "little") for v in x).hex()
        like = lambda x, y: sum(p == q for p, q in zip(x, y)) / len(x)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, k1 int").repartition(3)
    for block in (2000, 5):
        assert sorted(map(tuple, order_minhash.edited_likeness(docs, rows_in_block=block).collect())) == sorted(want)


def test_very_long_text(spark):
    """A text of two million characters beside repeated rows of it."""
    docs = spark.createDataFrame([(1, "wort " * 400_000), (1, "wort " * 400_000), (0, "wort")], "doc_id long, text string")
    got = order_minhash.edited_likeness(docs).collect()
    assert sorted(r.n_chars for r in got) == [4, 2_000_000, 2_000_000]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
