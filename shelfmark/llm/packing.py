"""Hierarchical packing of documents into sequences of several lengths.

Tiers are the powers of two from 128 to the window. Documents are routed by length: whole windows are sequences of the longest
tier, and what is left of a document goes to the shortest tier that holds it. Each tier is packed, from the longest down: a
rest opens a sequence of its tier, whose gap is filled from the shorter tiers, longest rest that fits first, cutting one where
none fits. Rests that fill no sequence wait for the task's later documents. A task's last rests are cut into sequences of falling
tiers; what is left then, less than the shortest tier, is the one short sequence that a task may have.

Every task packs its own rows, so no text is shuffled. Each tier's sequences are numbered over all tasks (from a small table of
their numbers by task and tier) and dealt to the step groups in turn: the groups of the whole run hold equal numbers of each
tier's sequences, to within one. Sequence ids hold the task's number in the upper bits.

Null texts count as empty: such a document still has its end id. Repeated rows are documents of their own. Every id of every
document lies in exactly one piece. The vocabulary's added tokens in a text are their own ids, as the tokenizers library has it.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.common import Remembered, once, texts, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, place long"
#: The splitting pattern of the vocabulary, with its white space (Unicode White_Space) spelt out.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
ODD_ASCII = "\t\r\x0b\x0c"
ODD = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _length(piece: tuple) -> int:
    return piece[3]


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class BytePairIds:
    """The ids that the tokenizers library gives for a byte-level vocabulary (JSON), with frequent words remembered.

    Added tokens are taken out of a text first. Byte-level merges never leave a part of the splitting pattern, so parts are
    encoded alone. Where spaces touch no other white space, the pattern never joins text across a space and gives each following
    word its leading space: such texts are looked up word by word, others part by part.
    """

    def __init__(self, path: str, end_id: int, most: int = 400_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("only byte-level vocabularies without normalisation and with plain added tokens are supported")
        names = byte_names()
        self.added = {x["content"]: struct.pack("<I", x["id"]) for x in added}
        ranks = {bytes(map(names.__getitem__, k)): v for k, v in model["vocab"].items() if k not in self.added}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("the ids of the vocabulary must follow the order of its merges")
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(SPLIT)
        self.at_added = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.end = struct.pack("<I", end_id)
        self.part = Remembered(self._part, most)
        self.word = Remembered(self._word, most)

    def _part(self, part: str) -> bytes:
        ids = self.encoding.encode_ordinary(part)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        return b"".join([self.part[x] for x in self.parts.findall(" " + word)])

    def _plain(self, text: str) -> bytes:
        if "  " in text or "\n " in text or " \n" in text or any(c in text for c in ODD_ASCII) or not text.isascii() and any(c in text for c in ODD):
            return b"".join(map(self.part.__getitem__, self.parts.findall(text)))
        first, *words = text.split(" ")
        head = b"".join([self.part[x] for x in self.parts.findall(first)]) if first else b""
        return head + b"".join(map(self.word.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids, the end id last."""
        if any(x in text for x in self.added):
            found, at = [], 0
            for m in self.at_added.finditer(text):
                found += [self._plain(text[at : m.start()]) if m.start() > at else b"", self.added[m.group()]]
                at = m.end()
            found.append(self._plain(text[at:]) if at < len(text) else b"")
            return np.frombuffer(b"".join(found) + self.end, "<u4")
        return np.frombuffer(self._plain(text) + self.end, "<u4")


class Packer:
    """Packs documents' ids into sequences of several tiers; out holds the pieces of finished sequences."""

    def __init__(self, window: int, first_id: int, least_tier: int = 128):
        self.window, self.next_id, self.least_tier = window, first_id, min(window, least_tier)
        self.rests: list[tuple] = []  # (doc_id, ids of the document, start, length), by length
        self.out: list[tuple] = []
        self.made: Counter = Counter()  # sequences by tier

    def tier(self, n: int) -> int:
        """The shortest tier that holds n ids."""
        return max(self.least_tier, 1 << max(0, n - 1).bit_length())

    def emit(self, tier: int, pieces: list[tuple]) -> None:
        """A finished sequence."""
        at, place = 0, self.made[tier]
        self.made[tier] += 1
        for doc_id, ids, start, n in pieces:
            self.out.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.next_id, at, tier, place))
            at += n
        self.next_id += 1

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Whole windows are sequences of the longest tier; what is left waits in the tier of its length."""
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self.emit(self.window, [(doc_id, ids, start, self.window)])
        if rest := len(ids) - whole:
            self.rests.append((doc_id, ids, whole, rest))

    def pack(self, last: bool = False) -> None:
        """Each tier from the longest down: a rest opens a sequence of its tier, and the gap is filled from the shorter ones.

        The longest rest that fits goes in whole; where none does, the longest of all is cut to fit. What can't be filled yet
        waits for more documents, unless these are the last.
        """
        pool = sorted(self.rests, key=_length)
        self.rests = []
        while pool:
            open_ = [pool.pop()]
            tier = self.tier(open_[0][3])
            room = tier - open_[0][3]
            while room and pool:
                if fit := bisect_right(pool, room, key=_length):
                    x = pool.pop(fit - 1)
                else:
                    doc_id, ids, start, n = pool.pop()
                    x = (doc_id, ids, start, room)
                    insort(pool, (doc_id, ids, start + room, n - room), key=_length)
                open_.append(x)
                room -= x[3]
            if not room:
                self.emit(tier, open_)
            elif last:
                self.close(open_)
            else:
                self.rests += open_

    def close(self, pieces: list[tuple]) -> None:
        """The task's last rests, cut into full sequences of falling tiers, and a short one of what is left then."""
        total = sum(x[3] for x in pieces)
        tier = self.window
        while total:
            while tier > max(total, self.least_tier):
                tier //= 2
            taken, room = [], min(tier, total)
            total -= room
            while room:
                doc_id, ids, start, n = pieces.pop(0)
                take = min(n, room)
                taken.append((doc_id, ids, start, take))
                if take < n:
                    pieces.insert(0, (doc_id, ids, start + take, n - take))
                room -= take
            self.emit(tier, taken)


def pack(docs: DataFrame, path: str | None = None, window: int = 1024, end_id: int = 0, groups: int = 8) -> DataFrame:
    """Pieces of every document in sequences of at most ``window`` (a power of two) ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; tier is the sequence's length, step_group the group that
    it is dealt to.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    schema = StructType.fromDDL(PIECES)
    arrow = to_arrow_schema(schema)

    def run(batches):
        codec = once(BytePairIds, path or _default_vocabulary(), end_id)
        packer = Packer(window, TaskContext.get().partitionId() << 33)

        def drain(most: int):
            for i in range(0, len(packer.out) if most == 0 else len(packer.out) // most * most, most or max(1, len(packer.out))):
                rows = packer.out[i : i + (most or len(packer.out))]
                yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*rows), arrow)], schema=arrow)
            packer.out = packer.out[len(packer.out) // most * most :] if most else []

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.put(doc_id, codec.encode(text or ""))
            packer.pack()
            yield from drain(10_000)
        packer.pack(last=True)
        yield from drain(0)

    pieces = written(texts(docs).mapInArrow(run, schema)).withColumn("task", F.shiftright("sequence_id", 33))
    # a row for each task and tier
    made = pieces.groupBy("task", "tier").agg((F.max("place") + 1).alias("n"))
    before = made.select("task", "tier", (F.sum("n").over(Window.partitionBy("tier").orderBy("task")) - F.col("n")).alias("before"))
    group = F.pmod(F.col("before") + F.col("place"), F.lit(groups).cast("long")).alias("step_group")
    return pieces.join(before, ["task", "tier"]).select(*(c for c in arrow.names if c != "place"), group)


def _default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
