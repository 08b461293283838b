"""SentencePiece (BPE with byte fallback): exact encoding by backtracking, and decoding.

A piece sequence is what merging yields if and only if each adjacent pair is compatible, i.e. merging the characters of the
two gives the two back. So the encoder walks the text with the longest piece at each position, tries shorter ones where a
pair is not compatible, and steps back where none is left; a bitfield keeps the positions from which no way leads on.
Pieces come from an Aho-Corasick automaton. No piece has U+2581 after another character, so merges never cross the start of
a run of spaces: each such segment is encoded alone, and short ones are remembered (a fixed number in each task).

Nulls count as empty texts; an empty text has no ids. Every row gives one row, repeated rows too. A text without spaces is one
segment; its time grows in proportion to its length, since a step looks no further than the longest piece.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from shelfmark.llm.common import Remembered, arrow_map, once, texts

SPACE = "▁"


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a leading space are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.rank = {p: n for n, p in enumerate(sorted(self.ids, key=lambda p: (-model.pieces[self.ids[p]].score, self.ids[p])))}
        self.names = {p: str(i) for p, i in self.ids.items()}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space after another character")
        chars = {c for p in self.rank for c in p}
        self.found = ahocorasick.Automaton()
        whole = {p for p in self.rank.keys() | chars if len(p) == 1 or self.merged(p) == [p]}  # others can't be in a result
        for p in whole:
            self.found.add_word(p, len(p))
        self.found.make_automaton()
        self.most = max(map(len, whole))
        #: the next shorter piece with which each piece begins
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), "") for p in whole}
        self.fits = Remembered(lambda pair: self.merged(pair[0] + pair[1]) == [*pair])
        self.segment = Remembered(self._segment, 400_000)

    def merged(self, text: str) -> list[str]:
        """Merges the best adjacent pair, the leftmost of equals, until none is left: the definition, for short strings."""
        parts, rank, none = list(text), self.rank, len(self.rank)
        while len(parts) > 1:
            best, at = none, 0
            for i in range(len(parts) - 1):
                if (r := rank.get(parts[i] + parts[i + 1], none)) < best:
                    best, at = r, i
            if best == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def longest(self, text: str, at: int) -> str:
        """The longest piece that starts here; an unknown character stands alone and never merges."""
        part = text[at : at + self.most]
        end, n = next(self.found.iter_long(part), (0, 1))
        return part[: n if end + 1 == n else 1]

    def tokens(self, text: str) -> list[str]:
        out: list[str] = []
        at, last, fits = 0, "", self.fits
        for end, n in self.found.iter_long(text):  # longest matches from left to right
            piece = text[at : end + 1]
            if len(piece) != n or last and not fits[last, piece]:
                break
            out.append(piece)
            at, last = end + 1, piece
        if at == len(text):
            return out
        failed = bytearray(len(text) // 8 + 1)
        piece, shorter = self.longest(text, at), self.shorter
        while at < len(text):
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits[out[-1], piece]):
                    break
                piece = shorter.get(piece, "")
            if piece:
                out.append(piece)
                at = end
                piece = self.longest(text, at) if at < len(text) else ""
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = shorter.get(last, "")
        return out

    def _segment(self, rest: str) -> tuple[int, str, bytes]:
        """Number of ids, ids joined by commas and decoded bytes of a segment: a space and the rest."""
        pieces = self.tokens(SPACE + rest)
        names = list(map(self.names.get, pieces))
        if None not in names:  # then the pieces are the text itself
            return len(names), ",".join(names), (SPACE + rest).replace(SPACE, " ").encode()
        ids = []
        for t in pieces:
            if (i := self.ids.get(t)) is not None:
                ids.append(i)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in t.encode()]
            else:
                ids.append(self.unknown)
        return len(ids), ",".join(map(str, ids)), self.raw(ids)

    def segments(self, text: str) -> list[str]:
        """What follows the first space of each segment; the library puts a space before a text."""
        if "  " in text or text.startswith(" ") or SPACE in text:
            return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for s in (self.segments(text) if text else ()) for i in self.segment[s][1].split(",")]

    def raw(self, ids: list[int]) -> bytes:
        """Bytes of the pieces, spaces as such; bytes pieces as the library shows them: invalid ones as U+FFFD each."""
        out, run = [], bytearray()

        def close():
            data, at = bytes(run), 0
            run.clear()
            while at < len(data):
                for n in (1, 2, 3, 4):
                    try:
                        data[at : at + n].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(data[at : at + n])
                    at += n
                    break
                else:
                    out.append("�".encode())
                    at += 1

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                close()
            if i == self.unknown:
                out.append(" ⁇ ".encode())
            elif i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " ").encode())
        if run:
            close()
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        data = self.raw(ids)
        return (data[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else data).decode()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        sizes, ids, parts = zip(*map(self.segment.__getitem__, self.segments(text))) if text else ((), (), ())
        data = b"".join(parts)
        return sum(sizes), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(data[1:] if data[:1] == b" " else data).hexdigest()


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every whole text."""

    def start():
        codec = once(PieceCodec, model or _default_model())

        def f(doc_id, text):
            ids = [codec.encode(t or "") for t in text]
            return [doc_id, ids, [codec.decode(x) for x in ids]]

        return f

    return arrow_map(texts(docs), start, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def start():
        codec = once(PieceCodec, model or _default_model())

        def f(doc_id, text):
            found = [codec.digest(t or "") for t in text]
            return [doc_id, *([x[i] for x in found] for i in range(3))]

        return f

    return arrow_map(texts(docs), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
