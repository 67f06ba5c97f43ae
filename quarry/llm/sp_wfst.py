"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled once a worker, as three machines:

* the normaliser: arcs from characters to characters (a space becomes the space mark), and one mark before the text;
* the pieces: arcs from a piece's characters to its id. In a unigram vocabulary an arc weighs the piece's negative score. In a BPE
  vocabulary sums of scores do not give the library's result; there the context of an arc is the piece before it, and the
  arc from piece a to piece b weighs 0 where BPE leaves the string ab as (a, b), and infinity where some merge would cross
  their border;
* byte fallback: arcs from a character that is no piece to its bytes, at the weight of an unknown.

Composed with an input, its states are (position, context); the ids are the labels of the shortest path in the tropical semiring
(``shortest``: a path adds its weights, paths to one state take the least). In the BPE machine merges have one order everywhere, so a path is
the BPE result if and only if each piece and each adjacent pair is: exactly one path per prefix has a finite
weight, and ``path`` finds it with one live state a position. No arc spans two characters that stand side by side in no piece, so
inputs factor there (at spaces and line ends, mostly between letters and marks), and each distinct part is composed once.

Defined results: null text is empty and has no ids. A text without the space mark survives decode(encode(text)); a space mark in it
comes back as a space. Characters outside the vocabulary become byte pieces. Repeated rows, ties and extra columns pass
through; a column named like an output is replaced. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = "▁"
#: Entries of a worker's word and pair memories.
MEMORY = 600_000


_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


INF = float("inf")
#: What an unknown character costs more than the worst piece of a unigram vocabulary.
UNKNOWN = 10.0


class Transducer:
    """``pieces`` are (text, id, score); ``byte`` has the id of each byte; ``kind`` is bpe or unigram."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte: dict[int, int], kind: str = "bpe"):
        if len(byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        n = 1 + max([*byte.values(), *(i for _, i, _ in pieces)])
        self.kind, self.byte = kind, byte
        self.piece, self.score, self.raw = {}, [0.0] * n, [b""] * n
        for s, i, score in pieces:
            self.piece[s], self.score[i], self.raw[i] = i, score, s.replace(MARK, " ").encode()
        for b, i in byte.items():
            self.raw[i] = bytes([b])
        if any(MARK in s.lstrip(MARK) or "\n" in s and len(s) > 1 for s in self.piece):
            raise ValueError("a piece spans words or lines")
        self.unknown = UNKNOWN - min((x for _, _, x in pieces), default=0.0) if kind == "unigram" else 0.0
        #: Characters that stand side by side in some piece.
        self.beside = {s[k : k + 2] for s in self.piece for k in range(len(s) - 1)}
        #: Longest piece that ends in these three characters; shorter ends have pieces of two characters at most.
        self.reach: dict[str, int] = {}
        for s in self.piece:
            if len(s) > 2:
                self.reach[s[-3:]] = max(len(s), self.reach.get(s[-3:], 0))
        self.text = {i: s for s, i in self.piece.items()}
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte.values())] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        """The machine of a SentencePiece model file; a model without merges among its pieces' scores is a unigram one."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        byte, pieces = {}, []
        for i in range(sp.get_piece_size()):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(s[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append((s, i, sp.get_score(i)))
        # The scores of a BPE model are the numbers of its merges.
        kind = "bpe" if all(x == int(x) for _, _, x in pieces) else "unigram"
        return cls(pieces, byte, kind)

    def normalise(self, text: str) -> str:
        """The text through the normaliser."""
        return MARK + text.replace(" ", MARK)

    def weight(self, context: int, piece: int) -> float:
        """Of the arc of a piece after a context: the piece before it, or a negative number after the start or a character in bytes."""
        if self.kind == "unigram":
            return -self.score[piece]
        return 0.0 if self._whole(piece) and (context < 0 or self.follows(context, piece)) else INF

    def arcs(self, w: str, end: int) -> Iterator[tuple[int, int | None]]:
        """(length, piece) of the arcs that end at a position; (1, None) is the byte arc of a character that is no piece."""
        reach = self.reach.get(w[end - 3 : end], 2) if end > 2 else end
        for length in range(min(reach, end), 0, -1):
            t = self.piece.get(w[end - length : end])
            if t is not None:
                yield length, t
        if w[end - 1] not in self.piece:
            yield 1, None

    def shortest(self, w: str) -> list[int]:
        """Ids along the shortest path of the composed machine, by dynamic programming over (position, context)."""
        best: list[dict[int, tuple]] = [{-1: (0.0, 0, None, None)}, *({} for _ in w)]
        for end in range(1, len(w) + 1):
            here = best[end]
            for length, t in self.arcs(w, end):
                for context, (cost, *_) in best[end - length].items():
                    total = cost + (self.unknown if t is None else self.weight(context, t))
                    state = -2 if t is None or self.kind == "unigram" else t
                    if total < INF and (state not in here or total < here[state][0]):
                        here[state] = (total, length, t, context)
        out: list[int] = []
        end, state = len(w), min(best[-1], key=lambda q: best[-1][q][0])
        while end:
            _, length, t, context = best[end][state]
            out += [t] if t is not None else [self.byte[b] for b in reversed(w[end - 1].encode("utf-8", "surrogatepass"))]
            end, state = end - length, context
        return out[::-1]

    def merges(self, s: str) -> list[str]:
        """BPE by its definition, for strings of a piece or two: join the best adjacent pair, leftmost on a tie."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.piece.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _whole(self, i: int) -> bool:
        if i not in self.own:
            self.own[i] = self.merges(self.text[i]) == [self.text[i]]
        return self.own[i]

    def follows(self, a: int, b: int) -> bool:
        """Whether the arc from piece a to piece b has a finite weight."""
        got = self.pairs.get((a, b))
        if got is None:
            s, t = self.text[a], self.text[b]
            got = (s + t) not in self.piece and self.merges(s + t) == [s, t]
            if len(self.pairs) < MEMORY:
                self.pairs[a, b] = got
        return got

    def path(self, w: str) -> list[int]:
        """``shortest`` of the BPE machine: along the one path of finite weight; a character without a piece is its bytes and joins nothing."""
        n = len(w)
        last: list[int] = [-1] * (n + 1)  # piece that ends here; -1 start, -2 a character in bytes
        size = [0] * (n + 1)
        piece, follows, reach = self.piece, self.follows, self.reach
        for e in range(1, n + 1):
            for length in range(min(reach.get(w[e - 3 : e], 2) if e > 2 else e, e), 0, -1):
                t = piece.get(w[e - length : e])
                if t is None:
                    continue
                p = last[e - length]
                if self._whole(t) and (p < 0 or follows(p, t)):
                    last[e], size[e] = t, length
                    break
            else:
                last[e], size[e] = -2, 1
        out: list[int] = []
        e = n
        while e:
            if last[e] >= 0:
                out.append(last[e])
            else:
                out += [self.byte[b] for b in reversed(w[e - 1].encode("utf-8", "surrogatepass"))]
            e -= size[e]
        return out[::-1]

    def _word(self, w: str) -> bytes:
        """Ids of a word as bytes: of each of its parts, cut where no piece holds both neighbours."""
        beside, at, ids = self.beside, 0, []
        for k in range(1, len(w) + 1):
            if k == len(w) or w[k - 1 : k + 1] not in beside:
                part = w[at:k]
                got = self.parts.get(part)
                if got is None:
                    got = self.path(part) if self.kind == "bpe" else self.shortest(part)
                    if len(self.parts) < MEMORY and len(part) < 64:
                        self.parts[part] = got
                ids += got
                at = k
        b = np.array(ids, "<u2").tobytes()
        if len(self.words) < MEMORY and len(w) < 64:
            self.words[w] = b
        return b

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint16)
        s = self.normalise(text)
        known, word = self.words.get, self._word
        return np.frombuffer(b"".join([known(w) or word(w) for w in _WORDS.findall(s)]), "<u2")

    def decode(self, ids) -> str:
        raw = self.raw
        s = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return s[1:] if s.startswith(" ") else s


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One machine a worker process and vocabulary."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer.load(path)
    return _MACHINES[path]


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("array<int>")
    def enc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(vocabulary)
        for s in parts:
            yield s.map(lambda t: m.encode(t).astype(np.int32))

    return df.withColumn(out, enc(F.coalesce(text_col, F.lit(""))))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def dec(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = machine(vocabulary)
        for s in parts:
            yield s.map(lambda v: m.decode(() if v is None else v))

    return df.withColumn(out, dec(ids_col))


def digest(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, n_byte_ids, ids_crc32, decoded_sha256): the ids of each text, decoded again; ids stay in the worker."""
    import hashlib
    import zlib

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(vocabulary)
        for rb in batches:
            rows = []
            for t in rb.column(1):
                ids = m.encode(t.as_py())
                back = m.decode(ids.tolist())
                rows.append((len(ids), int(m.is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(cols[k], pa.int64()) for k in range(3)), pa.array(cols[3], pa.string())], names=[id_col, "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(go, f"{id_col} {kind}, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string")
