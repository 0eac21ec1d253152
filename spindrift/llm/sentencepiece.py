"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file (states are numbers, arcs carry an input, outputs and a weight):

* the *normaliser* reads spaces and other characters, drops what is collapsed, and writes a U+2581 for a space and
  in front of the text (:class:`Normaliser`);
* the *pieces* are a trie: an arc reads a character, a final state writes a piece's id;
* *byte fallback* reads a character of one to four UTF-8 bytes along a chain of arcs and writes the bytes' ids, or
  the unknown id where the model has no bytes. It is used where no piece is the character.

Encoding composes them with an acceptor of the input and takes the shortest path in the tropical semiring (min, +):
:meth:`Transducer._path` relaxes the arcs of the composition in the order of the input's positions, which is a
topological one. A composed state is (position, last piece); an arc's weight is that of the last piece and the next:

* for unigram models the negative score of the next piece, so that the path of the largest sum of scores wins;
* for byte-pair models 0 where the two pieces are what the model makes of their concatenation, else infinity. Each
  text has exactly one path of finite weight, which is the model's encoding (the automaton of valid neighbours).

No piece has U+2581 behind another character, so texts are cut in front of it and the words' paths are
remembered for a bounded number of words.

Defined results: null and empty texts have no ids; decoding gives the text back wherever the normaliser
loses nothing; of paths of equal weight the one that a left-to-right relaxation meets first wins; the same row given
twice is encoded twice; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, arrow, table
from .tokens import place

MODEL, SPACE = "piece_bpe_32k.model", "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BYTE_PAIR = 1, 2
#: The zero of the tropical semiring, and the number that stands for no last piece.
INFINITY, NO_PIECE = float("inf"), 0xFFFF
#: How much worse than the worst piece an unknown character is, in unigram models.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + n]
            at += n


class Normaliser:
    """The transducer in front: arcs (state, whether a space is read) -> (next state, what is written first)."""

    OPEN, TEXT, GAP = 0, 1, 2  # before the text, within it, after a space that may be the last

    def __init__(self, prefix: bool, collapse: bool):
        first = SPACE if prefix else ""
        if collapse:
            self.arcs = {
                (self.OPEN, True): (self.OPEN, ""), (self.OPEN, False): (self.TEXT, first), (self.TEXT, True): (self.GAP, ""),
                (self.TEXT, False): (self.TEXT, ""), (self.GAP, True): (self.GAP, ""), (self.GAP, False): (self.TEXT, SPACE),
            }
        else:
            self.arcs = {
                (self.OPEN, True): (self.TEXT, first + SPACE), (self.OPEN, False): (self.TEXT, first),
                (self.TEXT, True): (self.TEXT, SPACE), (self.TEXT, False): (self.TEXT, ""),
            }

    def __call__(self, text: str) -> str:
        """What the path that reads ``text`` writes; runs of other characters are read in one go, as they write themselves."""
        state, out, arcs = self.OPEN, [], self.arcs
        for run in _RUNS.findall(text):
            space = run == " "
            state, before = arcs[state, space]
            out.append(before if space else before + run)
        return "".join(out)


class Transducer:
    """The compiled model."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        self.text: list[str] = []
        self.kind: list[int] = []
        self.score: list[float] = []
        for field, value in model:
            if field == 1:
                piece = dict(_fields(value))
                self.text.append(piece.get(1, b"").decode())
                self.score.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                self.kind.append(piece.get(3, NORMAL))
        if len(self.text) > NO_PIECE:
            raise ValueError("ids must fit 16 bits")
        normaliser = dict(_fields(dict(model).get(3, b"")))
        self.type = dict(_fields(dict(model).get(2, b""))).get(3, UNIGRAM)
        if self.type not in (UNIGRAM, BYTE_PAIR):
            raise ValueError("only unigram and byte-pair models have the weights described here")
        if normaliser.get(2):
            raise ValueError("normalisers with a character map are not compiled")
        self.prefix = bool(normaliser.get(3, 1))
        self.normalised = Normaliser(self.prefix, bool(normaliser.get(4, 1)))
        self.id = {t: k for k, (t, kind) in enumerate(zip(self.text, self.kind, strict=True)) if kind in (NORMAL, USER)}
        self.byte = {int(t[3:5], 16): k for k, (t, kind) in enumerate(zip(self.text, self.kind, strict=True)) if kind == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        self.longest = max(map(len, self.id), default=1)
        # The pieces' trie: a state is its arcs (character -> next state) and the id that it writes, or -1.
        self.root: dict[str, tuple] = {}
        for text, k in sorted(self.id.items()):  # beginnings first
            arcs, node = self.root, None
            for n, c in enumerate(text, 1):
                node = arcs.get(c)
                if node is None or (n == len(text) and node[1] < 0):
                    node = arcs[c] = (node[0] if node else {}, k if n == len(text) else -1)
                arcs = node[0]
        if self.type == BYTE_PAIR:
            rank = self.rank = {t: -self.score[k] for t, k in self.id.items()}
            self.joined = {
                self.id[t[:n]] << 16 | self.id[t[n:]]: rank[t] for t in self.id for n in range(1, len(t)) if t[:n] in self.id and t[n:] in self.id
            }
            self.order = [rank.get(t, -1.0) if len(t) > 1 else -1.0 for t in self.text]
            self.parts = Memo(self._split, 1 << 16, 0)
            self.weight = Memo(self._pair_weight, 600_000, 0)
            self.fallback = self.least = 0.0
        else:
            worst = min((self.score[k] for k in self.id.values()), default=0.0)
            self.fallback = UNKNOWN_PENALTY - worst
            self.least = min((-self.score[k] for k in self.id.values()), default=0.0)
            self.weight = Memo(lambda pair: -self.score[pair & 0xFFFF], 600_000, 0)
        self.path = Memo(self._path, 100_000)
        self.word = Memo(lambda word: self._path(SPACE + word), 500_000)
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() if k in (NORMAL, USER) else b"" for t, k in zip(self.text, self.kind, strict=True)]
        self.two = [k.to_bytes(2, "little") for k in range(len(self.text))]

    def _split(self, piece: int) -> tuple[int, int]:
        """The two pieces that are joined last on the way to a piece; (-1, -1) if its text ends otherwise."""
        parts = list(self.text[piece])
        while len(parts) > 2:
            best = min(((self.rank[ab], i) for i in range(len(parts) - 1) if (ab := parts[i] + parts[i + 1]) in self.rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (self.id.get(parts[0], -1), self.id.get(parts[1], -1)) if len(parts) == 2 else (-1, -1)

    def _pair_weight(self, pair: int) -> float:
        """The weight of a byte-pair model's piece b behind a piece a, of a << 16 | b.

        0 if no join across the border comes before the joins that make the two, else infinity. Walked back in
        time: the piece that was made later is taken apart, as far as single characters.
        """
        a, b = pair >> 16, pair & 0xFFFF
        parts = self.parts
        if self.order[b] >= 0 and parts[b][0] < 0:
            return INFINITY  # the model never makes this piece
        if a == NO_PIECE:
            return 0.0
        joined, order, until_a, until_b = self.joined.get, self.order, INFINITY, INFINITY
        while True:
            rank = joined(a << 16 | b)
            if rank is not None and rank < until_a and rank <= until_b:
                return INFINITY
            made_a, made_b = order[a], order[b]
            if made_a >= made_b:
                if made_a < 0:
                    return 0.0
                until_a, a = made_a, parts[a][1]
            else:
                until_b, b = made_b, parts[b][0]

    def _fallback(self, c: str) -> list[int]:
        """The outputs of the chain that reads a character without a piece."""
        return [self.byte[b] for b in c.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def _path(self, word: str) -> bytes:
        """The ids on the shortest path of a word that is normalised already.

        A position keeps its nearest state (distance, last piece, where that piece begins). This loses nothing: a
        unigram model's weights don't depend on the last piece, and a byte-pair model has one state of finite
        distance at each position.
        """
        n, root, weight = len(word), self.root, self.weight
        distance, last, begin = [INFINITY] * (n + 1), [NO_PIECE] * (n + 1), [0] * (n + 1)
        distance[0] = 0.0
        for i in range(n):
            far, behind, arcs, j = distance[i], last[i] << 16, root, i
            single, near = False, far + self.least
            for c in word[i : i + self.longest] if n > self.longest else word[i:] if i else word:
                node = arcs.get(c)
                if node is None:
                    break
                arcs, piece = node
                j += 1
                if piece >= 0:
                    if j == i + 1:
                        single = True
                    if distance[j] <= near:  # no weight of this arc can make it nearer
                        continue
                    total = far + weight[behind | piece]
                    if total < distance[j]:
                        distance[j], last[j], begin[j] = total, piece, i
            if not single and far + self.fallback < distance[i + 1]:  # byte fallback, behind which any piece may come
                distance[i + 1], last[i + 1], begin[i + 1] = far + self.fallback, NO_PIECE, i
        ids, at = [], n
        while at:
            piece, start = last[at], begin[at]
            ids.append(self.two[piece] if piece != NO_PIECE else b"".join([self.two[k] for k in self._fallback(word[start:at])]))
            at = start
        return b"".join(ids[::-1])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian 16-bit numbers."""
        if not text:
            return b""
        if self.prefix and not _UNUSUAL.search(text):  # words with one space between them: what the normaliser writes is known
            return b"".join(map(self.word.__getitem__, text.split(" ")))
        return b"".join(map(self.path.__getitem__, _WORDS.findall(self.normalised(text))))

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes are joined, the spaces come back, the one in front goes."""
        raw = self.raw
        text = b"".join([raw[k] for k in np.frombuffer(ids, "<u2").tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_RUNS = re.compile(" |[^ ]+")
_UNUSUAL = re.compile(f"^ |  | $|{SPACE}")
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@cache
def transducer(name: str = MODEL) -> Transducer:
    return Transducer(place(name))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = transducer()
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            ids = [t.encode(text) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id and ids (16-bit, little-endian) of every document."""
    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _encoded, "doc_id long, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = transducer()
    for batch in batches:
        texts = [None if ids is None else t.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decoded(ids: DataFrame) -> DataFrame:
    """doc_id and text, from :func:`encoded`."""
    return arrow(ids.select("doc_id", "ids"), _decoded, "doc_id long, text string")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t: Transducer = transducer()
    wide: Callable[[bytes], bytes] = lambda ids: np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    for batch in batches:
        texts = [text or "" for text in batch.column("text").to_pylist()]
        out: list[list] = [[], [], [], []]
        for text in texts:
            ids = t.encode(text)
            back = t.decode(ids)
            for column, value in zip(out, (len(ids) // 2, crc32(wide(ids)), crc32(back.encode("utf-8", "surrogatepass")), back == text), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"]
        )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: the number of ids, CRCs of the ids (32-bit, little-endian) and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow(docs, _checked, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
