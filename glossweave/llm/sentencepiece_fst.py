"""Encoding and decoding with a piece model as weighted finite-state transduction.

Three machines are compiled from the model file and composed lazily with each input:

* the normaliser, which emits U+2581 before the text and for every space (a model whose file names another
  one is refused);
* the pieces, a prefix tree whose final arcs write a piece, with a byte fallback: a
  character without a piece becomes its UTF-8 bytes;
* a bigram acceptor over pieces.  The model merges pairs by rank, and a sequence of pieces is
  what the merges give exactly if every two neighbours are what the merges give for their
  two texts together (Berglund and van der Merwe 2023, Cognetta and Okazaki 2024).  An arc of
  this machine is computed when it is first needed.

Every arc that writes a piece has weight 1; the encoding is the shortest path in the
tropical semiring.  Pre-tokens (see ``pretokens``) meet only at arcs that the acceptor always
has, so the path of a text is the paths of its pre-tokens in order, which workers cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import LONGEST_CACHED, checked_model, default_model, pre_tokens

SPACE = "▁"
#: Entries of one generation of a worker's path cache, and of its acceptor before it starts anew.
PATHS = 250_000
ARCS = 250_000
NO_ARCS: dict[int, bool] = {}
#: Stands for the last piece at the start and after bytes.
BYTES = -1


class PieceTransducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.ids[piece] = i
        self.score = {piece: model.get_score(i) for piece, i in self.ids.items()}
        # A node is a dict from character to node; "" holds the piece that ends there.
        self.root: dict = {}
        for piece, i in self.ids.items():
            if self._merged(piece) == [piece]:
                node = self.root
                for char in piece:
                    node = node.setdefault(char, {})
                node[""] = i
        self.arcs: dict[int, dict[int, bool]] = {}
        self.n_arcs = 0
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _arc(self, last: int, piece: int) -> bool:
        """Compute whether the acceptor lets ``piece`` follow ``last``."""
        a, b = self.pieces[last], self.pieces[piece]
        found = self._merged(a + b) == [a, b]
        if self.n_arcs >= ARCS:
            self.arcs.clear()
            self.n_arcs = 0
        self.n_arcs += 1
        self.arcs.setdefault(last, {})[piece] = found
        return found

    def shortest_path(self, text: str) -> list[int]:
        """Piece ids of a normalised text.

        The merges of every prefix are unique, so the acceptor leaves one arc into each
        position: a state of the composed machine is a position with its last piece
        (``BYTES`` at the start and after bytes, which never merge), and the first arc found
        into it is the shortest path to it.  States are taken on best first, the one behind
        the longest piece, which meets the end after few of them; each at most once.
        """
        n, root, arcs, compute = len(text), self.root, self.arcs, self._arc
        last: list[int | None] = [BYTES] + [None] * n
        came = [0] * (n + 1)
        agenda = [0]
        while last[n] is None:
            i = agenda.pop()
            piece = last[i]
            row = arcs.get(piece, NO_ARCS)
            node, j = root, i
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                if last[j] is None and "" in node:
                    to = node[""]
                    allowed = piece == BYTES or row.get(to)
                    if allowed is None:
                        allowed = compute(piece, to)
                    if allowed:
                        last[j], came[j] = to, i
                        agenda.append(j)
            if j == i and text[i] not in self.ids:
                last[j + 1], came[j + 1] = BYTES, i
                agenda.append(j + 1)
        at, found = n, []
        while at:
            back = came[at]
            if last[at] == BYTES:
                found.extend(reversed(self.fallback(text[back])))
            else:
                found.append(last[at])
            at = back
        return found[::-1]

    def fallback(self, char: str) -> list[int]:
        """Byte pieces of a character (a lone surrogate, which has no UTF-8, as U+FFFD)."""
        raw = "\ufffd" if "\ud800" <= char <= "\udfff" else char
        return [self.byte_ids[b] for b in raw.encode()]

    def path_bytes(self, token: str) -> bytes:
        """Path of one pre-token as 32-bit ids, kept in a cache of two generations."""
        found = self.older.get(token)
        if found is None:
            whole = token if token[:1] == "\n" else " " + token
            found = np.array(self.shortest_path(whole.replace(" ", SPACE)), "<i4").tobytes()
        if len(token) <= LONGEST_CACHED:
            if len(self.paths) >= PATHS:
                self.older, self.paths = self.paths, {}
            self.paths[token] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one."""
        get, path = self.paths.get, self.path_bytes
        return np.frombuffer(b"".join([get(t) or path(t) for t in pre_tokens(text)]), "<i4")


@lru_cache(maxsize=2)
def piece_texts(path: str) -> list[bytes]:
    """The decoding machine: what each piece id writes, as UTF-8.  Control ids write nothing."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_unknown(i):
            out.append(" ⁇ ".encode())
        else:
            out.append(b"" if model.is_control(i) else piece.replace(SPACE, " ").encode())
    return out


def decoded(ids: list[int], texts: list[bytes]) -> str:
    """Text of piece ids; the space that the normaliser put in front goes again."""
    raw = b"".join(map(texts.__getitem__, ids))
    return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """The compiled machines, once per worker process."""
    return PieceTransducer(path)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", column: str = "token_ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text (an empty array for null or empty).

    Rows are kept as they are: no shuffle, no grouping; an empty table stays empty.  A column named like the
    result is replaced.
    """
    path = checked_model(model or default_model())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in batches:
            yield pd.Series([machine.encode(x) for x in batch], dtype=object)

    return docs.withColumn(column, ids(F.col(text)))


def decode(docs: DataFrame, model: str | None = None, ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of piece ids (null stays null, none gives "").

    A column named like the result is replaced.
    """
    path = checked_model(model or default_model())

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = piece_texts(path)
        for batch in batches:
            yield pd.Series([None if x is None else decoded(x.tolist(), pieces) for x in batch], dtype=object)

    return docs.withColumn(column, texts(F.col(ids)))
