"""SentencePiece BPE encoding by a prefix table, and decoding.

Merging the best pair again and again fixes, for every prefix of a text, the last token of that prefix's
encoding. So one pass over the text fills a table "prefix length -> last token": the candidates are the pieces
that an Aho-Corasick automaton finds ending there, and a candidate stands if it is compatible with the last token
of the prefix that it would extend, that is, if merging would leave the border between the two alone. Exactly
one candidate stands. The ids are then read from the table backwards.

Compatibility is decided without merging the text: both tokens are taken apart again, latest merge first, and the
border must not have offered a better merge at any earlier time. Pieces of equal score, which the argument does
not cover, occur in these vocabularies only among runs of the space mark; stretches that hold such a run are
merged directly with a heap, under the library's rule (best score, then leftmost).

A text is cut where no piece can span: before a space mark that follows another character, and around characters
that no piece holds. Stretches are encoded once and remembered in a bounded table that each Python worker keeps.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import tidied

MARK = "▁"
#: Stretches that a worker remembers before it starts afresh, and their greatest length in characters.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48


class PieceTable:
    """The vocabulary of one SentencePiece BPE model, as plain tables that can be sent to executors."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], control: frozenset[int], bos: int, eos: int, unk: int):
        self.pieces, self.byte_ids, self.control = pieces, byte_ids, control
        self.bos, self.eos, self.unk = bos, eos, unk
        #: The two tokens whose merge makes a piece, or None; filled on the driver, so that workers start with it.
        self.made: dict[str, tuple[str, str] | None] = {}

    @classmethod
    @cache
    def from_model(cls, path: str) -> PieceTable:
        """Read a model file; ValueError if it is not BPE with byte fallback over unnormalised text with a space put before it."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, control = {}, {}, set()
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif sp.is_control(i):
                control.add(i)
            elif not sp.is_unknown(i):
                pieces[piece] = (i, sp.get_score(i))
        table = cls(pieces, byte_ids, frozenset(control), sp.bos_id(), sp.eos_id(), sp.unk_id())
        probes = ("", " ", "  a  b ", "ﬁ ① x", "é　é", "\x00\t\n", "ab" * 9)
        codec = Codec(table)
        if len(byte_ids) != 256 or any(codec.encode(t) != sp.encode(t, add_bos=True, add_eos=True) for t in probes):
            raise ValueError(f"{path}: not a BPE model with byte fallback and identity normalisation")
        return table


class Codec:
    """Encoder and decoder over a PieceTable; one for each Python worker."""

    def __init__(self, table: PieceTable):
        import ahocorasick

        self.table = table
        self.span = 1 + max((i for i, _ in table.pieces.values()), default=0)
        self.by_id = {i: p for p, (i, _) in table.pieces.items()}
        self.by_byte = {i: b for b, i in table.byte_ids.items()}
        inside = {c for p in table.pieces for c in p}
        lone = "".join(re.escape(c) for c in "\n\r\t" if c not in inside)
        inner = any(MARK in p.lstrip(MARK) for p in table.pieces)
        cut = rf"[{lone}]|" if lone else ""
        self.stretch = re.compile(r"(?s).+" if inner else rf"{cut}{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+")
        tied: dict[float, set[str]] = {}
        for p, (_, score) in table.pieces.items():
            tied.setdefault(score, set()).update(p)
        counts: dict[float, int] = {}
        for _, score in table.pieces.values():
            counts[score] = counts.get(score, 0) + 1
        self.tied = {c for score, chars in tied.items() if counts[score] > 1 for c in chars}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, (i, _) in table.pieces.items():
            if len(piece) == 1 or self.halves(piece):  # merging never makes the others
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    # -- merging, for short strings and for stretches with tied pieces

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The symbols left after merging best pairs (best score, then leftmost), and the last merge made."""
        pieces = self.table.pieces
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(symbols):
                both = symbols[left] + symbols[right]
                if both in pieces:
                    heapq.heappush(heap, (-pieces[both][1], left, both))

        for i in range(len(text) - 1):
            offer(i)
        last = None
        while heap:
            _, left, both = heapq.heappop(heap)
            if symbols[left] is None:
                continue
            right = after[left]
            if right >= len(symbols) or symbols[left] + symbols[right] != both:
                continue
            last = (symbols[left], symbols[right])
            symbols[left], symbols[right] = both, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [s for s in symbols if s is not None], last

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes piece; None for a character and for a piece that merging never makes."""
        made = self.table.made
        if piece not in made:
            symbols, last = self.merged(piece)
            made[piece] = last if len(symbols) == 1 else None
        return made[piece]

    def when(self, token: str) -> float:
        """The time of the merge that makes a token: better scores come first, characters are there from the start."""
        return -self.table.pieces[token][1] if len(token) > 1 else float("-inf")

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging left + right keeps the border between the two tokens."""
        # Going back in time, (left, right) face each other over the border until the later one is taken apart.
        # `until` is when they stopped doing so; of merges at one time, the one further left comes first.
        until, left_moved = float("inf"), True
        while True:
            across = self.table.pieces.get(left + right)
            if across is not None:
                time = -across[1]
                if time < until or (time == until and not left_moved):
                    return False
            if len(left) == 1 and len(right) == 1:
                return True
            left_moved = self.when(left) > self.when(right)
            until = self.when(left if left_moved else right)
            parts = self.halves(left if left_moved else right)
            if left_moved:
                left = parts[1]
            else:
                right = parts[0]

    # -- encoding

    def ids(self, stretch: str) -> list[int]:
        """The ids of a stretch, by the prefix table."""
        tied = self.tied
        if any(a in tied and b in tied for a, b in zip(stretch, stretch[1:], strict=False)):
            return self._ids_of(self.merged(stretch)[0])
        # last[n] is the last token of the first n characters' encoding; -1 stands for a character without a piece
        last, sizes = [-1] * (len(stretch) + 1), [1] * (len(stretch) + 1)
        pairs, span, found = self.pairs, self.span, -1
        for end, (token, size) in self.automaton.iter(stretch):
            if end == found:
                continue
            before = last[end + 1 - size] if end + 1 > size else -1
            if before >= 0:
                pair = before * span + token
                stands = pairs.get(pair)
                if stands is None:
                    if len(pairs) >= 2 * REMEMBERED:
                        pairs.clear()
                    stands = pairs[pair] = self.compatible(self.by_id[before], self.by_id[token])
                if not stands:
                    continue
            last[end + 1], sizes[end + 1], found = token, size, end
        out, end = [], len(stretch)
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
            else:
                out.extend(self.table.byte_ids[b] for b in reversed(stretch[end - 1].encode("utf-8")))
            end -= sizes[end]
        return out[::-1]

    def _ids_of(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for t in tokens:
            found = self.table.pieces.get(t)
            if found is not None:
                out.append(found[0])
            else:
                out.extend(self.table.byte_ids[b] for b in t.encode("utf-8"))
        return out

    def normalised(self, text: str) -> str:
        return (MARK + text.replace(" ", MARK)) if text else ""

    def encode(self, text: str) -> list[int]:
        """All ids of a text, begin and end included."""
        packed, _ = self.both(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def both(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the text that they decode to."""
        known, one = self.known, self._remember
        found = [known.get(s) or one(s) for s in self.stretch.findall(self.normalised(text))]
        body = b"".join([ids for ids, _ in found])
        said = "".join([said for _, said in found])
        ends = struct.Struct("<I").pack
        return ends(self.table.bos) + body + ends(self.table.eos), said[1:] if said.startswith(" ") else said

    def _remember(self, stretch: str) -> tuple[bytes, str]:
        ids = self.ids(stretch)
        value = (struct.pack(f"<{len(ids)}I", *ids), self._joined(ids))
        if len(stretch) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[stretch] = value
        return value

    # -- decoding

    def _joined(self, ids: list[int]) -> str:
        """The text of ids before the space that encoding put first is taken off."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            while raw:  # a byte that begins no character is one replacement character
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode("utf-8"))
                    except UnicodeDecodeError:
                        continue
                    del raw[:n]
                    break
                else:
                    out.append("�")
                    del raw[:1]

        for i in ids:
            if i in self.by_byte:
                raw.append(self.by_byte[i])
                continue
            flush()
            if i in self.table.control:
                continue
            out.append(" ⁇ " if i == self.table.unk else self.by_id[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, byte ids are joined, one leading space is taken off."""
        said = self._joined(ids)
        first = next((i for i in ids if i not in self.table.control), None)
        return said[1:] if first in self.by_id and self.by_id[first].startswith(MARK) else said


#: The codec of this Python worker, made when its first batch arrives.
_WORKER: dict[int, Codec] = {}


def _codec(table: PieceTable, tag: int) -> Codec:
    if tag not in _WORKER:
        _WORKER.clear()
        _WORKER[tag] = Codec(table)
    return _WORKER[tag]


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of whole texts and, with keep_ids, the ids (array).

    A null text is the empty text, whose ids are begin and end alone. One row for each row of df; other columns
    are not read. The vocabulary (some 32,000 pieces, about 1 MB) is broadcast; its size does not follow the data.
    """
    spark = df.sparkSession
    table = PieceTable.from_model(model)
    shared = spark.sparkContext.broadcast(table)
    tag = hash((model, len(table.pieces)))
    name = df.schema[key]
    schema = f"`{key}` {name.dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _codec(shared.value, tag).both
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [both(t or "") for t in part.column(1).to_pylist()]
                columns = [
                    part.column(0),
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(said.encode("utf-8")).hexdigest() for _, said in found], pa.string()),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    upto = np.cumsum([0, *(len(ids) // 4 for ids, _ in found)], dtype=np.int32)
                    flat = np.frombuffer(b"".join([ids for ids, _ in found]), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(key, text).mapInArrow(tidied(run), schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that an array of ids stands for; null for null."""
    shared = df.sparkSession.sparkContext.broadcast(PieceTable.from_model(model))
    tag = hash((model, len(shared.value.pieces)))

    @F.pandas_udf("string")
    def said(column: pd.Series) -> pd.Series:
        codec = _codec(shared.value, tag)
        return column.map(lambda x: None if x is None else codec.decode([int(i) for i in x]))

    return df.withColumn(out, said(F.col(ids)))
