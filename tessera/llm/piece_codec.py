"""SentencePiece encoding and decoding by a streaming Viterbi search over a model file's pieces and scores.

The text, in which the model's mark stands for spaces, is read character by character.  Pieces begin
at the last boundaries within the longest piece's length only.  Each boundary knows how many surviving
paths still lead through it; as soon as all of them lead through one later boundary, the ids before it
are committed and forgotten, at a constant cost a boundary.  Characters that no piece covers fall back
to byte pieces.  Paths always meet before a space that follows another character, and around a line
feed, where no piece goes across; so what stands between two such places is remembered by workers.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

#: The character that stands for a space in pieces.
MARK = "▁"
#: What a character outside the vocabulary scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Stretches between meeting places that a Python worker remembers before it starts afresh, and the longest of them.
CACHE_WORDS = 800_000
CACHE_CHARS = 64


class PieceModel:
    """The pieces, scores and bytes of a model file, and the search over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        #: Pieces as they stand in texts: a mark is a space, so a mark in a text is a character that no piece covers.
        self.ids = {self.pieces[k].replace(MARK, " "): (k, model.get_score(k)) for k in plain}
        self.bytes = {int(self.pieces[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = model.unk_id()
        self.controls = {k for k in range(n) if model.is_control(k)}
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(score for _, score in self.ids.values()) - UNKNOWN_PENALTY
        #: A tree of the pieces: (next characters, id or -1, score).
        self.tree: tuple[dict, list] = ({}, [-1, 0.0])
        for piece, (number, score) in self.ids.items():
            node = self.tree
            for char in piece:
                node = node[0].setdefault(char, ({}, [-1, 0.0]))
            node[1][:] = number, score
        # Where paths meet whatever stands around: before a space after another character, if no piece
        # has one there, and on both sides of a line feed, if no longer piece has one.
        spaces = all(" " not in piece.lstrip(" ") for piece in self.ids)
        lines = all("\n" not in piece for piece in self.ids if len(piece) > 1)
        self.stretch = re.compile((r"\n| +[^ \n]*|[^ \n]+" if lines else r" +[^ ]*") if spaces else r"(?s).+")
        self.cache: dict[str, bytes] = {}

    def fallback(self, char: str) -> list[int]:
        """The ids of a character that no piece covers."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def stream(self, chars: Iterable[str]) -> Iterator[tuple[int, ...] | list[int]]:
        """Ids of the best-scored segmentation, piece by piece, committed as soon as all surviving paths share a boundary.

        Of equal scores the path whose last piece starts earliest wins.
        """
        tree, low, ids = self.tree, self.unknown_score, self.ids
        base = at = 0
        score = {0: 0.0}  # of the best path to each boundary that a piece may begin at
        back: dict[int, tuple] = {}  # boundary -> (boundary before it, ids of the last piece)
        count, after = {0: 0}, {0: 0}  # boundary -> how many follow it on surviving paths, and all those xor-ed: the one if there is one
        open_ = [(0, tree)]  # boundaries from which a piece may go on, with its place in the tree
        for char in chars:
            at += 1
            best, how, grown, closed = None, None, [], []
            for start, node in open_:
                node = node[0].get(char)
                if node is None:
                    closed.append(start)
                    continue
                grown.append((start, node))
                number, gain = node[1]
                if number >= 0:
                    total = score[start] + gain
                    if best is None or total > best:
                        best, how = total, (start, (number,))
            if char not in ids:
                total = score[at - 1] + low
                if best is None or total > best:
                    best, how = total, (at - 1, self.fallback(char))
            score[at], back[at] = best, how
            count[at] = after[at] = 0
            count[how[0]] += 1
            after[how[0]] ^= at
            grown.append((at, tree))
            open_ = grown
            for start in closed:
                del score[start]
                while not count[start] and start != base and start not in score:  # no path leads through it any more
                    del count[start], after[start]
                    gone, start = start, back.pop(start)[0]
                    count[start] -= 1
                    after[start] ^= gone
            while count[base] == 1 and base not in score:
                meet = after[base]
                del count[base], after[base]
                base = meet
                yield back.pop(meet)[1]
        out = []
        while at > base:
            at, piece = back[at]
            out.append(piece)
        yield from reversed(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; a text of no characters has none."""
        if not text:
            return b""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, out = self.cache, bytearray()
        for part in self.stretch.finditer(" " + text):
            word = part[0]
            ids = cache.get(word)
            if ids is not None:
                out += ids
            elif len(word) <= CACHE_CHARS:
                ids = cache[word] = array("I", [x for piece in self.stream(word) for x in piece]).tobytes()
                out += ids
            else:
                for piece in self.stream(word):
                    out += array("I", piece).tobytes()
        return bytes(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: byte pieces are joined and read as UTF-8, marks become spaces, and the first space goes."""
        out: list[str] = []
        raw = bytearray()
        for k in array("I", ids):
            if k in self.byte_of:
                raw.append(self.byte_of[k])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if k not in self.controls:
                out.append(self.pieces[k].replace(MARK, " "))
        if raw:
            out.append(raw.decode(errors="replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model_for(path: str) -> PieceModel:
    """One model for each file and Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids) of every whole text; ids are little-endian unsigned 32-bit numbers.

    A null or empty text has no ids.  Texts of any length, also without a space, take time in proportion
    to it; what is kept beside the ids is what surviving paths do not yet share.  The mark itself in a text
    becomes byte pieces, so that it reads back as it is.  Repeated rows and null ids are encoded like any
    others; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model_for(model_path).encode
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                found = [of(x or "") for x in texts[at : at + 512]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_ids", "ids"])

    return docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text").mapInArrow(run, "doc_id long, n_ids long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_chars, text_sha256, text) of encoded rows; a null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model_for(model_path).decode
        for batch in batches:
            column = batch.column("ids").to_pylist()
            for at in range(0, len(column), 512):
                ids = [x or b"" for x in column[at : at + 512]]
                texts = [of(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([len(x) for x in texts], pa.int64()), pa.array([sha256(x.encode()).hexdigest() for x in texts]), pa.array(texts),
                    ],
                    ["doc_id", "n_ids", "ids_crc32", "n_chars", "text_sha256", "text"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, text_sha256 string, text string")


def round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_chars, text_sha256, exact): ids are encoded, decoded, and the decoded text compared with the document.

    Nulls count as empty; ``exact`` is true for every text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_for(model_path)
        for batch in batches:
            column = batch.column(1).to_pylist()
            for at in range(0, len(column), 512):
                texts = [x or "" for x in column[at : at + 512]]
                ids = [model.encode(x) for x in texts]
                back = [model.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([len(x) for x in back], pa.int64()), pa.array([sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(texts, back)]),
                    ],
                    ["doc_id", "n_ids", "ids_crc32", "n_chars", "text_sha256", "exact"],
                )

    return docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, text_sha256 string, exact boolean")
