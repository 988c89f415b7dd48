"""Best-fit-decreasing packing of tokenised documents into fixed-length training sequences.

Tokenising and cutting happen where the rows are read; only piece metadata (about 40 bytes a piece)
is shuffled, into groups of a bounded number of documents, and each group is packed by best-fit
decreasing.  A sequence never spans two groups, so a group leaves at most a few open sequences.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Words whose ids a Python worker remembers before it starts afresh.
CACHE_WORDS = 150_000
#: Parts longer than this are not remembered, and those with white space are encoded by ``tokenizers``.
LONG_PART = 10_000
#: Where a text may be cut: a space between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
WHITE = re.compile(r"\s")
#: White space other than space and line feed: of ASCII texts, and of all.
_ODD = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and chr(c) not in " \n"]
_ODD_ASCII = [c for c in _ODD if c.isascii()]


def plain(text: str) -> bool:
    """Whether every space of a text stands between two characters that are not white space (true only if so; some such texts give false)."""
    return not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in (_ODD_ASCII if text.isascii() else _ODD)))


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks by byte string, and added tokens, of a byte-level BPE file whose ids follow its merges.

    The file writes each byte as a printable character: printable Latin-1 bytes as themselves, the
    others, in order, as the characters from 256 on.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in added}, added


class WordCachedTokenizer:
    """Whole-text ids of a byte-level BPE file, put together from remembered ids of words.

    A space between two characters that are not white space opens the next word, and the
    pre-tokenizer never joins characters across its front.  So a text is cut there and nowhere else,
    and each different part is encoded once.  The ids equal those of
    ``tokenizers.Tokenizer.from_file(path)`` (tested on random mixtures of white space); the merges
    run in tiktoken, which needs about a quarter of its time for a new word.  Its pattern engine can't
    take very long runs of white space, so long parts with white space go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks, added = byte_ranks(path)
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.path, self.whole = path, None
        self.cache: dict[str, bytes] = {}

    def _encode(self, part: str) -> bytes:
        if len(part) > LONG_PART and WHITE.search(part):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes()
        return self.encoding.encode_to_numpy(part, allowed_special="all").astype("<u4").tobytes() if "<|" in part else array("I", self.encoding.encode_ordinary(part)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        first, *rest = text.split(" ") if plain(text) else CUT.split(text)
        out = [self._encode(first)]
        for part in rest:
            ids = cache.get(part)
            if ids is None:
                ids = self._encode(" " + part)
                if len(part) <= LONG_PART:
                    cache[part] = ids
            out.append(ids)
        return b"".join(out)


_tokenizers: dict[str, WordCachedTokenizer] = {}


def tokenizer_for(path: str) -> WordCachedTokenizer:
    """One tokenizer for each file and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordCachedTokenizer(path)
    return _tokenizers[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only longer ones are cut, and the first piece takes the rest."""
    head = n % capacity or capacity if n > capacity else n
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


class OpenBins:
    """Open sequences by remaining room, with a segment tree that finds the tightest room in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the tightest open bin with room >= need."""
        at, count = need + self.leaves, self.count
        while not count[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; lengths from 1 to ``capacity``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    full = np.flatnonzero(lengths == capacity)
    bins[full] = np.arange(len(full))
    made, tree = len(full), OpenBins(capacity)
    rest = np.flatnonzero(lengths < capacity)
    for k in rest[np.argsort(-lengths[rest], kind="stable")].tolist():
        need = int(lengths[k])
        found = tree.take(need)
        if found is None:
            room, at = capacity, made
            made += 1
        else:
            room, at = found
        bins[k], offsets[k] = at, capacity - room
        if room > need:
            tree.add(room - need, at)
    return bins, offsets


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, groups: int, keep_ids: bool) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, pack_group[, ids]) of the documents' pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer_for(tokenizer_path).encode, np.asarray([end_id], dtype="<u4").tobytes()
        group = TaskContext.get().partitionId() * 7919
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for begin in range(0, len(texts), 512):
                rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "group", "ids")}
                for k, ids in enumerate(map(encode, (x or "" for x in texts[begin : begin + 512]))):
                    ids += end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        group += 1
                        for name, value in (("row", begin + k), ("piece", piece), ("start", start), ("length", length), ("crc", zlib.crc32(own)), ("group", group % groups), ("ids", own)):
                            rows[name].append(value)
                out = {
                    "doc_id": doc_ids.take(pa.array(rows["row"], pa.int64())), "piece": pa.array(rows["piece"], pa.int32()), "start": pa.array(rows["start"], pa.int64()),
                    "length": pa.array(rows["length"], pa.int64()), "ids_crc32": pa.array(rows["crc"], pa.int64()), "pack_group": pa.array(rows["group"], pa.int64()),
                }
                if keep_ids:
                    out["ids"] = pa.array(rows["ids"], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, pack_group long" + ", ids binary" * keep_ids)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 0, group_documents: int = 65_536, keep_ids: bool = False
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens by best-fit decreasing.

    Each document is its ids followed by ``end_id``; a null text counts as empty, so every row gives
    at least one token.  Repeated rows and repeated or null ids are packed like any others (one set of
    pieces a row); other columns are ignored; an empty table gives no rows.  Returns doc_id, piece,
    start, length, ids_crc32, sequence_id, offset, and with ``keep_ids`` the pieces' ids as
    little-endian unsigned 32-bit bytes.
    """
    groups = max(1, docs.count() // group_documents)
    source = docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text")
    pieces = tokenized_pieces(source, tokenizer_path, capacity, end_id, groups, keep_ids)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(group["length"].to_numpy(), capacity)
        number = group["pack_group"].iloc[0] * (1 << 40)
        return group.drop(columns="pack_group").assign(sequence_id=number + bins, offset=offsets)

    return pieces.groupBy("pack_group").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")
