"""Sum-of-squares packing of tokenized documents into sequences.

Each document is tokenized and ends with ``end_id``; one longer than ``capacity``
is cut into pieces of that length. Pieces are then packed by the sum-of-squares
rule, the longest first: a piece goes where the sum, over the gaps, of the squared
number of open sequences that have that gap becomes smallest (a new sequence is
one of the choices; of equals, the smallest gap wins, a new sequence last).
Pieces are dealt at random into groups of about ``group_size``, each packed in one
task; a group leaves about one sequence partly empty.

Defined cases: a null text is empty, and an empty text is the end token alone.
Rows with equal doc_id are packed each on their own. An empty table gives no rows.
Columns of ``pack``'s input that are called sequence_id or offset are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

CAPACITY, END_ID, GROUP_SIZE = 4096, 1, 40_000


# The settings of a tokenizer for which what ``Words`` takes for granted holds.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Words:
    """A tokenizer with a memory: token ids, as little-endian 32-bit bytes, of chunks between spaces.

    The memory is used only with a tokenizer of the settings above, whose special
    tokens begin with ``<|``; with any other each text is encoded as it is.

    Such a tokenizer drops white space, and no token or normalization reaches over a
    space or line feed, so a text's ids are those of its chunks in turn. In a chunk
    of Latin letters and then signs the letters are one word of the tokenizer, in
    small letters, and the signs another. New words are encoded many at once: as
    only a word's last token has the end mark, the ids can be told apart. The memory
    is bounded: chunks are forgotten all at once, words in two generations.
    """

    # letters that the tokenizer lower-cases one by one as Python does, then signs without apostrophe, digit or white space
    _PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įĲ-ſ]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        added, model = settings.get("added_tokens") or [], settings["model"]
        self.by_words = settings.get("normalizer") == WORD_NORMALIZER and settings.get("pre_tokenizer") == WORD_SPLITTER and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in added)
        vocabulary = self.tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Adds words of one kind, letters only or signs only, to the memory."""
        if len(self._words) > self.most:
            self._older, self._words = self._words, {"": b""}
        new = []
        for w in words:
            if (found := self._older.get(w)) is None:
                new.append(w)
            else:
                self._words[w] = found
        raw = self._encode(" ".join(new)) if new else b""
        stops = (np.flatnonzero(self._ends[np.frombuffer(raw, "<u4")]) + 1) * 4
        if len(stops) == len(new):
            self._words.update(zip(new, (raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=False)), strict=True))
        else:
            self._words.update((w, self._encode(w)) for w in new)

    def _fill(self, chunks: list[str]) -> None:
        parts = {c: (m[1].lower(), m[2]) if (m := self._PLAIN.fullmatch(c)) else None for c in chunks}
        for kind in (0, 1):
            if missing := sorted(w for w in {p[kind] for p in parts.values() if p} if w not in self._words):
                self._learn(missing)
        for c, p in parts.items():
            try:
                self._chunks[c] = self._encode(c) if p is None else self._words[p[0]] + self._words[p[1]]
            except KeyError:  # its generation has just ended
                self._chunks[c] = self._encode(c)

    def ids(self, text: str) -> bytes:
        """The text's ids; where a special token's own text may stand, the whole text is encoded at once."""
        if "<|" in text:
            return self._encode(text)
        chunks = text.replace("\n", " ").split(" ")
        if missing := set(chunks).difference(self._chunks):
            if len(missing) > self.most:  # a text with more words than the memory holds
                return self._encode(text)
            if len(self._chunks) > 3 * self.most // 2:
                self._chunks.clear()
                missing = set(chunks)
            self._fill(list(missing))
        return b"".join(map(self._chunks.__getitem__, chunks))

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if self.by_words:
            yield from map(self.ids, texts)
            return
        for at in range(0, len(texts), 64):
            for found in self.tokenizer.encode_batch(texts[at : at + 64], add_special_tokens=False):
                yield np.array(found.ids, "<u4").tobytes()


_LOADED: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One memory for each Python worker, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32 (and ids, as an array)."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), words.ids_of(texts), strict=True):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row = [doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)]
                    for column, value in zip(out, row + [np.frombuffer(part, "<u4").astype(np.int32)] * with_ids, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given."""
    open_ = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one is no longer counted
    by_gap: dict[int, list[int]] = {}
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(open_[size:]) + size
        best = 2 * open_[capacity - size] + 1 if size < capacity else 0  # a new sequence adds so much
        gap = capacity
        if len(gaps):
            after = np.where(gaps > size, 2 * open_[gaps - size] + 1, 0)
            cost = after - 2 * open_[gaps] + 1
            if cost[i := int(cost.argmin())] <= best:
                gap = int(gaps[i])
        if gap == capacity:
            bins[k], made = made, made + 1
        else:
            bins[k] = by_gap[gap].pop()
            open_[gap] -= 1
        offsets[k] = capacity - gap
        if rest := gap - size:
            open_[rest] += 1
            by_gap.setdefault(rest, []).append(bins[k])
    return bins, offsets


def pack(found: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """``found`` (a table with length) with sequence_id and offset; no sequence has a hole or over ``capacity`` tokens."""
    groups = max(1, -(-found.count() // group_size))
    found = found.drop("sequence_id", "offset")
    dealt_by = fresh(found, "pack_group")
    dealt = found.withColumn(dealt_by, F.pmod(F.xxhash64("doc_id", "piece", "length", F.lit(7)), F.lit(groups)))
    fields = found.schema.names

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        # the longest first; ties in an order that does not hang on how rows arrive
        order = np.lexsort((table.column("ids_crc32").to_numpy(), table.column("piece").to_numpy(), pa.compute.fill_null(table.column("doc_id"), -1).to_numpy(), -lengths))
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        bins[order], offsets[order] = sum_of_squares(lengths[order], capacity)
        group = key[0].as_py()
        return table.select(fields).append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return dealt.groupBy(dealt_by).applyInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """Per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity, group_size)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array), and the pieces in their order."""
    placed = pack(written(pieces(docs, tokenizer, capacity, with_ids=True), "pieces"), capacity, group_size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # capacity bounds it
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"), p["piece"].alias("piece"))).alias("pieces"))
