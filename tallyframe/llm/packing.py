"""Packing tokenized documents into sequences: shortest pack first over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .ordering import with_position
from .scratch import written

#: Lower-case letters of Latin-1: words of these alone need no normalization and are one token candidate.
LATIN = re.compile(r"[a-zß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in turn."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


#: How a tokenizer prepares text whose ids are those of its words: lower case, white space dropped, no token across kinds of characters.
WORDS_APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def words_apart(model: Tokenizer) -> bool:
    """Whether the tokenizer prepares text as WORDS_APART says and then merges within words."""
    own = json.loads(model.to_str())
    return all(own.get(k) == v for k, v in WORDS_APART.items()) and own["model"]["type"] == "BPE" and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in own["added_tokens"])


PIECES = "doc long, start long, length int, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Token ids (little-endian 32-bit) of texts without blank or line feed, kept for ``room`` texts.

    The tokenizer neither joins nor looks across white space, so a text's ids are those
    of its parts at blanks and line feeds. Also a letter before one final comma
    or full stop ends a token, and the tokenizer lower-cases: these cases are
    composed, so that fewer texts have to be encoded. All this holds for tokenizers that prepare text as WORDS_APART says;
    with any other, whole texts are encoded at once.
    """

    def __init__(self, model: Tokenizer, room: int = 400_000):
        super().__init__()
        self.model, self.room = model, room
        self.bpe, self.letters, self.apart = model.model, byte_letters(), words_apart(model)

    def encode(self, word: str) -> list[int]:
        if LATIN.fullmatch(word):  # straight to the merges: three times as fast
            return [t.id for t in self.bpe.tokenize(word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode())))]
        return self.model.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        if word[-1:] in (",", ".") and word[-2:-1].isalpha() and word[-2:-1].isascii():
            found = self[word[:-1]] + self[word[-1]]
        elif word.isascii() and "<|" not in word and (low := word.lower()) != word:
            found = self[low]
        else:
            found = b"".join(i.to_bytes(4, "little") for i in self.encode(word))
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        if not self.apart:
            return b"".join(i.to_bytes(4, "little") for i in self.model.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(tokenizer: str) -> WordIds:
    """One cache a Python worker, kept from task to task."""
    return WordIds(Tokenizer.from_file(tokenizer))


def tokenized_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int, end_id: int) -> DataFrame:
    """Pieces of at most ``length`` ids of each document, its last id being ``end_id``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.of(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(pieces, PIECES)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how often, lengths in it) that hold each length as often as ``histogram`` says.

    Lengths are placed longest first. All items of a length go onto the open patterns with the most
    room left, that is the shortest packs; where fewer items are left than a pattern
    has sequences, the pattern is split; items without an open pattern that has
    room start one of their own. Open patterns are kept by room left, so the work depends on the
    number of different lengths, not on the number of documents.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, lengths: tuple[int, ...], room: int) -> None:
        if count:
            (open_.setdefault(room, []) if room else done).append((count, lengths))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        placed: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            room = max((r for r, found in open_.items() if found), default=0)
            if room < size:
                per = length // size
                whole, rest = divmod(left, per)
                placed.append((whole, (size,) * per, length - per * size))
                if rest:
                    placed.append((1, (size,) * rest, length - rest * size))
                left = 0
                break
            count, lengths = open_[room].pop()
            used = min(count, left)
            left -= used
            if used < count:
                open_[room].append((count - used, lengths))
            if room - size >= size:
                put(used, (*lengths, size), room - size)
            else:
                placed.append((used, (*lengths, size), room - size))
        for count, lengths, room in placed:
            put(count, lengths, room)
    return done + [x for found in open_.values() for x in found]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack all documents' token ids into sequences of at most ``length``.

    A document is cut at every ``length`` ids; the pieces are packed whole. The
    plan is made on the driver from the histogram of piece lengths (at most
    ``length`` rows) and has at most a few patterns a length; pieces then take the places that the
    plan has for their length by their rank among pieces of that length. Returns a row
    for each piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``.

    A null text is empty: its only id is ``end_id``. Rows with equal id are packed
    one by one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = written(tokenized_pieces(docs, tokenizer, id_col, text_col, length, end_id), "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    places, first = [], 0
    used: dict[int, int] = dict.fromkeys(counts, 0)
    for count, lengths in shortest_pack_first(counts, length):
        offset = 0
        for size in lengths:
            places.append((size, used[size], used[size] + count, first, offset))
            used[size] += count
            offset += size
        first += count
    # the plan's size depends on the number of lengths only
    plan = F.broadcast(spark.createDataFrame(places, "size int, low long, high long, first long, offset long"))
    before, total = {}, 0
    for size in sorted(counts):
        before[size], total = total, total + counts[size]
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "size int, before long"))
    ordered = with_position(pieces, [F.col("length"), F.col("doc"), F.col("start"), F.col("ids_crc32")])
    ranked = ordered.join(starts, F.col("length") == F.col("size")).drop("size").withColumn("rank", F.col("position") - F.col("before"))
    placed = ranked.join(plan, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(F.col("doc").alias(id_col), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
