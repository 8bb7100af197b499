"""BPE encoding and decoding over a table of distinct words.

Texts are split into words (the tokenizer's pre-tokens) in Spark, each distinct word is encoded once, and the table of
words and ids is stored as sorted hash arrays. Texts are then split again: each position gets its word's number, the
batch's new numbers are joined with the table by hash, and the ids come back by position (one gather over all
positions of a batch). The table is the only source of ids: a word that it lacks raises RuntimeError. Decoding joins ids
with the table of pieces, one gather for a batch; the vocabulary's size is fixed by the tokenizer (a proven bound).

A row for each position is never shuffled: it would move several times the text. A join compares a 64-bit hash and a 32-bit
check; two words that agreed in both would raise ValueError when the table is built. Special tokens in a text become
their own ids, as the tokenizers library does.

Defined cases: a null or empty text has no ids; very long texts are read whole; repeated rows stay; an empty table gives an
empty result; columns beyond those named are ignored by ``encode``. The operator serves byte-level BPE files of the
tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import blobs
from leafquarry.llm.common import bound_batches, parts, pick, written

#: Words from which on a worker passes on what it holds, or starts afresh.
MEMORY = 100_000
#: Characters whose words are held at once.
SLICE = 1_000_000
#: Bytes of a batch.
BATCH = 2 << 20
SEED = 7

#: Words of the table in a bucket, on average at most.
BUCKET = 1 << 19
#: Beyond these letters the classes depend on the Unicode version, so the library's own splitter is used.
LAST = 0x24F
BEYOND = re.compile(f"[^\\x00-{chr(LAST)}]")


def _class(kind: str) -> str:
    """The characters up to LAST of a general category, as ranges of a pattern."""
    own = [c for c in range(LAST + 1) if unicodedata.category(chr(c))[0] == kind]
    first = [c for c in own if c - 1 not in own]
    last = [c for c in own if c + 1 not in own]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last, strict=True))


# The pre-token pattern of the byte-level tokenizer, over the letters up to LAST.
WHITE, LETTER, DIGIT = r"\t-\r \x85\xa0", _class("L"), _class("N")
WORDS = re.compile(rf" ?[{LETTER}]+| ?[{DIGIT}]+|'(?:[stmd]|re|ve|ll)| ?[^{WHITE}{LETTER}{DIGIT}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """The tokenizer of a file: splitting, encoding single words, pieces by id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normaliser is served")
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = {i: bytes(self.letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in self.letters for c in token)}
        self.pieces |= {i: content.encode() for content, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        if BEYOND.search(text):
            return [bytes(self.letters[c] for c in piece).decode() for piece, _ in self.splitter.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches, and special tokens with their ids."""
        if self.at_special is None:
            yield text, None
            return
        for k, part in enumerate(self.at_special.split(text)):
            if part:
                yield part, self.special[part] if k % 2 else None

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def piece_table(self) -> pa.Array:
        """The piece of every id, in order of the ids."""
        return pa.array([self.pieces.get(i) for i in range(max(self.pieces) + 1)], pa.binary())


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """The worker's codec of a file; one that serves many tasks parses it once."""
    return Codec(path)


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """word: every distinct pre-token of the texts."""
    bound_batches(docs.sparkSession, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = codec_of(path), set()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            seen.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string())], ["word"])

        for batch in batches:
            for text in blobs.texts_of(batch.column(0)):
                for part, special in codec.segments(text):
                    if special is None:
                        seen.update(codec.words(part))
                if len(seen) > MEMORY:
                    yield from out()
        yield from out()

    return pick(docs, text="text").where("text <> ''").mapInArrow(run, "word string").distinct()


def hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in raw), np.uint64, len(raw)), np.fromiter(map(crc32, raw), np.uint32, len(raw))


def word_table(docs: DataFrame, path: str) -> tuple[list[str], int]:
    """Files of sorted hash arrays: hash, check, start and ids of every distinct word, by the hash's leading bits; and
    how many bits these are, by the number of words."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            h, check = hashes([w.encode() for w in words])
            ids = [np.array(x, np.uint32).tobytes() for x in codec.encode_words(words)]
            # as signed numbers of equal order
            yield pa.RecordBatch.from_arrays([pa.array((h ^ np.uint64(1 << 63)).view(np.int64)), pa.array(check.astype(np.int64)), pa.array(ids, pa.binary())], ["h", "word_check", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def out() -> pa.RecordBatch:
            h, check = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            ids = [i for x in held for i in x[2]]
            if ((h[1:] == h[:-1]) & (check[1:] == check[:-1])).any():
                raise ValueError("two words have the same hash and check")
            start = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
            blob = blobs.packed(at, 0, h.view(np.uint64) ^ np.uint64(1 << 63), check.astype(np.uint32), start, np.frombuffer(b"".join(ids), np.uint32))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            for b in np.unique(bucket):
                if at is not None and b != at:
                    yield out()
                at = int(b)
                rows = batch.filter(pa.array(bucket == b))
                held.append((rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(3).to_pylist()))
        if held:
            yield out()

    coded = written(distinct_words(docs, path).mapInArrow(encode, "h bigint, word_check bigint, ids binary"), "coded-words")
    bits = max(4, (coded.count() // BUCKET).bit_length(), min(12, (parts(spark) - 1).bit_length()))
    bucket = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int")
    tidy = coded.select(bucket.alias("bucket"), "h", "word_check", "ids").repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "h", "word_check")
    return blobs.files(spark, blobs.write(tidy.mapInArrow(gather, "blob binary"), "word-table")), bits


class Lookup(dict):
    """Numbers of words, given as they first occur, and the ids of each number, joined from the mapped table."""

    def __init__(self, names: list[str], bits: int, codec: Codec):
        super().__init__()
        self.codec, self.bits = codec, bits
        self.buckets = {b: blobs.unpacked(view, (np.uint64, np.uint32, np.int64, np.uint32)) for b, view in blobs.by_number(names).items()}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        for content, i in self.codec.special.items():
            self[content] = len(self)
            self._append([np.array([i], np.uint32)])

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def _append(self, found: list[np.ndarray]) -> None:
        length = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, *found))

    def join(self) -> None:
        """The new words with the table."""
        if not self.new:
            return
        h, check = hashes([w.encode() for w in self.new])
        found: list[np.ndarray | None] = [None] * len(h)
        order = np.argsort(h)
        where = (h[order] >> np.uint64(64 - self.bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(where, prepend=-1, append=1 << 40))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if (table := self.buckets.get(int(where[a]))) is None:
                continue
            (keys, checks, start, ids), own = table, order[a:b]
            low, high = np.searchsorted(keys, h[own]), np.searchsorted(keys, h[own], side="right")
            for k, i, j in zip(own.tolist(), low.tolist(), high.tolist(), strict=True):
                for at in range(i, j):
                    if checks[at] == check[k]:
                        found[k] = ids[start[at] : start[at + 1]]
        if any(x is None for x in found):
            raise RuntimeError("the word table lacks a word of the texts")
        self._append(found)
        self.new.clear()

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at all positions in order, and how many each position has."""
        length = self.length[numbers]
        before = np.cumsum(length) - length
        return self.ids[np.repeat(self.start[numbers] - before, length) + np.arange(int(length.sum()))], length


def encoder(names: list[str], bits: int, path: str):
    """A function from batches of doc_id, text to batches of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(names, bits, codec_of(path))
        codec = lookup.codec
        for batch in batches:
            texts, out, at = blobs.texts_of(batch.column(1)), [], 0
            while at < len(texts):  # in slices, as lists of words take many times their text
                upto, n = at, 0
                while upto < len(texts) and n < SLICE:
                    n += len(texts[upto])
                    upto += 1
                numbers = []
                for text in texts[at:upto]:
                    own = [[part] if special is not None else codec.words(part) for part, special in codec.segments(text)]
                    numbers.append(np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(lookup.__getitem__, x), np.int64, len(x)) for x in own)]))
                lookup.join()
                ids, length = lookup.of(np.concatenate(numbers))
                ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum([0, *map(len, numbers)])].tolist()
                out += [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                at = upto
                if len(lookup) > MEMORY:
                    lookup.forget()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return run


def decoder(path: str):
    """A function from batches of doc_id, ids to batches of doc_id, ids, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec_of(path).piece_table()
        for batch in batches:
            held = [x or b"" for x in batch.column(1).to_pylist()]
            joined = pieces.take(pa.array(np.frombuffer(b"".join(held), np.uint32)))  # ids with pieces, by position
            if joined.null_count:
                raise ValueError("an id has no piece")
            _, offsets, data = joined.buffers()
            offsets, data = np.frombuffer(offsets, np.int32), memoryview(data or b"")
            ends = offsets[np.cumsum([0, *(len(x) // 4 for x in held)])].tolist() if len(joined) else [0] * (len(held) + 1)
            texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def thin(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession, BATCH)
    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str | None = None, table: tuple[list[str], int] | None = None) -> DataFrame:
    """doc_id, ids (32-bit little-endian numbers as bytes): one row per row of docs. table: what ``word_table`` gave for
    these texts or more; made from docs where it isn't given."""
    path = path or default_path()
    names, bits = table or word_table(docs, path)
    return thin(docs).mapInArrow(encoder(names, bits, path), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text. An id without a piece raises ValueError; bytes that aren't UTF-8 become replacement characters."""
    bound_batches(encoded.sparkSession, BATCH)
    return pick(encoded, doc_id="doc_id", ids="ids").mapInArrow(decoder(path or default_path()), "doc_id bigint, ids binary, text string")


def digested(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``decode`` after ``encode``, in one worker a task."""
    path = path or default_path()
    names, bits = word_table(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoder(path)(encoder(names, bits, path)(batches)):
            ids, texts = (batch.column(k).to_pylist() for k in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return thin(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(spark.read.parquet(f"{sf_dir}/documents.parquet"))
