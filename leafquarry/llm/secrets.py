"""Secrets in whole texts: fixed patterns, and strings that a primed compressor finds new.

A candidate is a run of token characters that follows a word such as "key" or "bearer" closely, or what follows such a
word within the run. It is measured by its marginal bytes under zstandard: the size of the surrounding code with it
less the size without it, both primed with a dictionary. That holds keywords of code and the identifiers that the documents
themselves use most (counted in Spark over all whole texts; ``most`` bounds how many are taken). What hardly compresses
is reported as kind ``novel`` unless a fixed pattern covers it. Spans are in code points, ends exclusive; an
assignment's span is the whole match.

Defined cases: a null text counts as empty and has no spans; very long texts are read whole, in time proportional to their
length; overlapping spans of different kinds all stay; identifiers of equal count rank by name; repeated rows stay; an
empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.blobs import texts_of
from leafquarry.llm.common import bound_batches, pick

# The patterns and least lengths of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # finds what [0-9a-f]+ of 32 and more finds
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Words after which a string is looked at, lower case.
CONTEXT = re.compile(r"bearer|authorization|credential|private|passphrase|passw|pwd|secret|token|key|auth", re.ASCII)
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}", re.ASCII)
#: Characters after a context word within which a candidate begins; characters of code around it that prime the measure.
REACH, AROUND = 48, 96
#: Marginal bytes for each character from which a string counts as incompressible (random base64 has 0.75, hex 0.5 and more).
LEAST_NOVELTY = 0.62

#: Identifiers that the dictionary takes at most.
MOST_IDENTIFIERS = 3000
#: Identifiers of code: parts joined by underscores or capitals, without digits (so that no key is one).
IDENTIFIER = r"\b(?:[A-Za-z]{2,16}+(?:_[A-Za-z]{1,16}+)++|[a-z]{2,16}+(?:[A-Z][a-z]{1,16}+)++)\b"

# Keywords of code; they and the identifiers prime the compressor.
KEYWORDS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 _-/+= import from return def class self None True False async await function"
    " const let var public static void String int long boolean private protected final new this super extends implements interface username password"
    " secret token api_key access_key secret_key private_key client_id client_secret access_token session_token bearer authorization credential auth"
    " https://www.example.com/index.html http://localhost:8080/api/v1/users Content-Type: application/json Authorization: Bearer"
)


def identifiers(docs: DataFrame, most: int = MOST_IDENTIFIERS) -> list[str]:
    """The documents' most frequent identifiers, the most frequent first: a bounded list of short words."""
    words = pick(docs, text="text").select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), 0)).alias("word")).where("length(word) <= 48")
    found = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in found.collect()]


class Novelty:
    def __init__(self, words: list[str]):
        text = " ".join((*reversed(words), KEYWORDS)).encode()  # what is likeliest stands nearest
        primer = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=6)
        self.zip = zstandard.ZstdCompressor(level=6, dict_data=primer, write_checksum=False, write_content_size=False)

    def of(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes of the candidate for each of its characters."""
        around, found = (before + after).encode("utf-8", "replace"), candidate.encode()
        return (len(self.zip.compress(around + b" " + found)) - len(self.zip.compress(around + b" "))) / len(found)


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    low = text.lower() if low is None else low
    found = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, low: str) -> list[tuple[int, int]]:
    """(start, end) of the runs near context words: a run counts from its start if a word ends at most REACH before it,
    else from the end of the first word that it holds itself; what counts has 16 characters at least."""
    ends = [m.end() for m in CONTEXT.finditer(low)]
    found = []
    if not ends:
        return found
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        at = bisect_right(ends, a)
        if at and a - ends[at - 1] <= REACH:
            found.append((a, b))
        elif at < len(ends) and ends[at] <= b - LEAST_CANDIDATE:
            found.append((ends[at], b))
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, low: str | None = None) -> list[tuple[int, int, int]]:
    low = text.lower() if low is None else low
    if len(low) != len(text):  # places would differ
        low = "".join(c.lower() if c.isascii() else c for c in text)
    starts, upto, most = [x[0] for x in base], [], 0
    for _, _, b in base:
        most = max(most, b)
        upto.append(most)
    found = []
    for a, b in candidates(text, low):
        before = bisect_left(starts, b)  # of the base spans that begin before its end, does one reach past its start?
        string = text[a:b]
        if before and upto[before - 1] > a or not (any(c.isdigit() for c in string) and any(c.isalpha() for c in string)):
            continue
        if novelty.of(text[max(0, a - AROUND) : a], string, text[b : b + AROUND]) >= LEAST_NOVELTY:
            found.append((a, 3, b))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, most: int = MOST_IDENTIFIERS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of docs."""
    words = identifiers(docs, most)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                low = text.lower()
                base = base_spans(text, low)
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel_spans(text, base, novelty, low))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    thin = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return thin.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
