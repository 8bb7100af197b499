"""The text layer of PDF files, read in workers without libraries.

Pages are taken by the page tree, their content streams in their order; strings shown by the text operators are joined, and moves
to another line are line ends. Strings are read by their font: by its map to Unicode, else by the usual Latin encoding with the
names of its differences. A composite font without a map, a damaged stream, a scan or an encrypted file is told in ``error``; what such a
font shows is left out, not guessed. Files without a page tree give their streams in the file's order.

Defined cases: null or empty contents, what isn't a PDF, damaged streams: empty text and the reason in ``error``; a stream that
cannot be read leaves the others; of an object that is defined twice the last counts; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = re.compile(rb"(?<!end)stream\r?\n")
PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
TOKEN = re.compile(rb"(?P<text>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^\s()<>\[\]/%]*)|(?P<op>[A-Za-z'\"*]+)", re.DOTALL)
ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r?\n)|(.))", re.DOTALL)
LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift to the left within an array, in thousandths, from which it counts as a blank.
GAP = -180


def unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes([int(m[1], 8) & 255])
        return b"" if m[2] else LETTERS.get(m[3], m[3])

    return ESCAPE.sub(one, raw)


def hexed(digits: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


#: Names of signs that are neither letters nor references of HTML.
SIGNS = {
    "space": " ", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "hyphen": "-", "slash": "/", "parenleft": "(", "parenright": ")", "bracketleft": "[", "bracketright": "]",
    "question": "?", "exclam": "!", "percent": "%", "dollar": "$", "numbersign": "#", "asterisk": "*", "plus": "+", "equal": "=", "quotesingle": "'", "quotedbl": '"', "underscore": "_",
    "at": "@", "degree": "°", "ordmasculine": "º", "ordfeminine": "ª", "endash": "–", "emdash": "—", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "bullet": "•", "fi": "fi", "fl": "fl",
}
MAP_PART = re.compile(rb"begin(bfchar|bfrange|codespacerange)(.*?)end(?:bfchar|bfrange|codespacerange)", re.DOTALL)
HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")
RANGE_ROW = re.compile(rb"<([0-9A-Fa-f\s]*)>\s*<([0-9A-Fa-f\s]*)>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", re.DOTALL)


class Font:
    """How the bytes that a font shows are read."""

    def __init__(self, names: dict[int, str] | None = None):
        self.names, self.unknown = names or {}, False
        self.map: dict[bytes, str] = {}
        self.widths: list[int] = []

    @classmethod
    @lru_cache(maxsize=64)
    def mapped(cls, cmap: bytes) -> Font:
        """By a map to Unicode; ranges of at most 2^16 codes. Files of one maker share their maps."""
        font = cls()
        for kind, body in MAP_PART.findall(cmap):
            if kind == b"bfrange":
                for low, high, to, each in RANGE_ROW.findall(body):
                    first, last, n = int(hexed(low).hex() or "0", 16), int(hexed(high).hex() or "0", 16), len(hexed(low))
                    many = [hexed(x).decode("utf-16-be", "surrogatepass") for x in HEX.findall(each)]
                    start = hexed(to)
                    for k, code in enumerate(range(first, min(last, first + 0xFFFF) + 1)):
                        if to:
                            tail = int.from_bytes(start[-2:]) + k
                            font.map[code.to_bytes(n)] = (start[:-2] + (tail & 0xFFFF).to_bytes(2)).decode("utf-16-be", "surrogatepass")
                        elif k < len(many):
                            font.map[code.to_bytes(n)] = many[k]
            else:
                found = [hexed(x) for x in HEX.findall(body)]
                if kind == b"bfchar":
                    font.map |= {x: y.decode("utf-16-be", "surrogatepass") for x, y in zip(found[::2], found[1::2], strict=False)}
                else:
                    font.widths += [len(x) for x in found[::2]]
        font.widths = sorted(set(font.widths) | {len(x) for x in font.map}, reverse=True) or [1]
        return font

    def text(self, raw: bytes) -> str:
        if self.unknown:
            return ""
        if not self.map and not self.widths:
            return "".join(self.names.get(b) or bytes([b]).decode("cp1252", "replace") for b in raw) if self.names else raw.decode("cp1252", "replace")
        out, at = [], 0
        while at < len(raw):
            width = next((w for w in self.widths if raw[at : at + w] in self.map), self.widths[0])
            out.append(self.map.get(raw[at : at + width], ""))
            at += width
        # halves of a pair may have codes of their own
        return "".join(out).encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")


def shown(content: bytes, fonts: dict[bytes, Font] | None = None) -> tuple[str, set[bytes]]:
    """The text of one content stream, and the fonts in it that could not be read."""
    out, held, font, name, missed = [], [], Font(), b"", set()
    for m in TOKEN.finditer(content):
        if m["text"] or m["hex"]:
            held.append(font.text(unescaped(m["text"][1:-1]) if m["text"] else hexed(m["hex"][1:-1])))
            if font.unknown:
                missed.add(name)
        elif m["number"]:
            if held and float(m["number"]) < GAP:
                held.append(" ")
        elif m["name"]:
            name = m["name"]
        elif m["op"]:
            op = m["op"]
            if op == b"Tf":
                font = (fonts or {}).get(name) or Font()
            if op in (b"'", b'"', b"T*", b"Td", b"TD", b"Tm", b"ET"):
                out.append("\n")
            if op in (b"Tj", b"TJ", b"'", b'"'):
                out.append("".join(held))
            held.clear()
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n"), missed


OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b")
REF = re.compile(rb"(\d+)\s+\d+\s+R\b")


class File:
    """A file's objects by number, those in object streams too."""

    def __init__(self, raw: bytes):
        self.failed = 0
        self.objects: dict[int, bytes] = {}
        starts = [(int(m[1]), m.end()) for m in OBJECT.finditer(raw)]
        for (number, start), after in zip(starts, [*(m[1] for m in starts[1:]), len(raw)], strict=True):
            end = raw.find(b"endobj", start, after)
            self.objects[number] = raw[start : end if end >= 0 else after]
        for body in [b for b in self.objects.values() if b"/ObjStm" in b[:2000]]:
            data = self.data(body)
            first = re.search(rb"/First\s+(\d+)", body)
            if data and first:
                at, ints = int(first[1]), list(map(int, re.findall(rb"\d+", data[: int(first[1])])))
                places = list(zip(ints[::2], ints[1::2], strict=False))
                for (number, start), end in zip(places, [*(p for _, p in places[1:]), len(data) - at], strict=True):
                    self.objects.setdefault(number, data[at + start : at + end])

    def data(self, body: bytes) -> bytes | None:
        """The content of a stream object; None if it has none or can't be read."""
        m = START.search(body)
        if not m:
            return None
        end = body.rfind(b"endstream")
        data = body[m.end() : end if end >= 0 else len(body)]
        if b"FlateDecode" in body[: m.start()]:
            try:
                return zlib.decompressobj().decompress(data)
            except zlib.error:
                self.failed += 1
                return None
        return data

    def value(self, body: bytes, key: bytes) -> bytes:
        """What stands after a key: the object that it refers to, a dictionary or array, or the next word."""
        m = re.search(re.escape(key) + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := REF.match(rest):
            return self.objects.get(int(ref[1]), b"")
        for open_, close in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(open_):
                depth, at = 0, 0
                for t in re.finditer(re.escape(open_) + b"|" + re.escape(close), rest):
                    depth += 1 if t[0] == open_ else -1
                    at = t.end()
                    if not depth:
                        break
                return rest[:at]
        return re.match(rb"/?[^\s/<>\[\]]*", rest)[0]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """body and resources of each page, by the tree; a page takes its parents' resources where it has none."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
        out, seen, todo = [], set(), [(int(top[1]), b"")] if top else []
        while todo:
            number, given = todo.pop()
            body = self.objects.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            own = self.value(body, b"/Resources") or given
            if b"/Kids" in body:
                todo += [(int(k), own) for k in reversed(REF.findall(self.value(body, b"/Kids")))]
            elif PAGE.search(body):
                out.append((body, own))
        return out

    def font(self, body: bytes) -> Font:
        if cmap := self.data(self.value(body, b"/ToUnicode")):
            return Font.mapped(cmap)
        if re.search(rb"/Subtype\s*/Type0", body):
            font = Font()
            font.unknown = True
            return font
        names, code = {}, 0
        for word in re.findall(rb"/[^\s/\[\]<>]+|\d+", self.value(self.value(body, b"/Encoding"), b"/Differences")):
            if word.startswith(b"/"):
                name = word[1:].decode("latin-1")
                names[code] = name if len(name) == 1 else SIGNS.get(name) or (chr(name2codepoint[name]) if name in name2codepoint else "")
                code += 1
            else:
                code = int(word)
        return Font({k: v for k, v in names.items() if v and k < 256})

    def fonts(self, resources: bytes) -> dict[bytes, Font]:
        listed = self.value(resources, b"/Font")
        return {name: self.font(self.objects.get(int(number), b"")) for name, number in re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", listed)}


def read(raw: bytes | None) -> tuple[int, str, str | None]:
    """pages, text, error of one file."""
    if not raw or not raw.lstrip()[:5] == b"%PDF-":
        return 0, "", "not a PDF file"
    if b"/Encrypt" in raw:
        return len(PAGE.findall(raw)), "", "encrypted"
    file = File(raw)
    texts, missed, tree = [], set(), file.pages()
    for body, resources in tree:
        fonts = file.fonts(resources)
        m = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
        parts = [file.data(file.objects.get(int(n), b"")) for n in REF.findall(m[1] or m[2])] if m else []
        text, bad = shown(b"\n".join(x for x in parts if x), fonts)
        texts.append(text)
        missed |= bad
    if not tree or not any(b"/Contents" in body for body, _ in tree):
        for body in file.objects.values():
            head = START.split(body, 1)[0]
            if START.search(body) and b"/Image" not in head and b"/FontFile" not in head and b"/ObjStm" not in head:
                data = file.data(body)
                if data and re.search(rb"(?<![^\s])BT(?![^\s])", data):
                    texts.append(shown(data)[0])
    text = "\n".join(t for t in texts if t)
    pages = len(tree) or sum(PAGE.search(b) is not None for b in file.objects.values())
    told = [f"{file.failed} streams could not be read"] * (file.failed > 0) + [f"no map for the codes of {', '.join(sorted(x.decode('latin-1') for x in missed))}"] * bool(missed)
    return pages, text, "; ".join(told) or (None if text else "no text layer")


def texts(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, pages, text, error: one row per row of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(x) for x in batch.column(1).to_pylist()]
            pages, found, errors = ([r[k] for r in rows] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.int32()), pa.array(found, pa.string()), pa.array(errors, pa.string())], [key, "pages", "text", "error"])

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    thin = files.select(F.col(key), F.col(content).cast("binary").alias("content"))
    return thin.mapInArrow(run, f"`{key}` {thin.schema[0].dataType.simpleString()}, pages int, text string, error string")


def folder_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, pages, text, error of every PDF below a folder (each file at most 2 GB)."""
    return texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "content"))
