"""Secrets in texts and in whatever is encoded inside them (operator 11), by a worklist of decoded layers.

Base spans: leftmost non-overlapping matches of one pattern per kind in the text itself, those that are too
short being dropped. Beyond them every text starts a worklist of layers. A layer is a string each of
whose characters knows which range of the text it came from. It is scanned by the same patterns, and it is
unwrapped: percent escapes and Unicode forms (backslash escapes, character references, compatibility forms,
characters without width) give the whole layer with these decoded; every run of base64, of one line or of
several, read from each of four places, gives what decodes to text; and what decodes to compressed bytes
(gzip, zlib, bare deflate, bzip2, xz, zstandard, one around the other) gives what these unpack to. New layers join the list
until none is left. A layer that has been seen at the same place is not read again, so texts that decode to
themselves end, and so do archives that unpack to themselves.

A match in a layer becomes the span of the text that its characters came from: single escapes, the base64
letters that hold its bytes, or all of a compressed run. Unpacked bytes are read in pieces of 8 MiB that end
at a line break, or where there is none overlap by 64 Ki characters, so memory stays bounded however much unpacks; base64 of
several lines is not joined over such a border.

Each text is scanned by itself where Spark has read it; nothing is shuffled. Spans are in code points, the
end exclusive. Defined results: a null text counts as an empty one and has no span; every row gives
one row, whatever its doc_id; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
# The base patterns and the least length of what counts (of the second group, of the match, of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LEAST = (8, 16, 32)
# A run that fails its length holds no shorter match that would do, so the lengths are part of these two.
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{LEAST[1] - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{LEAST[2]},}}")

SHORTEST = 12  # characters; no decoded string that is shorter holds a match
URL = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
URL_BYTE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
NAMED = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "amp": "&", "colon": ":", "equals": "=", "period": ".", "lowbar": "_", "sol": "/", "plus": "+", "nbsp": " "}
UNICODE = re.compile(
    r"(?<!\\)\\++(?:u(?P<high>[dD][89abAB][0-9A-Fa-f]{2})\\++u(?P<low>[dD][c-fC-F][0-9A-Fa-f]{2})|u(?P<u>[0-9A-Fa-f]{4})|u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|U(?P<long>[0-9A-Fa-f]{8})|x(?P<x>[0-9A-Fa-f]{2}))"
    r"|&(?:amp;)*+(?:#(?P<ten>[0-9]{1,7});|#[xX](?P<hex>[0-9A-Fa-f]{1,6});|(?P<name>" + "|".join(NAMED) + r");)|&(?:amp;)+"
    r"|(?P<form>[\uff01-\uff5e\u2460-\u24ff\u2070-\u209c\U0001d400-\U0001d7ff])|(?P<none>[\u00ad\u200b-\u200d\u2060\ufeff])"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*")
PRINTED = re.compile(rb"[\x09\x0a\x0d\x20-\x7e]{%d,}" % SHORTEST)
UNPRINTED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
# What a text has to hold for any of the above to have something to do; for Arrow.
ANYTHING = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[uUx]|&[#a-z]|[\x{ff01}-\x{ff5e}\x{2460}-\x{24ff}\x{2070}-\x{209c}\x{1d400}-\x{1d7ff}\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]"""
PIECE, OVERLAP = 8 << 20, 64 << 10
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,is_base:boolean,layers:string>>"


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(rank of the kind, start, end) of the matches of all kinds."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST[0]:
            yield 0, m.start(), m.end()
    for rank, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            yield rank, m.start(), m.end()


class Layer:
    """A string whose character k came from ``low[k]`` to ``high[k]`` of the text: equal to it, or of one range as a whole, or by arrays."""

    def __init__(self, text: str, way: tuple[str, ...], low: np.ndarray | int | None = None, high: np.ndarray | int | None = None):
        self.text, self.way, self.low, self.high = text, way, low, high

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.low is None:
            return start, end
        if isinstance(self.low, int):
            return self.low, self.high
        return int(self.low[start]), int(self.high[end - 1])

    def key(self) -> bytes:
        sum_ = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for x in (self.low, self.high):
            sum_.update(b"|" + (x.tobytes() if isinstance(x, np.ndarray) else str(x).encode()))
        return sum_.digest()

    def inner(self, text: str, how: str, low: np.ndarray, high: np.ndarray) -> Layer:
        """The layer of a string whose character k came from ``low[k]`` to ``high[k]`` of this one."""
        way = (*self.way, how)
        if self.low is None:
            return Layer(text, way, low, high)
        if isinstance(self.low, int):
            return Layer(text, way, self.low, self.high)
        return Layer(text, way, self.low[low], self.high[high - 1])


def _with_replaced(layer: Layer, how: str, hits: list[tuple[int, int, str]]) -> Layer:
    """The layer with each (start, end, new string) put in."""
    parts, low, high, at = [], [], [], 0
    for start, end, new in hits:
        parts += [layer.text[at:start], new]
        low += [np.arange(at, start), np.full(len(new), start)]
        high += [np.arange(at + 1, start + 1), np.full(len(new), end)]
        at = end
    n = len(layer.text)
    return layer.inner("".join([*parts, layer.text[at:]]), how, np.concatenate([*low, np.arange(at, n)]), np.concatenate([*high, np.arange(at + 1, n + 1)]))


def _url(layer: Layer) -> Iterator[Layer]:
    hits: list[tuple[int, int, str]] = []
    for run in URL.finditer(layer.text):
        escapes = [(m.start(), m.end(), int(m[1], 16)) for m in URL_BYTE.finditer(layer.text, run.start(), run.end())]
        data, k = bytes(x[2] for x in escapes), 0
        for c in data.decode("utf-8", "surrogateescape"):
            size = 1 if "\ud800" <= c <= "\udfff" else len(c.encode())
            hits.append((escapes[k][0], escapes[k + size - 1][1], "\ufffd" if "\ud800" <= c <= "\udfff" else c))
            k += size
        if _packing(data):
            yield from _unpacked(layer, data, run.start(), run.end(), "url")
    if hits:
        yield _with_replaced(layer, "url", hits)


def _one(m: re.Match) -> str | None:
    kind = m.lastgroup
    if kind is None:
        return "&"
    if kind == "name":
        return NAMED[m[kind]]
    if kind == "form":
        return unicodedata.normalize("NFKC", m[kind])
    if kind == "none":
        return ""
    if kind == "low":
        return chr(0x10000 + (int(m["high"], 16) - 0xD800 << 10) + int(m["low"], 16) - 0xDC00)
    code = int(m[kind], 10 if kind == "ten" else 16)
    if code > 0x10FFFF:
        return None
    return "\ufffd" if 0xD800 <= code < 0xE000 else chr(code)


def _unicode(layer: Layer) -> Iterator[Layer]:
    hits = [(m.start(), m.end(), new) for m in UNICODE.finditer(layer.text) if (new := _one(m)) is not None]
    if hits:
        yield _with_replaced(layer, "unicode", hits)


def _read(make: Callable[[], object], pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What a decompressor of the standard library gives, at most ``PIECE`` bytes at a time; a damaged stream ends where it is damaged."""
    unpack = make()
    try:
        for data in pieces:
            while data or not getattr(unpack, "needs_input", True):
                out = unpack.decompress(data, PIECE)
                if out:
                    yield out
                if unpack.eof:
                    data, unpack = unpack.unused_data, make()
                elif hasattr(unpack, "unconsumed_tail"):
                    data = unpack.unconsumed_tail
                else:
                    data = b""
                    if not out:
                        break
        if hasattr(unpack, "flush") and (out := unpack.flush()):
            yield out
        if hasattr(unpack, "flush") and (out := unpack.flush()):
            yield out
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def _read_zstandard(pieces: Iterator[bytes]) -> Iterator[bytes]:
    import zstandard

    class Source:
        def read(self, size: int) -> bytes:
            return next(pieces, b"")

    try:
        with zstandard.ZstdDecompressor(max_window_size=128 << 20).stream_reader(Source(), read_across_frames=True) as reader:
            while out := reader.read(PIECE):
                yield out
    except zstandard.ZstdError:
        return


# How compressed bytes begin.
def _packing(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstandard"
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if data[:3] == b"BZh":
        return "bzip2"
    if len(data) > 6 and data[0] == 0x78 and data[1] in (0x01, 0x5E, 0x9C, 0xDA):
        return "zlib"
    return None


READERS: dict[str, Callable[[Iterator[bytes]], Iterator[bytes]]] = {
    "gzip": lambda x: _read(lambda: zlib.decompressobj(31), x),
    "zlib": lambda x: _read(lambda: zlib.decompressobj(15), x),
    "deflate": lambda x: _read(lambda: zlib.decompressobj(-15), x),
    "bzip2": lambda x: _read(bz2.BZ2Decompressor, x),
    "xz": lambda x: _read(lzma.LZMADecompressor, x),
    "zstandard": _read_zstandard,
}


def _strings(pieces: Iterator[bytes]) -> Iterator[str]:
    """Bytes as text, in strings that end at a line break, or overlap."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for data in pieces:
        held += decoder.decode(data)
        if len(held) < PIECE:
            continue
        cut = held.rfind("\n") + 1
        if cut:
            yield held[:cut]
            held = held[cut:]
        else:
            yield held
            held = held[-OVERLAP:]
    held += decoder.decode(b"", True)
    if held:
        yield held


def _unpacked(layer: Layer, data: bytes, start: int, end: int, how: str, first: str | None = None) -> Iterator[Layer]:
    """The layers that compressed bytes at a range of ``layer`` unpack to, compression by compression, each level read from the start so that none is held whole."""
    low, high = layer.span(start, end)
    names, digests = [first or _packing(data)], {hashlib.blake2b(data).digest()}

    def level() -> Iterator[bytes]:
        out: Iterator[bytes] = iter([data])
        for name in names:
            out = READERS[name](out)
        return out

    while True:
        head, digest, n = b"", hashlib.blake2b(), 0
        for piece in level():
            head = head if len(head) >= 8 else head + piece[:8]
            digest.update(piece)
            n += len(piece)
        if not n:
            if len(names) == 1:
                return
            names.pop()  # what looked compressed is not
            break
        if digest.digest() in digests:
            return  # it unpacks to what it is inside of
        digests.add(digest.digest())
        if not (inner := _packing(head)):
            break
        names.append(inner)
    for text in _strings(level()):
        yield Layer(text, (*layer.way, how, *names), low, high)


def _base64(layer: Layer) -> Iterator[Layer]:
    for run in BASE64.finditer(layer.text):
        lines = [(m.start(), m.end()) for m in re.compile(r"[^\r\n]+").finditer(layer.text, run.start(), run.end())]
        ranges = [[x] for x in lines] + ([lines] if len(lines) > 1 else [])
        for some in ranges:
            yield from _decoded(layer, some)


def _decoded(layer: Layer, lines: list[tuple[int, int]]) -> Iterator[Layer]:
    """What the base64 of these ranges of the layer, in a row, may stand for, from each of its first four letters on."""
    letters = "".join(layer.text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
    place = np.concatenate([np.arange(a, b) for a, b in lines]) if len(lines) > 1 else None

    def at(k: np.ndarray | int) -> np.ndarray | int:
        return lines[0][0] + k if place is None else place[k]

    for skip in range(4):
        n = len(letters) - skip
        n -= n % 4 == 1
        data = base64.b64decode(letters[skip : skip + n] + "=" * (-n % 4))
        if len(data) < SHORTEST:
            continue

        def part(text: str, starts: np.ndarray, ends: np.ndarray, skip: int = skip) -> Layer:
            """A string whose characters are bytes from ``starts`` to ``ends``."""
            return layer.inner(text, "base64", at(skip + starts * 4 // 3), at(skip + (ends * 4 + 2) // 3 - 1) + 1)

        if packing := _packing(data):
            yield from _unpacked(layer, data, int(at(skip)), int(at(skip + n - 1)) + 1, "base64", packing)
        if data[1::2].count(0) * 5 >= len(data) * 2:
            text = data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
            if len(text) == len(data) // 2:
                k = np.arange(len(text)) * 2
                yield part(text, k, k + 2)
            continue
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = None
        if text is not None and not UNPRINTED.search(text):
            sizes = np.array([len(c.encode()) for c in text]) if len(text) < len(data) else np.ones(len(text), np.int64)
            ends = np.cumsum(sizes)
            yield part(text, ends - sizes, ends)
            continue
        for m in PRINTED.finditer(data):
            k = np.arange(m.start(), m.end())
            yield part(m[0].decode(), k, k + 1)
        if not packing and _telling(next(iter(READERS["deflate"](iter([data]))), b"")):
            yield from _unpacked(layer, data, int(at(skip)), int(at(skip + n - 1)) + 1, "base64", "deflate")


def _telling(head: bytes) -> bool:
    """Whether bytes that begin so, unpacked from what nothing marks as compressed, are text or compressed once more."""
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(head[:256])
    except UnicodeDecodeError:
        text = ""
    return len(text) >= SHORTEST and not UNPRINTED.search(text) or _packing(head) is not None


DECODERS = (_url, _unicode, _base64)


def find(text: str) -> list[tuple[int, int, str, int, bool, str]]:
    """(start, rank, kind, end, whether a base span, layers) of all secrets of a text, by start and kind; of ways to the same span the first found, which has the fewest layers."""
    found = {(start, rank, end): (True, "") for rank, start, end in scan(text)}
    seen: set[bytes] = set()
    work = deque([Layer(text, ())])
    while work:
        layer = work.popleft()
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        if layer.way:
            for rank, a, b in scan(layer.text):
                start, end = layer.span(a, b)
                found.setdefault((start, rank, end), (False, ">".join(layer.way)))
        for decoder in DECODERS:
            work.extend(decoder(layer))
    return [(start, rank, KINDS[rank], end, *found[start, rank, end]) for start, rank, end in sorted(found)]


def find_secrets(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``spans`` of every row: an array of (start, rank, kind, end, is_base, layers) by start and kind."""
    schema = docs.select(*keys).limit(0).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("is_base", pa.bool_()), ("layers", pa.string())]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            some = pc.fill_null(pc.match_substring_regex(texts, ANYTHING), False).to_pylist()
            spans = [[dict(zip(names, s, strict=True)) for s in find(texts[k].as_py())] if yes else [] for k, yes in enumerate(some)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, kind)], names=[*keys, "spans"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"spans {SPANS}"])
    return docs.select(F.col("text").alias("_text"), *keys).mapInArrow(run, fields)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_recursive_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    base, new = F.filter("spans", lambda s: s["is_base"]), F.filter("spans", lambda s: ~s["is_base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    layers = F.array_join(F.transform("new", lambda s: s["layers"]), ",")
    return found.withColumns({"base": base, "new": new}).select("doc_id", *map(count, KINDS), F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), F.size("new").cast("long").alias("n_found"), layers.alias("layers"))
