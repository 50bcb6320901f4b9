"""Secret scans with a recursive decoding worklist.

Each text is scanned for three kinds of secrets. Then a worklist of layers unwraps what is encoded in
the text: percent-encoding, Unicode and hexadecimal escapes, numeric character references, and base64, whose payload may be compressed
any number of times (gzip, zlib, bzip2, xz, and deflate without a header where what comes out is worth opening). A layer is the text it came from with every candidate of one encoding decoded
in place, so a keyword outside an encoded value still counts. Every new layer is scanned and unwrapped
again until none changes; a layer, or a compressed payload, whose digest was seen before is not opened
again, which ends cycles. Each character of a layer carries the span of the original text it came from,
so that what is found at any depth is reported there. Only spans that touch decoded characters are added.

Base64 is read line by line and joined over line breaks, at each of the four alignments and, for compressed payloads, from
each delimiter; bytes that are no plain text, UTF-16 among them, are read byte by byte where they hold a secret's mark or another encoding.

Defined results: a null text counts as empty and has no spans; repeated rows get equal results; a compressed payload
of over `max_payload` bytes is scanned in pieces that are cut between candidates, never within one, and all that is encoded or compressed in them is opened as
anywhere else; a run of one character counts as its first thousands there, and one candidate of over `max_payload` characters in such a payload is
scanned in parts. A payload that is broken stays as it is. Extra columns are kept by `redacted`.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

# fixed values: the three kinds in their order, with their patterns and least lengths
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_REFERENCE = re.compile(r"(?:&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]+)*={0,2}")
_DELIMITER = re.compile(r"[/_+-]")
#: What makes bytes that aren't plain text worth opening: a secret's mark or another encoding.
_WORTH = re.compile(rb"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}|%[0-9a-f]{2}|\\u[0-9a-f]{4}|\\u\{[0-9a-f]|\\x[0-9a-f]{2}|&#x?[0-9a-f]|[a-z0-9+/_-]{16}", re.I)
#: What makes inflated bytes without any header worth opening: nearly all random bytes that happen to inflate hold none of these.
_SURE = re.compile(rb"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}|(?:%[0-9a-f]{2}){4}|(?:\\[ux][0-9a-f]{2}){2}|[A-Za-z0-9+/_-]{24}", re.I)
_WIDE = re.compile(rb"(?:[\t\n\r -~]\0){8}|(?:\0[\t\n\r -~]){8}")
_URL_SAFE = str.maketrans("-_", "+/")

#: Bytes of a decompressed payload that is still opened as a whole.
MAX_PAYLOAD = 16 << 20
#: Larger ones are scanned in pieces.
_PIECE, _OVERLAP = 1 << 20, 1 << 12

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> Iterator[Span]:
    low = text.encode().lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def _opener(data: bytes):
    """A decompressor for data by its first bytes; None if they are of no known format."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if data[:1] == b"\x78" and len(data) > 5 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    return None


def _blocks(source: Iterable[bytes], most: int) -> Iterator[bytes]:
    """One compressed layer, given in blocks, in blocks of up to `most` bytes, all of its members; raises if one of them is broken."""
    source = iter(source)
    data = next(source, b"")
    while True:
        while len(data) < 12 and (more := next(source, None)) is not None:  # enough to tell the format
            data += more
        if (opener := _opener(data)) is None:
            return
        while not opener.eof:
            block = opener.decompress(data, most)
            data = opener.unconsumed_tail if hasattr(opener, "unconsumed_tail") else b""
            if block:
                yield block
            elif not opener.eof:
                if (more := next(source, None)) is None:
                    raise EOFError
                data += more
        data = opener.unused_data.lstrip(b"\0")


def _deep(data: bytes, most: int, layers: int = 32) -> Iterator[bytes]:
    """The blocks of what lies below all compressed layers of data, each of which is opened block by block."""
    blocks: Iterator[bytes] = iter([data])
    for _ in range(layers):
        first = next(blocks, b"")
        blocks = chain([first], blocks)
        if _opener(first) is None:
            break
        blocks = _blocks(blocks, most)
    return blocks


_BROKEN = (OSError, zlib.error, lzma.LZMAError, EOFError, ValueError)


def _bare(data: bytes, most: int) -> bytes | None:
    """Deflated data without a header opened, if they end where the data do and hold what is worth opening."""
    if len(data) < 8 or data[0] & 6 == 6:
        return None
    opener = zlib.decompressobj(-15)
    try:
        out = opener.decompress(data, most + 1)
    except zlib.error:
        return None
    whole = opener.eof and not opener.unused_data.strip(b"\0") and len(out) <= most
    return out if whole and (_SURE.search(out) or _opener(out)) else None


def _may_be_bare(body: str, k: int) -> bool:
    """Whether base64 text from place k on can hold deflated data without a header, by longer and longer stretches of its start: nearly all that can't
    fails within the first, or ends within it."""
    for n in (64, 512, 1 << 13, 1 << 17):
        head = _unpadded(body[k : k + n])
        if not head or head[0] & 6 == 6:
            return False
        opener = zlib.decompressobj(-15)
        try:
            opener.decompress(head, 1 << 20)
        except zlib.error:
            return False
        if opener.eof:
            return n >= len(body) - k or not opener.unused_data.strip(b"\0")
        if n >= len(body) - k:
            return False
    return True


def _inflate(data: bytes, most: int) -> bytes | None:
    """One compressed layer opened; None if data isn't compressed, is broken or too large."""
    if _opener(data) is None:
        return _bare(data, most)
    out, size = [], 0
    try:
        for block in _blocks([data], most + 1):
            out.append(block)
            size += len(block)
            if size > most:
                return None
    except _BROKEN:
        return None
    return b"".join(out) if out else None


#: Where a piece may be cut: before a character that no candidate holds, or at a space between two words, in UTF-16 of either order too.
_CUT = re.compile(r"""[^A-Za-z0-9+/_=\-\s>%\\{}&#;"':.\0]|(?<![\s>"':=\0])\ (?=[A-Za-z0-9])|(?<=[A-Za-z0-9]\0)\ (?=\0[A-Za-z0-9])|(?<=\0[A-Za-z0-9])\0(?=\ \0[A-Za-z0-9])""")
_SAME = re.compile(r"(.)\1{4095,}", re.S)


def _large(data: bytes, most: int) -> str | None:
    """The secrets of a compressed layer of over `most` bytes, one a line, from pieces that are cut where no candidate runs on; None
    if it is broken. What is open at the end of a piece is carried into the next one."""
    found, tail = set(), ""

    def scan(text: str) -> None:
        text = _SAME.sub(lambda m: m[1] * 4096, text)
        for view in {text, text.replace("\0", "")}:
            for layer in (view, *(x.text for x in _layers(view, most))):
                found.update(layer[a:b] for a, _, b in base_spans(layer))

    try:
        for block in _deep(data, min(most, _PIECE)):
            if block.count(block[:1]) == len(block):
                block = block[:4096]
            text = tail + block.decode("latin-1")
            cut = max(_last_cut(text), len(text) - most)
            scan(text[:cut])
            tail = text[cut:]
        scan(tail)
    except _BROKEN:
        return None
    return "\n".join(sorted(found))


def _last_cut(text: str) -> int:
    """The last place before the last characters where a piece may be cut; 0 if there is none."""
    end = len(text) - _OVERLAP
    reach = 1 << 12
    while end > 0:
        start = max(end - reach, 0)
        places = [m.start() for m in _CUT.finditer(text, start, end)]
        if places:
            return places[-1]
        if not start:
            return 0
        reach *= 4
    return 0


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _text(data: bytes) -> str | None:
    """data as text, if it is UTF-8 without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not _CONTROL.search(text) else None


@dataclass(frozen=True)
class Piece:
    """Decoded text and, for each of its characters, where it begins and ends in the text it came from: arrays, or one number for all,
    so that a payload costs no more than its text."""

    text: str
    starts: np.ndarray | int
    stops: np.ndarray | int


def _percent(m: re.Match, most: int) -> list[Piece]:
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    ends = m.start() + 3 * np.cumsum([len(c.encode("utf-8", "surrogateescape")) for c in text])
    return [Piece(_LONE.sub("\ufffd", text), np.append(m.start(), ends[:-1]), ends)]


_LONE = re.compile("[\ud800-\udfff]")
_ONE_ESCAPE = re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_ONE_REFERENCE = re.compile(r"&#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));")


def _character(code: int) -> str:
    return chr(code) if code < 0x110000 else "\ufffd"


def _escape(m: re.Match, most: int) -> list[Piece]:
    text, ends = [], []
    for e in _ONE_ESCAPE.finditer(m[0]):
        text.append(chr(0x10000 + ((int(e[1], 16) & 0x3FF) << 10) + (int(e[2], 16) & 0x3FF)) if e[1] else _character(int(next(filter(None, e.groups())), 16)))
        ends.append(m.start() + e.end())
    return [Piece(_LONE.sub("\ufffd", "".join(text)), np.array([m.start(), *ends[:-1]]), np.array(ends))]


def _reference(m: re.Match, most: int) -> list[Piece]:
    text, ends = [], []
    for e in _ONE_REFERENCE.finditer(m[0]):
        text.append(_character(int(e[1]) if e[1] else int(e[2], 16)))
        ends.append(m.start() + e.end())
    return [Piece(_LONE.sub("\ufffd", "".join(text)), np.array([m.start(), *ends[:-1]]), np.array(ends))]


def _opened(data: bytes, most: int) -> Iterator[bytes]:
    """The layers of compressed data, one after the other, until one isn't compressed or was there before."""
    seen: set[bytes] = set()
    while (inner := _inflate(data, most)) is not None and (digest := hashlib.sha256(inner).digest()) not in seen:
        seen.add(digest)
        data = inner
        yield data


def _char_sizes(text: str) -> np.ndarray:
    return np.array([len(c.encode()) for c in text])


def _base64(m: re.Match, most: int) -> list[Piece]:
    body = m[0].rstrip("=").translate(_URL_SAFE)
    if len(body) % 4 == 1:
        return []
    data = base64.b64decode(body + "=" * (-len(body) % 4))
    plain = _text(data)
    if plain is not None:
        ends = np.cumsum(_char_sizes(plain))
        stops = m.start() - (-ends * 4 // 3)
        stops[-1] = m.end()
        return [Piece(plain, m.start() + np.append(0, ends[:-1]) * 4 // 3, stops)]
    for inner in _opened(data, most):
        plain = _text(inner)
        if plain is not None:
            return [Piece(plain, m.start(), m.end())]
    return []


def _unpadded(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _views(data: bytes) -> Iterator[tuple[str, np.ndarray | None]]:
    """data read a byte a character, and without the zeros of UTF-16 with the places of what is left (none: all)."""
    if _WORTH.search(data):
        yield data.decode("latin-1"), None
    if _WIDE.search(data):
        yield data.replace(b"\0", b"").decode("latin-1"), np.flatnonzero(np.frombuffer(data, np.uint8))


def _loose(m: re.Match, most: int) -> list[Piece]:
    """What the strict base64 decoder leaves: payloads wrapped over lines, those after or before other characters of the
    alphabet, and bytes that are no plain text. All readings stand in place of the run, one a line."""
    lines = m[0].count("\n")
    if not lines and _base64(m, most):
        return []
    raw = np.frombuffer(m[0].encode("utf-32-le"), "<u4")
    at = np.flatnonzero(~np.isin(raw, np.frombuffer(" \t\r\n>=".encode("utf-32-le"), "<u4"))) + m.start()
    begins = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist()]
    body = m[0].translate(_NOT_BODY)
    starts = {*begins, *(d.end() for d in _DELIMITER.finditer(body))}
    body, out = body.translate(_URL_SAFE), []
    line = Piece("\n", m.start(), m.start() + 1)

    def stop(k: np.ndarray) -> np.ndarray:
        return at[np.minimum(k, len(at)) - 1] + 1

    plain = _text(_unpadded(body)) if lines else None
    if plain is not None:
        ends = np.cumsum(_char_sizes(plain))
        return [Piece(plain, at[np.append(0, ends[:-1]) * 4 // 3], stop(-(-ends * 4 // 3)))]
    packed = len(body)  # where the first compressed payload starts
    for k in sorted(starts):
        if _opener(_unpadded(body[k : k + 12])) is None and not _may_be_bare(body, k):
            continue
        data = _unpadded(body[k:])
        if _opener(data) is None and _bare(data, most) is None:
            continue
        if _inflate(data, most) is None:
            data = b""
        last = data
        for inner in _opened(data, most) if data else ():
            packed, last = min(packed, k), inner
            plain = _text(inner)
            for text in [plain] if plain is not None else [v for v, _ in _views(inner)]:
                out += [Piece(text, m.start(), m.end()), line]
        if not data or _opener(last) is not None:  # too large to open whole, or broken
            found = _large(last or _unpadded(body[k:]), most)
            if found is not None:
                packed = min(packed, k)
                out += [Piece(found + "\n", m.start(), m.end())]
    for k in range(4):  # whatever stands before a payload, one of these is in step with it
        for text, places in _views(_unpadded(body[k:packed])):
            j = np.arange(len(text)) if places is None else places
            out += [Piece(text, at[k + j * 4 // 3], stop(k - (-(j + 1) * 4 // 3))), line]
    return out if any(p.text.strip("\n") for p in out) else []


_NOT_BODY = str.maketrans("", "", " \t\r\n>=")
#: What a text must hold for a decoder to find anything, its candidates, and the decoder.
DECODERS = (("%", _PERCENT, _percent), ("\\", _ESCAPE, _escape), ("&#", _REFERENCE, _reference), ("", _BASE64, _base64), ("", _WRAPPED, _loose))


class Layer:
    """Text in runs of characters. The characters of a run came from places of the original text that begin at `starts` and end at
    `stops`, one place further for each character where `steps` is 1, the same for all where it is 0."""

    def __init__(self, text: str, first: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: np.ndarray, decoded: np.ndarray):
        self.text, self.first, self.starts, self.stops, self.steps, self.decoded = text, first, starts, stops, steps, decoded

    @classmethod
    def of(cls, text: str) -> Layer:
        one = lambda x: np.array([x])
        return cls(text, one(0), one(0), one(1), one(1), one(False))

    def _span(self, at: np.ndarray | int, run: np.ndarray | int, side: str):
        return getattr(self, side)[run] + (at - self.first[run]) * self.steps[run]

    def _run(self, at):
        return np.searchsorted(self.first, at, side="right") - 1

    def _cut(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """The runs of characters a to b, counted from a."""
        k = np.arange(self._run(a), self._run(b - 1) + 1) if b > a else np.empty(0, int)
        first = np.maximum(self.first[k], a)
        return first - a, self._span(first, k, "starts"), self._span(first, k, "stops"), self.steps[k], self.decoded[k]

    def _decoded(self, piece: Piece) -> tuple[np.ndarray, ...]:
        x, y = np.atleast_1d(piece.starts), np.atleast_1d(piece.stops) - 1
        n = len(x)
        return np.arange(n), self._span(x, self._run(x), "starts"), self._span(y, self._run(y), "stops"), np.zeros(n, int), np.ones(n, bool)

    def unwrapped(self, pattern: re.Pattern, decode, most: int) -> Layer | None:
        """This layer with each candidate of one encoding decoded in place; None if there is none."""
        text, runs, at, size = [], [], 0, 0

        def add(part: str, own: tuple[np.ndarray, ...]) -> None:
            nonlocal size
            text.append(part)
            runs.append((own[0] + size, *own[1:]))
            size += len(part)

        for m in pattern.finditer(self.text):
            pieces = decode(m, most)
            if not pieces:
                continue
            add(self.text[at : m.start()], self._cut(at, m.start()))
            for piece in pieces:
                if piece.text:
                    add(piece.text, self._decoded(piece))
            at = m.end()
        if not runs:
            return None
        add(self.text[at:], self._cut(at, len(self.text)))
        return Layer("".join(text), *(np.concatenate(x) for x in zip(*runs)))

    def spans(self) -> Iterator[Span]:
        for a, kind, b in base_spans(self.text):
            k = np.arange(self._run(a), self._run(b - 1) + 1)
            if self.decoded[k].any():
                ends = np.append(self.first[k[1:]], b) - 1
                yield int(self._span(np.maximum(self.first[k], a), k, "starts").min()), kind, int(self._span(ends, k, "stops").max())


def _layers(text: str, most: int) -> Iterator[Layer]:
    """Every layer below a text, each once."""
    # every wrapped candidate begins with a plain one, so the last pattern needs no look of its own
    if not any(mark in text and pattern.search(text) for mark, pattern, _ in DECODERS[:4]):
        return
    work, seen = [Layer.of(text)], {hashlib.sha256(text.encode()).digest()}
    while work:
        layer = work.pop()
        for mark, pattern, decode in DECODERS:
            inner = layer.unwrapped(pattern, decode, most) if mark in layer.text else None
            if inner is not None and (digest := hashlib.sha256(inner.text.encode()).digest()) not in seen:
                seen.add(digest)
                yield inner
                work.append(inner)


def decoded_spans(text: str, most: int = MAX_PAYLOAD) -> set[Span]:
    """Spans of the original text that hold a secret at some depth of decoding."""
    return {span for layer in _layers(text, most) for span in layer.spans()}


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _scan(most: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, 1):
                base, every = [], []
                for x in part.column(1).to_pylist():
                    own = sorted(base_spans(x))
                    base.append(own)
                    every.append(sorted({*own, *decoded_spans(x, most)}))
                counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(3)]
                digests = [hashlib.sha256(_listed(own).encode()).hexdigest() for own in base]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(_listed, every), pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return run


def secret_spans(docs: DataFrame, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan(max_payload), schema)


def _redact(at: int, count: int | None, mask: str, most: int):
    def cleaned(x: str | None) -> str | None:
        if not x:
            return x
        out, end = [], 0
        for a, _, b in sorted({*base_spans(x), *decoded_spans(x, most)}):
            if a >= end:
                out += [x[end:a], mask]
            end = max(end, b)
        return "".join(out) + x[end:]

    def run(batches):
        for batch in batches:
            for part in parts(batch, at):
                texts = [cleaned(x) for x in part.column(at).to_pylist()]
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                if count is not None:
                    field = part.schema.field(count)
                    part = part.set_column(count, field, pa.array([None if x is None else len(x) for x in texts], field.type))
                yield part

    return run


def redacted(docs: DataFrame, mask: str = "[SECRET]", max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """docs with each secret's span replaced by the mask, and n_chars, if there is such a column, counted again."""
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_redact(docs.columns.index("text"), count, mask, max_payload), docs.schema)
