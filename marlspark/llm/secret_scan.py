"""Secret scans: a worklist of decoded layers, each rescanned, with spans mapped back.

Each text is the first layer. Runs that look percent-encoded, Unicode-escaped,
or base64 (whose bytes may be gzip or zlib streams) are unwrapped into further
layers until no new layer appears; a layer already seen at the same place of the
text is not entered again, which ends cycles, and one that stands at several
places is unwrapped once and reported at each. Matches in a deeper layer are
reported at the span of the text that they were decoded from.

Base64 is looked for from the start of a run and from behind each ``/``, ``_``,
``+`` or ``-`` in it, and over lines of one length that it is wrapped at. Its
bytes need not be text.

What base64 holds has no place of its own in the text: it is reported at its run,
so it is read as a stream of bytes, in pieces that overlap, to the end of all
members of compressed streams, in bounded memory however far they expand.

Defined cases: null counts as the empty text, which has no spans. Repeated rows
are scanned each on their own. A compressed stream that breaks off is scanned as
far as it goes. Streams compressed ``MAX_DEPTH`` times into one another end there,
as some unpack to themselves. ``n_layers`` counts distinct decoded contents.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

# The kinds, in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: what [0-9a-f]+ finds with 24 characters or more

URL_RUN = re.compile(r"[A-Za-z0-9_.~!*'();:@&=+$,/?#\[\]%-]+")
URL_CODE = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|[!-\[\]-~])*")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Bytes that are inflated, and scanned, at once; how far pieces of an unbroken line overlap;
#: compressed streams in one another; base64 runs whose kinds are kept.
CHUNK, PIECE, OVERLAP, MAX_DEPTH, MOST_KNOWN = 1 << 20, 1 << 22, 1 << 16, 64, 100_000


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _percent(run: str) -> tuple[str, array | None]:
    """Decoded text, and for each of its characters its start in the run."""
    raw, at, i = bytearray(), array("q"), 0
    while i < len(run):
        if run[i] == "%" and re.fullmatch("[0-9A-Fa-f]{2}", run[i + 1 : i + 3]):
            raw.append(int(run[i + 1 : i + 3], 16))
            at.append(i)
            i += 3
        else:
            raw += (one := run[i].encode())
            at.extend([i] * len(one))
            i += 1
    text = raw.decode("utf-8", "replace")
    if len(text) == len(raw):
        return text, at
    places, k = array("q"), 0
    for c in text:  # a replaced byte run has no exact place: the whole run stands for it
        if c == "�":
            return text, None
        places.append(at[k])
        k += len(c.encode())
    return text, places


def _escapes(run: str) -> tuple[str, array | None]:
    out, at, i = [], array("q"), 0
    while i < len(run):
        size = {"\\u": 4, "\\x": 2, "\\U": 8}.get(run[i : i + 2], 0)
        digits = run[i + 2 : i + 2 + size]
        if size and re.fullmatch("[0-9A-Fa-f]{%d}" % size, digits) and (code := int(digits, 16)) < 0x110000:
            out.append("�" if 0xD800 <= code < 0xE000 else chr(code))
            at.append(i)
            i += 2 + size
        else:
            out.append(run[i])
            at.append(i)
            i += 1
    return "".join(out), at


def _ascii(pattern: re.Pattern) -> re.Pattern:
    return re.compile(pattern.pattern.encode(), pattern.flags & re.I)


_ASSIGN, _ACCESS, _HEX, _URL_CODE, _ESCAPE_RUN, _BASE64_RUN = map(_ascii, (ASSIGN, ACCESS, HEX, URL_CODE, ESCAPE_RUN, BASE64_RUN))
# the runs of URL_RUN with a code in them
_URL = URL_RUN.pattern.encode()[:-1]
_CODED_RUN = re.compile(rb"(?<!%s)(?:(?!%%)%s|%%(?![0-9A-Fa-f]{2}))*+%%[0-9A-Fa-f]{2}%s*+" % (_URL, _URL, _URL))
_ESCAPE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_SPACES = re.compile(b" {2,}")


def _character(m: re.Match) -> bytes:
    code = int(m[m.lastindex], 16)
    return m[0] if code >= 0x110000 else ("�" if 0xD800 <= code < 0xE000 else chr(code)).encode()


def _packed(head: bytes) -> bool:
    """Whether a gzip or zlib stream may begin so."""
    return head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0)


def _bytes(run: bytes) -> bytes:
    """What a base64 run stands for; a last character that is too much is left out."""
    body = run.rstrip(b"=").translate(_STANDARD)
    body = body[: len(body) - (len(body) % 4 == 1)]
    return binascii.a2b_base64(body + b"=" * (-len(body) % 4))


_STANDARD = bytes.maketrans(b"-_", b"+/")


_EDGE = re.compile(rb"[/_+-]")
_PACKED_EDGE = re.compile(rb"[/_+-](?=H4[s-v]|[CGKOSWae][A-P])")  # what the first bytes of gzip and zlib look like
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_PADDING = re.compile(rb"={0,2}")
_LINE = re.compile(rb"[A-Za-z0-9+/_-]+")
_WHOLE_LINE = re.compile(rb"[ \t]*[A-Za-z0-9+/_-]+\r?")


def _inflates(raw: bytes) -> bool:
    try:
        zlib.decompressobj(47).decompress(raw, 1)
        return True
    except zlib.error:
        return False


def _complete(raw: bytes) -> bool:
    """Whether a compressed stream ends within ``raw``."""
    inflater = zlib.decompressobj(47)
    try:
        while raw and not inflater.eof:
            inflater.decompress(raw, CHUNK)
            raw = inflater.unconsumed_tail
    except zlib.error:
        return True
    return inflater.eof


def starts(run: bytes) -> list[int]:
    """Where base64 may begin in a run: its start, and behind a ``/``, ``_``, ``+`` or ``-`` if that shifts the groups of four or a compressed stream begins there."""
    out, last = {0: 0}, max(0, len(run) - 16)
    for m in _EDGE.finditer(run, 0, last):
        if m.end() % 4 not in out:
            out[m.end() % 4] = m.end()
            if len(out) == 4:
                break
    packed = {m.end() for m in _PACKED_EDGE.finditer(run, 0, last) if _packed(_bytes(run[m.end() : m.end() + 4])) and _inflates(_bytes(run[m.end() : m.end() + 4096]))}
    return sorted(packed.union(out.values()))


def wrapped(layer: bytes) -> list[tuple[int, int, bytes, int]]:
    """Base64 wrapped over lines of one length, but for the last: (start, end, the lines in one, length of a line)."""
    out = []
    for m in _WRAPPED.finditer(layer):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(layer, m.start(), m.end())]
        # the last is no part of it if its line goes on with other things
        if layer[m.end() : m.end() + 1].strip(b"\r\n\"'`,;)]}<") and lines:
            lines.pop()
        i = 0
        while i < len(lines):
            size, j = lines[i][1] - lines[i][0], i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == size:
                j += 1
            if j < len(lines) and lines[j][1] - lines[j][0] < size:
                j += 1
            if j - i > 1 and size >= 16:
                end = lines[j - 1][1]
                out.append((lines[i][0], end + len(_PADDING.match(layer, end)[0]), b"".join(layer[a:b] for a, b in lines[i:j]), size))
                i = j
            else:
                i += 1
    return out


def digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


class Hidden:
    """The layers of a text that are reported at their run: which kinds each holds, and the distinct contents."""

    def __init__(self) -> None:
        self.contents: set[bytes] = set()
        self.known: dict[bytes, set[int]] = {}
        self.open: set[bytes] = set()

    def run(self, run: bytes, depth: int = 0) -> set[int]:
        """The kinds that base64 holds from its start; one that is met inside itself adds nothing."""
        key = digest(run)
        if key in self.open:
            return set()
        if key not in self.known:
            self.open.add(key)
            kinds = self.stream(_bytes(run), depth + 1)
            self.open.discard(key)
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            self.known[key] = kinds
        return self.known[key]

    def stream(self, raw: bytes, depth: int = 0) -> set[int]:
        stream = Stream(self, depth)
        stream.feed(raw)
        return stream.end()


class Stream:
    """Bytes of a layer, fed in parts: scanned as they are and, if they are compressed, inflated."""

    def __init__(self, hidden: Hidden, depth: int) -> None:
        self.hidden, self.depth, self.kinds = hidden, depth, set()
        self.head: bytes | None = b""
        self.inflater = self.inner = None
        self.rest = self.buffer = b""
        self.size, self.digest, self.decoder, self.is_text = 0, hashlib.blake2b(digest_size=16), codecs.getincrementaldecoder("utf-8")(), True
        # a base64 run that is longer than a piece: for each place where base64 may begin in it, the stream of its bytes
        # and its characters that do not fill a group
        self.long: list[tuple[Stream, bytes]] = []

    def feed(self, data: bytes) -> None:
        if self.head is not None:
            data = self.head + data
            self.head = data if len(data) < 3 else None
            if self.head is not None:
                return
            if self.depth < MAX_DEPTH and _packed(data):
                self.inflater, self.inner = zlib.decompressobj(47), Stream(self.hidden, self.depth + 1)
        if self.inflater:
            self._inflate(data)
        for at in range(0, len(data), CHUNK):
            self._plain(data[at : at + CHUNK])

    def _inflate(self, data: bytes) -> None:
        data, self.rest = self.rest + data, b""
        while data:
            if self.inflater.eof:  # a further member
                data = data.lstrip(b"\0")
                if len(data) < 3:
                    self.rest = data
                    return
                if not _packed(data):
                    break
                self.inflater = zlib.decompressobj(47)
            try:
                out = self.inflater.decompress(data, CHUNK)
            except zlib.error:
                break
            if out:
                self.inner.feed(out)
            data = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        else:
            return
        self.inflater = None

    def _plain(self, data: bytes) -> None:
        self.size += len(data)
        self.digest.update(data)
        if self.is_text:
            try:
                self.decoder.decode(data)
            except UnicodeDecodeError:
                self.is_text = False
        if self.long:
            self._go_on(data)
        self.buffer += data
        if len(self.buffer) < PIECE:
            return
        # behind a line, but not among lines that may be wrapped base64
        end = self.buffer.rfind(b"\n")
        cut = self.buffer.rfind(b"\n", 0, max(end, 0)) + 1
        while cut and end > 0 and _WHOLE_LINE.fullmatch(self.buffer, cut, end):
            end = cut - 1
            cut = self.buffer.rfind(b"\n", 0, end) + 1
        if cut > PIECE // 2:
            self._scan(self.buffer[:cut])
            self.buffer = self.buffer[cut:]
            return
        # an unbroken line: no match needs more than the overlap, once long runs of spaces are one space
        self.buffer = _SPACES.sub(b" ", self.buffer)
        self._scan(self.buffer)
        if not self.long:
            runs = [m for m in _BASE64_RUN.finditer(self.buffer, max(0, len(self.buffer) - PIECE)) if m.end() == len(self.buffer) and m.end() - m.start() > OVERLAP and m[0][-1:] != b"="]
            if runs:
                run = runs[0][0]
                for at in starts(run):
                    # a compressed stream that ends in the run so far has been read to its end
                    if not (at and _packed(_bytes(run[at : at + 4])) and _complete(_bytes(run[at:]))):
                        self.long.append(self._fed(Stream(self.hidden, self.depth + 1), run[at:]))
        self.buffer = self.buffer[-OVERLAP:]

    @staticmethod
    def _fed(stream: Stream, group: bytes) -> tuple[Stream, bytes]:
        full = len(group) // 4 * 4
        stream.feed(_bytes(group[:full]))
        return stream, group[full:]

    def _go_on(self, data: bytes) -> None:
        """The next part of a long base64 run, or its end."""
        more = _RUN_GOES_ON.match(data)[0]
        self.long = [self._fed(stream, group + more) for stream, group in self.long]
        if len(more) < len(data):
            self._close()

    def _close(self) -> None:
        for stream, group in self.long:
            stream.feed(_bytes(group))
            self.kinds |= stream.end()
        self.long = []

    def _scan(self, piece: bytes) -> None:
        work, seen = [piece], set()
        while work:  # percent-encoded and escaped layers, which only get shorter
            layer = work.pop()
            if b":" in layer or b"=" in layer:
                if 0 not in self.kinds and any(m.end(2) - m.start(2) >= 6 for m in _ASSIGN.finditer(layer)):
                    self.kinds.add(0)
            if 1 not in self.kinds and b"AKIA" in layer and any(m.end() - m.start() >= 20 for m in _ACCESS.finditer(layer)):
                self.kinds.add(1)
            if 2 not in self.kinds and _HEX.search(layer):
                self.kinds.add(2)
            for m in _BASE64_RUN.finditer(layer):
                for at in starts(m[0]):
                    self.kinds |= self.hidden.run(m[0][at:], self.depth)
            for _, _, lines, _ in wrapped(layer):
                self.kinds |= self.hidden.run(lines, self.depth)
            inner = []
            if _URL_CODE.search(layer):
                inner += [(m[0], _URL_CODE.sub(lambda c: bytes([int(c[0][1:], 16)]), m[0])) for m in _CODED_RUN.finditer(layer)]
            if b"\\" in layer:
                inner += [(m[0], _ESCAPE.sub(_character, m[0])) for m in _ESCAPE_RUN.finditer(layer)]
            for run, raw in inner:
                if raw != run and (key := digest(raw)) not in seen:
                    seen.add(key)
                    self.hidden.contents.add(key)
                    work.append(raw)

    def end(self) -> set[int]:
        if self.head:
            self._plain(self.head)
        if self.inner:
            if self.inflater:
                self.inner.feed(self.inflater.flush())
            self.kinds |= self.inner.end()
        if self.long:
            self._close()
        if self.buffer:
            self._scan(self.buffer)
        try:
            self.decoder.decode(b"", True)
        except UnicodeDecodeError:
            self.is_text = False
        if self.size and (self.is_text or self.kinds and not self.inner):
            self.hidden.contents.add(self.digest.digest())
        return self.kinds


_RUN_GOES_ON = re.compile(rb"[A-Za-z0-9+/_-]*")


def layers(text: str) -> list[tuple[str, int, int, array | None]]:
    """The percent-encoded and escaped runs of one layer: (decoded, start, end, each character's place in the run or None)."""
    out = []
    if URL_CODE.search(text):
        for m in URL_RUN.finditer(text):
            if URL_CODE.search(m[0]):
                out.append((*_percent(m[0]), m.start(), m.end()))
    if "\\" in text:
        for m in ESCAPE_RUN.finditer(text):
            out.append((*_escapes(m[0]), m.start(), m.end()))
    return [(d, s, e, at) for d, at, s, e in out if d != text[s:e]]


def encoded(layer: str, hidden: Hidden) -> list[tuple[set[int], int, int]]:
    """The base64 of a layer: (kinds in it, start, end)."""
    runs = [(m[0].encode(), m.start(), m.end()) for m in BASE64_RUN.finditer(layer)]
    out, streams = [], []
    if "\n" in layer and runs:
        # the ASCII places are those of the text: other characters count as one
        for s, e, lines, size in wrapped(layer.encode("ascii", "replace")):
            raw = _bytes(lines)
            if _packed(raw) and _inflates(raw):
                if not _complete(_bytes(lines[:size])):  # else its lines stand for themselves
                    streams.append((s, e))
                    out.append((hidden.run(lines), s, e))
                continue
            # plain: what lies within a line is found there; here the lines that the wrapping cuts, side by side in one
            cuts = np.arange(size, len(lines), size) * 3 // 4
            at, begun = 0, None
            for part in [*raw.split(b"\n"), None]:
                cut = part is not None and bool(((cuts > at) & (cuts < at + len(part))).any())
                if cut and begun is None:
                    begun = at
                if not cut and begun is not None:
                    out.append((hidden.stream(raw[begun:at]), s, e))
                    begun = None
                at += len(part or b"") + 1
    for run, s, e in runs:
        if not any(a <= s and e <= b for a, b in streams):
            out += [(hidden.run(run[at:]), s + at, e) for at in starts(run)]
    return out


class Places:
    """Where each character of a layer stands in the text: its start and end there. Of the text itself, nowhere else."""

    def __init__(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.starts, self.ends = starts, ends

    def of(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def inner(self, at: array, a: int, b: int) -> Places:
        """Of the layer that the run from ``a`` to ``b`` stands for; ``at``: its characters' places in the run."""
        starts = np.frombuffer(at, np.int64)
        ends = np.maximum(np.append(starts[1:], b - a), starts + 1)
        starts, ends = starts + a, ends + a
        return Places(starts, ends) if self.starts is None else Places(self.starts[starts], self.ends[ends - 1])

    def key(self) -> bytes:
        return digest(self.starts.tobytes() + self.ends.tobytes())


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (both sorted, distinct) as (start, kind, end), and the number of distinct layers."""
    base = sorted(matches(text))
    found, contents, seen, known, hidden = set(base), set(), set(), {}, Hidden()
    work: list[tuple[str, Places]] = [(text, Places())]
    while work:
        layer, places = work.pop()
        if layer not in known:
            inner = layers(layer)
            opaque = [(hidden.stream(d.encode()), s, e) for d, s, e, at in inner if at is None]
            opaque += encoded(layer, hidden)
            known[layer] = base if layer is text else matches(layer), opaque, [x for x in inner if x[3] is not None]
        own, opaque, inner = known[layer]
        for a, kind, b in [*own, *((s, k, e) for kinds, s, e in opaque for k in kinds)]:
            x, y = places.of(a, b)
            found.add((x, kind, y))
        for decoded, a, b, at in inner:
            there = places.inner(at, a, b)
            if (key := (decoded, there.key())) not in seen:
                seen.add(key)
                contents.add(decoded)
                work.append((decoded, there))
    return base, sorted(found), len(({digest(c.encode()) for c in contents} | hidden.contents) - {digest(text.encode())})


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts and spans, in code points with ends exclusive."""

    def one(text: str | None) -> tuple:
        base, every, depth = spans(text or "")
        listed = joined(base)
        return (*(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(listed.encode()).hexdigest(), joined(every), depth)

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"]

    def batch(rows: pa.RecordBatch) -> dict:
        cols = zip(*map(one, rows.column("text").to_pylist()), strict=True) if rows.num_rows else [[]] * len(names)
        return {"doc_id": rows.column("doc_id")} | {k: list(v) for k, v in zip(names, cols, strict=True)}

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")
