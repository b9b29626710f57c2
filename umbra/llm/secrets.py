"""Secret scans with a recursive decoding worklist.

A layer is a text and a map from its offsets to the document's. The document is the first layer. Each layer is
scanned with the base patterns; then its URL escapes, Unicode escapes, and base64 or hexadecimal runs are decoded, and
every decoded text that was not seen with the same place before (cycle detection) joins the worklist. Runs are joined
over line breaks and decoded at each phase of their groups, as a word before them may be of the same letters; of the
bytes, plain stretches and gzip or zlib streams are taken wherever they begin. Work ends when no layer decodes to
anything new.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

#: Fixed patterns of the contract; ASCII letters match in either case in the assignment's key.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the greedy run from AKIA, 20 characters at least
HEX = re.compile(r"[0-9a-f]{24,}")

#: An escape that itself was escaped any number of times (%2541, \u005cu0041) is one: nests of any depth take one layer.
URL_ONE = r"%(?:25)*([0-9A-Fa-f]{2})"
URL = re.compile(f"(?:{URL_ONE})+")
URL_BYTES = re.compile(URL_ONE)
UNI_ONE = re.compile(r"\\(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}|U0000005[cC])*(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
UNI = re.compile(f"(?:{UNI_ONE.pattern})+")
#: A line break as it is or escaped, with the blanks around it; runs go on over it.
BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|\\r\\n|\\n)[ \t]*")
B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:%(b)s[A-Za-z0-9+/_-]{16,})*(?:%(b)s[A-Za-z0-9+/_-]+)?={0,2}" % {"b": BREAK.pattern})
HEXRUN = re.compile(r"[0-9A-Fa-f]{32,}(?:%(b)s[0-9A-Fa-f]{32,})*(?:%(b)s[0-9A-Fa-f]+)?" % {"b": BREAK.pattern})
#: Decoded bytes that may hold a secret, which is all ASCII and has 12 characters at least.
PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: A gzip header, or a zlib header but for its check.
STREAM = re.compile(rb"(?=\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\xff])")
#: A decompressed layer may be this many times its document's size plus a mebibyte: the guard against bombs, which are counted.
EXPANSION, EXPANSION_FLOOR = 1000, 1 << 20

Span = tuple[int, int, int]  # start, end, kind's number


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return sorted(out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)])


class Pieces:
    """A map from a text's offsets to its source's, in pieces: copied ones keep their offsets, others map as a whole."""

    def __init__(self):
        self.starts: list[int] = []  # in the text
        self.pieces: list[tuple[int, int, bool]] = []  # (start in the source, end in the source, whether copied)
        self.size = 0

    def add(self, size: int, lo: int, hi: int, copied: bool) -> None:
        if not size:
            return
        if self.pieces and copied and self.pieces[-1][2] and self.pieces[-1][1] == lo:
            self.pieces[-1] = (self.pieces[-1][0], hi, True)
        else:
            self.starts.append(self.size)
            self.pieces.append((lo, hi, copied))
        self.size += size

    def back(self, a: int, b: int) -> tuple[int, int]:
        if a >= b or not self.pieces:
            at = min(bisect.bisect_right(self.starts, a) - 1, len(self.pieces) - 1) if self.pieces else -1
            lo = self.pieces[at][0] + (a - self.starts[at]) * self.pieces[at][2] if at >= 0 else 0
            return lo, lo
        i, j = bisect.bisect_right(self.starts, a) - 1, bisect.bisect_left(self.starts, b) - 1
        (lo, _, copied), (last, hi, copied_last) = self.pieces[i], self.pieces[j]
        return lo + (a - self.starts[i]) * copied, last + b - self.starts[j] if copied_last else hi

    def over(self, below: Pieces) -> Pieces:
        """This map, then `below`, as one: nested escapes of any depth stay one map."""
        out = Pieces()
        for at, (lo, hi, copied) in enumerate(self.pieces):
            size = (self.starts[at + 1] if at + 1 < len(self.starts) else self.size) - self.starts[at]
            if not copied:
                out.add(size, *below.back(lo, hi), False)
                continue
            i = bisect.bisect_right(below.starts, lo) - 1
            while lo < hi:
                end = min(hi, below.starts[i + 1] if i + 1 < len(below.starts) else below.size)
                out.add(end - lo, *below.back(lo, end), below.pieces[i][2])
                lo, i = end, i + 1
        return out


def _escapes(text: str, pattern: re.Pattern, decode: Callable[[str], str]):
    """The text with all escapes decoded, the map back, and the decoded ranges; a run of escapes maps as a whole."""
    parts, map_, ranges, at = [], Pieces(), [], 0
    for m in pattern.finditer(text):
        new = decode(m.group())
        map_.add(m.start() - at, at, m.start(), True)
        ranges.append((map_.size, map_.size + len(new)))
        map_.add(len(new), m.start(), m.end(), False)
        parts += [text[at : m.start()], new]
        at = m.end()
    if not parts:
        return None
    map_.add(len(text) - at, at, len(text), True)
    parts.append(text[at:])
    return "".join(parts), map_, ranges


def _url(s: str) -> str:
    """Bytes that are no UTF-8 become marks; secrets are ASCII."""
    return bytes.fromhex("".join(URL_BYTES.findall(s))).decode(errors="replace")


def _unicode(s: str) -> str:
    units = [int(next(filter(None, m.groups())), 16) for m in UNI_ONE.finditer(s)]
    return b"".join(u.to_bytes(2, "big") if u < 0x10000 else chr(u).encode("utf-16-be") if u < 0x110000 else b"\xff\xfd" for u in units).decode("utf-16-be", "replace")


def _text(data: bytes) -> str | None:
    """Printable text or nothing: decoded noise is no layer."""
    try:
        s = data.decode()
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\t\n\r" for c in s) >= 0.95 * len(s) else None


def _heads(data: bytes) -> list[int]:
    """Where a gzip or zlib stream may begin."""
    return [i for m in STREAM.finditer(data) if data[i := m.start()] == 0x1F or ((data[i] << 8) + data[i + 1]) % 31 == 0 and not data[i + 1] & 0x20]


class TooLarge(Exception):
    """A layer beyond the guard against decompression bombs."""


def _inflate(data: bytes, most: int) -> bytes | None:
    """All streams one after the other at the start of data, unwrapped until the bytes are none; None if broken from the
    start. Of a stream that breaks off, what came before."""
    seen, been = False, set()
    while 0 in _heads(data[:3]):
        rest, parts, n = data, [], 0
        while 0 in _heads(rest[:3]):
            d = zlib.decompressobj(47)
            try:
                new = d.decompress(rest, most - n + 1)
            except zlib.error:
                new = _before_error(rest, most - n + 1)
                d = None
            n += len(new)
            if n > most:
                raise TooLarge
            parts.append(new)
            if d is None or not d.eof:
                break
            rest = d.unused_data.lstrip(b"\0")
        new = b"".join(parts)
        mark = hashlib.blake2b(new, digest_size=16).digest()
        if not new or mark in been:  # a stream may hold itself
            break
        been.add(mark)
        data, seen = new, True
    return data if seen else None


def _before_error(data: bytes, most: int) -> bytes:
    """What a broken stream gives before its fault, fed by 64 bytes; nothing if the fault is in the first."""
    d, out = zlib.decompressobj(47), []
    try:
        for at in range(0, len(data), 64):
            out.append(d.decompress(data[at : at + 64], max(1, most)))
            most -= len(out[-1])
            if d.eof or d.unconsumed_tail or most <= 0:
                break
    except zlib.error:
        pass
    return b"".join(out)


def _runs(text: str, pattern: re.Pattern):
    """(characters of a run without its line breaks, their places, the run's end)"""
    for m in pattern.finditer(text):
        raw, start = m.group().rstrip("="), m.start()
        at: list[int] | range = range(start, start + len(raw))
        if breaks := list(BREAK.finditer(raw)):
            ends = [*(x.start() for x in breaks), len(raw)]
            at = [start + i for lo, hi in zip([0, *(x.end() for x in breaks)], ends) for i in range(lo, hi)]
            raw = BREAK.sub("", raw)
        yield raw, at, m.end()


def layers_of(text: str, most: int, too_large: Callable[[], None]):
    """(decoded text, map back: Pieces or a function, decoded ranges or None for all) for each way the text unwraps."""
    if "%" in text and (x := _escapes(text, URL, _url)):
        yield x
    if "\\" in text and (x := _escapes(text, UNI, _unicode)):
        yield x
    for pattern, per, chars in ((B64, 3, 4), (HEXRUN, 1, 2)):
        for run, at, end in _runs(text, pattern):
            for phase in range(chars):
                part = run[phase:]
                if per == 1:
                    data = bytes.fromhex(part[: len(part) // 2 * 2])
                else:
                    part = part[: len(part) - (len(part) % 4 == 1)].replace("-", "+").replace("_", "/")
                    data = base64.b64decode(part + "=" * (-len(part) % 4))

                def place(i, j, at=at, end=end, phase=phase, per=per, chars=chars):
                    last = phase + -(-j // per) * chars
                    return at[phase + i // per * chars], at[last - 1] + 1 if last <= len(at) else end

                if s := _text(data):
                    ascii_ = s.isascii()
                    yield s, (lambda x, y, s=s, ascii_=ascii_, place=place: place(x, y) if ascii_ else place(len(s[:x].encode()), len(s[:y].encode()))), None
                else:
                    for m in PLAIN.finditer(data):
                        yield m.group().decode(), (lambda x, y, o=m.start(), place=place: place(o + x, o + y)), None
                for head in _heads(data):
                    try:
                        new = _inflate(data[head:], most)
                    except TooLarge:
                        too_large()
                        continue
                    if new is None:
                        continue
                    back = lambda x, y, o=head, n=len(data), place=place: place(o, n)
                    if s := _text(new):
                        yield s, back, None
                    else:
                        for m in PLAIN.finditer(new):
                            yield m.group().decode(), back, None


@dataclass
class Found:
    base: list[Span]
    every: list[Span]  # base ones too, each span once, by start, end and kind
    left_out: int  # decompressed layers beyond the guard against bombs


def scan(text: str | None) -> Found:
    """The spans of all layers. A layer's map is a list of maps down to the document, neighbouring maps of pieces made one."""
    text = text or ""
    base = base_spans(text)
    found, left_out = set(base), 0
    most = EXPANSION * len(text) + EXPANSION_FLOOR

    def too_large():
        nonlocal left_out
        left_out += 1

    work = deque([(text, ())])
    seen = {(0, len(text), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())}
    while work:
        layer, below = work.popleft()
        for new, back, ranges in layers_of(layer, most, too_large):
            if not new:
                continue
            maps = (back.over(below[0]), *below[1:]) if isinstance(back, Pieces) and below and isinstance(below[0], Pieces) else (back, *below)

            def here(a, b, maps=maps):
                for m in maps:
                    a, b = m.back(a, b) if isinstance(m, Pieces) else m(a, b)
                return a, b

            mark = (*here(0, len(new)), hashlib.blake2b(new.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if mark in seen:
                continue
            seen.add(mark)
            for a, b, kind in base_spans(new):
                if ranges is None or any(x < b and a < y for x, y in ranges):  # text that was plain before is no news
                    found.add((*here(a, b), kind))
            work.append((new, maps))
    return Found(base, sorted(found), left_out)


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark] if a >= at else []
        at = b
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, base and all: arrays of (start, end, kind), offsets in code points, end exclusive; redacted: the text.

    One row per input row; null text is as empty and has no span. Overlapping and repeated spans of different kinds
    all stay; the same span of the same kind stays once. n_left_out: decompressed layers that were not scanned, being over 1000
    times the text and a mebibyte (streams within streams only: one deflate stream can't reach that).
    """

    def start():
        def f(c):
            both = [(x.base, x.every, x.left_out) for x in map(scan, c["t"])]
            as_rows = lambda v: [{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in v]
            return {"doc_id": c["k"], "base": [as_rows(x) for x, *_ in both], "all": [as_rows(x) for _, x, _ in both], "base_text": [joined(x) for x, *_ in both], "all_text": [joined(x) for _, x, _ in both], "n_left_out": [n for *_, n in both], "redacted": [t if t is None or not x else redact(t, x) for t, (_, x, _) in zip(c["t"], both)]}

        return f

    kind, s = docs.schema[key].dataType.simpleString(), "array<struct<start:int,end:int,kind:string>>"
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), f"doc_id {kind}, base {s}, all {s}, base_text string, all_text string, n_left_out int, redacted string", start)


def op3(spark, sf_dir: str) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *map(n, KINDS), F.sha2("base_text", 256).alias("base_sha256"), F.col("all_text").alias("spans"), "n_left_out")


def redacted(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of its text replaced by the mark, in place; null texts stay null."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                i = part.schema.get_field_index(text)
                new = [t if t is None else redact(t, scan(t).every, mark) for t in part.column(i).to_pylist()]
                yield part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))

    small_batches(docs)
    return docs.mapInArrow(run, docs.schema)
