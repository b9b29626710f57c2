"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string ends, for each prefix, in one token: the only token t that ends there and whose
predecessor (the last token of the prefix before t) stays apart from t under the merges. Storing that last token for
every prefix gives the encoding by walking back, makes appending exact (new bytes only add prefixes) and lets an edit
re-encode from the edit until the stored tokens agree again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows


BLANK = re.compile(r" (?=\S)")
ODD_BLANK = re.compile(r" (?!\S)")
#: Parts strings of bytes written as the characters of their numbers: beyond 255, so no token reaches over it.
BORDER = "\u0100"


def as_chars(text: str) -> str:
    """The UTF-8 bytes of text as the characters of their numbers."""
    return text if text.isascii() else text.encode().decode("latin-1")


class Vocabulary:
    """Ranks of a byte-level BPE whose tokens rank above the two they merge from, and which holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.length = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes, default=-1) + 1)]
        # gives all tokens that end at each byte in one pass, longest first
        self.tokens = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.tokens.add_word(b.decode("latin-1"), i)
        self.tokens.make_automaton()
        self.known_apart: dict[int, bool] = {}
        self.known_produced: dict[int, bool] = {}
        self.sides: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}

    def halves(self, piece: bytes) -> list[bytes]:
        """Plain BPE, lowest rank and then leftmost first, until two parts are left or no pair can merge."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            r, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if r == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def produced(self, t: int) -> bool:
        """Whether the merges of the token's own bytes give it."""
        known = self.known_produced.get(t)
        if known is None:
            known = self.known_produced[t] = len(self.bytes[t]) == 1 or len(self.halves(self.bytes[t])) == 2
        return known

    def side(self, t: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts at the token's right (left) end from its outermost byte to itself, each with the rank at which it is
        merged into the next."""
        out = self.sides.get((t, right))
        if out is None:
            down, up = [], float("inf")
            part = self.bytes[t]
            while True:
                down.append((part, up))
                if len(part) == 1:
                    break
                up = self.ranks[part]
                part = self.halves(part)[-1 if right else 0]
            out = self.sides[t, right] = down[::-1]
        return out

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes give just a and b.

        As merges go by rising rank, the parts that touch at the border climb a's right and b's left side; a and b stay
        apart unless some touching pair has a merge due before either part joins its own next one. a = -1 stands for the
        start: then whether the merges of b's bytes give b. Results are kept; the store starts anew at a bound.
        """
        k = a << 24 | b
        known = self.known_apart.get(k)
        if known is not None:
            return known
        if len(self.known_apart) > 600_000:
            self.known_apart.clear()
        if a < 0:
            self.known_apart[k] = self.produced(b)
            return self.known_apart[k]
        left, right, i, j = self.side(a, True), self.side(b, False), 0, 0
        apart = True
        while True:
            (u, up_u), (v, up_v) = left[i], right[j]
            r = self.ranks.get(u + v)
            if r is not None and r < up_u and r <= up_v:
                apart = False
                break
            if i == len(left) - 1 and j == len(right) - 1:
                break
            if up_u <= up_v:
                i += 1
            else:
                j += 1
        self.known_apart[k] = apart
        return apart

    def extend(self, line: str, ends: list[int], start: int = 0) -> None:
        """Bring `ends` up to `line`: for each place the last token of the prefix that ends there, and -1 for each BORDER.

        line holds strings as as_chars() gives them, a BORDER before each; start: where the first token that matters may
        begin. Of the tokens that end at a place the one that stays apart from the token before it is the only valid one.
        """
        length, known, apart, put, at = self.length, self.known_apart, self.stay_apart, ends.append, len(ends)
        for end, t in self.tokens.iter(line, start):
            if end < at:
                continue
            while at < end:
                put(-1)
                at += 1
            before = ends[end - length[t]]
            ok = known.get(before << 24 | t)
            if ok is None:
                ok = apart(before, t)
            if ok:
                put(t)
                at += 1

    def walk(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the string that ends at place `at`, from its last token back."""
        out = []
        while (t := ends[at]) >= 0:
            out.append(t)
            at -= self.length[t]
        return out[::-1]


class Prefixes:
    """Last tokens of all prefixes of a byte string; append() and edit() keep them exact."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.line, self.ends = vocabulary, BORDER, [-1]
        self.append(data)

    @property
    def data(self) -> bytes:
        return self.line[1:].encode("latin-1")

    def append(self, data: bytes) -> None:
        """Computes the new bytes' prefixes only: a token that ends among them begins at most a token's length before."""
        self.line += data.decode("latin-1")
        self.v.extend(self.line, self.ends, max(0, len(self.ends) - self.v.longest))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; last tokens are computed anew from there only until they agree with the old ones for
        as many bytes as the longest token has. Returns how many prefixes were computed."""
        old, tail = self.ends[end + 1 :], self.data[end:]
        self.line, self.ends = self.line[: start + 1], self.ends[: start + 1]
        self.append(new)
        done, step = 0, self.v.longest
        while done < len(old):
            self.append(tail[done : done + step])
            done = min(done + step, len(old))
            if done >= step and self.ends[-step:] == old[done - step : done]:
                self.line += tail[done:].decode("latin-1")
                self.ends += old[done:]
                break
        return len(new) + done

    def tokens(self) -> list[int]:
        return self.v.walk(self.ends, len(self.ends) - 1)


class Codec:
    """Encodes texts word by word. Ids of words of up to `longest` characters are kept: two generations, of which a new one
    starts at a bound. Longer ones cost memory in proportion to their length, while their text is encoded."""

    def __init__(self, path: str, pattern: str, words: int = 250_000, longest: int = 40):
        with open(path, "rb") as f:
            self.v = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.split = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.most, self.longest = words, longest

    def pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece; a piece that is a token of its own merges needs no other prefix."""
        out: list = []
        lines, open_, tokens, produced = [], [], self.v.tokens, self.v.produced
        for i, line in enumerate(map(as_chars, pieces)):
            t = tokens.get(line, None)
            if t is not None and produced(t):
                out.append((t,))
            else:
                out.append(None)
                lines.append(line)
                open_.append(i)
        if lines:
            ends: list[int] = []
            self.v.extend(BORDER + BORDER.join(lines), ends)
            at = -1
            for i, line in zip(open_, lines):
                at += len(line) + 1
                out[i] = tuple(self.v.walk(ends, at))
        return out

    def encode(self, text: str | None) -> list[int]:
        """Words are looked up with the blank before them: as the pattern's words take one leading blank and no other
        alternative reaches over it, each blank before a visible character starts a piece."""
        if not text:
            return []
        words = text.split(" ") if not ODD_BLANK.search(text) else BLANK.split(text)
        if len(self.words) > self.most:
            self.words, self.old_words = {}, self.words
        known, old = self.words, self.old_words
        new = []
        for w in set(words[1:]).difference(known):
            if (ids := old.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
        # ASCII letters are one piece by the pattern, whatever blank is before them
        split = self.split
        parts = [[" " + w] if w.isascii() and w.isalpha() else split(" " + w) for w in new]
        parts.append(split(words[0]))
        of: dict[str, tuple[int, ...]] = {}
        missing = []
        for p in set(chain.from_iterable(parts)):
            ids = known.get(p[1:]) if p[0] == " " else None  # a word is kept without its blank
            if ids is None:
                missing.append(p)
            else:
                of[p] = ids
        of.update(zip(missing, self.pieces(missing)))
        once: dict[str, tuple[int, ...]] = {}
        for w, p in zip(new, parts):
            ids = of[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(of.__getitem__, p)))
            (known if len(w) <= self.longest else once)[w] = ids
        for p in missing:
            if p[0] == " " and 1 < len(p) <= self.longest and not p[1].isspace():
                known[p[1:]] = of[p]
        look = known.__getitem__ if not once else lambda w: known[w] if w in known else once[w]
        return list(chain(chain.from_iterable(map(of.__getitem__, parts[-1])), chain.from_iterable(map(look, islice(words, 1, None)))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker: tasks that follow use it again."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if keep_ids, ids.

    path: a rank file that every executor can open (installed with the workers' Python, as the tokenizers are).
    One row per input row, null text as empty: no ids, the digests of nothing. Whole texts.
    """

    def start():
        c = codec(path, pattern)
        as_text = {i: str(i) for i in c.v.bytes}

        def f(cols):
            out = {"doc_id": cols["k"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for t in cols["t"]:
                ids = c.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(as_text.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
                out["ids"].append(ids if keep_ids else None)
            return out

        return f

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, start)


def public(docs: DataFrame, **kw) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **kw)


def op5(spark, sf_dir: str) -> DataFrame:
    return public(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
