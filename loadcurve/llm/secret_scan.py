"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Ordinary words cost a tokenizer few tokens, random strings many.  What is left
of a run of key characters outside the fixed patterns' spans, known digests and
identifiers, host names and e-mail local parts is a span of kind ``random`` if
it has at most ``ratio`` characters a token under a tiktoken vocabulary; if not,
each stretch of its pieces between plain words and numbers is tested on its own.
Spans count code points; ends are exclusive.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textgrams as tg
from .labelled import with_scores

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KINDS = ("assign", "access", "hex", "random")
# The patterns of the scan (ASCII letters in either case for the first).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 16  # characters of a random string
PLAIN = 0.82  # of the ratio that letters without a capital inside may have
VOWELS = 0.2  # of such letters that are vowels in a word at least
#: A run of key characters long enough to test.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_EDGE = "=-_/+"
_PIECE = re.compile(r"[A-Za-z0-9]+")
_WORDS = re.compile(r"([A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*)[-_/=+]?[0-9]{0,6}")  # letters, with a short number at most
# Identifiers, digests and addresses that look random but are no secrets.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"          # UUID
    r"|(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"  # digests
    r"|(?:sha|SHA)(?:1|256|384|512)[-:][A-Za-z0-9+/]+=*"            # integrity attribute, named digest
    r"|(?:md5|MD5):[A-Za-z0-9+/]+=*"
    r")(?![A-Za-z0-9])")
HOST = re.compile(
    r"(?<![A-Za-z0-9._-])(?:(?<=//)|(?<=@))(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9_-])"
    r"|(?<![A-Za-z0-9._-])(?:[a-z0-9-]{1,63}\.)+(?:com|org|net|edu|gov|int|info|biz|io|dev|app|cloud|eu|de|at|ch|fr|es|it|nl|be"
    r"|pl|pt|uk|ie|us|ca|mx|br|jp|cn|in|au|example|test|invalid|local|localhost)(?![A-Za-z0-9_-])")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
#: Before a local part: a colon or slash makes it the password of a URL or a login, but not after these words.
_MAIL_LABEL = re.compile(r"(?:mailto|e-?mail|mail|from|to|cc|bcc|reply-to|contact|kontakt|contacto|courriel|correo):\Z", re.IGNORECASE)
_AROUND = 256  # characters before and after a run that can make it part of an address
_BLOCK = 8
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


class Tokens:
    """Counts tokens; the encoder is built in the task that first needs it."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks, self._encoder = f.read(), None

    def __getstate__(self):
        return {"ranks": self.ranks, "_encoder": None}

    def count(self, text: str) -> int:
        if self._encoder is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self._encoder = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return len(self._encoder.encode_ordinary(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then by kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _known(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Places of identifiers, digests, host names and e-mail local parts in or around the run ``a`` to ``b``."""
    first = max(0, a - _AROUND)
    near = text[first: b + _AROUND]
    out = [m.span() for m in KNOWN.finditer(near)]
    if "." in near:
        out += [m.span() for m in HOST.finditer(near)]
    if "@" in near:
        for m in MAIL.finditer(near):
            before = re.split(r"[\s\"'<>(),;]", near[: m.start()])[-1]
            if ":" not in before or _MAIL_LABEL.search(before):
                out.append(m.span())
    return [(first + x, first + y) for x, y in out]


def _outside(a: int, b: int, taken) -> list[tuple[int, int]]:
    """What is left of ``a`` to ``b`` outside the spans of ``taken``."""
    out = []
    for x, y in sorted(taken):
        if x < b and y > a:
            if x > a:
                out.append((a, x))
            a = max(a, y)
    return out + [(a, b)] * (a < b)


def _inefficient(run: str, tokens: Tokens, ratio: float) -> bool:
    """Whether a run is long enough and has at most ``ratio`` characters a token.

    Of letters with a short number at most, the letters are judged, also as a
    word in lower case after a space, which is how the vocabulary knows words.
    Compounds of the rarer languages come down to ``ratio`` too, so letters
    without a capital inside need ``PLAIN`` of it, or hardly a vowel.
    """
    run = run.strip(_EDGE)
    if len(run) < LEAST:
        return False
    words = _WORDS.fullmatch(run)
    if not words:
        return not run.strip("0123456789" + _EDGE) == "" and len(run) <= ratio * tokens.count(run)
    parts = _PIECE.findall(words[1])
    n = sum(map(len, parts))
    if (all(p[1:].islower() or p.isupper() or len(p) < 2 for p in parts)
            and sum(words[1].lower().count(v) for v in "aeiouy") >= VOWELS * n):
        ratio *= PLAIN
    return all(n <= ratio * sum(tokens.count(form(p)) for p in parts)
               for form in (str, lambda p: " " + p, lambda p: " " + p.lower()))


def _random_parts(text: str, a: int, b: int, tokens: Tokens, ratio: float):
    """Inefficient parts of ``a`` to ``b``: all of it, or stretches of pieces between its words and numbers."""
    if b - a < LEAST:
        return
    if _inefficient(text[a:b], tokens, ratio):
        yield a, b
        return
    start = end = None
    for m in _PIECE.finditer(text, a, b):
        piece = m[0]
        plain = (piece.isdigit() or piece.isalpha() and len(piece) < 4
                 or len(piece) > ratio * max(tokens.count(piece), tokens.count(" " + piece.lower()) * piece.isalpha()))
        if not plain:
            start, end = m.start() if start is None else start, m.end()
        elif start is not None:
            if _inefficient(text[start:end], tokens, ratio):
                yield start, end
            start = None
    if start is not None and _inefficient(text[start:end], tokens, ratio):
        yield start, end


def random_spans(text: str, taken: list[tuple[str, int, int]], tokens: Tokens, ratio: float):
    """Spans of inefficient runs, or pieces of runs, outside the spans of ``taken``, addresses and known forms."""
    out = []
    base = [s[1:] for s in taken]
    for m in RUN.finditer(text):
        a, b = m.span()
        inner = [s for s in base if s[0] < b and a < s[1]]
        found = [s for x, y in _outside(a, b, inner) for s in _random_parts(text, x, y, tokens, ratio)]
        if found and (known := _known(text, a, b)):
            found = [s for x, y in _outside(a, b, inner + known) for s in _random_parts(text, x, y, tokens, ratio)]
        out += [("random", *s) for s in found]
    return out


def _worth_reading(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can have a span at all: a key mark, ``AKIA``, a digit or a long run of key characters.

    A run of ``LEAST`` = 16 characters has an aligned block of 8 in it.
    """
    a, b = int(offsets[0]), int(offsets[-1])
    buf = data[a:b]
    at = offsets - a
    marks = np.isin(buf, np.frombuffer(b":=0123456789", np.uint8))
    odd = tg.segment_sums(marks.astype(np.int64), at) > 0
    n = len(buf) // _BLOCK * _BLOCK
    runs = _KEY[buf[:n]].reshape(-1, _BLOCK).all(axis=1)
    upper = (buf[:-3] == 65) & (buf[1:-2] == 75) & (buf[2:-1] == 73) & (buf[3:] == 65) if len(buf) > 3 else np.empty(0, bool)
    hits = np.r_[np.flatnonzero(runs) * _BLOCK, np.flatnonzero(upper)]
    odd[np.searchsorted(at, hits, side="right") - 1] = True
    return odd


def scan(docs: DataFrame, tokens: Tokens | None = None, ratio: float = 2.2, out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: an array of (kind, start, end) by start and kind, empty for a null or empty text.

    Whole texts are scanned.  An older column ``out`` gives way; nulls in other
    columns stay.
    """
    tokens = tokens or Tokens()
    kind = "array<struct<kind:string,start:int,end:int>>"

    def find(text):
        data, offsets = tg.text_buffer(text)
        rows = [[] for _ in range(len(text))]
        for i, j in tg.row_slices(offsets):
            for r in np.flatnonzero(_worth_reading(data, offsets[i: j + 1])) + i:
                t = text[int(r)].as_py() or ""
                base = base_spans(t)
                found = base + random_spans(t, base, tokens, ratio)
                rows[r] = [dict(zip(("kind", "start", "end"), s, strict=True))
                           for s in sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))]
        return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    return with_scores(docs, {"text": F.col("text").cast("string")}, find, {out: kind})


def redact(docs: DataFrame, tokens: Tokens | None = None, ratio: float = 2.2, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; overlapping spans become one.

    Other columns stay as they are, but ``n_chars`` (where there is one) follows
    a changed text.  Null texts stay null.
    """
    tokens = tokens or Tokens()

    def clean(text):
        out = []
        data, offsets = tg.text_buffer(text)
        worth = np.zeros(len(text), bool)
        for i, j in tg.row_slices(offsets):
            worth[i:j] = _worth_reading(data, offsets[i: j + 1])
        for r in np.flatnonzero(worth):
            t = text[int(r)].as_py() or ""
            base = base_spans(t)
            at, parts = 0, []
            for _, a, b in sorted(base + random_spans(t, base, tokens, ratio), key=lambda s: s[1:]):
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append((r, "".join([*parts, t[at:]]) if parts else None))
        new = [None] * len(text)
        for r, t in out:
            new[r] = t
        return [pa.array(new, pa.string())]

    found = with_scores(docs, {"text": F.col("text").cast("string")}, clean, {"__clean__": "string"})
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "text":
            c = F.coalesce("__clean__", c)
        elif f.name == "n_chars":
            c = F.when(F.col("__clean__").isNotNull(), F.char_length("__clean__").cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return found.select(*cols)


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(scanned: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts of the fixed kinds, the hash of their spans and all spans as text."""
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"), count("assign").alias("n_assign"),
        count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans"))

