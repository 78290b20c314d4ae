"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Folding maps a text to lower-case words: compatibility forms, look-alike
letters of other scripts and digits that stand for letters are folded, marks
that hide inside a word too, and everything else that is not a letter parts
words.  The lexicon holds whole words and word beginnings with their log-odds,
learned from labelled texts.  An entry inside an exception phrase does not
count.  The score is the logistic of a line in three figures of the hits'
weight: its sum, its sum over the length in words, and the heaviest hit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import textgrams as tg
from .labelled import id_remainder, labelled_sample, with_scores

# Letters of other scripts that look like Latin ones, digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝһвкмнтгαβεικνορτυχ", "aeopcyxijsdqwhbkmhtraeeikvoptux".replace("aee", "abe"), strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: Phrases in which a lexicon entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "rodeo clown", "stupid easy")

SHORTEST, LONGEST = 4, 8
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|+](?=[^\W_])")
_HIDDEN = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


class _Folding(dict):
    """str.translate table: letters stay, digits and look-alikes fold, anything else is a space."""

    def __missing__(self, code):
        c = chr(code)
        to = HOMOGLYPHS.get(c) or LEET.get(c) or (c if c.isalpha() or unicodedata.combining(c) else " ")
        self[code] = to
        return to


_FOLD = _Folding(_HIDDEN)


def fold(text: str | None) -> str:
    """Words of lower-case letters with one space before, between and after them."""
    text = unicodedata.normalize("NFKC", text or "").lower()
    text = _INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_FOLD).split())} "


class Lexicon:
    """Entries with weights, exception phrases and the line that turns figures into a score.

    An entry ends with a space if it is a whole word, else it is a word's beginning.
    """

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS, line=(-4.0, 1.0, 8.0, 0.5)):
        self.weights, self.exceptions, self.line = dict(weights), tuple(exceptions), tuple(line)
        self._found = None

    def __getstate__(self):
        return {**self.__dict__, "_found": None}

    def _automaton(self):
        if self._found is None:
            found = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                found.add_word(f" {entry}", (len(entry), weight))
            for phrase in self.exceptions:
                key = fold(phrase)
                found.add_word(key, (len(key) - 2, None))
            found.make_automaton()
            self._found = found
        return self._found

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, length, weight) of the longest entry at each word that no exception phrase covers."""
        if not self.weights:
            return []
        best, covered = {}, []
        for end, (size, weight) in self._automaton().iter(folded):
            if weight is None:
                covered.append((end - size, end))
                continue
            start = end - size + 1
            if start not in best or size > best[start][0]:
                best[start] = (size, weight)
        return [(s, n, w) for s, (n, w) in best.items() if not any(a <= s < b for a, b in covered)]

    def figures(self, text: str | None):
        folded = fold(text)
        found = self.hits(folded)
        weight = sum(w for _, _, w in found)
        words = folded.count(" ") - 1
        return math.log1p(weight), weight / (words + 20), max((w for _, _, w in found), default=0.0), len(found)

    def score(self, figures: np.ndarray) -> np.ndarray:
        y = self.line[0] + figures @ np.array(self.line[1:])
        return 1 / (1 + np.exp(-np.clip(y, -40, 40)))


def _candidates(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f"{word} ")
        for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
            out.add(word[:k])
    return out


def fit_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 12_000, support: int = 4,
                odds: float = 3.0, surety: float = 2.5, entries: int = 5_000, phrases: int = 1_000) -> Lexicon:
    """A lexicon from at most ``sample`` labelled ids whose crc32 modulo 3 is not 1.

    Whole words and word beginnings are counted in Spark, once a text, after
    near copies in the sample are thinned to one (of rows with the same label that
    agree in three least shingle hashes, the one with the smallest id).  An entry needs ``support`` toxic texts, log-odds of
    ``odds`` and log-odds of ``surety`` standard errors; at most the ``entries``
    surest go to the driver, and at most ``phrases`` exception phrases.  Without
    such entries every score is low.  The order of the rows makes no difference.
    """
    rows = labelled_sample(docs, labels, "toxic", id_remainder(3) != 1, sample)

    def sketch(batches):
        for batch in batches:
            data, offsets = tg.text_buffer(batch.column(0))
            marks = []
            for i, j in tg.row_slices(offsets):
                h, row, _, _ = tg.words(data, offsets[i: j + 1])
                x, row = tg.shingles(h, row, j - i, 3)
                least = np.full((3, j - i), -1, np.int64)
                if len(x):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    for k in range(3):
                        least[k, row[first]] = np.minimum.reduceat(tg.mix(x + np.uint64(k)), first).view(np.int64)
                marks.append(least)
            marks = np.concatenate(marks, axis=1) if marks else np.empty((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, marks)],
                                             ["text", "label", "doc_id", "x", "y", "z"])

    thin = rows.select("text", "label", "doc_id").mapInArrow(
        sketch, "text string, label int, doc_id long, x long, y long, z long")
    alike = Window.partitionBy("x", "y", "z", "label").orderBy("doc_id", "text")  # within the bounded sample
    thin = materialize(thin.withColumn("k", F.row_number().over(alike)).filter("k = 1").select("text", "label"))

    def count(batches):
        bad, good = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (bad if label else good).update(_candidates(fold(text)))
        keys = list(bad)  # what no toxic text has cannot become an entry
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()),
             pa.array([0] * len(keys), pa.int64())], ["entry", "bad", "good"])
        keys = list(good)
        for a in range(0, len(keys), 50_000):
            part = keys[a: a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64()),
                 pa.array([good[k] for k in part], pa.int64())], ["entry", "bad", "good"])

    total = thin.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    p, n = int(total["p"]), int(total["n"] - total["p"])
    counted = thin.mapInArrow(count, "entry string, bad long, good long").groupBy("entry").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (p + 1)) - F.log((F.col("good") + 0.5) / (n + 1))
    sure = weight / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = (counted.filter(F.col("bad") >= support).select("entry", "bad", "good", weight.alias("w"), sure.alias("z"))
            .filter((F.col("w") >= odds) & (F.col("z") >= surety)).orderBy(F.desc("z"), "entry").limit(entries))
    weights = _prune({r["entry"]: (r["bad"], r["good"], r["w"]) for r in best.collect()})
    lexicon = Lexicon(weights)
    lexicon.exceptions += _harmless(thin, lexicon, phrases)
    return Lexicon(weights, lexicon.exceptions, _fit_line(thin, lexicon))


def _prune(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Of entries that begin each other, the longest that keeps nine tenths of the toxic texts."""
    kept: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (len(e), e)):
        bad, good, w = found[entry]
        longer = [e for e in found if len(e) > len(entry) and e.startswith(entry) and found[e][0] >= 0.9 * bad]
        before = [e for e in kept if entry.startswith(e)]
        if longer or any(kept[e] >= w - 1 for e in before):
            continue
        kept[entry] = float(w)
    return kept


def _harmless(thin: DataFrame, lexicon: Lexicon, most: int, support: int = 3) -> tuple[str, ...]:
    """Two-word phrases around an entry that several harmless texts have and no toxic one."""
    def around(batches):
        seen = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, phrases = fold(text), set()
                for start, _, _ in lexicon.hits(folded):
                    word = folded[start: folded.index(" ", start)]
                    before, after = folded[:start].split()[-1:], folded[start + len(word):].split(maxsplit=1)[:1]
                    phrases.update(" ".join(x) for x in ([*before, word], [word, *after]) if len(x) == 2)
                seen.update((p, int(label)) for p in phrases)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] * seen[k] for k in keys], pa.int64()),
             pa.array([(1 - k[1]) * seen[k] for k in keys], pa.int64())], ["phrase", "bad", "good"])

    if not lexicon.weights:
        return ()
    got = (thin.mapInArrow(around, "phrase string, bad long, good long").groupBy("phrase")
           .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
           .filter(f"bad = 0 and good >= {support}").orderBy(F.desc("good"), "phrase").limit(most))
    return tuple(r["phrase"] for r in got.collect())


def _fit_line(thin: DataFrame, lexicon: Lexicon, ridge: float = 0.02) -> tuple[float, ...]:
    """Logistic regression of the label on the three figures, by Newton steps with a small ridge."""
    def measure(batches):
        for batch in batches:
            got = np.array([lexicon.figures(t)[:3] for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(got[:, k], pa.float64()) for k in range(3))], ["label", "a", "b", "c"])

    table = thin.mapInArrow(measure, "label int, a double, b double, c double").toArrow()  # of the bounded sample
    table = table.sort_by([(c, "ascending") for c in ("label", "a", "b", "c")])  # sums do not depend on the rows' order
    y = np.asarray(table.column(0), dtype=float) if table.num_rows else np.empty(0)
    if not 0 < y.sum() < len(y) or not lexicon.weights:
        return (-4.0, 1.0, 8.0, 0.5)
    x = np.column_stack([np.ones(len(y)), *(np.asarray(table.column(k)) for k in (1, 2, 3))])
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    scale[0] = 1
    x, beta = x / scale, np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        pull = ridge * np.r_[0, beta[1:]]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-3, 1, 1, 1]) + 1e-9 * np.eye(4),
                               x.T @ (y - p) - pull)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta / scale)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, out: str = "score", hits: str = "n_hits") -> DataFrame:
    """``docs`` with the toxicity score from 0 to 1 and the number of lexicon hits.

    Whole texts are matched; null and empty texts have no hits and the score of
    that.  Older columns with the names of the results give way.
    """
    def score(text):
        got = np.array([lexicon.figures(t) for t in text.to_pylist()], dtype=float).reshape(-1, 4)
        return [pa.array(lexicon.score(got[:, :3]), pa.float64()), pa.array(got[:, 3].astype(np.int64))]

    return with_scores(docs, {"text": F.col("text").cast("string")}, score, {out: "double", hits: "long"})
