"""Toxicity by a weighted lexicon over folded text.

Texts are folded first: case, accents, look-alike letters of other scripts, full-width and
styled letters, digits and signs used as letters, invisible characters. What is no letter then
becomes a space. Lexicon entries are beginnings of words with a weight; one Aho-Corasick
automaton finds them all in a single pass, together with exception phrases, whose words do not
count. The weights found in a text are summed and normalised by its number of words; a
logistic unit over the total, the density and the heaviest entry found gives the score.

The lexicon is learned: of the word beginnings in a bounded sample of labelled documents
(SAMPLE_ROWS of at most SAMPLE_BYTES each, parameters), those are kept that mark toxic documents clearly, the shortest one
that is as clear as its extensions, with their log-odds as weights, MAX_ENTRIES at most. No
word is in it that labels of the training fold did not put there. Each whole text is folded and
searched in one go.

Exception phrases are a parameter. One counts only where its last word ends there, or in a plural
s ("trash can" excuses neither "trash can't" nor "trash canoe").

Defined cases: null and empty texts have no words and get the score of a text without hits;
without labels of both classes every score is 0.5. Rows may repeat; a null doc_id
is not held out. Bytes of a text that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labels import sample

SAMPLE_ROWS = 8000
#: Longer labelled documents are not used for the fit; every document is scored whole.
SAMPLE_BYTES = 200_000
#: Distinct beginnings that a task holds before it hands them on.
HELD_TERMS = 200_000
MAX_ENTRIES = 4000
SHORTEST, LONGEST = 4, 12
MOD, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Letters that look like others, and signs that stand for letters.
ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "æ": "ae", "œ": "oe", "ß": "ss",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "|": "i", "£": "l",
}
#: Fixed value: benign phrases around words that may be insults.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "scum line", "pond scum")
#: n't at the end of a word is part of it.
_NOT = re.compile("(?i)n['\u2019]t\\b")


class _Fold(dict):
    """A translation table filled as characters are met: letters folded, the rest to a space or to nothing.

    keep: accented letters of Latin alphabets stay themselves.
    """

    def __init__(self, keep: bool):
        self.keep = keep

    def __missing__(self, code: int):
        c = chr(code)
        low = c.lower()
        if self.keep and 0xC0 <= code < 0x180 and c.isalpha():
            out = low
        elif low in ALIKE or c in ALIKE:
            out = ALIKE.get(low) or ALIKE[c]
        elif unicodedata.category(c) in ("Mn", "Me", "Cf"):
            out = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(ALIKE.get(x, x) if x.isalnum() or x in "@$" else " " for x in plain) or " "
        out = self[code] = out.replace("l", "i")  # 1, l and i are one letter here
        return out


_LOOSE, _KEPT = _Fold(False), _Fold(True)


def fold(text: str) -> str:
    return _NOT.sub("nt", text).translate(_LOOSE)


def fold_kept(text: str) -> str:
    """As fold(), but accents that belong to a language's spelling stay."""
    return _NOT.sub("nt", text).translate(_KEPT)


def word_count(folded: str) -> int:
    """How many words a folded text has; blanks are all that is between them."""
    blank = np.frombuffer(b" " + folded.encode("utf-8", "replace"), dtype=np.uint8) == 32
    return int((blank[:-1] & ~blank[1:]).sum())


def beginnings(text: str) -> tuple[set[str], int]:
    """Distinct words of a text (loose, and kept if they have accents), and the number of words."""
    loose = fold(text)
    words = set(loose.split())
    if not text.isascii():
        words.update(w for w in fold_kept(text).split() if not w.isascii())
    return words, word_count(loose)


def prefixes(word: str):
    """Beginnings of a word that may become entries; one of an accented word must show an accent."""
    plain = word.isascii()
    for n in range(SHORTEST if plain else SHORTEST - 1, min(len(word), LONGEST) + 1):
        if plain or not word[:n].isascii():
            yield word[:n]


class Lexicon:
    """Entries with weights, exception phrases and the logistic unit."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions = weights, exceptions
        self.accents = any(not e.isascii() for e in weights)
        self.unit: tuple[float, ...] = ()
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        """Entries and exceptions by their length, weight (none: an exception) and whether they have accents."""
        if self._machine is None:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(" " + entry, (len(entry), w, not entry.isascii()))
            for phrase in self.exceptions:
                a.add_word(" " + fold(phrase), (len(fold(phrase)), None, False))
            a.make_automaton()
            self._machine = a
        return self._machine

    def measure(self, text: str) -> tuple[float, int, float]:
        """Sum of the weights of the entries found (at each place the longest one, each word once), the number of words, and the greatest weight."""
        folded = " " + fold(text)
        words = word_count(folded)
        if not self.weights:
            return 0.0, words, 0.0
        weights = self._found(self.machine(), folded, False)
        if self.accents and not text.isascii():
            weights += self._found(self.machine(), " " + fold_kept(text), True)
        return float(sum(weights)), words, max([0.0, *weights])

    @staticmethod
    def _found(machine: ahocorasick.Automaton, folded: str, accented: bool) -> list[float]:
        """accented: count only entries with accents; the others were counted in the loose folding."""
        found: dict[int, tuple[int, float | None, bool]] = {}
        for end, hit in machine.iter(folded):
            if hit[1] is None:
                after = folded[end + 1 : end + 3]
                if after[:1] not in ("", " ") and after not in ("s", "s "):
                    continue
            start = end - hit[0]
            if hit[2] == accented and (start not in found or hit[0] > found[start][0]):
                found[start] = hit
        reach, words = -1, {}
        for start in sorted(found):
            length, w, _ = found[start]
            if w is None:
                reach = max(reach, start + length)
            elif start > reach:  # a word that recurs counts once
                end = folded.find(" ", start + 1)
                words[folded[start:end] if end > 0 else folded[start:]] = w
        return list(words.values())


def features(total: np.ndarray, words: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1)), top], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon | None:
    spark = docs.sparkSession
    C.prepare(spark)
    chosen = sample(docs, labels, label, MOD, HELD_OUT, rows).where(F.octet_length("body") <= SAMPLE_BYTES).checkpoint()
    if chosen.select((F.col("y") > 0).alias("y")).distinct().count() < 2:
        return None

    def terms(batches):
        docs_, times = Counter(), {True: Counter(), False: Counter()}

        def flush():
            both = list(times[True].keys() | times[False].keys())
            out = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([x[t] for t in both], pa.int64()) for x in (docs_, times[True], times[False]))], names=["term", "t", "k", "c"])
            for x in (docs_, *times.values()):
                x.clear()
            return out

        for batch in C.slices(batches, 1):
            for y, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, _ = beginnings(body.decode("utf-8", "replace"))
                own = Counter(t for w in words for t in prefixes(w))  # distinct words with each beginning
                if y > 0:
                    docs_.update(own.keys())
                times[y > 0].update(own)
                times[y > 0][""] += len(words)
                if len(times[True]) + len(times[False]) > HELD_TERMS:
                    yield flush()
        if times[True] or times[False]:
            yield flush()

    counted = C.arrow_map(chosen, terms, "term string, t long, k long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("k").alias("k"), F.sum("c").alias("c")).where("k > 0").checkpoint()
    every = counted.where("term = ''").first()
    if every is None:
        return None
    # Weight: how much oftener the beginning occurs among the distinct words of toxic documents. Evidence:
    # the log-likelihood, in nats, of its toxic and clean counts against the share of words;
    # chance finds among so many beginnings must stay rare.
    share = every.k / (every.k + every.c)
    both = F.col("k") + F.col("c")
    evidence = F.col("k") * F.log(F.col("k") / (both * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * max(1 - share, 1e-12)))).otherwise(0.0)
    odds = F.log((F.col("k") + 0.5) / every.k) - F.log((F.col("c") + 0.5) / max(every.c, 1))
    enough = 2 * math.log(counted.count())
    found = (
        counted.where("term <> ''").withColumn("w", odds).withColumn("e", evidence)
        .where((F.col("t") >= 3) & (F.col("w") > 2) & (F.col("e") > enough)).orderBy(F.desc("e"), "term").limit(4 * MAX_ENTRIES).collect()
    )
    kept: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r.term), r.term)):
        shorter = max((kept[r.term[:k]] for k in range(SHORTEST - 1, len(r.term)) if r.term[:k] in kept), default=-1.0)
        if r.w > shorter + 0.7 and len(kept) < MAX_ENTRIES:
            kept[r.term] = float(r.w)
    lexicon = Lexicon(kept, exceptions)

    def measures(batches):
        for batch in batches:
            got = [lexicon.measure(b.decode("utf-8", "replace")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _, _ in got], pa.float64()), pa.array([b for _, b, _ in got], pa.int64()), pa.array([c for _, _, c in got], pa.float64())], names=["y", "total", "words", "top"])

    rows_ = sorted(C.arrow_map(chosen, measures, "y int, total double, words long, top double").collect())
    x = features(np.array([r.total for r in rows_]), np.array([r.words for r in rows_]), np.array([r.top for r in rows_]))
    lexicon.unit = logistic(x, np.array([float(r.y > 0) for r in rows_]))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; returns the weights and the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) * np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row, with total weight and word count."""
    lexicon = fit(docs, labels, exceptions=exceptions)

    def run(batches):
        for batch in C.slices(batches, 1):
            n = batch.num_rows
            if lexicon is None:
                total, words, score = np.zeros(n), np.zeros(n, dtype=np.int64), np.full(n, 0.5)
            else:
                got = [lexicon.measure(b.decode("utf-8", "replace")) for b in batch.column(1).to_pylist()]
                total, words, top = (np.array(x) for x in zip(*got))
                *w, c = lexicon.unit
                score = 1 / (1 + np.exp(-np.clip(features(total, words, top) @ np.array(w) + c, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score, pa.float64()), pa.array(total, pa.float64()), pa.array(words, pa.int64())], names=["doc_id", "score", "weight", "n_words"])

    scored = C.arrow_map(docs.select(F.col(id_col).alias("doc_id"), C.text_bytes(text_col)), run, "doc_id long, score double, weight double, n_words long")
    return scored.select("doc_id", F.coalesce(C.fold_of("doc_id", MOD) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight", "n_words")
