"""Token counts of whole texts, with the whole-token shortcut.

Offline, every string of the vocabulary is merged on its own; those that come out as one token
are proven whole tokens. That proof is made once on the driver and handed to the executors, a
set no larger than the vocabulary. A text is then split into pre-tokens: one that is a proven
string counts one, and only the rest is merged, with the results of recurring ones remembered.

The vocabulary file is a `tokenizers` JSON with a byte-level BPE model. Its added tokens are
found in the text first, as the library does by default, and count one each.

Defined cases: null text counts as empty text (no tokens); rows may repeat.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LIMIT = 512
MAX_KNOWN = 400_000
#: Fixed value: the pattern that byte-level pre-tokenizers split text by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Merger:
    """The merges of a vocabulary over byte symbols."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        symbols = byte_symbols()
        self.symbols = dict(enumerate(symbols))

    def spell(self, text: str) -> str:
        if text.isascii() and text[1:].isalpha() and text[0] == " ":
            return self.symbols[32] + text[1:]
        return text.encode().decode("latin-1").translate(self.symbols)

    def count(self, spelled: str) -> int:
        """Number of tokens left once no merge applies; the lowest rank first, the leftmost of equals."""
        if len(spelled) > 200:
            return self._count_long(spelled)
        rank = self.rank.get
        parts = list(spelled)
        never = 1 << 60
        ranks = [rank(pair, never) for pair in zip(parts, spelled[1:])]  # of each part with the next
        while ranks:
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            both = parts[at] = parts[at] + parts.pop(at + 1)
            ranks.pop(at)
            if at < len(ranks):
                ranks[at] = rank((both, parts[at + 1]), never)
            if at:
                ranks[at - 1] = rank((parts[at - 1], both), never)
        return len(parts)

    def _count_long(self, spelled: str) -> int:
        """The same by a heap over a linked list, for very long pre-tokens."""
        parts: list[str | None] = list(spelled)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        left = n

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := self.rank.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            offer(i)
            offer(before[i])
        return left


def load(path: str) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """Merges, vocabulary strings and added tokens of a byte-level BPE file; refuses other kinds."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file["pre_tokenizer"]
    plain = {"normalizer": None, "post_processor": None}
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or any(file[k] != v for k, v in plain.items()):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return merges, list(model["vocab"]), [t["content"] for t in file["added_tokens"]]


def proven_whole(merger: Merger, vocabulary: list[str]) -> set[str]:
    """The vocabulary strings that encode alone as one token, as text; strings that are no text are left out."""
    back = {s: b for b, s in merger.symbols.items()}
    out = set()
    for spelled in vocabulary:
        if all(c in back for c in spelled) and merger.count(spelled) == 1:
            try:
                out.add(bytes(back[c] for c in spelled).decode())
            except UnicodeDecodeError:
                continue
    return out


#: A text without this falls apart at its spaces: each one begins a pre-token.
_LOOSE = re.compile(r" (?:\s|\Z)")


class Counter:
    def __init__(self, merges: list[tuple[str, str]], whole: set[str], added: list[str]):
        self.merger = Merger(merges)
        self.split = regex.compile(BYTE_LEVEL).findall
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = whole
        # Pre-tokens that begin with the space before them, without it; proven ones for a start.
        self.spaced = {w[1:]: 1 for w in whole if w[:1] == " " and len(w) > 1 and self.split(w) == [w] and not w[1:2].isspace() and " " not in w[1:]}
        self.limit = len(self.spaced) + MAX_KNOWN
        self.rest: dict[str, int] = {}
        self.marks = {m for m in ",." if m in whole}

    def _one(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        n = self.rest.get(piece)
        if n is None:
            n = self.merger.count(self.merger.spell(piece))
            if len(piece) < 64:
                if len(self.rest) > MAX_KNOWN // 2:
                    self.rest.clear()
                self.rest[piece] = n
        return n

    def _spaced(self, part: str) -> int:
        """A space and what follows it up to the next space."""
        if part.isalpha() and max(part) < "\u0250":  # letters by any Unicode version: one pre-token
            return self.merger.count(self.merger.spell(" " + part))
        if part[-1:] in self.marks and (word := part[:-1]).isalpha() and max(word) < "\u0250":
            known = self.spaced.get(word)
            return 1 + (known if known is not None else self.merger.count(self.merger.spell(" " + word)))
        return self._pieces(" " + part)

    def _pieces(self, text: str) -> int:
        return sum(map(self._one, self.split(text)))

    def _plain(self, text: str) -> int:
        if _LOOSE.search(text):
            return self._pieces(text)
        head, *parts = text.split(" ")
        counts = list(map(self.spaced.get, parts))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    part = parts[i]
                    n = counts[i] = self._spaced(part)
                    if len(part) < 64 and len(self.spaced) < self.limit:
                        self.spaced[part] = n
        return self._pieces(head) + sum(counts)

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        return len(self.added.findall(text)) + sum(map(self._plain, self.added.split(text)))


_made: dict = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every document row."""
    spark = docs.sparkSession
    C.prepare(spark)
    if path not in _made:
        merges, vocabulary, added = load(path)
        _made[path] = (merges, proven_whole(Merger(merges), vocabulary), added)
    shared = spark.sparkContext.broadcast(_made[path])

    def run(batches):
        counter = C.resident(("counter", path), lambda: Counter(*shared.value))
        for batch in C.slices(batches, 1):
            bodies = [x.as_py() for x in batch.column(1)]
            n = [counter.count(b.decode("utf-8", "replace")) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = C.arrow_map(docs.select(F.col(id_col).alias("doc_id"), C.text_bytes(text_col)), run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
