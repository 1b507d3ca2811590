"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. The merges of a rank file are compiled to a nondeterministic transducer that reads
bytes: from a token boundary it guesses the next token by walking a trie of the vocabulary,
and may end token t after token p only if p and t stay two tokens when their bytes are merged
together. A byte string has exactly one path of such pairs, and it is what the merges give.
Guesses differ for a few bytes at most (no longer than the longest token), so the transducer
is made deterministic as it runs: a state holds the live guesses with the tokens that not all
of them agree on yet; a token is emitted as soon as all live guesses agree. States and
transitions are built when first met and thrown away together when there are too many, inside
a long pre-token too: the live guesses alone are enough to go on.

Decoding keeps the unfinished bytes of a UTF-8 sequence as its state; (state, token) steps are
remembered, so a stream is decoded token by token with at most three pending bytes. Malformed
sequences become U+FFFD, one for each maximal broken part.

Defined cases: null text is encoded as empty text (no ids); empty input decodes to ''. Rows
may repeat. Special tokens are never produced; their strings are ordinary text. Bytes of a text
that are no UTF-8 count as U+FFFD. A rank file without a token for each single byte is refused.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bounds of what one Python process remembers: about 150 MB of states and 60 MB of pieces.
MAX_STATES = 250_000
MAX_PIECES = 250_000
#: Bytes of a pre-token between two looks at the number of states; each byte makes one state at most.
LOOK = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path} has no token for the bytes {missing}")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge by rank, the lowest first and the leftmost of equals: the definition all else must match."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _State(dict):
    """A deterministic state: byte -> (next state, emitted ids as text). Missing steps are built on demand."""

    __slots__ = ("machine", "guesses", "rest")

    def __missing__(self, byte: int):
        step = self[byte] = self.machine._step(self.guesses, byte)
        return step


class Transducer:
    """The encoder of one pre-token.

    A guess is (previous token, trie node, tokens not emitted yet); a state's guesses are kept
    in one flat tuple, and strings and token tuples are shared between states, to save memory.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, r in ranks.items():
            node = 0
            for b in word:
                node = self.trie[node].setdefault(b, len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
                    self.token.append(-1)
            self.token[node] = r
        self.bytes = {r: w for w, r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.max_pairs = 400_000
        self.states: dict[tuple, _State] = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():  # no cycles are left behind
            state.clear()
            state.machine = None
        self.states: dict[tuple, _State] = {}
        self.shared: dict = {}
        self.start = self._state((-1, 0, ()))

    def _state(self, guesses: tuple) -> _State:
        found = self.states.get(guesses)
        if found is None:
            found = _State()
            found.machine, found.guesses = self, guesses
            found.rest = self._ids(guesses[-1])  # the guess that stands at a token's end comes last
            self.states[guesses] = found
        return found

    def _ids(self, tokens: tuple[int, ...]) -> str:
        text = "".join([f" {t}" for t in tokens])
        return self.shared.setdefault(text, text)

    def _follows(self, prev: int, token: int) -> bool:
        """Whether `token` may stand after `prev` (-1: at the start)."""
        b = self.bytes[token]
        if len(self.pairs) > self.max_pairs:
            self.pairs.clear()
        if prev < 0:
            ok = len(merge(b, self.ranks)) == 1
        else:
            a = self.bytes[prev]
            ok = merge(a + b, self.ranks) == [a, b]
        self.pairs[(prev + 1) << 32 | token] = ok
        return ok

    def _step(self, guesses: tuple, byte: int):
        trie, tokens, known = self.trie, self.token, self.pairs.get
        prevs, nodes, rests, done = [], [], [], -1
        for i in range(0, len(guesses), 3):
            prev, rest = guesses[i], guesses[i + 2]
            to = trie[guesses[i + 1]].get(byte)
            if to is None:
                continue
            if trie[to]:
                prevs.append(prev)
                nodes.append(to)
                rests.append(rest)
            if done < 0 and (token := tokens[to]) >= 0:
                ok = known((prev + 1) << 32 | token)
                if ok or (ok is None and self._follows(prev, token)):
                    done, last = token, (*rest, token)
        prevs.append(done)
        nodes.append(0)
        rests.append(last)
        # Tokens that all live guesses agree on go out: the common start of the least and the greatest.
        low, high = min(rests), max(rests)
        shared = 0
        for x, y in zip(low, high):
            if x != y:
                break
            shared += 1
        same = self.shared.setdefault
        out = []
        for prev, node, rest in zip(prevs, nodes, rests):
            rest = rest[shared:]
            out += (prev, node, same(rest, rest))
        return self._state(tuple(out)), self._ids(low[:shared])

    def encode(self, piece: bytes) -> str:
        """The ids of one pre-token, each with a space before it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return f" {whole}"
        if len(self.states) > self.max_states:
            self._reset()
        state, out = self.start, []
        for at in range(0, len(piece), LOOK):
            if at and len(self.states) > self.max_states:
                guesses = state.guesses
                self._reset()
                state = self._state(guesses)
            for b in piece[at : at + LOOK]:
                state, ids = state[b]
                if ids:
                    out.append(ids)
        return "".join(out) + state.rest


#: A text without this has no space that stands before white space or at the end; it falls apart at its spaces.
_LOOSE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """Whole texts: split by the pattern, encode each pre-token, remember what recurs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.split = regex.compile(pattern).findall
        self.machine = Transducer(ranks, max_states)
        self.max_pieces = max_pieces
        self.pieces: dict[str, str] = {}
        self.spaced: dict[str, str] = {}
        self.missed: dict[int, int] = {}
        whole = lambda t: self.split(t) == [t]
        letters_alone = whole(" azé") and self.split(" ab,") == [" ab", ","]
        self.marks = {m: self.machine.encode(m.encode()) for m in ",." if letters_alone}

    def _keep(self, known: dict[str, str], text: str, ids: str) -> None:
        """Remember up to max_pieces short texts: the first met are mostly the common ones.

        Eight times as many misses as entries mean that the texts have changed; then start anew.
        """
        if len(text) > 64:
            return
        if len(known) < self.max_pieces:
            known[text] = ids
            return
        missed = self.missed[id(known)] = self.missed.get(id(known), 0) + 1
        if missed > 8 * self.max_pieces:
            known.clear()
            self.missed[id(known)] = 0

    def _piece(self, piece: str) -> str:
        found = self.pieces.get(piece)
        if found is None:
            found = self.machine.encode(piece.encode())
            self._keep(self.pieces, piece, found)
        return found

    def _spaced(self, part: str) -> str:
        """A space and what follows it up to the next space."""
        if self.marks and part.isalpha() and max(part) < "\u0250":  # letters by any Unicode version: one pre-token
            return self.machine.encode((" " + part).encode())
        if part[-1:] in self.marks and (word := part[:-1]).isalpha() and max(word) < "\u0250":
            return self.machine.encode((" " + word).encode()) + self.marks[part[-1]]
        return self._pieces(" " + part)

    def _pieces(self, text: str) -> str:
        return "".join(map(self._piece, self.split(text)))

    def encode(self, text: str) -> str:
        """The decimal ids of a text, joined by single spaces."""
        if _LOOSE.search(text):
            return self._pieces(text)[1:]
        # Each space is followed by a printing character, so a pre-token starts at it.
        head, *rest = text.split(" ")
        spaced = self.spaced
        ids = list(map(spaced.get, rest))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    part = rest[i]
                    x = spaced.get(part)
                    if x is None:
                        x = self._spaced(part)
                        self._keep(spaced, part, x)
                    ids[i] = x
        return (self._pieces(head) + "".join(ids))[1:]


class Utf8Machine:
    """Incremental UTF-8 over byte chunks: state is the pending bytes of one unfinished sequence."""

    #: Lead byte range -> (continuation bytes, lowest and highest first continuation).
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self):
        self.lead = {b: (n, lo, hi) for first, last, n, lo, hi in self.LEADS for b in range(first, last + 1)}

    def step(self, pending: bytes, chunk: bytes) -> tuple[str, bytes]:
        """Text that is complete after `chunk`, and the new pending bytes."""
        out = []
        held = bytearray(pending)
        for b in chunk:
            if held:
                n, lo, hi = self.lead[held[0]]
                if len(held) > 1:
                    lo, hi = 0x80, 0xBF
                if lo <= b <= hi:
                    held.append(b)
                    if len(held) == n + 1:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("�")
                held.clear()
            if b < 0x80:
                out.append(chr(b))
            elif b in self.lead:
                held.append(b)
            else:
                out.append("�")
        return "".join(out), bytes(held)


class Decoder:
    """Token streams to text. `clean` maps tokens that are whole characters, met between characters."""

    def __init__(self, ranks: dict[bytes, int]):
        self.utf8 = Utf8Machine()
        self.bytes = {str(r): w for w, r in ranks.items()}
        self.clean: dict[str, str] = {}
        for t, w in self.bytes.items():
            text, pending = self.utf8.step(b"", w)
            if not pending and "�" not in text:
                self.clean[t] = text
        self.steps: dict[tuple[bytes, str], tuple[str, bytes]] = {}

    def feed(self, pending: bytes, token: str) -> tuple[str, bytes]:
        """One step of the stream: (state, token) -> (text, state)."""
        if not pending and (text := self.clean.get(token)) is not None:
            return text, pending
        found = self.steps.get((pending, token))
        if found is None:
            if len(self.steps) > 200_000:
                self.steps.clear()
            found = self.steps[pending, token] = self.utf8.step(pending, self.bytes[token])
        return found

    def decode(self, tokens: list[str]) -> str:
        out = list(map(self.clean.get, tokens))
        if None not in out:
            return "".join(out)
        pending, text = b"", []
        for known, token in zip(out, tokens):
            if known is None or pending:
                known, pending = self.feed(pending, token)
            text.append(known)
        return "".join(text) + ("�" if pending else "")


def coders(path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> tuple[Encoder, Decoder]:
    """The coders of one rank file, one pair per Python process."""

    def make():
        ranks = read_ranks(path)
        return Encoder(ranks, pattern, max_states, max_pieces), Decoder(ranks)

    return C.resident(("coders", path, pattern, max_states, max_pieces), make)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them."""
    C.prepare(docs.sparkSession)

    def run(batches):
        encoder, decoder = coders(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in C.slices(batches, 1):
            n, ids_sha, text_sha = [], [], []
            for body in batch.column(1):
                ids = encoder.encode(body.as_py().decode("utf-8", "replace"))
                tokens = ids.split(" ") if ids else []
                n.append(len(tokens))
                ids_sha.append(sha(ids.encode()))
                text_sha.append(sha(decoder.decode(tokens).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.arrow_map(docs.select(F.col(id_col).alias("doc_id"), C.text_bytes(text_col)), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc_id, n_tokens, the token ids of every text, and whether they decode to the same text.

    max_states, max_pieces: how much a worker remembers; less takes less memory and more time.
    """
    C.prepare(docs.sparkSession)

    def run(batches):
        encoder, decoder = coders(path, pattern, max_states, max_pieces)
        for batch in C.slices(batches, 1, 2 << 20):
            flat, counts, same = [], [], []
            for body in batch.column(1):
                text = body.as_py().decode("utf-8", "replace")
                tokens = encoder.encode(text).split()
                same.append(decoder.decode(tokens) == text)
                flat.append(np.array(tokens, dtype=np.int32))
                counts.append(len(tokens))
            columns = [pa.array(counts, pa.int64()), C.list_array(np.concatenate(flat), np.array(counts), pa.int32()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return C.arrow_map(docs.select(F.col(id_col).alias("doc_id"), C.text_bytes(text_col)), run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of token ids; null ids are no tokens."""
    C.prepare(encoded.sparkSession)

    def run(batches):
        _, decoder = coders(path, pattern)
        for batch in batches:
            texts = [decoder.decode([str(t) for t in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return C.arrow_map(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")
