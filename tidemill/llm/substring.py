"""Substring deduplication over a compacted de Bruijn graph of word k-mers.

An edge of the graph is a window of 13 consecutive words; it leads from the node of its first
12 words to the node of its last 12. Only edges that occur in several documents matter, and the
graph is built of these alone.

1. Which edges repeat. Texts are dealt to blocks of bounded size. Consecutive windows of a text
   that share a minimiser (the smallest hashed 6-word run inside the window) form a piece, and
   equal windows always have equal minimisers; so a block reports the minimisers of its pieces,
   each once, with the smallest document and a fingerprint of the piece's windows. Reports are
   joined in a tree: FAN blocks at a time, then FAN of these, each level with finer parts, so
   no task grows with the corpus, even if a passage is in every block. Where all fingerprints of
   a minimiser agree the piece is one chain of edges; where they differ, paths branch inside it,
   and its windows are reported and joined in the same way, one by one. The smallest document
   that has a repeated edge or chain is its source.
2. Compaction. A source's block reports the nodes between its repeated edges, with the edges that
   enter and leave them; the joined reports tell which nodes branch, that is, have two different
   repeated edges on one side. Edges that follow each other in their source are compacted into
   one path where the node between them does not branch.
3. Verification. A block gets the words of the paths of the sources it shares edges with, and
   their source coordinates. A window of a text is a repeat if its words are those that stand at
   these coordinates in a smaller document; consecutive ones are compared as one span, word by
   word.

Words are the runs of non-white-space bytes, unchanged.

Defined cases: null or wordless text keeps nothing and loses nothing; texts under 13 words
lose nothing; rows with one doc_id count as one document; a null doc_id is neither a source
nor ever shortened; repeats inside one document alone stay; equal rows each stay a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import common as C

WINDOW = 13
MINIMISER = 6
BLOCK_BYTES = 4 << 20
#: Reports that meet in one task, and parts that a block's report is dealt to; each level of the tree has FAN times as many.
FAN, PARTS = 512, 64


class Windows:
    """Window hashes, nodes, piece names and piece fingerprints of texts; one per Python process."""

    def __init__(self, window: int, run: int):
        self.k, self.m = window, run
        self.hasher = C.WordHasher(C.WHITE)
        self.edge, self.name, self.twin, self.node = (C.odd_constants(n, seed) for n, seed in ((window, 31), (run, 37), (window, 41), (window - 1, 43)))

    def _hash(self, words: np.ndarray, factors: np.ndarray) -> np.ndarray:
        n = len(words) - len(factors) + 1
        out = np.zeros(n, dtype=np.uint64)
        for j, f in enumerate(factors):
            out += words[j : j + n] * f
        return C.mix64(out)

    def twins(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Independent second hashes of the windows at some starts."""
        out = np.zeros(len(starts), dtype=np.uint64)
        for j, f in enumerate(self.twin):
            out += C.mix64(words[starts + j] ^ f)
            out *= f
        return C.mix64(out)

    def nodes(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The nodes whose words begin at some starts."""
        out = np.zeros(len(starts), dtype=np.uint64)
        for j, f in enumerate(self.node):
            out += words[starts + j] * f
        return C.mix64(out)

    def edges(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The window hashes of each text."""
        for _, words, first in self.hasher.many(texts):
            own = self._hash(words, self.edge) if len(words) >= self.k else words[:0]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                yield own[a : max(a, b - self.k + 1)]

    def of(self, texts: list[bytes]):
        """For each text: word hashes, window hashes, and the piece name of each window."""
        none = np.zeros(0, dtype=np.uint64)
        for _, words, first in self.hasher.many(texts):
            if len(words) >= self.k:
                edges = self._hash(words, self.edge)
                names = self._hash(words, self.name)
                span, width = self.k - self.m + 1, 1
                while width < span:  # running minimum over `span` runs
                    step = min(width, span - width)
                    names = np.minimum(names[:-step], names[step:])
                    width += step
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                yield (words[a:b], edges[a : b - self.k + 1], names[a : b - self.k + 1]) if b - a >= self.k else (words[a:b], none, none)


def _windows(window: int, run: int) -> Windows:
    return C.resident(("windows", window, run), lambda: Windows(window, run))


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, dtype=np.int64)


def pieces(edges: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the pieces of one text, and a fingerprint of each piece's window sequence."""
    starts = _groups(names)
    sizes = np.diff(np.append(starts, len(edges)))
    place = np.arange(len(edges), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    return starts, sizes, np.add.reduceat(C.mix64(edges ^ (place * np.uint64(0x9E3779B97F4A7C15))), starts)


# --- reports and answers, packed -----------------------------------------------------------------

#: One report: the part of the keys, the block (or, higher in the tree, the group of blocks), and its columns as raw arrays.
_REPORT = "part long, block long, keys binary, marks binary, docs binary, which binary, flags binary"
_ANSWER = "part long, block long, keys binary, marks binary, docs binary, which binary, kinds binary"
_EMPTY = {"part": pa.int64(), "block": pa.int64()}
SEVERAL_DOCS, SEVERAL_MARKS = 1, 2
#: Of an answer: paths branch inside the piece; the block has the key in other documents than its source.
BRANCHES, ELSEWHERE = 1, 2


def short(hashes: np.ndarray) -> np.ndarray:
    """Keys and marks are the upper 48 bits of hashes: they only propose, and two of them together name a window."""
    return hashes >> np.uint64(16)


def _bytes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _numbers(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _table(rows, names: str) -> pa.Table:
    rows = list(rows)
    columns = [c.strip().split()[0] for c in names.split(",")]
    return pa.table([pa.array([r[i] for r in rows], _EMPTY.get(n, pa.binary())) for i, n in enumerate(columns)], names=columns)


def _packed_docs(docs: np.ndarray) -> tuple[bytes, bytes]:
    """Some documents as a table of the different ones (the first, then steps) and the place of each in it."""
    table, which = np.unique(docs, return_inverse=True)
    steps = np.diff(table.view(np.uint64))
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or int(steps.max()) < 1 << (8 * w))
    return table[:1].tobytes() + steps.astype(f"<u{width}").tobytes(), which.astype(np.uint16 if len(table) < 1 << 16 else np.uint32).tobytes()


def _docs(table: bytes, which: bytes, n: int) -> np.ndarray:
    """The n documents of _packed_docs()."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    at = np.frombuffer(which, dtype=np.uint16 if len(which) == 2 * n else np.uint32)
    different = int(at.max()) + 1
    width = (len(table) - 8) // max(1, different - 1) or 1
    first, steps = np.frombuffer(table[:8], dtype=np.uint64), np.frombuffer(table[8:], dtype=f"<u{width}")
    return np.concatenate((first, first + np.cumsum(steps, dtype=np.uint64))).view(np.int64)[at]


def _order(keys: np.ndarray, marks: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order, and the starts of groups in it: by key, for single windows by key and mark."""
    if not single:
        order = np.argsort(keys, kind="stable")
        return order, _groups(keys[order])
    order = np.lexsort((marks, keys))
    k, m = keys[order], marks[order]
    return order, np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])))) if len(k) else np.zeros(0, dtype=np.int64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


def _summed(keys, docs, marks, flags, single: bool):
    """Every key once, with its smallest document and mark; flags say if it has several documents or marks."""
    order, at = _order(keys, marks, single)
    keys, docs, marks, flags = keys[order], docs[order], marks[order], flags[order]
    if not len(at):
        return keys, docs, marks, flags
    low, least = np.minimum.reduceat(docs, at), np.minimum.reduceat(marks, at)
    either = np.bitwise_or.reduceat(flags, at)
    either |= (low != np.maximum.reduceat(docs, at)).astype(np.uint8) * np.uint8(SEVERAL_DOCS)
    either |= (least != np.maximum.reduceat(marks, at)).astype(np.uint8) * np.uint8(SEVERAL_MARKS)
    return keys[at], low, least, either


def _reports(block: int, parts: int, keys, docs, marks, flags, single: bool):
    """Rows for _REPORT, a row for each part."""
    keys, docs, marks, flags = _summed(keys, docs, marks, flags, single)
    part = _part(keys, parts)
    order = np.argsort(part, kind="stable")
    bounds = np.append(_groups(part[order]), len(order)).astype(np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        i = order[a:b]
        yield int(part[i[0]]), block, _bytes(keys[i]), _bytes(marks[i]), *_packed_docs(docs[i]), flags[i].tobytes()


def _unpacked(table: pa.Table):
    """Keys, documents, marks and flags of all reports of a table, and the number of keys of each."""
    c = {n: table[n].to_pylist() for n in ("keys", "marks", "docs", "which", "flags")}
    sizes = [len(x) // 6 for x in c["keys"]]
    docs = [_docs(*x) for x in zip(c["docs"], c["which"], sizes)]
    return _numbers(c["keys"]), np.concatenate(docs), _numbers(c["marks"]), np.frombuffer(b"".join(c["flags"]), dtype=np.uint8), np.array(sizes)


def _combine(table: pa.Table, parts: int, fan: int, single: bool) -> pa.Table:
    """The reports of FAN blocks and one part as one, dealt to finer parts."""
    keys, docs, marks, flags, _ = _unpacked(table)
    return _table(_reports(table["block"][0].as_py() // fan, parts, keys, docs, marks, flags, single), _REPORT)


def _answer(table: pa.Table, keys, marks, docs, kinds, single: bool) -> pa.Table:
    """The reports of a table, cut down to the keys asked for (sorted), with their sources; marks only for single windows."""
    own_keys, own_docs, own_marks, flags, sizes = _unpacked(table)
    at, hit = Finder(keys, marks if single else None).find(own_keys, own_marks)
    ends = np.cumsum(sizes)
    rows = []
    for part, block, end, size in zip(table["part"].to_pylist(), table["block"].to_pylist(), ends.tolist(), sizes.tolist()):
        own = np.flatnonzero(hit[end - size : end]) + end - size
        if len(own):
            mine = at[own]
            elsewhere = (own_docs[own] != docs[mine]) | (flags[own] & SEVERAL_DOCS > 0)
            kind = (kinds[mine] & BRANCHES) | elsewhere.astype(np.uint8) * np.uint8(ELSEWHERE)
            rows.append((part, block, _bytes(keys[mine]), _bytes(marks[mine]) if single else b"", *_packed_docs(docs[mine]), kind.tobytes()))
    return _table(rows, _ANSWER)


def _meet(table: pa.Table, single: bool, wanted: int) -> pa.Table:
    """All reports of one part, at the top of the tree: answers to those that hold keys with the wanted flag."""
    keys, docs, marks, flags, _ = _unpacked(table)
    keys, low, marks, flags = _summed(keys, docs, marks, flags, single)
    keep = flags & wanted > 0
    kinds = (flags & SEVERAL_MARKS > 0).astype(np.uint8) * np.uint8(BRANCHES)
    return _answer(table, keys[keep], marks[keep], low[keep], kinds[keep], single)


def _hand_down(table: pa.Table, answers: pa.Table, single: bool) -> pa.Table:
    """Answers to a group of blocks, handed on to its blocks."""
    if not answers.num_rows or not table.num_rows:
        return _table([], _ANSWER)
    return _answer(table, *_known(answers, single), single)


def _known(answers: pa.Table, single: bool):
    """Keys, marks (of single windows), sources and kinds of all answers of a table, by key and mark."""
    c = {n: answers[n].to_pylist() for n in ("keys", "marks", "docs", "which", "kinds")}
    keys, marks, kinds = _numbers(c["keys"]), _numbers(c["marks"]), np.frombuffer(b"".join(c["kinds"]), dtype=np.uint8)
    docs = np.concatenate([np.zeros(0, dtype=np.int64), *(_docs(t, w, len(k) // 6) for t, w, k in zip(c["docs"], c["which"], c["keys"]))])
    order = np.lexsort((marks, keys)) if single else np.argsort(keys, kind="stable")
    return keys[order], marks[order] if single else marks, docs[order], kinds[order]


class Finder:
    """Where keys stand among known ones; with marks, where pairs of key and mark do."""

    def __init__(self, keys: np.ndarray, marks: np.ndarray | None = None):
        self.keys, self.marks = keys, marks
        names = keys if marks is None else C.mix64(keys ^ C.mix64(marks))
        self.order = np.argsort(names, kind="stable")
        self.names = names[self.order]

    def find(self, keys: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of each wanted key, and whether it is there."""
        if not len(self.names):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        wanted = keys if self.marks is None else C.mix64(keys ^ C.mix64(marks))
        at = self.order[np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)]
        return at, (self.keys[at] == keys) if self.marks is None else (self.keys[at] == keys) & (self.marks[at] == marks)


def joined(reports: DataFrame, blocks: int, single: bool = False, wanted: int = SEVERAL_DOCS) -> DataFrame:
    """Answers (block, keys, marks, docs: the smallest, kinds) to the blocks that hold keys with the wanted flag."""
    levels, parts = [(reports, PARTS)], PARTS
    group = F.floor(F.col("block") / F.lit(FAN))
    while blocks > FAN:
        up = lambda t, parts=parts * FAN: _combine(t, parts, FAN, single)
        below, parts = levels[-1][0], parts * FAN
        levels.append((below.groupBy("part", group).applyInArrow(C.arrow_groups(up, __name__), _REPORT), parts))
        blocks = -(-blocks // FAN)
    out = levels[-1][0].groupBy("part").applyInArrow(C.arrow_groups(lambda t: _meet(t, single, wanted), __name__), _ANSWER)
    for below, parts in reversed(levels[:-1]):
        down = C.arrow_cogroups(lambda t, a: _hand_down(t, a, single), __name__)
        out = below.groupBy("part", group).cogroup(out.groupBy(F.pmod("part", F.lit(parts)), "block")).applyInArrow(down, _ANSWER)
    return out.drop("part")


# --- texts ------------------------------------------------------------------------------------------

#: A run of repeated edges in their source: where it begins, its words, and at which windows of it another edge begins, with the nodes there.
_RUN = "block long, doc long, pos int, words binary, cuts binary, nodes binary"
_PATH = "doc long, pos binary, words binary"
#: Nodes that edges enter are told apart from nodes that edges leave.
ENTERED = np.uint64(0xD1B54A32D192ED03)


def _bodies(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table["body"].to_pylist()]


def _piece_report(table: pa.Table, w: Windows) -> pa.Table:
    """Step 1: the pieces of one block."""
    found = []
    for doc, (_, edges, names) in zip(table["doc"].to_pylist(), w.of(_bodies(table))):
        if len(edges) and doc is not None:
            starts, _, mark = pieces(edges, names)
            found.append((short(names[starts]), np.full(len(starts), doc, dtype=np.int64), short(mark)))
    if not found:
        return _table([], _REPORT)
    keys, docs, marks = (np.concatenate(x) for x in zip(*found))
    return _table(_reports(table["block"][0].as_py(), PARTS, keys, docs, marks, np.zeros(len(keys), dtype=np.uint8), False), _REPORT)


def _window_report(table: pa.Table, answers: pa.Table, w: Windows) -> pa.Table:
    """Step 1: the windows of one block's branching pieces."""
    if not table.num_rows or not answers.num_rows:
        return _table([], _REPORT)
    keys, _, _, kinds = _known(answers, False)
    branching = Finder(keys[kinds & BRANCHES > 0])
    found = []
    for doc, (words, edges, names) in zip(table["doc"].to_pylist(), w.of(_bodies(table))):
        if len(edges) and doc is not None and len(branching.keys):
            starts = np.flatnonzero(branching.find(short(names))[1])
            found.append((short(edges[starts]), np.full(len(starts), doc, dtype=np.int64), short(w.twins(words, starts))))
    if not sum(len(x[0]) for x in found):
        return _table([], _REPORT)
    keys, docs, marks = (np.concatenate(x) for x in zip(*found))
    return _table(_reports(table["block"][0].as_py(), PARTS, keys, docs, marks, np.zeros(len(keys), dtype=np.uint8), True), _REPORT)


def _source_runs(table: pa.Table, answers: pa.Table, w: Windows):
    """For each text that is a source: its document, words, word hashes, window hashes, owned windows, and where its owned edges begin and how many windows they have."""
    if not table.num_rows or not answers.num_rows:
        return
    kind = np.array(answers["single"].to_pylist(), dtype=bool)
    chain, _, chain_doc, how = _known(answers.filter(pa.array(~kind)), False)
    chain, chain_doc = chain[how & BRANCHES == 0], chain_doc[how & BRANCHES == 0]
    single, single_mark, single_doc, _ = _known(answers.filter(pa.array(kind)), True)
    chains, ones, maybe = Finder(chain), Finder(single, single_mark), Finder(np.unique(single))
    sources = set(chain_doc.tolist()) | set(single_doc.tolist())
    some = [(doc, body) for doc, body in zip(table["doc"].to_pylist(), _bodies(table)) if doc in sources]
    for (doc, body), (words, edges, names) in zip(some, w.of([b for _, b in some])):
        if not len(edges):
            continue
        starts, sizes, _ = pieces(edges, names)
        at, hit = chains.find(short(names[starts]))
        if len(chain):
            hit &= chain_doc[at] == doc
        one = np.flatnonzero(maybe.find(short(edges))[1])
        at, alone = ones.find(short(edges[one]), short(w.twins(words, one)))
        if len(single):
            alone &= single_doc[at] == doc
        begin = np.concatenate((starts[hit], one[alone]))
        size = np.concatenate((sizes[hit], np.ones(int(alone.sum()), dtype=np.int64)))
        order = np.argsort(begin, kind="stable")
        if len(begin):
            yield doc, body, words, edges, begin[order], size[order]


def _node_report(table: pa.Table, answers: pa.Table, w: Windows) -> pa.Table:
    """Step 2: the nodes at both ends of the repeated edges and chains whose source is in this block, with the edge that leaves or enters."""
    found = []
    for _, _, words, edges, begin, size in _source_runs(table, answers, w):
        end = begin + size
        keys = np.concatenate((w.nodes(words, begin), C.mix64(w.nodes(words, end) ^ ENTERED)))
        found.append((short(keys), short(np.concatenate((edges[begin], edges[end - 1])))))
    if not found:
        return _table([], _REPORT)
    keys, marks = (np.concatenate(x) for x in zip(*found))
    return _table(_reports(table["block"][0].as_py(), PARTS, keys, np.zeros(len(keys), dtype=np.int64), marks, np.zeros(len(keys), dtype=np.uint8), False), _REPORT)


def _runs(table: pa.Table, answers: pa.Table, w: Windows) -> pa.Table:
    """Step 2: the runs of repeated edges and chains whose source is in this block."""
    rows = []
    for doc, body, words, _, begin, size in _source_runs(table, answers, w):
        text = body.split()
        new = np.concatenate(([True], begin[1:] != begin[:-1] + size[:-1]))
        heads = np.flatnonzero(new)
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(begin)).tolist()):
            pos, end = int(begin[a]), int(begin[b - 1] + size[b - 1])
            cuts = begin[a + 1 : b]
            rows.append((table["block"][0].as_py(), doc, pos, b" ".join(text[pos : end + w.k - 1]), (cuts - pos).astype(np.int32).tobytes(), w.nodes(words, cuts).tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _RUN.split(", ")])


def _compact(runs: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    """Step 2: the runs of a block as paths, cut where their nodes branch; all paths of a document in one row, one a line."""
    branching = Finder(_known(answers, False)[0])
    found: dict[int, tuple[list[int], list[bytes]]] = {}
    for doc, pos, words, cuts, nodes in zip(*(runs[c].to_pylist() for c in ("doc", "pos", "words", "cuts", "nodes"))):
        nodes = np.frombuffer(nodes, dtype=np.uint64)
        branch = branching.find(short(nodes))[1] | branching.find(short(C.mix64(nodes ^ ENTERED)))[1]
        at = np.frombuffer(cuts, dtype=np.int32)[branch].tolist()
        places, texts = found.setdefault(doc, ([], []))
        if not at:
            places.append(pos)
            texts.append(words)
            continue
        text = words.split(b" ")
        for a, b in zip([0, *at], [*at, len(text) - window + 1]):
            places.append(pos + a)
            texts.append(b" ".join(text[a : b + window - 1]))
    columns = list(found), [np.array(p, dtype=np.int32).tobytes() for p, _ in found.values()], [b"\n".join(t) for _, t in found.values()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["doc", "pos", "words"])


def _spans(paths: pa.Table, w: Windows):
    """A function from (document, words, window hashes) to the spans (start, windows, source, source's start) that stand in paths of smaller documents."""
    begins = [np.frombuffer(p, dtype=np.int32) for p in paths["pos"].to_pylist()]
    docs = np.repeat(np.array(paths["doc"].to_pylist(), dtype=np.int64), [len(p) for p in begins])
    begins = np.concatenate([np.zeros(0, dtype=np.int32), *begins])
    texts = [t for joined_ in paths["words"].to_pylist() for t in joined_.split(b"\n")]
    found = list(w.edges(texts))
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    edges = np.concatenate([*found, np.zeros(0, dtype=np.uint64)])
    which = np.repeat(np.arange(len(found)), sizes)
    offset = np.arange(len(edges)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((offset, docs[which] if len(which) else which, edges))
    edges, which, offset = edges[order], which[order], offset[order]
    split: dict[int, list[bytes]] = {}

    def run(doc: int, words: list[bytes], own: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not len(edges):
            return []
        at = np.minimum(np.searchsorted(edges, own), len(edges) - 1)
        hit = np.flatnonzero((edges[at] == own) & (docs[which[at]] < doc))
        if not len(hit):
            return []
        path, place = which[at[hit]], offset[at[hit]]
        new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (path[1:] != path[:-1]) | (place[1:] != place[:-1] + 1)))
        starts = np.flatnonzero(new)
        out = []
        for s, size in zip(starts.tolist(), np.diff(np.append(starts, len(hit))).tolist()):
            p, i, o = int(path[s]), int(hit[s]), int(place[s])
            theirs = split.get(p)
            if theirs is None:
                theirs = split[p] = texts[p].split(b" ")
            k = w.k - 1
            if words[i : i + size + k] == theirs[o : o + size + k]:
                out.append((i, size, int(docs[p]), int(begins[p]) + o))
            else:  # a hash has misled: window by window
                out += [(i + x, 1, int(docs[p]), int(begins[p]) + o + x) for x in range(size) if words[i + x : i + x + w.k] == theirs[o + x : o + x + w.k]]
        return out

    return run


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPANS = "doc_id long, start int, length int, source_id long, source_start int"


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = MINIMISER, digest: bool = False, spans: bool = False,
) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Returns the columns of `docs` with the text shortened (kept words joined by one space; a
    text that loses nothing stays as it is). With digest=True returns doc_id, n_words,
    n_removed and kept_sha256 instead; with spans=True the verified spans, in words: doc_id,
    start, length, source_id and source_start (a span that covers several paths is several rows).
    """
    spark = docs.sparkSession
    C.prepare(spark)
    names = docs.columns
    size = docs.select(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))).first()[0] or 0
    parts = max(C.parts(spark), -(-size // (8 * BLOCK_BYTES)))
    blocks = max(2 * parts, -(-size // BLOCK_BYTES))
    short = digest or spans
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)] if not short else [F.col(f"`{id_col}`").alias("c0"), F.col(f"`{text_col}`").alias("c1")]
    at_text = names.index(text_col) if not short else 1
    # The number of the input partition spreads rows that are equal in all, without regard to their order.
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(blocks))
    dealt = docs.select(
        place.alias("block"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("body"), *[c for i, c in enumerate(carried) if i != at_text],
    ).repartition(parts, "block")
    others = [c for c in dealt.columns if c not in ("block", "doc", "body")]
    schema = DIGEST if digest else SPANS if spans else StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    w = lambda: _windows(window, run)

    def finish(table: pa.Table, paths: pa.Table) -> pa.Table:
        """Step 3: the texts of one block without their repeats."""
        spans_of = _spans(paths, w())
        bodies = _bodies(table)
        counts, gone, kept, rows = [], [], [], []
        for doc, body, edges in zip(table["doc"].to_pylist(), bodies, w().edges(bodies)):
            words = body.split() if len(edges) or short else []
            found = spans_of(doc, words, edges) if len(edges) and doc is not None else []
            cover = np.zeros(len(words), dtype=bool)
            for i, n, source, start in found:
                cover[i : i + n + window - 1] = True
                rows.append((doc, i, n + window - 1, source, start))
            counts.append(len(words))
            gone.append(int(cover.sum()))
            if found:
                kept.append(b" ".join(compress(words, (~cover).tolist())))
            else:
                kept.append(b" ".join(words) if digest else body)
        if spans:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.strip().split()[0] for c in SPANS.split(",")])
        if digest:
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            return pa.table([table["c0"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        null = table["body"].is_null().to_pylist()
        columns = [table[c] for c in others]
        columns.insert(at_text, pa.array([None if x else t.decode("utf-8", "replace") for x, t in zip(null, kept)], pa.string()))
        return pa.table(columns, names=[f"c{i}" for i in range(len(columns))])

    def with_blocks(f, answers: DataFrame, out) -> DataFrame:
        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(C.arrow_cogroups(f, __name__), out)

    # One job: the dealt texts, the reports and the answers are shuffled once each and read again.
    chains = joined(dealt.groupBy("block").applyInArrow(C.arrow_groups(lambda t: _piece_report(t, w()), __name__), _REPORT), blocks)
    ones = joined(with_blocks(lambda t, a: _window_report(t, a, w()), chains, _REPORT), blocks, single=True)
    answers = chains.withColumn("single", F.lit(False)).union(ones.withColumn("single", F.lit(True))).repartition(parts, "block")
    branching = joined(with_blocks(lambda t, a: _node_report(t, a, w()), answers, _REPORT), blocks, wanted=SEVERAL_MARKS)
    runs = with_blocks(lambda t, a: _runs(t, a, w()), answers, _RUN)
    paths = runs.groupBy("block").cogroup(branching.groupBy("block")).applyInArrow(C.arrow_cogroups(lambda r, a: _compact(r, a, window), __name__), _PATH)
    shared = C.arrow_map(answers.select("block", "docs", "which", "kinds"), _sources, "block long, doc long").distinct()
    sent = shared.join(paths, "doc").select(F.col("block").alias("block"), "doc", "pos", "words")
    done = with_blocks(finish, sent, schema)
    return done if short else done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _sources(batches):
    """The documents that are sources of what each block has in others too."""
    for batch in batches:
        for block, docs, which, kinds in zip(*(c.to_pylist() for c in batch.columns)):
            found = np.unique(_docs(docs, which, len(kinds))[np.frombuffer(kinds, dtype=np.uint8) == ELSEWHERE])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, dtype=np.int64)), pa.array(found)], names=["block", "doc"])
