"""Operators on texts against brute force, with nulls, empty and very long texts, ties and repeats."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import bpe, common, decontam, minhash, sharding, substring, token_count

WORDS = "the of and to in that is was for on with as by at from or an be this which".split()
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, score string, n_words string"  # clashing names too


def corpus(seed, n=60):
    """Texts with copies, near copies, shared passages, nulls, blanks and one very long text."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(30) for _ in range(3)]
    out = [None, "", " \n ", "one two", "One  TWO", "x" * 5000]
    for _ in range(n):
        k = rng.random()
        if k < 0.25 and len(out) > 8:
            t = rng.choice([x for x in out if x and len(x) > 50] or [text(40)])
            w = t.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        elif k < 0.5:
            out.append(text(rng.randint(0, 30)) + " " + rng.choice(shared) + "\n" + text(rng.randint(0, 30)))
        else:
            out.append(text(rng.randint(1, 80)))
    out.append(" ".join(word() for _ in range(120_000)))
    return [(i * 3 % 97 if i < 97 else i, t) for i, t in enumerate(out)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "s", "w") for i, t in rows], SCHEMA).repartition(parts)


def blank_words(text, lower=False):
    b = (text or "").encode()
    if lower:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    return re.findall(rb"[^\x20\x09-\x0D]+", b)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"aB  \n\xc3\xa9") for _ in range(rng.randint(0, 300))) for _ in range(40)] + [b"x" * 900, b"x" * 900 + b" y"]
    whole = common.WordHasher(common.WHITE, common.LOWER)
    monkeypatch.setattr(common.WordHasher, "PIECE", 37)
    small = common.WordHasher(common.WHITE, common.LOWER)
    seen = {}
    for i, h, first in small.many(texts):
        for k in range(len(first) - 1):
            t = texts[i + k]
            assert h[first[k] : first[k + 1]].tolist() == whole.one(t).tolist()
            for w, x in zip(re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t)), h[first[k] : first[k + 1]].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    sets = {}
    for i, t in rows:
        w = blank_words(t, True)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    kept = minhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "n_words"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if root(i) == i)


def test_near_duplicates_tiles(spark, monkeypatch):
    """A large cluster is cut into tiles and still linked as a whole."""
    monkeypatch.setattr(minhash, "TILE_DOCS", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"v{i}"] + base[100:])) for i in range(30)] + [(100, " ".join(base))]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_a_chain_of_near_copies_costs_its_length(spark, monkeypatch):
    """Each text is linked with the next ones only; the copied sets grow with the chain, not with its square."""
    copied = {}
    for n in (150, 300):
        words = [f"w{i}" for i in range(60 + 2 * n)]
        rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(n)]  # neighbours have 54 of 58 shingles in common
        copied[n] = 0

        def counted(rows_, percent, f, n=n):
            copied[n] += rows_.count()
            return f(rows_, percent)

        for name in ("linked_to_first", "linked_across"):
            real = getattr(minhash, name)
            monkeypatch.setattr(minhash, name, lambda r, p, f=real: counted(r, p, f))
        got = minhash.near_duplicates(frame(spark, rows)).collect()
        assert {r.component_id for r in got} == {0} and len(got) == n
        monkeypatch.undo()
    assert copied[300] < 3 * copied[150]


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    """The way beyond small tables, with hot keys and without."""
    rows = corpus(1, 30) + [(5000 + i, "a copy that is met " * 5) for i in range(40)]
    want = sorted(minhash.near_duplicates(frame(spark, rows)).collect())
    for hot in (5, 10**9):
        monkeypatch.setattr(common, "SMALL", 0)
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(minhash.near_duplicates(frame(spark, rows)).collect()) == want
        monkeypatch.undo()


def test_hot_join(spark, monkeypatch):
    left = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (3, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, "one", 50), (2, "two", 1), (4, "four", 0)], "k int, y string, n int")
    for small in (0, 100):
        monkeypatch.setattr(common, "SMALL", small)
        monkeypatch.setattr(common, "HOT", 10)
        for how in ("inner", "left", "left_anti"):
            got = common.hot_join(left, right, "k", "n", left.count, how)
            plain = left.join(right.drop("n"), "k", how)
            assert sorted(got.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)


def test_components_of_a_star_and_a_chain(spark, monkeypatch):
    from tidemill.llm import graph

    edges = [(900, i) for i in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    for small in (0, 100_000):
        monkeypatch.setattr(common, "SMALL", small)
        common.prepare(spark)
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {**{i: 0 for i in range(200)}, 900: 0, **{i: 1000 for i in range(1000, 1041)}}


def test_recall_of_bands():
    """Pairs just over the limits, also of short documents: how many share no band."""
    s = minhash.Sketcher()
    rng = np.random.default_rng(5)
    missed = {}
    for low, n, common_ in [(0.85, 300, 276), (0.85, 20, 19), (0.85, 100, 92), (0.80, 90, 80), (0.80, 18, 16)]:
        lost = 0
        for _ in range(400):
            pool = rng.integers(0, 1 << 63, 2 * n - common_, dtype=np.uint64)
            pair = np.array([s.signature(pool[:n]), s.signature(pool[n - common_ :])])
            assert common_ / (2 * n - common_) >= low
            lost += not np.intersect1d(*s.band_keys(pair)).size
        missed[low, n] = lost
    assert all(v == 0 for (low, _), v in missed.items() if low == 0.85) and all(v <= 1 for v in missed.values()), missed


def test_columns_may_have_any_name(spark):
    copy = "a b c d e f g h i j k l m n o p q r s t u v w x"
    rows = spark.createDataFrame([(1, copy, 5, 6, 7, 8), (2, copy, 5, 6, 7, 8), (3, "of its own", 1, 2, 3, 4)], "doc_id long, text string, _key int, _row int, c1 int, `a.b` int")
    bench = spark.createDataFrame([(1, copy)], "item_id long, text string")
    for got, ids in ((minhash.drop_near_duplicates(rows), [1, 3]), (substring.drop_repeats(rows), [1, 2, 3]), (decontam.drop_contaminated(rows, bench), [3])):
        assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == ids


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (7, 7, True), (None, 5, False), (None, None, True)]
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_pipeline_stage_links_at_80_percent(spark):
    """The stage against brute force, with pairs at 0.80 exactly, just under it, and between 0.80 and 0.85."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for n, off in [(36, 4), (36, 4), (35, 4), (38, 4), (42, 4), (30, 1), (50, 6)] * 3:
        base = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n + 4)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: n + 4 - off] + [f"z{len(rows)}y{k}" for k in range(off)]))]
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(corpus(3)[:40])]
    sets = {}
    for i, t in rows:
        w = blank_words(t, True)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    link = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]]
    assert sum(0.8 <= j < 0.85 for _, _, j in link) >= 6 and any(0.75 < j < 0.8 for _, _, j in link)
    root = {i: i for i in sets}
    for _ in sets:
        for a, b, j in link:
            if j >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    got = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i in sets if root[i] == i)


def test_near_duplicates_are_dropped_by_row(spark):
    copy = "a b c d e f g h i j k l m n o p q r s t u v w x"
    rows = [
        (1, copy), (None, copy), (None, "only one without an id here"), (None, "another one without any id"),
        (9, copy), (9, "shares its id but not its text with a copy"), (9, "shares its id but not its text with a copy"),
        (4, "two rows of one id and one set"), (4, "Two rows of ONE id and one set"),
        (None, "three copies that all lack an id"), (None, "Three copies that all lack an id"), (None, "three copies that all lack an id"),
        (None, None), (None, None), (1, " "),
    ]
    got = [(r.doc_id, (r.text or "").lower()) for r in minhash.drop_near_duplicates(frame(spark, rows)).collect()]
    want = [rows[k] for k in (0, 2, 3, 5, 7, 9)] + [(None, ""), (None, ""), (1, " ")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert minhash.drop_near_duplicates(frame(spark, rows)).columns == ["doc_id", "text", "score", "n_words"]
    assert minhash.drop_near_duplicates(frame(spark, rows).limit(0)).collect() == []


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = blank_words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in rows:
        w = blank_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out[i] = (w, gone)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    expected = brute_repeats(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.drop_repeats(frame(spark, rows), digest=True).collect()}
    keep = {i: b" ".join(x for x, g in zip(w, gone) if not g) for i, (w, gone) in expected.items()}
    assert got == {i: (len(w), sum(gone), hashlib.sha256(keep[i]).hexdigest()) for i, (w, gone) in expected.items()}
    texts = {r.doc_id: r.text for r in substring.drop_repeats(frame(spark, rows)).collect()}
    original = dict(rows)
    assert texts == {i: keep[i].decode() if any(gone) else original[i] for i, (w, gone) in expected.items()}


def test_substring_dedup_in_a_tree_of_reports(spark, monkeypatch):
    """Two reports meet at a time, so the tree has several levels; one passage is in every block."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 50)}" for _ in range(30)) + " " + passage) for i in range(40)] + corpus(7, 20)[:30]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    expected = brute_repeats(rows)
    monkeypatch.setattr(substring, "FAN", 2)
    got = {r.doc_id: r.n_removed for r in substring.drop_repeats(frame(spark, rows), digest=True).collect()}
    assert got == {i: sum(gone) for i, (_, gone) in expected.items()}


def test_spans_stand_at_their_source(spark):
    """Each span's words are those at the source's coordinates, and the spans cover what is removed."""
    rows = corpus(3)
    words = {i: blank_words(t) for i, t in rows}
    cover = {i: set() for i, _ in rows}
    for r in substring.drop_repeats(frame(spark, rows), spans=True).collect():
        assert r.source_id < r.doc_id and r.length >= 13
        assert words[r.doc_id][r.start : r.start + r.length] == words[r.source_id][r.source_start : r.source_start + r.length]
        cover[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert cover == {i: {k for k, g in enumerate(gone) if g} for i, (_, gone) in brute_repeats(rows).items()}


def test_paths_end_where_they_branch():
    """Runs of repeated edges are one path up to a node that another repeated edge leaves."""
    import pyarrow as pa

    w = substring.Windows(13, 6)
    text = [b"w%d" % i for i in range(30)]
    hashes, _ = w.hasher.placed(b" ".join(text))
    cuts = np.array([5, 9], dtype=np.int32)
    nodes = w.nodes(hashes, cuts.astype(np.int64))
    runs = pa.table({"doc": [4], "pos": [100], "words": [b" ".join(text)], "cuts": [cuts.tobytes()], "nodes": [nodes.tobytes()]})
    places = lambda *at: np.array(at, dtype=np.int32).tobytes()

    def answer(keys):
        docs, which = substring._packed_docs(np.zeros(len(keys), dtype=np.int64))
        return pa.table({"keys": [substring._bytes(substring.short(np.array(keys, dtype=np.uint64)))], "marks": [b""], "docs": [docs], "which": [which], "kinds": [np.zeros(len(keys), dtype=np.uint8).tobytes()]})

    whole = substring._compact(runs, answer([1, 2]), 13).to_pylist()
    assert whole == [{"doc": 4, "pos": places(100), "words": b" ".join(text)}]
    for branching in (nodes[1:], common.mix64(nodes[1:] ^ substring.ENTERED)):
        cut = substring._compact(runs, answer(branching), 13).to_pylist()
        assert cut == [{"doc": 4, "pos": places(100, 109), "words": b" ".join(text[:21]) + b"\n" + b" ".join(text[9:])}]


def test_packed_documents():
    rng = np.random.default_rng(3)
    for docs in ([5], [-7, 2**63 - 1, -(2**63), 0, 5, 5], rng.integers(0, 300, 50), rng.integers(-(2**62), 2**62, 70_000), rng.integers(0, 10**6, 1000)):
        docs = np.array(docs, dtype=np.int64)
        assert (substring._docs(*substring._packed_docs(docs), len(docs)) == docs).all()
    numbers = substring.short(rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (substring._numbers([substring._bytes(numbers[:3]), substring._bytes(numbers[3:])]) == numbers).all()


def test_words_decide_not_hashes():
    """If hashes mislead, nothing is taken for a repeat that is none."""
    import pyarrow as pa

    class Blind(substring.Windows):
        def edges(self, texts):
            for e in super().edges(texts):
                yield e * np.uint64(0)

    text = [b"w%d" % i for i in range(20)]
    paths = pa.table({"doc": [1], "pos": [np.zeros(1, dtype=np.int32).tobytes()], "words": [b" ".join(text)]})
    blind, seeing = Blind(13, 6), substring.Windows(13, 6)
    other = [b"v%d" % i for i in range(20)]
    assert substring._spans(paths, blind)(2, other, next(blind.edges([b" ".join(other)]))) == []
    assert substring._spans(paths, seeing)(2, other[:3] + text, next(seeing.edges([b" ".join(other[:3] + text)]))) == [(3, 8, 1, 0)]
    assert substring._spans(paths, seeing)(1, text, next(seeing.edges([b" ".join(text)]))) == []


def test_the_largest_doc_id_is_an_id(spark):
    t = " ".join(f"w{i}" for i in range(20))
    got = substring.drop_repeats(frame(spark, [(2**63 - 1, t), (-5, t), (None, t)]), digest=True).collect()
    assert {r.doc_id: r.n_removed for r in got} == {2**63 - 1: 20, -5: 0, None: 0}


def test_substring_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(20))
    rows = [(1, t), (1, t), (None, t), (2, t + " more")]
    got = substring.drop_repeats(frame(spark, rows), digest=True).collect()
    assert sorted(((r.doc_id or 0), r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 20)]
    assert substring.drop_repeats(frame(spark, rows).limit(0), digest=True).collect() == []
    assert substring.drop_repeats(frame(spark, rows).limit(0)).columns == ["doc_id", "text", "score", "n_words"]


def bench_words(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b)


def brute_hits(rows, items):
    windows = {}
    for item, t in items:
        w = bench_words(t)
        if item is not None and w:
            n = min(13, len(w))
            for j in range(len(w) - n + 1):
                windows.setdefault(tuple(w[j : j + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, names = bench_words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    names |= own
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_decontamination(spark, limit, monkeypatch):
    rows = corpus(5)
    long = [t for _, t in rows if t and len(t) > 200][:4]
    items = [(1, long[0][20:150]), (2, "The OF"), (3, None), (4, "..."), (None, long[1]), (5, long[1].upper()), (5, long[1][:100]), (6, "zebra " * 13)]
    monkeypatch.setattr(decontam, "SLICE_BYTES", limit)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.scan(frame(spark, rows), bench).collect()), key=str)
    expected = brute_hits(rows, items)
    assert got == expected
    clean = decontam.drop_contaminated(frame(spark, rows), bench)
    assert clean.columns == ["doc_id", "text", "score", "n_words"]
    assert {(r.doc_id, r.text) for r in clean.collect()} == {(i, dict(rows)[i]) for i, n, h, _ in expected if not (h and 20 * h >= n)}
    assert decontam.scan(frame(spark, rows).limit(0), bench).collect() == []
    none = decontam.scan(frame(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_lists_come_back(spark):
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.choice(1 << rng.integers(4, 31), rng.integers(1, 9), replace=False)) for _ in range(200)] + [np.array([0]), np.array([2**31 - 1])]
    counts = np.array([len(x) for x in lists])
    data, bounds = decontam.pack(np.concatenate(lists).astype(np.int64), np.cumsum(counts) - counts)
    assert bounds[-1] == len(data) and (decontam.unpack(data.tobytes(), counts) == np.concatenate(lists)).all()


def test_index_holds_every_token(spark, tmp_path):
    """All tokens of all texts, not only those that a benchmark asks for, from a stored table."""
    rows = corpus(5, 20)
    table = decontam.index(frame(spark, rows), path=str(tmp_path / "index"))
    docs = table.where("row is not null").collect()
    assert sorted((r.doc_id, r.n) for r in docs) == sorted((i, len(bench_words(t))) for i, t in rows)
    n, = table.where("term is not null").agg(F.sum("n")).first()
    assert n == sum(len(bench_words(t)) for _, t in rows)
    block = table.where("term is not null").first()
    positions = decontam.unpack(bytes(block["at"]), np.array([block.n]))
    assert len(positions) == block.n and (np.diff(positions) > 0).all()
    again = spark.read.parquet(str(tmp_path / "index"))
    found = decontam.search(again, spark.createDataFrame([(1, rows[9][1])], "item_id long, text string"))
    assert found.count() >= 1


def test_decontamination_without_broadcasts(spark, monkeypatch):
    rows = corpus(5, 20)
    long = [t for _, t in rows if t and len(t) > 200][:6]
    bench = spark.createDataFrame([(k, t[10:300]) for k, t in enumerate(long)], "item_id long, text string")
    want = brute_hits(rows, [(k, t[10:300]) for k, t in enumerate(long)])
    for small, size in ((0, 200), (0, 4 << 20), (50_000, 64)):
        monkeypatch.setattr(common, "SMALL", small)
        monkeypatch.setattr(decontam, "SLICE_BYTES", size)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.scan(frame(spark, rows), bench).collect()), key=str) == want


def test_phrase_and_proximity_matches(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "gamma x beta alpha y delta"), (3, "alpha beta"), (4, None)]
    items = spark.createDataFrame([(9, "beta gamma delta")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind, r.start) for r in decontam.matches(frame(spark, rows), items, slop=3).collect()}
    assert (1, "9", "exact", 1) in got and {g[0] for g in got if g[2] == "proximity"} == {2}


def test_bpe(spark):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    letters = list("abcdehilnorstuAB  \n\t0123456789.,'!é…中😀  \x85\x1c") + ["<|endoftext|>"]
    rows = corpus(6, 20) + [(1000 + k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for k in range(300)] + [(2000, "a" * 3000)]
    got = {r.doc_id: r for r in bpe.digests(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert encoded.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_transducer_survives_a_full_memory():
    ranks = bpe.read_ranks(RANKS)
    small, rng = bpe.Transducer(ranks, max_states=50), random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("thenigoaé") for _ in range(rng.randint(1, 25))).encode()
        assert small.encode(piece).split() == [str(ranks[p]) for p in ([piece] if piece in ranks else bpe.merge(piece, ranks))]


def test_a_long_pre_token_stays_within_the_states():
    ranks, rng = bpe.read_ranks(RANKS), random.Random(5)
    piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    machine = bpe.Transducer(ranks, max_states=2000)
    got = machine.encode(piece.encode()).split()
    assert len(machine.states) <= 2000 + bpe.LOOK + 1
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    assert list(map(int, got)) == library.encode_ordinary(piece)


def test_ranks_need_every_byte(tmp_path):
    with open(RANKS, "rb") as f:
        lines = f.read().splitlines()
    (tmp_path / "few.tiktoken").write_bytes(b"\n".join(x for x in lines if not x.startswith(b"QQ== ")))
    with pytest.raises(ValueError, match="65"):
        bpe.read_ranks(str(tmp_path / "few.tiktoken"))


def test_bytes_that_are_no_utf8(spark):
    """Such strings come from other writers; every operator takes them."""
    rows = spark.createDataFrame([(1, bytearray(b"ab \xff\xfe cd")), (2, bytearray(b"\xc3"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert [r.decoded_sha256 for r in bpe.digests(rows, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == [hashlib.sha256(t.encode()).hexdigest() for t in ("ab \ufffd\ufffd cd", "\ufffd")]
    assert token_count.count_tokens(rows, path).count() == 2
    assert substring.drop_repeats(rows).count() == 2 and minhash.drop_near_duplicates(rows).count() == 2


def test_utf8_machine():
    m, rng = bpe.Utf8Machine(), random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0]) for _ in range(rng.randint(0, 12)))
        pending, text = b"", ""
        for i in range(0, len(data), 2):
            out, pending = m.step(pending, data[i : i + 2])
            text += out
        assert text + ("�" if pending else "") == data.decode("utf-8", "replace")


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    letters = list("abcdehilnorstuAB  \n\t0123456789.,'!é…中😀  \x85\x1c") + ["<|endoftext|>"]
    rows = corpus(9, 20) + [(1000 + k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for k in range(300)] + [(2000, "abtheing" * 400)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(frame(spark, rows), path).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)


def test_proof_is_right():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    merges, vocabulary, _ = token_count.load(path)
    whole = token_count.proven_whole(token_count.Merger(merges), vocabulary)
    some = sorted(whole)[::97]
    assert len(whole) > 40_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in some)
    with pytest.raises(ValueError):
        token_count.load(public_tokenizers.path("word_bpe_49k.json"))


def plain_pack(weights, shards):
    """The packing rule, one group at a time, in plain numbers."""
    mean = [max(sum(w[d] for w in weights) / shards, 1e-9) for d in range(3)]
    scaled = [[w[d] / mean[d] for d in range(3)] for w in weights]
    room = [[1.0] * 3 for _ in range(shards)]
    out = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-max(scaled[i]), -scaled[i][0], i)):
        w = scaled[i]
        dot = lambda s: sum(room[s][d] * w[d] for d in range(3))
        fit = [s for s in range(shards) if all(room[s][d] >= w[d] for d in range(3))]
        out[i] = max(fit, key=lambda s: (dot(s), -s)) if fit else max(range(shards), key=lambda s: (room[s][0], dot(s), -s))
        for d in range(3):
            room[out[i]][d] -= w[d]
    return out


def test_packing_follows_the_rule(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(sharding, "settle", lambda scaled, out, residual: out)
    for n in (3, 40, 300):
        weights = rng.integers(1, 4000, (n, 3)).astype(float)
        assert sharding.pack(weights, 16).tolist() == plain_pack(weights.tolist(), 16)


def test_settling_keeps_the_balance():
    rng = np.random.default_rng(9)
    size = rng.integers(50, 5000, 1000).astype(float)
    weights = np.column_stack([size, np.round(size / rng.uniform(4, 8, 1000)), np.ones(1000)])
    load = np.zeros((16, 3))
    np.add.at(load, sharding.pack(weights, 16), weights)
    off = (load.max(axis=0) - load.min(axis=0)) / load.mean(axis=0)
    assert off[0] < 2e-3 and off[1] < 0.05 and off[2] < 0.1, off


def check_shards(rows, got, shards=16):
    """Sizes, checksums, slots and whole groups of any outcome; returns the bytes of each shard."""
    import zlib
    from collections import Counter

    data = [(i, (t or "").encode()) for i, t in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in data)
    slots, load = {}, [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return load


def test_sharding(spark):
    same = "the same text over and over " * 4
    rows = corpus(10) + [(5000 + i, same) for i in range(200)] + [(1, "x"), (1, "x"), (None, "y"), (None, None)]
    got = sharding.assign(frame(spark, rows)).collect()
    check_shards(rows, got)
    words = {(t or ""): len(blank_words(t)) for _, t in rows}
    assert sorted(r.n_tokens for r in got) == sorted(words[t or ""] for _, t in rows)
    # A group of a third of all rows goes to the least number of shards; all others stay whole.
    where = {}
    for r in got:
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    big = [k for k, v in where.items() if len(v) > 1]
    assert {k[0] for k in big} <= {len(same) + 1, max(len(t or "") for _, t in rows) + 1} | {k[0] for k in big if k[0] > sum(k2[0] for k2 in where) / 16}
    assert sharding.assign(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("per_slice", [50_000, 200])
def test_shards_are_even(spark, monkeypatch, per_slice):
    """Also if the groups of a level are dealt to many slices and levels."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab c") for _ in range(rng.randint(100, 900)))) for i in range(1500)] + [(2000 + i, "again " * 30) for i in range(60)]
    monkeypatch.setattr(sharding, "SLICE", per_slice)
    if per_slice == 200:
        monkeypatch.setattr(sharding, "TOP", 100)
        monkeypatch.setattr(sharding, "STEP", 8)
    got = sharding.assign(frame(spark, rows)).collect()
    load = check_shards(rows, got)
    assert (max(load) - min(load)) / (sum(load) / 16) < (0.002 if per_slice > 200 else 0.02), load
    where = {}
    for r in got:
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert max(map(len, where.values())) == 1  # no group outweighs a shard


def test_packing():
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 1000, (3000, 3)).astype(float)
    for s in (2, 16):
        shard = sharding.pack(weights, s)
        load = np.zeros((s, 3))
        np.add.at(load, shard, weights)
        assert (load[:, 0].max() - load[:, 0].min()) / load[:, 0].mean() < 1e-3
        assert (load.max(axis=0) / load.min(axis=0)).max() < 1.1
