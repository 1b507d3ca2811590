"""Classifiers, URL filter, fingerprints and the pipeline."""

import io
import math
import random
import re
import wave
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chroma, common, labels, quality, toxicity, url_filter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(rows, marks, label):
    known = {r.doc_id: r[label] for r in marks.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return np.mean([a == b for a, b in held])


ODD = [(-1, None), (-2, ""), (-3, "word " * 60_000), (-4, "!!"), (-1, None), (None, "no id")]


@pytest.mark.parametrize(("op", "label", "mod", "fold"), [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_classifiers(spark, docs, marks, op, label, mod, fold):
    import zlib

    more = docs.select("doc_id", "text", F.lit("x").alias("score"), F.lit("x").alias("weight")).unionByName(spark.createDataFrame([(i, t, "x", "x") for i, t in ODD], "doc_id long, text string, score string, weight string"))
    rows = op.classify(more, marks).collect()
    assert len(rows) == 1000 + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= op.THRESHOLD) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == fold) for r in rows)
    assert accuracy(rows, marks, label) >= 0.95
    again = {r.doc_id: r.score for r in op.classify(more.repartition(5), marks).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows if (r.doc_id or -1) >= 0)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_without_labels(docs, marks, op):
    assert {r.score for r in op.classify(docs.limit(5), marks.limit(0)).collect()} == {0.5}
    assert op.classify(docs.limit(0), marks).collect() == []


def test_without_a_model_every_document_stays(docs, marks):
    few = docs.limit(20)
    for none in (marks.limit(0), marks.where("quality = 1")):
        assert sorted(map(str, quality.keep_good(few, none).collect())) == sorted(map(str, few.collect()))


def test_a_long_text_is_learned_from(spark):
    rows = [(i, f"{'good calm prose' if i % 2 else 'bad loud junk'} " * 60) for i in range(40)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    marks_ = docs_.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.fit(docs_, marks_, most=1) is not None


def test_sample_is_bounded(spark):
    df = spark.range(5000).toDF("_id")
    got = sorted(r[0] for r in labels.least(df, 100, "_id").collect())
    assert len(got) == 100 and got == sorted(r[0] for r in labels.least(df.repartition(7), 100, "_id").collect())


def test_attention_learns_from_one_passage():
    """A bag is positive if one of its passages is; the weights must find it."""
    rng = np.random.default_rng(3)
    counts = rng.integers(2, 8, 400)
    x = rng.normal(0, 1, (counts.sum(), quality.SIZE)).astype(np.float32)
    y = rng.integers(0, 2, 400)
    at = np.cumsum(counts) - counts
    for i in np.flatnonzero(y):
        x[at[i] + rng.integers(counts[i]), :6] += 4
    bag = quality.Bag(x[: at[300]], counts[:300], y[:300])
    assert ((bag.score(x[at[300] :], counts[300:]) >= 0.5) == y[300:]).mean() > 0.85


def test_passages_are_what_they_hold():
    """Features against a plain reading of each passage."""
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcé1,") for _ in range(rng.randint(1, 9))) for _ in range(400)) + " ab ab ab x y z ab ab ab"
    data = text.encode()
    x, counts = quality.passages([b"", data, b"   "], common.WordHasher(common.WHITE, common.LOWER))
    assert counts.tolist() == [1, -(-len(data) // quality.PASSAGE), 1] and not x[0].any()
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    low = [w.lower() for _, w in words]
    for p in range(counts[1]):
        piece = data[p * quality.PASSAGE : (p + 1) * quality.PASSAGE]
        own = [i for i, (at, _) in enumerate(words) if at // quality.PASSAGE == p]
        row = x[1 + p]
        on = data[p * quality.PASSAGE : (p + 1) * quality.PASSAGE + 1]  # a pair belongs to the passage of its first byte
        pairs = Counter(zip(quality.CLASS[list(on[:-1])], quality.CLASS[list(on[1:])]))
        assert np.allclose([row[a * 8 + b] for a in range(8) for b in range(8)], [pairs[a, b] / (len(on) - 1) for a in range(8) for b in range(8)], atol=1e-3)
        n = max(1, len(own))
        again = sum(i > 0 and low[i] == low[i - 1] for i in own) / n
        seen = sum(i >= 2 and any(low[j - 2 : j + 1] == low[i - 2 : i + 1] for j in range(2, i)) for i in own) / n
        assert np.allclose(row[64:], [math.log1p(len(piece) / n), again, seen, len(piece) / quality.PASSAGE], atol=1e-5)


def test_attention_against_plain_sums():
    """The forward pass bag by bag, and the gradient by finite differences."""
    rng = np.random.default_rng(4)
    counts = np.array([1, 3, 2])
    x, y = rng.normal(0, 1, (6, quality.SIZE)), np.array([0.0, 1.0, 1.0])
    bag = quality.Bag(x.astype(np.float32), counts, y, epochs=3)
    p, score = bag.p, bag._forward(x, counts)[-1]
    for i, (a, b) in enumerate([(0, 1), (1, 4), (4, 6)]):
        h = [np.tanh(r @ p["W"] + p["b"]) for r in x[a:b]]
        e = [math.exp(sum(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"]))) * p["a"])) for v in h]
        z = sum(w * v for w, v in zip(e, h)) / sum(e)
        assert abs(score[i] - 1 / (1 + math.exp(-(z @ p["c"] + p["d"][0])))) < 1e-12
    loss = lambda: -np.mean(y * np.log(s := bag._forward(x, counts)[-1]) + (1 - y) * np.log(1 - s))
    for k, g in bag.gradient(x, counts, y).items():
        flat, slope = p[k].reshape(-1), g.reshape(-1)
        for i in rng.choice(len(flat), min(8, len(flat)), replace=False):
            was = flat[i]
            flat[i] = was + 1e-6
            high = loss()
            flat[i] = was - 1e-6
            low = loss()
            flat[i] = was
            assert abs((high - low) / 2e-6 - slope[i]) < 1e-6


def test_exceptions_end_where_they_say():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 2.0})
    weigh = lambda t: lexicon.measure(t)[0]
    assert [weigh(t) for t in ("a trash can", "two trash cans.", "TRASH CAN")] == [0, 0, 0]
    assert [weigh(t) for t in ("trash can't", "trash can\u2019t do", "trash cannot", "trash canoe", "trash")] == [2] * 5
    zero = toxicity.Lexicon({toxicity.fold("moron"): 0.0, toxicity.fold("moronic"): 1.0}, ())
    assert zero.measure("moronic moron") == (1.0, 2, 1.0)  # no weight is not an exception


def test_toxicity_measures_whole_texts():
    lexicon = toxicity.Lexicon({toxicity.fold("moron"): 3.0, toxicity.fold("trash"): 2.0})
    assert lexicon.measure("moron " + "a " * 600_000 + "moron") == (3.0, 600_002, 3.0)
    for n in range(1_048_560, 1_048_590):  # wherever a cut might fall
        assert lexicon.measure("x" * n + " trash can")[0] == 0
    assert lexicon.measure("ab" * 1_500_000)[1] == 1


def test_folding():
    assert toxicity.fold("M0r0n ｉdiot ѕtupid lösёr @$$\u200b") == toxicity.fold("moron idiot stupid loser ass")
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 2.0, toxicity.fold("moron"): 3.0})
    assert lexicon.measure("You TR4SH, m0rons! moron")[0] == 2 + 3 + 3
    assert lexicon.measure("a trash can, an oxymoron")[0] == 0
    assert lexicon.measure("") == (0.0, 0, 0.0)
    assert lexicon.measure("a " * 800_000 + "moron")[0] == 3


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])] if rest.startswith("/") else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://COM/en/1", "https://a.example.com/en/7x?q=1", "http://example.com/en/6", "http://xcom/en/1", "x://net#/de/", "x://example.net/de/81", "x://É.org/es/a://b",
            "x://a.net/de/9?/de/8", "http://h.com?a=/en/", "http://a\nb.com/en/\n"] + ["http://s.org/es/" + "k" * 100_000]
    rng = random.Random(4)
    urls += [f"http://{rng.choice(['a', 'b-c', 'x9'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 999)}{rng.choice(['', '?a=1&b=2', '#t'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path = parts_of(u)
        fits = [(v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        v, rule = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (v or ("block" if got[i].block_score >= 0.5 else "allow"))
    plan = url_filter.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert url_filter.judge(df.limit(0)).collect() == []
    alone = url_filter.judge(df.where("page_id < 3")).collect()
    assert [r.verdict for r in alone] == ["allow"] * 3


def test_entropy_and_trees(spark):
    urls = ["", "aaaa", "http://x.com/a1?b=2&c"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    got = {r.url: r for r in url_filter.lexical(df, "url").collect()}
    for u in urls:
        expected = -sum(c / len(u) * math.log2(c / len(u)) for c in Counter(u).values()) if u else 0
        assert abs(got[u].f_entropy - expected) < 1e-9
    assert got[urls[2]].f_params == 2 and got[urls[2]].f_depth == 1
    rng = np.random.default_rng(5)
    x = rng.random((2000, len(url_filter.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = url_filter.Boosted(x, y)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], ", ".join(f"{f} double" for f in url_filter.FEATURES))
    p = np.array([r[0] for r in rows.select(F.expr(model.sql())).collect()])
    assert ((p >= 0.5) == (y[:200] == 1)).mean() > 0.95


def brute_align(mine, own, library):
    best = None
    for q, theirs in sorted(library.items()):
        if q == own:
            continue
        for offset in range(-len(theirs) + chroma.MIN_OVERLAP, len(mine) - chroma.MIN_OVERLAP + 1):
            a, b = max(offset, 0), min(offset + len(theirs), len(mine))
            if b - a < chroma.MIN_OVERLAP:
                continue
            wrong = sum(bin(int(x)).count("1") for x in mine[a:b] ^ theirs[a - offset : b - offset]) / (32 * (b - a))
            key = (wrong, -(b - a), q, offset)
            if wrong <= chroma.MAX_ERROR and (best is None or key < best):
                best = key
    return best


def test_fingerprints_align(spark):
    rng = np.random.default_rng(6)
    base = [rng.normal(0, 0.125, 64).tolist() for _ in range(6)]
    songs = [chroma.tune(v) for v in base]
    cut = {i: s for i, s in enumerate(songs)}
    cut[50] = songs[1]
    cut[100] = songs[2][20 * chroma.HOP :] + rng.normal(0, 0.02, len(songs[2]) - 20 * chroma.HOP).astype(np.float32)
    cut[150] = rng.normal(0, 1, 60_000).astype(np.float32)
    cut[7], cut[8] = np.zeros(0, dtype=np.float32), np.zeros(90_000, dtype=np.float32)

    def wav(x):
        blob = io.BytesIO()
        with wave.open(blob, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(chroma.RATE)
            w.writeframes((np.clip(x / 4, -1, 1) * 32767).astype("<i2").tobytes())
        return blob.getvalue()

    odd = [(9, None, "s"), (10, bytearray(b"notawav"), "s"), (11, bytearray(wav(songs[1])[:60]), "s"), (1, bytearray(wav(cut[1])), "s"), (None, bytearray(wav(cut[1])), "s")]
    df = spark.createDataFrame([(i, bytearray(wav(x)), "s") for i, x in cut.items()] + odd, "vec_id long, audio binary, codes string")
    prints = chroma.fingerprints(df, "vec_id", "audio").cache()
    queries = prints.where("id % 50 = 0")
    aligned = chroma.align(prints, queries)
    assert aligned.where("id = 1 and match_id = 50").count() == 2 and aligned.where("id is null and match_id = 50").count() == 1
    got = {r.id: r for r in chroma.best(aligned).collect()}
    codes = {r.id: np.frombuffer(bytes(r.codes), dtype="<u4") for r in prints.collect()}
    assert got[1].match_id == 50 and got[1].match_offset == 0 and got[1].bit_error == 0
    assert got[2].match_id == 100 and got[2].match_offset == 20
    assert got[7].match_id is None and got[9].n_codes == got[10].n_codes == got[11].n_codes == 0 and got[3].match_id is None
    library = {r.id: codes[r.id] for r in queries.collect() if len(codes[r.id])}
    right = 0
    for i, c in codes.items():
        b = brute_align(c, i, library)
        right += (got[i].match_id, got[i].match_offset) == ((b[2], b[3]) if b else (None, None))
    assert right / len(codes) >= 0.9
    blocks = {r.id: (r.match_id, r.match_offset) for r in chroma.best(chroma.align(prints, queries, block=1)).collect()}
    assert blocks == {i: (r.match_id, r.match_offset) for i, r in got.items()}
    assert chroma.align(prints.limit(0), queries).collect() == []
    assert {r.match_id for r in chroma.align(prints, queries.limit(0)).collect()} == {None}


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_samples_of_every_width(size):
    x = (np.sin(np.arange(5000) / 9) * 0.5 * 2 ** (8 * size - 1)).astype(np.int64)
    raw = (x + 128).astype(np.uint8).tobytes() if size == 1 else b"".join(int(v).to_bytes(size, "little", signed=True) for v in x)
    blob = io.BytesIO()
    with wave.open(blob, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(size)
        w.setframerate(chroma.RATE)
        w.writeframes(raw)
    got = chroma.wav_samples(blob.getvalue())
    assert len(got) == 5000 and np.abs(got - np.sin(np.arange(5000) / 9) * 0.5).max() < 0.01
    assert len(chroma.wav_samples(blob.getvalue()[:-1])) in (4999, 5000) or size == 1


def prints_of(spark, rows):
    return spark.createDataFrame([(i, bytearray(np.asarray(c, dtype="<u4").tobytes())) for i, c in rows.items()], "id long, codes binary")


def test_every_query_of_a_recording_is_reported(spark):
    """Copies and near copies of several queries, equal and not, against brute force over all pairs."""
    rng = np.random.default_rng(3)
    song, other = (rng.integers(0, 1 << 32, 40, dtype=np.uint32) for _ in range(2))
    near = song.copy()
    near[::4] ^= np.uint32(0b1011)
    rows = {50: song, 100: song, 150: near, 200: other, 1: song, 2: song[7:], 3: other[3:30], 4: near, 5: song[:10], 6: song[:0], 250: song}
    prints = prints_of(spark, rows)
    queries = prints.where("id % 50 = 0")
    want = {}
    for i, c in rows.items():
        for q in (50, 100, 150, 200, 250):
            if b := brute_align(c, i, {q: rows[q]}):
                want[i, q] = (b[3], -b[1], b[0])
    assert len([1 for i, _ in want if i == 1]) == 4
    for block in (1, 4096):
        out = chroma.align(prints, queries, block=block)
        assert {(r.id, r.query_id): (r.match_offset, r.match_overlap, r.bit_error) for r in chroma.matched_pairs(out, queries).collect()} == want
        got = {r.id: r.match_id for r in chroma.best(out).collect()}
        assert got[1] == 50 and got[50] == 100 and got[200] is None and sorted(r.match_id for r in out.where("id = 1").collect()) == [50, 150]
        assert sorted(i for i, in out.select("id").distinct().collect()) == sorted(rows)


def noisy_recordings(rng, n, wrong_share):
    """(query, row, offset) of n true alignments of 16 to 40 integers, with as many wrong bits as the share allows."""
    for _ in range(n):
        k = int(rng.integers(chroma.MIN_OVERLAP, 41))
        query = rng.integers(0, 1 << 32, k + int(rng.integers(0, 20)), dtype=np.uint32)
        at = int(rng.integers(0, len(query) - k + 1))
        bits = np.unpackbits(query[at : at + k].astype("<u4").view(np.uint8))
        bits[rng.choice(len(bits), int(wrong_share * len(bits)), replace=False)] ^= 1
        yield query, np.packbits(bits).view("<u4"), -at


@pytest.mark.parametrize(("wrong_share", "least"), [(0.0, 1.0), (0.0625, 1.0), (0.1, 0.999), (chroma.MAX_ERROR, 0.98)])
def test_recall_of_alignments_up_to_the_limit(wrong_share, least):
    """Rows that all match truly; what is found is exact."""
    rng = np.random.default_rng(12)
    found = n = 0
    for query, row, offset in noisy_recordings(rng, 1000, wrong_share):
        n += 1
        for got in chroma.Library([query.tobytes()]).align(chroma.Recordings([row.tobytes()])):
            for _, _, o, size, error in zip(*got):
                assert (o, size) == (offset, len(row)) and error <= wrong_share
                found += 1
    assert found / n >= least, found / n


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from tidemill.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        n.append(docs.count())
    assert n[0] > n[1] > n[2] == n[3] >= n[4] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == n[4] and out.where("not round_trip").count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0


def words_of(text, lower=False):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in data) if lower else data)


def brute_pipeline(rows, items):
    """All stages after the classifier, one document at a time: {doc_id: token ids}."""
    import public_tokenizers
    import tiktoken

    from tidemill.llm import bpe
    from tests.llm.test_text_operators import brute_hits, brute_repeats

    sets = {}
    for i, t in rows:
        w = words_of(t, True)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    kept = [(i, t) for i, t in rows if root[i] == i]
    short = [(i, b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else dict(kept)[i]) for i, (w, gone) in brute_repeats(kept).items()]
    clean = {i for i, n, hit, _ in brute_hits(short, items) if not (hit and 20 * hit >= n)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return {i: library.encode_ordinary(t or "") for i, t in short if i in clean}


def test_pipeline_is_the_stages_by_hand(spark, monkeypatch):
    """Every row of run(); and each stage reads what the one before has written, so nothing is computed twice."""
    import corpus_pipeline

    sf, plans = "/root/testdata/sf0.001", []

    def seen(f):
        def run(spark, docs, sf_dir):
            plans.append(docs._jdf.queryExecution().toString())
            return f(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, seen(f)) for n, f in corpus_pipeline.STAGES])
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    monkeypatch.undo()
    assert len(plans) == 5 and not any("MapInArrow" in p or "Exchange" in p for p in plans)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.keep_quality(spark, docs, sf).select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert 0 < len(good) < docs.count()
    assert got == brute_pipeline([tuple(r) for r in good], items)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_takes_odd_tables(spark, tmp_path, empty):
    """Nulls in every column, empty and repeated rows, no labels and an empty table, through all stages."""
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", None, 5), (1, text, "en", None, 5), (None, None, None, None, None), (2, "", None, "s", 0), (3, text + " more", None, None, None), (None, "one of its own", None, None, None), (4, "asked " * 20, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tables = {"documents": docs, "labels": spark.createDataFrame([(None, 1, None)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "asked " * 13), (None, text), (2, None)], "item_id long, text string")}
    for name, df in tables.items():
        (df.limit(0) if empty else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 3 is a near copy of 1, one row of which stays; 4 is from the benchmark.
    assert sorted((str(r.doc_id), r.n_tokens > 0, r.round_trip) for r in got) == ([] if empty else [("1", True, True), ("2", False, True), ("None", False, True), ("None", True, True)])
