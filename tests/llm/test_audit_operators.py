"""Operators 11 (decontamination), 12 (hard negatives) and 13 (Merkle manifest) against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wearline.llm import decontaminate, manifest, negatives
from wearline.llm.decontaminate import Bits, FMIndex, Phrases, WaveletTree, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, phrases string, spans int, tree string, place int, __file string, __place long"
CLASH = ("x", 1, "t", 2, "f", 3)


def docs_frame(spark, rows):
    """Rows (doc_id, text[, lang, source, n_chars]) with extra columns whose names the operators use."""
    full = [tuple(r) + ("en", "s", 1)[len(r) - 2 :] + CLASH for r in rows]
    return spark.createDataFrame(full, DOCS)


# --- operator 11 ----------------------------------------------------------------------------------


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, window=10):
    phrases = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            phrases[tuple(w[i : i + window])].add(item)
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = phrases.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in got if x is not None}
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return Counter(out)


def hits_of(frame):
    return Counter((r["doc_id"], r["n_words"], tuple(k for s in r["spans"] for k in range(s["start"], s["stop"])), tuple(r["items"]))
                   for r in frame.collect())


def test_suffix_array_and_index_against_slices():
    rng = np.random.default_rng(1)
    for n, symbols in ((1, 1), (2, 2), (40, 2), (300, 3), (500, 400), (64, 1)):
        s = np.append(rng.integers(2, 2 + symbols, n), 0)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        tree = WaveletTree(s, symbols + 2)
        at = np.arange(len(s) + 1)
        for c in range(symbols + 2):
            assert tree.rank(np.full(len(at), c), at).tolist() == [int((s[:i] == c).sum()) for i in at]
        index = FMIndex(s, symbols + 2)
        matrix = np.full((30, 4), -1)
        for row in matrix:
            k = rng.integers(1, 5)
            row[4 - k :] = rng.integers(2, 2 + symbols, k)
        low, high = index.search(matrix)
        for row, a, b in zip(matrix, low, high, strict=True):
            p = [x for x in row.tolist() if x >= 0]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n) if s[i : i + len(p)].tolist() == p]


def test_bits_count_at_word_borders():
    bits = np.random.default_rng(2).random(200) < 0.4
    b = Bits(bits)
    assert b.rank(np.arange(201)).tolist() == [int(bits[:i].sum()) for i in range(201)]
    assert b[np.arange(200)].tolist() == bits.tolist()


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdeé") * rng.randint(1, 3) for _ in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice((1, 3, 9, 10, 11, 30)))) for k in range(12)] + [(100, None), (101, ""), (102, "...")]
    items += [(3, items[5][1]), (None, items[8][1]), (200, items[4][1])]  # one id twice, no id, the same text twice
    docs = []
    for k in range(60):
        parts = [text(rng.randint(0, 30)), "Strange words, 42!", rng.choice(items)[1] or "", text(5).upper()]
        rng.shuffle(parts)
        docs.append((k, rng.choice(("; ", "\n")).join(parts)))
    docs += [(None, items[5][1]), (61, None), (62, ""), (63, "?!"), (7, docs[7][1]), (7, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_against_brute_force(spark, seed):
    docs, items = random_case(seed)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, phrase string")
    got = hits_of(decontaminate.decontaminate(docs_frame(spark, docs), bench))
    assert got == brute_hits(docs, items)


def test_decontamination_in_small_shards_pieces_and_passes(spark):
    """Long texts go through many shards and pieces; many phrases through several passes."""
    docs, items = random_case(3)
    rng = random.Random(4)
    long = " ".join(rng.choice(("aa", "bb", "cc")) for _ in range(4000)) + " " + items[11][1]
    docs += [(70, long), (71, "a" * 500 + " " + long)]
    items += [(300, " ".join(long.split()[100:160])), (301, "aa bb")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    held = decontaminate.phrase_items(bench)
    phrases = [(k, r["phrase"]) for k, r in enumerate(held.select("phrase").distinct().collect())]
    by_phrase = defaultdict(set)
    for r in held.collect():
        by_phrase[r["phrase"]].add(r["item"])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    keep = {k: getattr(decontaminate, k) for k in ("SHARD_WORDS", "PIECE_BYTES")}
    try:
        for shard, piece in ((40, 64), (1000, 700)):
            decontaminate.SHARD_WORDS, decontaminate.PIECE_BYTES = shard, piece
            out = next(decontaminate._find(Phrases(phrases))(iter([batch]))).to_pylist()
            got = Counter((r["doc_id"], r["n_words"], tuple(k for s in r["spans"] for k in range(s["start"], s["stop"])),
                           tuple(sorted({x for k in r["phrases"] for x in by_phrase[phrases[k][1]] if x is not None}))) for r in out)
            assert got == brute_hits(docs, items)
    finally:
        for k, v in keep.items():
            setattr(decontaminate, k, v)


def test_decontamination_passes(spark, monkeypatch):
    docs, items = random_case(5)
    monkeypatch.setattr(decontaminate, "BLOCK_PHRASES", 25)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert hits_of(decontaminate.decontaminate(docs_frame(spark, docs), bench)) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs, items = random_case(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(docs_frame(spark, docs).limit(0), bench).count() == 0
    assert hits_of(decontaminate.decontaminate(docs_frame(spark, docs), bench.limit(0))) == brute_hits(docs, [])


# --- operator 12 ----------------------------------------------------------------------------------


def brute_negatives(rows):
    """(vec_id, label, vector of ints or None) -> result rows; the rows are told apart by their number."""
    use = [(i, k, lab, np.array(v, object)) for i, (k, lab, v) in enumerate(rows) if k is not None and lab is not None and v is not None]
    out = []
    for i, k, lab, v in use:
        if k % 100:
            continue
        dot = lambda w: int((v[: len(w)] * w[: len(v)]).sum()) if len(v) and len(w) else 0
        scored = [(dot(w), j, kk, ll) for j, kk, ll, w in use if j != i]
        pos = sorted((-s, kk, j) for s, j, kk, ll in scored if ll == lab)[:5]
        for s, kk, _ in pos:
            neg = sorted((-t, nn) for t, _, nn, ll in scored if ll != lab and -80 * s <= 100 * t <= -100 * s)[:5]
            out += [(k, kk, r + 1, nn, -s, -t) for r, (t, nn) in enumerate(neg)]
    return Counter(out)


def mined(frame):
    return Counter(tuple(r) for r in frame.collect())


def clustered(seed, n, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (7, 20))
    rows = [(k, int(rng.integers(0, 5)), [int(x) for x in centres[rng.integers(0, 7)] + rng.normal(0, 8, 20)]) for k in range(n)]
    same = [3] * 20
    return rows + [(n + k, k % 2, same) for k in range(hot)]


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(negatives, "CHUNK", 64)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    rows = clustered(1, 900, hot=450)  # a third of all rows is one vector
    rows += [(100, 1, rows[3][2]), (200, 2, rows[200][2]), (1350, 0, []), (1400, 1, [5]), (None, 1, rows[0][2]), (1351, None, rows[0][2]), (1352, 1, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, vector array<int>, part string")
    d = d.where("vec_id is not null and label is not null and vector is not null")
    want = brute_negatives(rows)
    assert want and mined(negatives.mine(d, F.col("vec_id") % 100 == 0)) == want
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", 0)  # beyond the bound: joined by block and part
    assert mined(negatives.mine(d, F.col("vec_id") % 100 == 0)) == want


def test_hard_negatives_edge_cases(spark):
    from pyspark.sql import functions as F

    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 2, [0.4, 0.3]), (3, 2, None), (4, None, [1.0, 1.0]), (5, 2, [float("nan"), 1.0]),
            (6, 2, [float("inf"), 1.0]), (7, 2, [None, 1.0]), (None, 2, [0.4, 0.3]), (8, 2, [1e30, -1e30]), (9, 2, [0.7]), (10, 1, [-9.0, -9.0])]
    d = spark.createDataFrame([(i, v, lab, 5) for i, lab, v in rows], "vec_id long, embedding array<float>, label int, a_place int")
    used = {r["vec_id"]: list(r["vector"]) for r in negatives.usable(d).collect()}
    assert used[0] == [128, 128] and used[2] == [102, 76] and used[8] == [2**27, -(2**27)] and set(used) == {0, 1, 2, 8, 9, 10}
    got = mined(negatives.mine(negatives.usable(d), F.col("vec_id") % 100 == 0))
    assert got == Counter({(0, 1, 1, 9, 24576, 179 * 128): 1, (0, 1, 2, 2, 24576, 178 * 128): 1})
    assert negatives.mine(negatives.usable(d.limit(0)), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(negatives.usable(d.where("vec_id = 1")), F.col("vec_id") % 100 == 0).count() == 0


def test_summary_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (50, 32)) for c in (-40, 0, 40)]).astype(np.int32)
    s = negatives.summarise(x)
    at, share = 0, []
    scores = x.astype(np.int64) @ x.T
    for n in negatives.SEGMENTS:
        mean, dev = s[:, at : at + n], s[:, at + n : at + 2 * n]
        at += 2 * n
        centre, radius = 32 // n * mean @ mean.T, dev @ dev.T
        assert (np.abs(scores - centre) <= radius + 1e-6).all()
        share.append((centre[0] + radius[0] >= np.sort(scores[0])[-5]).mean())
    assert share[0] < 0.5  # on clustered vectors the coarsest level drops most rows


# --- operator 13 ----------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes, fan):
    """Levels of a tree, and per node the sibling lists on its way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            start = at // fan * fan
            path.append((level[start:at], level[at + 1 : start + fan]))
            at //= fan
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows, fan=16):
    leaf = lambda r, text: H(*[field(x) for x in (r[0], r[3], r[2], r[4], text)])
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        done[s] = climb([leaf(r, r[1]) for r in sources[s]], fan)
    root, tops = climb([done[s][0] for s in names], fan)
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(sources[s], done[s][1], strict=True):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for before, after in path + top:
                folded = H(*before, folded, *after)
            proof = H(*[h for before, after in path + top for h in before + after])
            out.append((r[0], leaf(r, r[1]), done[s][0], root, proof, folded, folded == root))
    return Counter(out)


def manifest_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            k = len(rows)
            rows.append((k, rng.choice((None, "", "Ünïcode ABC", f"Text {k}", "plain")), rng.choice((None, "en")), s, rng.choice((None, k))))
    rows += [(None, "No id", "en", "a", 1)] * 3 + [(4, "Again", "en", "a", 2)] * 20 + [(4, "Other", "en", "a", 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 5}, {"a": 300, "b": 1, None: 16, "": 17}, {"hot": 700, **{f"ü{k}": 2 for k in range(20)}, None: 256}])
def test_manifest_against_brute_force(spark, sizes, tmp_path):
    rows = manifest_rows(1, sizes)
    docs_frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in manifest.op13_merkle_manifest(spark, str(tmp_path)).collect())
    want = brute_manifest(rows)
    assert got == want
    assert {v[-1] for v in want} == {True, False} or len(rows) < 50


@pytest.mark.parametrize(("fan", "every"), [(2, 1), (2, 3), (3, 2)])
def test_manifest_levels_kept_change_nothing(spark, fan, every):
    from pyspark.sql import functions as F

    n = 70
    d = spark.range(n).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("hash"))
    rows, root = manifest.manifest(d, fan, every)
    want, paths = climb([H(str(k)) for k in range(n)], fan)
    got = {r["doc_id"]: [(p["before"].hex(), p["after"].hex()) for p in r["path"]] for r in rows.collect()}
    assert root == want
    assert got == {k: [("".join(a), "".join(b)) for a, b in p] for k, p in enumerate(paths)}


def test_manifest_of_nothing_and_of_one_row(spark, tmp_path):
    one = docs_frame(spark, [(1, "Only", "en", None, 4)])
    one.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    one.write.parquet(str(tmp_path / "one" / "documents.parquet"))
    assert manifest.op13_merkle_manifest(spark, str(tmp_path / "none")).count() == 0
    r = manifest.op13_merkle_manifest(spark, str(tmp_path / "one")).first()
    assert r["leaf"] == r["subroot"] == r["root"] == H(*[field(x) for x in (1, None, "en", 4, "Only")]) and r["proof_sha256"] == H("")
