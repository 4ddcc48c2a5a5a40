"""Operators 3, 4, 9, the shared helpers and the pipeline on small tables."""
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wearline.llm import chat, fixity, neighbours
from wearline.llm.common import connected_components, ranked, row_keyed

VECTORS = "vec_id long, embedding array<float>, label int, uid long, v string"


def brute(rows, k):
    out = {}
    x = {i: np.array(v, np.float64) for i, v in rows}
    for i in x:
        if i % 100 == 0:
            d = sorted((math.sqrt(((x[i] - x[j]) ** 2).sum()), j) for j in x if j != i)
            out[i] = [(r + 1, j, s) for r, (s, j) in enumerate(d[:k])]
    return out


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, []),
            (100, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0])]
    d = spark.createDataFrame([(i, v, 0, 1, "c") for i, v in rows], VECTORS)
    got = Counter((r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(d).collect())
    assert got == Counter([(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)])
    assert neighbours.nearest(d.limit(0)).count() == 0


def test_neighbours_recall_and_hot_vector(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(3000)]
    rows += [(k, [1.0] * 16) for k in range(3000, 4500)]  # a third of all rows is one vector
    monkeypatch.setattr(neighbours, "CHUNK", 400)
    d = spark.createDataFrame([(i, v, 0, 1, "c") for i, v in rows], VECTORS)
    got = {}
    for r in neighbours.nearest(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 10)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want if q < 3000)
    assert hits >= 0.9 * 10 * sum(q < 3000 for q in want)
    for q in (3000, 3100, 4400):  # copies of the hot vector: the smaller ids first
        assert [j for _, j, _ in sorted(got[q])] == [j for j in range(3000, 3011) if j != q][:10]
    for q, found in got.items():
        x = dict(rows)
        for _, j, s in found:
            assert abs(s - math.dist(x[q], x[j])) < 1e-12


def test_neighbours_recall_on_the_table(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in emb.collect()], 10)
    got = Counter()
    for r in neighbours.nearest(emb).collect():
        got[r["query_id"]] += r["vec_id"] in {j for _, j, _ in want[r["query_id"]]}
    assert sum(got.values()) >= 0.9 * sum(map(len, want.values()))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, bytes string")


def test_audit(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}" * (k % 7 + 1)) for k in range(300)] + [(5000, None, None), (None, "u", "x"), (7, "http://h/7", "again"), (5000, None, None)]
    left = fixity.records(pages(spark, rows))
    assert fixity.audit(left, left).count() == 0
    bad = [(i, u, "longer than before" if i == 40 else h) for i, u, h in rows if i not in (41, 299)] + [(301, "new", "new"), (5000, None, None)]
    out = {r["page_id"]: r for r in fixity.audit(left, fixity.records(pages(spark, bad))).collect()}
    assert {i: r["kind"] for i, r in out.items()} == {40: "altered", 41: "missing", 299: "missing", 301: "extra", 5000: "altered"}
    sizes = {r["page_id"]: r["n"] for r in left.groupBy("page_id").agg(F.sum(F.octet_length("bytes")).alias("n")).collect()}
    assert out[41]["offset"] == sum(n for i, n in sizes.items() if i is not None and i < 41) and out[41]["length"] == sizes[41]
    assert fixity.audit(left.limit(0), left.limit(0)).count() == 0
    whole = fixity.audit(left.limit(0), left)
    assert whole.count() == len(sizes) and whole.where("kind <> 'extra'").count() == 0


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")


def test_chat_collapse(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "")]
    rows = [(1, t, *full[t]) for t in range(1)] + [(2, t, *full[t]) for t in range(3)] + [(3, t, *full[t]) for t in range(4)]
    rows += [(4, t + 10, *full[t]) for t in range(4)] + [(5, 0, "user", "hi"), (5, 1, "assistant", "other")] + [(6, 0, "user", "hi"), (6, 0, "user", "hi")]
    rows += [(7, 0, "user", ""), (8, 0, "user", None), (None, 0, "user", "nobody"), (9, None, "user", "no turn"), (9, 1, "user", "turn")]
    d = chats(spark, rows)
    out = {r["conv_id"]: r for r in chat.collapse(d).collect()}
    assert set(out) == {3, 5, 7, 8, None, 9}
    assert out[3]["n_turns"] == 4 and out[3]["n_copies"] == 2 and out[5]["n_turns"] == 2
    text = {r["conv_id"]: r["text"] for r in chat.rendered(d).collect()}
    assert text[3] == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
                       "<|im_start|>user\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert all(out[c]["n_chars"] == len(t) for c, t in text.items())
    assert chat.collapse(d.limit(0)).count() == 0


def test_chat_collapse_against_brute_force(spark):
    rng = random.Random(8)
    convs = {}
    for c in range(120):
        n = rng.choice([1, 2, 3, 5, 600])
        seed = rng.randrange(6)
        convs[c] = [(("user", "assistant")[t % 2], f"t{seed}-{t}") for t in range(n)]
    d = chats(spark, [(c, t, *x) for c, ts in convs.items() for t, x in enumerate(ts)])
    kept = {}
    for c, ts in sorted(convs.items()):
        if not any(len(o) > len(ts) and o[:len(ts)] == ts for o in convs.values()):
            kept.setdefault(tuple(ts), c)
    assert {r["conv_id"] for r in chat.collapse(d).collect()} == set(kept.values())


def test_chat_collapse_with_a_null_conversation_of_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_TURNS", 16)
    rng = random.Random(10)
    rows = [(None, rng.choice([None, 0, 1]), "user", f"n{k}") for k in range(1500)]  # hundreds of rows a turn number
    rows += [(c, t, "user", f"c{c % 50}-{t}") for c in range(300) for t in range(rng.randint(1, 20))]
    placed = chat.turns(chats(spark, rows))
    sizes = placed.groupBy("_c", "_chunk").count().agg(F.max("count").alias("m")).first()["m"]
    assert sizes <= 16  # no chunk is larger, whatever the turn numbers
    at = [(r["_place"], r["_text"]) for r in placed.where("_c is null").orderBy("_place").collect()]
    order = sorted({(t is not None, t or 0, x) for c, t, _, x in rows if c is None})
    assert at == [(k + 1, x) for k, (_, _, x) in enumerate(order)]
    convs = {}
    for c, t, _, x in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2]):
        convs.setdefault(c, []).append(x)
    kept = {}
    for c, ts in sorted(convs.items()):
        if not any(len(o) > len(ts) and o[: len(ts)] == ts for o in convs.values()):
            kept.setdefault(tuple(ts), c)
    assert {r["conv_id"] for r in chat.collapse(chats(spark, rows)).collect()} == {None, *kept.values()}


def test_neighbours_beyond_the_sample_in_small_blocks(spark, monkeypatch):
    """Recall on a table much larger than the sample, hot leaves cut into chunks and blocks; clusters need few visits."""
    for k, v in {"SAMPLE": 800, "LEAF": 32, "CHUNK": 64, "BLOCK": 8}.items():
        monkeypatch.setattr(neighbours, k, v)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (60, 12))
    x = (centres[rng.integers(0, 60, 9000)] + rng.normal(0, 0.5, (9000, 12))).astype(np.float32)
    x[3000:4500] = x[3000]  # a hot vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    d = spark.createDataFrame([(i, v, 0, 1, "c") for i, v in rows], VECTORS)
    _, visit = neighbours.fit(neighbours.valid_vectors(d, "embedding").select("uid", "vec_id", "v"), 9000)
    assert visit < 0.6
    got = {}
    for r in neighbours.nearest(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want, hits, total = brute(rows, 10), 0, 0
    for q, best in want.items():
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11)) and len({j for _, j, _ in got[q]}) == 10
        if not 3000 <= q < 4500:
            hits += len({j for _, j, _ in got[q]} & {j for _, j, _ in best})
            total += 10
    assert hits >= 0.9 * total
    assert [j for _, j, _ in sorted(got[3000])] == list(range(3001, 3011))


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5001), (5001, 5000), (6, 6)]
    edges += [(rng.randrange(10_000, 10_100), rng.randrange(10_000, 10_100)) for _ in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[root(a)] = root(b)
    got = {}
    for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    want = {}
    for x in list(up):
        want.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked_and_row_key(spark):
    d = spark.createDataFrame([(random.Random(k).randrange(1000),) for k in range(500)], "x long")
    got = sorted((r["n"], r["x"]) for r in ranked(d, [F.col("x")], "n").collect())
    assert [n for n, _ in got] == list(range(500)) and [x for _, x in got] == sorted(x for _, x in got)
    same = spark.createDataFrame([(1,)] * 50, "x long")
    k = row_keyed(same)
    first = {(r["__file"], r["__place"]) for r in k.collect()}
    assert len(first) == 50 and first == {(r["__file"], r["__place"]) for r in k.collect()}


def test_pipeline_with_nulls_copies_clashing_names_and_a_long_text(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = ["the", "of", "and", "river", "mountain", "winter", "letter", "garden", "question", "answer", "quiet", "street"]
    text = lambda n: " ".join(rng.choice(words) + ("." if k % 9 == 8 else "") for k in range(n))
    copy = text(90)
    long = " ".join("".join(rng.choice(words) for _ in range(3)) for _ in range(40_000))
    rows = [(k, text(rng.randint(60, 140)), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", None]), 5) for k in range(150)]
    rows += [(200, copy, "en", "a", 1), (200, copy, "en", "a", 1), (None, copy, None, None, None), (201, None, "en", "a", 0), (202, "", None, "b", 0),
             (203, long, "en", "b", 9), (204, "12 34 !!", "en", "a", 2)]
    names = ("__file", "_metadata", "_row", "_text", "size")
    d = spark.createDataFrame([(*r, f"f{r[0]}", {"file_path": "x"}, 1, "t", -1) for r in rows],
                              "doc_id long, text string, lang string, source string, n_chars long, __file string, _metadata map<string,string>, _row int, _text string, size int")
    docs, seen = d, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.scratch_table(stage(spark, docs, str(tmp_path)))
        assert out.columns == d.columns
        got = Counter(r["doc_id"] for r in out.collect())
        if name == "quality_rules":
            assert not {201, 202, 204} & set(got) and got[203] == 1 and got[200] == 2
        if name == "near_duplicates":  # one of the three copies, the least id
            assert got[200] == 1 and got[None] == 0
        if name == "mix_sources":
            assert set(got) <= seen
        assert all(r["__file"] == f"f{r['doc_id']}" and r["size"] == -1 for r in out.select("doc_id", *names).collect())
        docs, seen = out, set(got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == seen and max(r["piece"] for r in packed) > 3
    loads = Counter()
    for r in packed:
        loads[r["sequence_id"]] += r["length"]
    assert max(loads.values()) <= 4096


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, total = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.scratch_table(stage(spark, docs, sf))
        if name != "pack":
            assert out.columns == names
        if name in ("quality_rules", "language_id", "near_duplicates"):
            assert 0 < out.count() <= docs.count()
        if name == "mix_sources":
            total = out.count()
        if name == "pack":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            assert out.where("piece = 0").count() == total
        docs = out
    empty = docs.limit(0)
    assert empty.count() == 0
    blank = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        blank = corpus_pipeline.scratch_table(stage(spark, blank, sf))
    assert blank.count() == 0
