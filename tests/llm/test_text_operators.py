"""Operators 1, 2, 5, 6, 7, 8, 10 on small tables: brute force, edge cases, round trips."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import language, licenses, mixing, ngram_join, packing, quality, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", -1) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = [rng.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    rows = [(0, None, None, "a"), (1, "", "en", "a"), (2, " \t\n", "en", None), (3, long, "en", "b"), (4, " ".join(base), "en", "a"),
            (5, " ".join(near), "de", "b"), (6, " ".join(base), "en", None), (6, " ".join(base), "en", None), (None, "one two three", None, None),
            (8, "x x x x x x x", "fr", "c"), (9, "line a\nline a\nline b\n\nline a", "fr", "c"), (10, "12345 !!! ###", "fr", "c"),
            (11, "Released under the MIT License.\n" + " ".join(base[:40]), "en", "a"), (12, "nul\x0bvt\x0cff nb sp  em", "en", "a")]
    return rows + [(20 + k, " ".join(rng.choice(words) for _ in range(80)), "en", rng.choice("abc")) for k in range(30)]


@pytest.fixture(scope="module")
def edge(spark, edge_rows):
    return make(spark, edge_rows)


# --- 6 ---------------------------------------------------------------------------------------------


def rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i:i + 3])].append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def test_quality_rules(spark, edge, edge_rows):
    got = Counter(tuple(r)[:7] for r in quality.quality(edge).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((i, *rules(t)) for i, t, _, _ in edge_rows)
    assert quality.quality(edge.limit(0)).count() == 0
    kept = quality.reject(edge)
    assert kept.columns == edge.columns
    want = {r["doc_id"] for r in quality.quality(edge).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_host_rates_are_shrunk(spark):
    rows = [("big", i % 10 == 0) for i in range(1000)] + [("tiny", True)] + [("bad", True)] * 200 + [(f"h{k}", k % 5 == 0) for k in range(50) for _ in range(20)]
    r = {x["_host"]: x for x in quality.host_verdicts(spark.createDataFrame(rows, "_host string, _fail boolean")).collect()}
    assert 0.05 < r["big"]["rate"] < 0.2 and r["big"]["good"]
    assert r["tiny"]["rate"] < 1.0 and not r["bad"]["good"] and r["bad"]["rate"] > 0.9


# --- 2 ---------------------------------------------------------------------------------------------


def test_mix(spark, edge, edge_rows):
    out = mixing.mix(edge).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in edge_rows)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(WORD.findall(t or ""))) for i, t, _, _ in edge_rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    again = mixing.mix(edge).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix(edge.limit(0)).count() == 0


def test_mix_targets(spark):
    words = {"s0": 9000, "s1": 50_000, "s2": 700, "s3": 20_000, None: 30_000}
    sizes = spark.createDataFrame(list(words.items()), "_src string, _size long")
    got = {r["_src"]: r["target"] for r in mixing.targets(sizes).collect()}
    total, order = 1.5 * sum(words.values()), ["s0", "s1", "s2", "s3", None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, open_ = {}, set(order)
    while True:
        rate = (total - sum(want.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate >= 2 * words[s]}
        if not full:
            want.update({s: weight[s] * rate for s in open_})
            break
        want.update({s: 2.0 * words[s] for s in full})
        open_ -= full
    assert all(abs(got[s] - want[s]) < 1e-6 * want[s] for s in order)


def test_mix_comes_to_the_target_of_small_sources_too(spark):
    words = {"big": 30_000, "s20": 20, "s40": 40, "s130": 130, "one": 1, "s700": 700, None: 9001}
    rows = [(k * 1000 + j, " ".join(f"w{i}" for i in range(min(97, n - 97 * j))), "en", s)
            for k, (s, n) in enumerate(words.items()) for j in range(-(-n // 97))]
    docs = make(spark, rows)
    total, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        source = list(words)[r["doc_id"] // 1000]
        total[source] += r["taken"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(total[s] - target[s]) <= 0.5 for s in words) and min(total.values()) >= 1
    kept = Counter()
    for r in mixing.mixed_documents(docs).collect():
        kept[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(kept[s] - target[s]) <= 0.5 for s in words)


def test_permutation_reaches_every_block(spark):
    for n in (1, 2, 3, 5, 17, 100, 1000):
        d = spark.range(n).select(mixing._place(F.col("id"), F.lit(n).cast("long"), F.lit(7).cast("long")).alias("p"))
        assert sorted(r["p"] for r in d.collect()) == list(range(n))


def test_shards_hold_what_they_drew(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 64)
    docs = make(spark, [(k, " ".join(f"w{i}" for i in range(40 + k % 90)), "en", "abc"[k % 3]) for k in range(400)])

    def drawn():
        sizes = mixing._sized(docs, "source")
        per = mixing.targets(sizes)
        counts = [r for r in mixing.slot_counts(per).collect()]
        found = {}
        for r in mixing.shards(docs).collect():
            found.setdefault(r["shard"], {}).setdefault(r["place"], []).append((r["source"], r["doc_id"], r["first_word"], r["n_words"]))
        return counts, found

    counts, found = drawn()
    slots = Counter()
    for r in counts:
        slots[r["shard"], r["_src"]] += r["n"]
    got = Counter()
    for shard, places in found.items():
        assert sorted(places) == list(range(len(places))) and len(places) <= 64  # gapless, one source a slot
        for parts in places.values():
            assert len({p[0] for p in parts}) == 1
            got[shard, parts[0][0]] += 1
    assert got == slots  # a shard holds as many slots of a source as it drew
    taken = Counter()
    for places in found.values():
        for parts in places.values():
            for _, doc, _, n in parts:
                taken[doc] += n
    mixed = mixing.mix(docs).collect()
    assert all(taken[r["doc_id"]] == r["taken"] for r in mixed)
    first = {}
    for shard, places in found.items():
        for parts in places.values():
            for _, doc, _, _ in parts:
                first[doc] = min(first.get(doc, shard), shard)
    assert {r["doc_id"]: r["first_shard"] for r in mixed if r["taken"]} == first
    order = [r["doc_id"] for r in mixing.mixed_documents(docs).coalesce(1).collect()]
    monkeypatch.setattr(mixing, "SEED", 99)
    other_counts, other = drawn()
    other_slots = Counter()
    for r in other_counts:
        other_slots[r["shard"], r["_src"]] += r["n"]
    assert other_slots != slots and other != found  # another seed deals other sources to a shard ...
    words = lambda f: Counter(p[0] for places in f.values() for parts in places.values() for p in parts for _ in range(p[3]))
    assert words(other) == words(found)  # ... and every source's total stays
    assert order != [r["doc_id"] for r in mixing.mixed_documents(docs).coalesce(1).collect()]


@pytest.mark.parametrize("names", [("__file", "__place"), ("_metadata", "_row"), ("_ROW", "_Metadata")])
def test_stages_carry_columns_of_any_name(spark, names, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text if k < 3 else f"{text} x{k} " * 2, "en", "a", len(text), f"f{k}", k) for k in range(8)]
    d = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, `{names[0]}` string, `{names[1]}` long")
    d.write.parquet(str(tmp_path / "d"))
    for docs in (d, spark.read.parquet(str(tmp_path / "d"))):
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns and {r["doc_id"]: r[names[0]] for r in kept.collect()}[0] == "f0"
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns and all(r[names[0]] == f"f{r['doc_id']}" for r in mixed.collect())


def test_slots_of_the_mix_are_not_broadcast(spark):
    """The slots that shards draw are as many as the corpus has blocks; the planner takes them for the few counts they come from."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("word "), 400).alias("text"))
    for mixed in (mixing.mix(docs), mixing.mixed_documents(docs)):
        mixed.collect()
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line and "_block" in line]
        assert joins and not any("Broadcast" in line for line in joins)


def test_mixed_documents(spark, edge):
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns
    took = {r["doc_id"]: r["taken"] for r in mixing.mix(edge.where("doc_id <> 6")).collect()}
    got = Counter()
    for r in mixing.mixed_documents(edge.where("doc_id <> 6")).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert abs(sum(got.values()) - sum(took.values())) <= 5 * mixing.BLOCK
    assert mixing.mixed_documents(edge.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------


def test_host_verdicts_by_hand(spark):
    """The beta prior by moments, the shrunk rates and the verdicts, computed in plain Python."""
    hosts = {"good": (40, 2), "bad": (60, 55), "mixed": (30, 17), "tiny": (1, 1), None: (5, 0)}
    good = " ".join(f"word{k}" for k in range(80))
    rows, k = [], 0
    for h, (n, fails) in hosts.items():
        for i in range(n):
            rows.append((k, "short text" if i < fails else good, "en", h))
            k += 1
    got = {}
    for r in quality.quality(make(spark, rows)).join(make(spark, rows).select("doc_id", "source"), "doc_id").collect():
        got.setdefault(r["source"], []).append((r["host_rate"], r["base_failed"], r["kept"]))
    n, f = sum(x for x, _ in hosts.values()), sum(x for _, x in hosts.values())
    rates = [b / a for a, b in hosts.values()]
    m = f / n
    v = sum((r - sum(rates) / 5) ** 2 for r in rates) / 5 - m * (1 - m) * sum(1 / a for a, _ in hosts.values()) / 5
    strength = max(m * (1 - m) / v - 1, 1.0)
    for h, (a, b) in hosts.items():
        rate = (b + m * strength) / (a + strength)
        assert all(abs(r - rate) < 1e-9 and kept == (not failed and rate <= 0.5) for r, failed, kept in got[h])
    assert any(x[2] for x in got["good"]) and not any(x[2] for x in got["bad"])


# --- 5 ---------------------------------------------------------------------------------------------


def test_packing(spark, edge, edge_rows):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    tok = Tokenizer.from_file(path)
    out = packing.pack(packing.pieces(edge, path)).collect()
    want = Counter()
    for i, t, _, _ in edge_rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s:s + 4096]
            want[(i, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in out) // 4096) + 1
    assert packing.pack(packing.pieces(edge.limit(0), path)).count() == 0


def test_token_ids_equal_the_tokenizer():
    rng = random.Random(2)
    ids = packing.TokenIds(packing.vocabulary_path())
    odd = ["don't 'RE", "İΣ ς", "a\x1cb\x85c", "<|endoftext|> x", "½ ª º 12", "ﬁ é", "", " ", "日本語 text", "é" * 300]
    odd += ["".join(chr(rng.choice([*range(32, 127), *range(0xA1, 0x250), 9, 10])) for _ in range(80)) for _ in range(200)]
    for t in odd:
        assert ids(t) == np.asarray(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_parts_of_a_block_are_encoded_once(monkeypatch):
    """A word with other punctuation behind it is not encoded anew, in its own text or in later blocks."""
    from types import SimpleNamespace

    monkeypatch.setattr(packing, "BLOCK_CHARS", 60)
    ids, seen = packing.TokenIds(packing.vocabulary_path()), []
    real = ids.tokenizer
    counted = SimpleNamespace(tokenize=lambda part: seen.append(part) or real.model.tokenize(part))
    ids.tokenizer = SimpleNamespace(model=counted, encode=real.encode)
    texts = ["Zqxab zqxab, zqxab.", "", "  zqxab%%%\tdon't 'tis zqxab's x1y2", "日本 zqxab", "zqxab" * 20, "zqxab, ÉTÉ!"] * 3
    want = [np.asarray(real.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ids.many(texts)) == want
    assert "zqxab" in seen and all(n == 1 for p, n in Counter(seen).items() if len(p) <= 64) and list(ids.many([])) == []


def test_crossover_keeps_every_piece():
    rng = random.Random(3)
    sizes = [rng.randint(1, 4095) for _ in range(300)]
    a, b = (packing.best_fit(sizes, packing.descending(sizes, list(range(300)), rng, 0.3), 4096, packing.Bins([], [])) for _ in range(2))
    c = packing.crossover(a, b, sizes, 4096, rng)
    assert sorted(i for x in c.items for i in x) == list(range(300))
    assert all(sum(sizes[i] for i in x) == load <= 4096 for x, load in zip(c.items, c.loads, strict=True))


# --- 7 ---------------------------------------------------------------------------------------------


def test_language(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    out = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("acc"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["acc"] > 0.95 and 0 <= r["lo"] and r["hi"] <= 1
    held = {r["doc_id"]: r["held_out"] for r in language.identify(docs, model).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    e = language.identify(edge, model).collect()
    und = {r["doc_id"] for r in e if r["lang_pred"] == "und"}
    assert und == {0, 1, 2, 10} and len(e) == edge.count()
    assert language.identify(edge, None).where("lang_pred <> 'und'").count() == 0
    assert language.reject(edge.limit(0)).count() == 0
    kept = language.reject(edge)
    assert kept.columns == edge.columns and not und & {r["doc_id"] for r in kept.collect()}


def test_language_tables_equal_the_convolution():
    rng = np.random.default_rng(4)
    model = language.ByteNetwork(["a", "b", "c"])
    x = rng.integers(0, 256, (37, language.WINDOW), dtype=np.uint8)
    pooled, _ = model._pooled(x)
    logits = np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    assert np.abs(model.window_probabilities(x, model.tables()) - p / p.sum(1, keepdims=True)).max() < 1e-5


def test_language_sample_is_bounded_with_hot_texts_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_DOCS", 20)
    monkeypatch.setattr(language, "MAX_LANGS", 5)
    rows = [(k, "the same words again and again " * 3, "en", "a") for k in range(3000)]  # copies are one text
    rows += [(10_000 + k, f"text number {k} of many other ones", "en", "a") for k in range(300)]
    rows += [(20_000 + k, f"texte numéro {k}", f"l{k % 40:02}", "a") for k in range(2000)]
    x, y, langs = language.training_windows(make(spark, rows))
    known = Counter(lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert langs == sorted(sorted(known, key=lambda lang: (-known[lang], lang))[:5]) and len(x) == len(y)
    assert np.bincount(y).tolist() == [20 * language.TRAIN_WINDOWS] * 5
    again = language.training_windows(make(spark, rows[::-1]))
    assert (x == again[0]).all() and (y == again[1]).all()


# --- 8 ---------------------------------------------------------------------------------------------


def brute_links(rows):
    sets = []
    for i, t in rows:
        w = tuple((t or "").encode().split())
        sets.append((i, w, frozenset(w[k:k + 5] for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return [sum(1 for j, (_, w2, s2) in enumerate(sets) if j != i and s and s2 and len(s & s2) >= 0.8 * len(s | s2) - 1e-9) for i, (_, w, s) in enumerate(sets)]


def test_ngram_join(spark, edge, edge_rows):
    out = ngram_join.join(edge).collect()
    assert len(out) == len(edge_rows)
    want = brute_links([(i, t) for i, t, _, _ in edge_rows])
    assert Counter((r["doc_id"], r["n_links"]) for r in out) == Counter((i, n) for (i, _, _, _), n in zip(edge_rows, want, strict=True))
    of = {r["doc_id"]: r["class_id"] for r in out}
    assert of[4] == of[5] == of[6] == 4 and of[0] == 0 and of[1] == 1 and of[None] is None
    assert ngram_join.join(edge.limit(0)).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in edge_rows if i not in (5, 6))


def test_ngram_join_of_a_crowded_group(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "a"))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)  # many blocks
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    out = {r["doc_id"]: r["n_links"] for r in ngram_join.join(make(spark, rows)).collect()}
    assert out == dict(enumerate(brute_links([(i, t) for i, t, _, _ in rows])))


def test_ngram_join_of_long_texts_with_an_empty_block(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(8):  # pairs of near copies; about half of them lie in one block of two
        base = [f"p{k}w{i}" for i in range(300)]
        near = list(base)
        near[rng.randrange(300)] = "other"
        rows += [(2 * k, " ".join(base), "en", "a"), (2 * k + 1, " ".join(near), "en", "a")]
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    out = ngram_join.join(make(spark, rows)).collect()
    assert {(r["doc_id"], r["n_links"], r["text_links"], r["class_id"]) for r in out} == {(i, 1, 1, i - i % 2) for i in range(16)}


def test_ngram_join_finds_lone_pairs_at_the_threshold_asked_for(spark):
    for s in (0.4, 0.6, 0.8, 0.95):
        assert (1 - s ** ngram_join.prefix_depth(s)) ** ngram_join.TREES <= 1e-4 and ngram_join.candidate_cut(s) < s
    with pytest.raises(ValueError):
        ngram_join.prefix_depth(0.05)
    rows = []
    for k in range(60):  # lone pairs of a Jaccard similarity of 100 / 196
        same = " ".join(f"p{k}s{i}" for i in range(104))
        rows += [(2 * k + c, same + " " + " ".join(f"p{k}c{c}w{i}" for i in range(48)), "en", "a") for c in range(2)]
    out = ngram_join.join(make(spark, rows), 0.5).collect()
    assert {r["n_links"] for r in out} == {1} and len({r["class_id"] for r in out}) == 60


def test_prefixes_are_shortened_where_the_node_stays_small(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(120):  # a crowd of near copies and many texts of their own
        w = list(base)
        for _ in range(rng.randint(1, 30)):
            w[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "a"))
    rows += [(1000 + k, " ".join(f"o{rng.randrange(10**6)}" for _ in range(60)), "en", "b") for k in range(80)]
    monkeypatch.setattr(ngram_join, "CROWD", 10)
    docs = make(spark, rows)
    reps = ngram_join.signatures(docs.select("doc_id", "text"), ["doc_id"])
    full = ngram_join.prefix_depth()
    labels = {r["uid"]: np.frombuffer(r["labels"], np.uint32).reshape(ngram_join.TREES, ngram_join.DEPTH) for r in reps.collect()}
    got = defaultdict(set)
    for r in ngram_join.matched_prefixes(reps).collect():
        got[r["node"]].add(r["uid"])
    want = Counter()
    for t in range(ngram_join.TREES):  # the same descent, node by node
        todo = [(full - ngram_join.SHORTEN, list(labels))]
        while todo:
            d, uids = todo.pop()
            nodes = defaultdict(list)
            for u in uids:
                nodes[labels[u][t, :d].tobytes()].append(u)
            for members in nodes.values():
                if len(members) > 10 and d < full:
                    todo.append((d + 1, members))
                elif len(members) > 1:
                    want[frozenset(members)] += 1
    assert Counter(map(frozenset, got.values())) == want and any(len(u) > 10 for u in got.values())
    out = {r["doc_id"]: r["n_links"] for r in ngram_join.join(docs).collect()}
    assert out == dict(zip([i for i, *_ in rows], brute_links([(i, t) for i, t, _, _ in rows]), strict=True))


def test_word_hashes_follow_the_words(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("ab \n\té") for _ in range(5000)).encode()
    known = {}
    whole = ngram_join.word_hashes(text)
    for w, h in zip(text.split(), whole.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 64)
    assert (ngram_join.word_hashes(text) == whole).all()


# --- 1, 10 -----------------------------------------------------------------------------------------


def brute_tokens(word, scores, byte):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        options = [(best[e - 1][0] + n * byte, -(best[e - 1][1] + n))]
        options += [(best[s][0] + scores[word[s:e]], -(best[s][1] + 1)) for s in range(e) if word[s:e] in scores]
        total, tokens = max(options)
        best.append((total, -tokens))
    return best[-1][1]


def test_token_counts(spark, edge, edge_rows, monkeypatch):
    path = token_counts.vocabulary_path()
    scores, byte = token_counts.scores_of(path)
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(edge, path).collect()}
    for i, t, _, _ in edge_rows:
        words = [w.decode() for w in (t or "").encode().split()]
        counted = {w: brute_tokens("▁" + w, scores, byte) for w in set(words)}
        assert got[i] == (len(words), sum(counted[w] for w in words))
    trie = token_counts.UnigramTrie(scores, byte)
    some = ["▁hello", "▁help", "▁日本語", "▁" + "ab" * 300, "▁éèê"]
    first = [trie.count(w) for w in some]
    assert first == [brute_tokens(w, scores, byte) for w in some] and trie._long(some[3]) == first[3]
    assert token_counts.token_counts(edge.limit(0), path).count() == 0


def test_license_scan(spark, edge):
    text = {n: t for n, t in licenses.TEMPLATES}
    rng = random.Random(6)
    filler = lambda n: " ".join(f"f{rng.randrange(999)}" for _ in range(n))
    words = text["BSD-3-Clause"].split()
    changed = " ".join(words[:-1] + ["differ"])  # one shingle of 17 goes
    rows = [(100 + k, f"{filler(30)}\n{t.upper()}\n{filler(20)}", "en", "a") for k, t in enumerate(text.values())]
    rows += [(200, filler(10) + " " + changed, "en", "a"), (201, " ".join(words[:9]), "en", "a"), (202, None, "en", "a"), (203, "", "en", "a")]
    out = licenses.scan(make(spark, rows)).collect()
    found = defaultdict(set)
    for r in out:
        found[r["doc_id"]].add(r["license"])
    for k, name in enumerate(text):
        assert name in found[100 + k]
    assert found[200] == {"BSD-3-Clause"} and not {201, 202, 203} & set(found)
    assert {(r["doc_id"], r["first_word"]) for r in out if r["doc_id"] == 200} == {(200, 9)}  # windows at 9 and 10 hold 16 of 17: the first
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(edge).collect()} == {(11, "MIT")}
    assert licenses.scan(edge.limit(0)).count() == 0


def best_containment(text, template, widen):
    """Brute force: for every place of a text the share of the template's shingles in the widened stretch there."""
    clean = lambda t: [re.sub(r"^[^\w]+|[^\w]+$", "", w) or w for w in t.lower().split()]
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    have, want = sh(clean(text)), set(sh(clean(template)))
    m = len(want)
    more = -(-m * widen // 1)
    return max((len(want & set(have[max(0, int(i - more)) : int(i + m + more)])) / m for i in range(len(have))), default=0)


def test_license_scan_with_inserted_words_and_two_places(spark):
    mit = dict(licenses.TEMPLATES)["MIT-text"]
    rng = random.Random(12)
    filler = lambda n: " ".join(f"f{rng.randrange(9999)}" for _ in range(n))
    w = mit.split()
    inserted = lambda n: " ".join([*w[: len(w) // 2], filler(n), *w[len(w) // 2 :]])
    texts = {0: inserted(40), 1: filler(70) + " " + inserted(20) + " " + filler(30), 2: mit + " " + filler(500) + " " + mit, 3: mit + "\n" + mit,
             4: " ".join(x if k % 12 else "changed" for k, x in enumerate(w)), 5: " ".join(w[: len(w) // 2]), 6: inserted(400)}
    texts |= {10 + k: " ".join(x for x in w if rng.random() > k / 400) for k in range(12)}
    rows = licenses.scan(make(spark, [(i, t, "en", "a") for i, t in texts.items()]), (("MIT-text", mit),)).collect()
    found = {r["doc_id"]: r["containment"] for r in sorted(rows, key=lambda r: r["containment"])}
    for i, t in texts.items():
        share = best_containment(t, mit, licenses.WIDEN)
        assert (i in found) == (share >= 0.8), (i, share)
        assert i not in found or abs(found[i] - share) < 0.03
    assert {0, 1, 2, 3} <= set(found) and not {5, 6} & set(found)
    at = lambda i: sorted(r["first_word"] for r in rows if r["doc_id"] == i)
    n = len(w)
    assert len(at(2)) == 2 and at(2)[0] == 0 and abs(at(2)[1] - (n + 500)) <= 3
    assert len(at(3)) == 2 and abs(at(3)[1] - n) <= 8 and len(at(0)) == len(at(1)) == 1


def test_license_scan_finds_short_notices_and_whole_texts(spark):
    text = dict(licenses.TEMPLATES)
    rng = random.Random(9)
    filler = " ".join(f"f{rng.randrange(999)}" for _ in range(50))
    part = " ".join(text["MPL-2.0-text"].split()[:1500])  # well under the share that counts
    gone = " ".join(w for i, w in enumerate(text["GPL-2.0-text"].split()) if i % 50)  # about a tenth of the shingles goes
    rows = [(0, filler + "\nAll rights reserved.\n" + filler, "en", "a"), (1, filler + " " + text["ISC-text"], "en", "a"),
            (2, part, "en", "a"), (3, filler + " " + gone, "en", "a"), (4, "all rights", "en", "a")]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(make(spark, rows)).collect()}
    assert {(0, "All-rights-reserved"), (1, "ISC-text"), (3, "GPL-2.0-text")} <= found
    assert (2, "MPL-2.0-text") not in found and not any(i == 4 for i, _ in found)
    with pytest.raises(ValueError):
        licenses.scan(make(spark, rows), (("none", " "),))
