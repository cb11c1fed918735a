"""Operators over the whole corpus, against brute force on small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import embedding_dedup, lm_scoring, mixing, ngram_join, warc
from basketlens.llm.common import bucket, scratch
from basketlens.llm.components import components
from basketlens.llm.shingles import Hasher

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_join(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {k: len(v) for k, v in sets.items()}, smallest_reachable(sets, links)


def check_join(rows, texts):
    sizes, roots = brute_join(texts)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], roots[r.doc_id]), r


def test_join_bears_everything(docs, texts, nothing):
    rows = ngram_join.link(docs).collect()
    assert len(rows) == docs.count()
    check_join(rows, texts)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert ngram_join.link(nothing).count() == 0
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_join(texts)[1].values()) | {None}


def test_join_finds_all_links_between_edited_copies_and_around_a_common_passage(spark):
    random = np.random.default_rng(3)
    word = lambda n: [f"t{x}" for x in random.integers(0, 5000, n)]
    passage, texts = word(60), {}
    for k in range(150):  # strangers that share a passage half as long as they are
        texts[k] = " ".join(word(int(random.integers(30, 50))) + passage + word(int(random.integers(20, 40))))
    for group in range(25):  # copies with edits around the threshold
        body = word(int(random.integers(6, 160)))
        for copy in range(6):
            mine = list(body)
            for at in random.integers(0, len(mine), copy * max(1, len(mine) // 80)):
                mine[at] = f"e{random.integers(0, 10 ** 6)}"
            texts[1000 + group * 10 + copy] = " ".join(mine)
    rows = ngram_join.link(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")).collect()
    check_join(rows, texts)


def test_signatures_never_lose_a_similar_pair():
    """The pigeonhole itself, for sizes where each kind of segment is used."""
    random = np.random.default_rng(5)
    bounds = ngram_join.edges(3000)
    labels = ngram_join.labels_for({k: 500 for k in range(len(bounds))}, bounds)
    assert any(x.doubles for x in labels) and any(x.spare for x in labels)
    band = lambda s: int(np.searchsorted(bounds, len(s), side="right")) - 1
    for _ in range(300):
        size = int(random.integers(5, 1500)) if random.random() < 0.5 else int(random.integers(5, 30))
        one = np.unique(random.integers(0, 1 << 62, size).astype(np.uint64))
        removed, added = (int(x) for x in random.integers(0, size // 8 + 2, 2))
        other = np.unique(np.concatenate([random.permutation(one)[removed:], random.integers(0, 1 << 62, added).astype(np.uint64)]))
        same = len(np.intersect1d(one, other))
        if len(other) and 100 * same >= 80 * (len(one) + len(other) - same):
            owner, key = ngram_join.signatures([one, other], [band(one), band(other)], labels)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()), (len(one), len(other), same)
            both = ngram_join.folded([ngram_join.sketch(one).tobytes(), ngram_join.sketch(other).tobytes()])
            assert ngram_join.may_link(both[:1], np.array([len(one)]), both[1:], np.array([len(other)]))[0, 0]


def test_shingles_match_words():
    h = Hasher()
    a, b = h.sets(["A b c d e f\ng", "a B\tc  d e F g"])
    assert len(a) == 3 and np.array_equal(a, b) and len(h.of("")) == 0 and len(h.of("x")) == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (103, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 103: 100, 105: 100}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_is_the_formula(docs, texts, order):
    one_each = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    tokens = {k: [None, *[w.translate(LOWER) for w in WORD.findall(t or "")], "\n"] for k, t in texts.items()}
    grams = Counter(tuple(x[i - n + 1:i + 1]) for k, x in tokens.items() if k not in held for n in (1, 2, 3) for i in range(len(x)) if i >= n - 1)
    single = Counter({g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] is not None})
    total, kinds = sum(single.values()), len(single)
    n1, n2 = (sum(c == k for c in single.values()) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2)

    def probability(gram):
        if len(gram) == 1:
            return (single[gram[0]] - discount) / total if single[gram[0]] else discount * kinds / total
        seen = grams[gram[:-1]]
        share = 4 * seen ** 0.9 / (seen + 4 * seen ** 0.9) if seen else 1.0
        return (1 - share) * grams[gram] / max(seen, 1) + share * probability(gram[1:])

    for r in lm_scoring.score(one_each, bucket("doc_id", 7) != 2, order=order).collect():
        x = tokens[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x) - 1, sum(single[w] > 0 for w in x[1:]), total)
        assert r.base_score == pytest.approx(sum(math.log10((single[w] + 1) / (total + kinds + 1)) for w in x[1:]))
        assert r.score == pytest.approx(sum(math.log10(probability(tuple(x[max(0, i - order + 1):i + 1]))) for i in range(1, len(x))))
        assert r.train == (r.id not in held)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_counts_followers(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "SHARD_ENTRIES", 64)  # several shards
    random = np.random.default_rng(5)
    texts = {i: "of course " * 30 + " ".join(f"w{int(x)}" for x in random.zipf(1.5, 40) if x < 50) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    tokens = {k: [None, *t.split(), "\n"] for k, t in texts.items()}
    grams = Counter(tuple(x[i - n + 1:i + 1]) for k, x in tokens.items() if k % 5 for n in (1, 2, 3) for i in range(len(x)) if i >= n - 1)
    single = Counter({g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] is not None})
    total, kinds = sum(single.values()), len(single)
    n1, n2 = (sum(c == k for c in single.values()) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    followers = Counter(g[:-1] for g in grams)

    def probability(gram):
        if len(gram) == 1:
            return (single[gram[0]] - discount) / total if single[gram[0]] else discount * kinds / total
        seen, kinds_after = grams[gram[:-1]], followers[gram[:-1]]
        share = kinds_after / (seen + kinds_after) if seen else 1.0
        return (1 - share) * grams[gram] / max(seen, 1) + share * probability(gram[1:])

    assert probability(("of", "course")) > 0.99  # always followed by the same word
    rows = lm_scoring.score(df, F.col("doc_id") % 5 > 0, order=order, heaps=None).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = tokens[r.id]
        assert r.score == pytest.approx(sum(math.log10(probability(tuple(x[max(0, i - order + 1):i + 1]))) for i in range(1, len(x))))


def test_lm_edges(docs, nothing):
    untaught = lm_scoring.score(docs, F.lit(False)).collect()
    assert len(untaught) == docs.count() and {(r.n_known, r.base_score, r.score) for r in untaught} == {(0, 0.0, 0.0)}
    assert lm_scoring.score(nothing, F.lit(True)).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([(1, "a b a c"), (2, "a b b")] + [(i, f"a {w}") for i, w in ((10, "a"), (11, "b"), (12, "c"), (13, "new"))] + [(14, "a")], "doc_id long, text string")
    got = {r.id: r.score for r in lm_scoring.score(rows, F.col("doc_id") < 10).collect()}
    ends = {r.id: r.score for r in lm_scoring.score(spark.createDataFrame([(1, "a b a c"), (2, "a b b"), (14, "a")], "doc_id long, text string"), F.col("doc_id") < 10).collect()}
    assert got[14] == pytest.approx(ends[14]) and all(x < 0 for x in got.values())


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nWARC-Type: x", None), (4, "u", ""), (5, "é", "日本"), (6, "u", "same")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    path = warc.write_archive(df, str(tmp_path / "w"))
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    whole = {r.id: bytes(r.record) for r in warc.records_of(spark, path).collect()}
    for key, _, html in pages:
        head, _, rest = whole[key].partition(b"\r\n\r\n")
        body = (html or "").encode()
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest == (b"" if b"revisit" in head.split(b"\r\n")[1] else body) + b"\r\n\r\n"
        assert f"Content-Length: {len(rest) - 4}".encode() in head
    got = {r.page_id: r for r in warc.archived(df).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 6), 2: ("revisit", 6), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for key, _, html in pages:
        assert got[key].payload_digest == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
        assert got[key].payload_bytes == len((html or "").encode())
    assert {r.page_id for r in warc.archived(df, min_bytes=3).filter("record_type = 'response'").collect()} == {3, 4, 5, 6}
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_damage_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    path = warc.write_archive(df, str(tmp_path / "w"))
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), b"y")], "sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, path).collect()


def brute_links(vectors, threshold=0.95):
    good = {k: np.array(v, dtype=float) for k, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    good = {k: v / np.abs(v).max() for k, v in good.items()}
    unit = {k: v / np.linalg.norm(v) for k, v in good.items()}
    return [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= threshold]


def test_embeddings_recall_and_components(spark):
    random = np.random.default_rng(1)
    points, vectors = random.normal(size=(60, 64)), []
    for i, p in enumerate(points):
        for k in range(int(random.integers(1, 30))):
            vectors.append((i * 100 + k, (p + random.normal(size=64) * random.uniform(0, 0.3)).tolist()))
    vectors += [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None, *[1.0] * 63]), (9006, [float("inf"), *[1.0] * 63]),
                (9007, points[0].tolist()), (9008, points[0].tolist()), (9009, (points[0] * 1e200).tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).repartition(4)
    rows = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    links = brute_links(vectors)
    count = Counter(x for link in links for x in link)
    found = sum(r.n_links for r in rows.values())
    assert len(rows) == len(vectors) and 0.99 * 2 * len(links) <= found <= 2 * len(links)
    assert all(r.n_links <= count[k] for k, r in rows.items()) and all(rows[k].n_links == 0 and rows[k].kept for k in range(9001, 9007))
    exact = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, margin=1.0).collect()}
    roots = smallest_reachable([k for k, _ in vectors], links)
    assert {k: (r.n_links, r.component_id) for k, r in exact.items()} == {k: (count[k], roots[k]) for k, _ in vectors}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.filter("vec_id BETWEEN 9001 AND 9006")).count() == 6


@pytest.mark.parametrize("kind", ["decaying", "rank 4"])
@pytest.mark.parametrize("count", [2000, 8000])
def test_embeddings_recall_along_few_directions(spark, monkeypatch, kind, count):
    monkeypatch.setattr(embedding_dedup, "QUERIES", 1000)
    random = np.random.default_rng(3)
    spread = 1 / np.arange(1, 65) if kind == "decaying" else np.concatenate([np.ones(4), np.full(60, 0.02)])
    points = random.normal(size=(count, 64)) * spread
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "vec_id long, embedding array<double>").repartition(4)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    rows = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    found = np.array([rows[i] for i in range(count)])
    assert (found <= true).all() and true.sum() > count and found.sum() >= 0.999 * true.sum() and (found == true).mean() >= 0.99


def test_embeddings_with_few_links_take_the_exact_margin(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "QUERIES", 50)
    monkeypatch.setattr(embedding_dedup, "MAX_QUERIES", 200)
    random = np.random.default_rng(4)
    points = random.normal(size=(600, 64))
    points[1::60] = points[::60] + 0.04 * points[30::60] * np.linalg.norm(points[::60], axis=1, keepdims=True) / np.sqrt(8)
    vectors = [(i, p) for i, p in enumerate(points.tolist())]
    rows = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    count = Counter(x for link in brute_links(vectors) for x in link)
    assert rows == {k: count[k] for k in rows}


def test_blocks_of_one_large_cell(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    random = np.random.default_rng(2)
    centre = random.normal(size=16)
    vectors = [(i, (centre + 0.1 * random.normal(size=16)).tolist()) for i in range(150)]
    rows = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), margin=1.0).collect()}
    assert rows == {k: n for k, n in ((k, Counter(x for link in brute_links(vectors) for x in link)[k]) for k in range(150))}


def mixed(docs, **targets):
    _, sources = mixing.plan(docs, **targets)
    shown = mixing.mix(docs, **targets)
    return {r["key"]: r for r in sources.collect()}, shown


def test_mixing_meets_its_target(spark):
    rows = [(i, "w " * (i % 9 + 1), "hot" if i % 3 else f"s{i % 12}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    tokens = {i: i % 9 + 1 for i, _, _ in rows}
    for targets in (dict(target_entropy=0.9), dict(target_entropy=None, max_repeats=1.5), dict(target_entropy=0.99, budget=1000)):
        sources, shown = mixed(docs, **targets)
        weights = np.array([r["weight"] for r in sources.values()])
        entropy = -(weights * np.log(weights)).sum() / math.log(len(weights))
        whole = sum(tokens.values())
        assert weights.sum() == pytest.approx(1)
        if targets["target_entropy"]:
            assert entropy == pytest.approx(targets["target_entropy"], abs=1e-4)
        else:
            assert max(r["budget"] / r["t"] for r in sources.values()) == pytest.approx(1.5, abs=0.02)
        got = shown.select("doc_id", "source", "mix.*").collect()
        budget = targets.get("budget", whole)
        for key, r in sources.items():
            mine = [x for x in got if "=" + x.source == key]
            spent = sum(tokens[x.doc_id] for x in mine)
            assert r["budget"] - 9 <= spent <= r["budget"] and r["budget"] == pytest.approx(r["weight"] * budget, abs=1)
            times = Counter(x.doc_id for x in mine)
            assert set(times.values()) <= {r["passes"], r["passes"] + 1}
            # The partial pass is the longest prefix of its order: the next document would not fit.
            assert all(sorted(x.epoch for x in mine if x.doc_id == k) == list(range(n)) for k, n in times.items())
        assert all(0 <= x.block < 100 and 0 <= x.place for x in got)


def test_mixing_bears_everything(docs, nothing):
    shown = mixing.mix(docs, target_entropy=None, max_repeats=10.0)
    assert shown.columns == [*docs.columns, "mix"]
    assert {r.source for r in shown.collect()} >= {"hot", "cold"}
    same = mixing.mix(docs, target_entropy=0.0)  # the shares are flat enough as they are
    assert same.count() == docs.count() and {r.source for r in same.collect()} == {None, "hot", "cold"}
    assert mixing.mix(nothing).count() == 0
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct") if x in plan]


def test_scratch_is_below_the_checkpoint_folder(spark):
    assert scratch(spark, "x").startswith(spark.sparkContext.getCheckpointDir())
