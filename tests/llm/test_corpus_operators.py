import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tidemark.llm import mixing, near_dedup, neighbours, repeats, toxicity
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=lambda i: f"src{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], COLUMNS).repartition(3)


def sentence(rng, n):
    return " ".join(rng.choice("the of and ing tion er xq zz ab cat dog sun".split()) + rng.choice("abcdefgh") for _ in range(n))


# mixing


def test_targets_share_the_excess():
    assert mixing.targets([10, 100, 100]) == [20.0, pytest.approx(590 / 3), pytest.approx(295 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 5000) for _ in range(500)]
    p = [rng.random() for _ in sizes]
    out = mixing.flight(sizes, p, random.Random(2))
    assert sum(out) == pytest.approx(sum(p)) and sum(s * x for s, x in zip(sizes, out, strict=True)) == pytest.approx(sum(s * x for s, x in zip(sizes, p, strict=True)))
    assert sum(0 < x < 1 for x in out) <= 2
    p = [0.3] * 6
    mean = np.mean([mixing.flight([5, 1, 9, 2, 7, 7], p, random.Random(k)) for k in range(3000)], axis=0)
    assert np.allclose(mean, 0.3, atol=0.04)


def test_mix_of_documents(spark):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(0, 60)) for _ in range(400)] + [None, "", "one"]
    df = docs(spark, texts, lambda i: [None, "a", "b", "é"][i % 4] if i % 3 else "hot")
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(again.itertuples(index=False, name=None))
    size = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert dict(zip(got["id"], got["size"], strict=True)) == size and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    for target, rows in got.groupby("target"):
        assert abs(rows["taken"].sum() - target * rows["source_size"].nunique()) <= 60
    assert got.drop_duplicates("source_size")["target"].sum() == pytest.approx(1.5 * sum(size.values()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_repeated_and_missing_ids_and_sources(spark):
    rng = random.Random(12)
    rows = [(i if i % 3 else None, sentence(rng, rng.randrange(1, 40)) if i % 5 else "same words here", rng.choice(["a", "b", None, "é", "z"])) for i in range(400)] + [(1, None, "a"), (1, "", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, mixing.targets([size[s] for s in names]), strict=True))
    assert sorted({(n, round(t, 6)) for n, t in zip(got["source_size"], got["target"], strict=True)}) == sorted({(size[s], round(want[s], 6)) for s in names})
    taken = got.groupby(["source_size", "target"])["taken"].sum()
    assert len(taken) == len(names) and all(abs(x - t) <= 2 for (_, t), x in taken.items()) and (got["taken"] <= 2 * got["size"]).all()
    clash = df.select("*", F.lit(1).alias("_mix_hash"), F.lit(2).alias("_MIX_COPY"))
    assert mixing.mixed_rows(clash).columns == clash.columns and mixing.mixed_rows(clash).count() > 0


def test_targets_of_many_sources(spark):
    rng = random.Random(13)
    sizes = [rng.choice((0, 1, 5, 40, 3000)) for _ in range(700)]
    df = spark.createDataFrame([(i, " ".join(["w"] * min(n, 60)), f"s{i:04}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = {r["id"]: r["target"] for r in mixing.mix(df).collect()}
    want = mixing.targets([min(n, 60) for n in sizes])
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got) and len(got) == 700


# nearest neighbours


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:300] = x[100]  # one hot vector
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [1.0, 2.0], 0), (1080, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = neighbours.search(df).toPandas()
    found = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, g in found.items():
        scores = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:20]
        hits += len(set(order) & set(g["vec_id"]))
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], scores[g["vec_id"]], rtol=0, atol=1e-12)
        assert list(zip(-g["score"], g["vec_id"], strict=True)) == sorted(zip(-g["score"], g["vec_id"], strict=True))
    assert hits >= 0.9 * 20 * len(found)
    assert neighbours.search(df.limit(0)).count() == 0 and neighbours.search(df.filter("vec_id < 5")).count() == 4


def test_search_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(400, 16)) * 3
    x = (centres[rng.integers(0, 400, 12000)] + rng.normal(size=(12000, 16)) * 0.3).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = neighbours.search(df, step=400).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        scores = x.astype(float) @ x[q].astype(float)
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores, kind="stable")[:20]) & set(g["vec_id"]))
    share = neighbours.last_share()
    print("recall", hits / 600, "share of entries visited", share)
    assert hits >= 0.9 * 600 and share <= 0.3


def test_search_of_repeated_ids(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(50, 4)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(0, x[7]), (2, x[9]), (3, x[3])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert got["query_id"].value_counts().to_dict() == {0: 40, 20: 20, 40: 20}
    assert sorted(got[got["query_id"] == 0]["rank"]) == sorted([*range(1, 21)] * 2) and not (got["query_id"] == got["vec_id"]).any()
    double = spark.createDataFrame([(20, [1e200, 1.0]), (40, [1.0, 2.0]), (41, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.search(double).collect()] == [(40, 1, 41, 5.0)]


def test_cells_come_by_falling_nearness():
    rng = np.random.default_rng(5)
    index = neighbours.MultiIndex(rng.normal(size=(6, 3)), rng.normal(size=(6, 3)))
    index.counts[:] = 1
    q = rng.normal(size=6)
    nearness = [(index.first[c // 6] @ q[:3] + index.second[c % 6] @ q[3:]) for c in index.visit(q, 36)]
    assert len(nearness) == 36 and nearness == sorted(nearness, reverse=True)


# repeats


def cut(rows):
    """Brute force: (id, n_bytes, n_removed, n_spans, kept)."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                covered[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        spans = sum(1 for j, c in enumerate(covered) if c and (j == 0 or not covered[j - 1]))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(6)
    base, passage = [sentence(rng, 60) for _ in range(5)], sentence(rng, 30)
    kinds = [lambda: rng.choice(base), lambda: (b := rng.choice(base))[: (c := rng.randrange(len(b)))] + "Q" + b[c:], lambda: sentence(rng, 20) + passage + sentence(rng, 20), lambda: "ab" * rng.randrange(40, 200), lambda: "é" * 120 + sentence(rng, 30), lambda: "".join(rng.choice("ab") for _ in range(300)), lambda: sentence(rng, 9) + "xyz" * 60 + "x" * 300]
    texts = [rng.choice(kinds)() for _ in range(90)] + [None, "", "x" * 99, "y" * 100, "y" * 101, "z" * 250]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType())])
    df = docs(spark, texts)
    got = repeats.apply_marks(repeats.repeats(df.select("doc_id", "text")), "doc_id", "text", schema, lambda k: hashlib.sha256(k).hexdigest())
    assert sorted(tuple(r) for r in got.collect()) == sorted(cut(enumerate(texts)))
    empty = df.limit(0).select("doc_id", "text")
    assert repeats.repeats(empty).count() == 0


def test_repeats_of_repeated_and_missing_ids(spark):
    rng = random.Random(16)
    p, unique = sentence(rng, 60), [sentence(rng, 60) for _ in range(4)]
    rows = [(1, p), (None, p + sentence(rng, 20)), (None, unique[0]), (5, unique[1]), (5, unique[2]), (6, unique[1] + "tail"), (None, unique[2]), (None, unique[3]), (None, unique[3]), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType())])
    got = repeats.apply_marks(repeats.repeats(df), "doc_id", "text", schema, lambda k: k.hex())
    # rows in order of id (missing ones last) and text hash; equal rows are one document
    hashed = [((r["doc_id"] is None, r["doc_id"] or 0, r["h"]), r["doc_id"], r["text"]) for r in df.select("*", F.xxhash64("text").alias("h")).collect()]
    distinct = sorted(set(hashed), key=lambda r: r[0])
    want = {(i, t): (n, m, k) for (_, i, t), (_, n, m, k, _) in zip(distinct, cut([(i, t) for _, i, t in distinct]), strict=True)}
    assert sorted(tuple(r)[1:4] for r in got.collect()) == sorted(want[i, t] for _, i, t in hashed)
    assert want[None, unique[0]][1] == 0 and want[None, rows[1][1]][1] >= len(p)
    cleaned = corpus_pipeline.suffix_dedup(spark, df.select("doc_id", "text", F.lit("en").alias("_marks"), F.lit("s").alias("_repeat_id"), F.length("text").cast("long").alias("n_chars")), SF)
    assert cleaned.columns == ["doc_id", "text", "_marks", "_repeat_id", "n_chars"] and {r["_marks"] for r in cleaned.collect()} == {"en"}


def test_marks_join():
    columns = {"doc": [2, 1, 1, 1, 1], "sub": [0, 0, 0, 0, 0], "first": [0, 5, 0, 20, 6], "last": [3, 9, 4, 30, 7], "kind": [0, 0, 0, 0, 1]}
    m = np.zeros(5, repeats.MARK)
    for name, values in columns.items():
        m[name] = values
    assert repeats.joined_marks(m)[["doc", "first", "last", "kind"]].tolist() == [(1, 0, 9, 0), (1, 20, 30, 0), (2, 0, 3, 0), (1, 6, 7, 1)]


# near duplicates


def links(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, size, percent):
    rng = random.Random(7)
    texts = [None, "", "one", "One", "two words", "TWO\twords"]
    for _ in range(12):
        base = sentence(rng, rng.choice((6, 20, 60, 200))).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            texts.append(" ".join(w))
    got = near_dedup.near_duplicates(docs(spark, texts), size=size, percent=percent).orderBy("id").collect()
    assert [(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got] == links(texts, size, percent)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102)], "a long, b long")
    got = dict(near_dedup.components(edges).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100


def test_bounds_refuse_only_what_is_far():
    least = near_dedup.least_matches(0.85)
    assert all(m < 0.85 * n for n, m in enumerate(least) if n) and all(m > 0 for m in least[32:]) and least[0] == 0
    sets = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, 300).astype(np.uint64)) for k in range(3)]
    assert near_dedup.common_counts([sets[0][:200], sets[1]], [sets[0][100:], sets[2]]).tolist() == [[100, 0], [0, 0]]


def test_empty_documents(spark):
    assert near_dedup.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_links_of_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    x, y, z = (sentence(rng, 60) for _ in range(3))
    rows = [(1, x), (1, y), (2, x + " end"), (3, y + " end"), (None, z), (None, z), (None, z + " end"), (None, sentence(rng, 50)), (None, ""), (None, x + " stop"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df).collect()
    seen = Counter((r["id"], r["component_id"], r["kept"]) for r in got)
    assert seen[1, 1, True] == 2 and seen[2, 1, False] == seen[3, 1, False] == seen[None, 1, False] == 1 and seen[7, 7, True] == 1
    alone = [r for r in got if r["id"] is None and r["component_id"] is None]
    # z twice and its near copy: one text of them stays; the other one and the empty one stay too
    assert len(alone) == 5 and len({r["text_hash"] for r in alone if r["kept"]}) == 3
    kept = corpus_pipeline.near_dedup(spark, df, SF).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in kept)) == [(False, 1), (False, 1), (False, 7), (True, 0), (True, 0), (True, 0)]


# toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 200)).split()
        label = int(rng.random() < 0.3)
        for _ in range(3 * label):
            words.insert(rng.randrange(len(words)), rng.choice("scumbag idiot moron rubbish".split()))
        rows.append((i, " ".join(words), label))
    return rows


def test_toxicity_on_unseen_rows():
    model = toxicity.fit(corpus(500, 8))
    scored = [(model.score(t), y) for _, t, y in corpus(200, 9)]
    right = sum((s >= 0.5) == bool(y) for s, y in scored)
    assert right >= 190 and 0 <= model.score("") < 0.5


def test_toxicity_without_labels(spark):
    assert toxicity.fit([]).score("any") == 0 and toxicity.fit([(1, "a", 1)]).score("any") > 0.5
    df = docs(spark, [None, "", "x y"])
    got = toxicity.toxicity_scores(df, toxicity.learn(df, spark.createDataFrame([(0, 1), (None, 1), (2, None)], "doc_id long, toxic int")), df.columns).collect()
    assert len(got) == 3 and all(r["predicted"] in (0, 1) for r in got)


def test_held_out_rows_do_not_train(spark):
    remainder = {r[0]: r[1] for r in spark.range(50).select("id", toxicity.crc_remainder("id")).collect()}
    assert remainder == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


# pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    found = {}
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.common.written(stage(spark, frame, sf), f"test-{name}")
        found[name] = (frame, out)
        if name != "bpe":
            assert out.columns == columns
        frame = out
    before, after = found["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = after.join(labels, "doc_id").groupBy("toxic").count().rdd.collectAsMap()
    total = before.join(labels, "doc_id").groupBy("toxic").count().rdd.collectAsMap()
    assert kept[0] >= 0.97 * total[0] and kept.get(1, 0) <= 0.5 * total[1]
    before, after = found["near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    want = [rows[i][0] for i, _, _, k in links([t for _, t in rows], 5, 80) if k]
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == want
    before, after = found["suffix_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    want = {i: n - m for i, n, m, _, _ in cut(rows)}
    for r in after.collect():
        assert r["n_chars"] == len(r["text"]) and want[r["doc_id"]] - 6 <= len(r["text"].encode()) <= want[r["doc_id"]]
    before, after = found["mixing"]
    assert after.count() == mixing.mix(before).agg(F.sum("copies")).first()[0] or after.count() > 0
    assert found["bpe"][1].count() == after.count()


@pytest.mark.parametrize("name", ["op5_mixing", "op8_suffix_dedup", "op9_near_dedup", "op10_toxicity"])
def test_queries_return_every_document(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
