import hashlib
import re

import numpy as np
import pytest
from llm_samples import HARD
from pyspark.sql import functions as F
from test_sharding_mix import targets
from test_text_ops import brute_components

import corpus_pipeline
from siltstone.llm import cotrain, cover_tree, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, d", [(700, 2), (700, 6), (300, 64), (1, 3), (40, 1)])
def test_tree_covers_and_separates(n, d):
    x = np.floor(np.random.default_rng(0).normal(0, 60, (n, d)))
    t = cover_tree.Tree(x, leaf=8)
    assert sorted(t.order.tolist()) == list(range(n)) and (t.x == x[t.order]).all()
    far = lambda rows, p: np.sqrt(((rows - p) ** 2).sum(1))
    for node in range(len(t.lo)):
        rows = t.x[t.lo[node] : t.hi[node]]
        assert abs(far(rows, rows[0]).max() - t.radius[node]) < 1e-6
        kids = t.below(np.array([node]))
        if len(kids):
            assert t.lo[kids].tolist() == [t.lo[node], *t.hi[kids][:-1]] and t.hi[kids][-1] == t.hi[node]
            assert t.radius[kids].max() <= t.radius[node] / cover_tree.BASE + 1e-6
            centres = t.x[t.lo[kids]]
            assert all(far(centres[:i], centres[i]).min() > t.radius[node] / cover_tree.BASE - 1e-6 for i in range(1, len(kids)))
        else:
            assert len(rows) <= 8 or t.radius[node] == 0


def test_clusters_are_pruned():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (40, 64))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 3, (4000, 64)))
    ids = np.arange(4000)
    q = ids % 50 == 0
    search = cover_tree.Search(cover_tree.Tree(x[q]), ids[q], 5)
    for part in (slice(0, 2000), slice(2000, 4000)):
        search.meet(cover_tree.Tree(x[part]), ids[part])
    s = x[q] @ x.T
    s[ids[q][:, None] == ids] = -np.inf
    assert (search.result()[1] == np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]).all()
    assert search.compared < 0.15 * q.sum() * 4000 and search.bounded < 0.25 * q.sum() * 4000


def test_dual_search_against_brute_force():
    rng = np.random.default_rng(1)
    for n, d in ((1, 3), (5, 4), (300, 2), (900, 16)):
        x = np.floor(rng.normal(0, 20, (n, d)))
        x[n // 2 :] = x[: n - n // 2]  # copies: ties
        ids = rng.permutation(n)
        q = np.flatnonzero(ids % 7 == 0)
        if not len(q):
            continue
        score, got = cover_tree.dual_search(cover_tree.Tree(x[q], 8), cover_tree.Tree(x, 8), ids[q], ids, 5)
        both = cover_tree.Search(cover_tree.Tree(x[q], 8), ids[q], 5)
        for part in (slice(0, n // 3), slice(n // 3, n)):
            both.meet(cover_tree.Tree(x[part], 8), ids[part])
        assert (both.result()[1] == got).all() and (both.result()[0] == score).all()
        for r, i in enumerate(q):
            s = x @ x[i]
            order = sorted((-s[j], ids[j]) for j in range(n) if j != i)[:5]
            assert got[r][: len(order)].tolist() == [o[1] for o in order] and score[r][: len(order)].tolist() == [-o[0] for o in order]


def test_top_k_hard_rows(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.5, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, [1.0, 0.5]), (7, []), (100, [2.0]), (None, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in cover_tree.top_k(d, d.where("vec_id % 50 = 0"), 5).collect()}
    assert got == {(0, 1): (6, 256 * 256 + 128 * 128), (0, 2): (50, 256 * 128 * 2), (50, 1): (0, 65536), (50, 2): (6, 65536), (100, 1): (5, 2 * 65536)}
    assert cover_tree.top_k(d.limit(0), d.limit(0), 5).count() == 0


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    out = cotrain.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), labels.where("doc_id % 4 <> 0"), model=cotrain.train(docs, labels.where("doc_id % 4 <> 0"))).join(held, "doc_id").toPandas()
    assert ((out.quality_score >= 0.5) == (out.quality == 1)).mean() > 0.97
    toxic = out.toxic == 1
    assert (~out.kept[toxic]).mean() > 0.9 and out.kept[(out.quality == 1) & ~toxic].mean() > 0.97


def test_classifier_hard_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, 1), (5, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    d = docs(HARD).withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang"))).withColumn("kept", F.lit("clash"))
    out = cotrain.score(d, labels)
    assert out.count() == len(HARD) and out.where("quality_score BETWEEN 0 AND 1 AND toxic_score BETWEEN 0 AND 1").count() == len(HARD)
    assert cotrain.score(docs([]), labels).count() == 0
    assert cotrain.score(docs(HARD), labels.limit(0)).count() == len(HARD)


def brute_windows(text, n=8):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(0, len(w) - n + 1))}, tuple(w)


def brute_mix(rows):
    """Copies of each (doc_id, text, source): whole ones, then the rank prefix nearest to the rest."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    want, out = targets(total), {}
    for s in total:
        ratio = want[s] / total[s]
        whole, rest = int(ratio), want[s] - int(ratio) * total[s]
        p = rest / total[s]
        u = lambda i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        ranked = sorted((u(i) / (1 - u(i)) / (p / (1 - p)) if p > 0 else 0, i, size(t)) for i, t, x in rows if x == s)
        upto = 0
        for _, i, n in ranked:
            upto += n
            out[i] = whole + (p > 0 and 2 * upto - n <= 2 * rest) if n else 0
    return out


def brute_shards(rows, n=8):
    order = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), i, len((t or "").encode()) + 1) for i, t in rows)
    total, before, out, slots = sum(o[2] for o in order), 0, [], {}
    group, begins = {}, {}
    for k, _, b in order:
        group[k] = group.get(k, 0) + b
        begins.setdefault(k, min(n - 1, before * n // total))
        before += b
    before = 0
    for k, i, b in order:
        # A group of equal texts stays in the shard where it begins unless it is a large part of one.
        s = begins[k] if group[k] * n * 128 <= total else min(n - 1, before * n // total)
        out.append((i, s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        before += b
    return sorted(out)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, got = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == names or stage is corpus_pipeline.shard
        got.append(rows)
        docs = spark.createDataFrame(rows, out.schema)
    quality, near, clean, mixed, sharded = got
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in quality}
    assert sum(i in left for i, r in labels.items() if r["quality"] and not r["toxic"]) >= 0.9 * sum(bool(r["quality"] and not r["toxic"]) for r in labels.values())
    comp = brute_components([(r["doc_id"], r["text"]) for r in quality], 5, 80)
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, (_, c) in comp.items() if i == c)
    items = [brute_windows(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = set().union(*(g for g, _ in items))
    assert all(len(w) >= 8 for _, w in items)
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in near if not brute_windows(r["text"])[0] & grams)
    copies = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in clean])
    assert sorted(r["doc_id"] for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharded) == brute_shards([(r["doc_id"], r["text"]) for r in mixed])
    assert {c for r in sharded for c in r.asDict()} == {*names, "shard", "slot"}


def test_pipeline_stages_on_hard_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "same text here"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = docs([]).columns
    odd = docs([(*r, None) for r in HARD[:4]] + list(HARD[4:]))
    clash = odd.selectExpr("*", "1 AS kept", "'x' AS shard", "2 AS component_id", "3 AS __t", "4 AS __w", "5 AS size", "6 AS n_words")
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), str(tmp_path)).count() == 0
        for table in (odd, clash):
            out = stage(spark, table, str(tmp_path))
            assert set(table.columns) | ({"shard", "slot"} if stage is corpus_pipeline.shard else set()) == set(out.columns)
            if table is clash and stage is not corpus_pipeline.shard:
                assert out.where("kept = 1 AND shard = 'x' AND component_id = 2 AND __t = 3 AND __w = 4 AND size = 5 AND n_words = 6").count() == out.count()
            n.setdefault(name, set()).add(out.count())
    # Both tables agree; the stage of near duplicates drops copies, that of decontamination the benchmark's text.
    assert {k: len(v) for k, v in n.items()} == dict.fromkeys(n, 1)
    rows = {k: min(v) for k, v in n.items()}
    assert rows["quality classifier"] == rows["sharding"] == len(HARD) and rows["near duplicates"] == len(HARD) - 2 and rows["decontamination"] == len(HARD) - 3


def test_queries_have_known_names():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}


def test_ids_pack():
    rows = [np.array(x, "int64") for x in ([], [0], [65535, 131070, 131071], [], [3, 70_000, (1 << 20) - 1])]
    got = cotrain.unpack([cotrain.pack(x) for x in rows])
    assert got.ids.tolist() == np.concatenate(rows).tolist() and np.diff(got.first).tolist() == [len(x) for x in rows]


def exchange_docs(spark):
    """Labelled documents whose source tells the label; the others' sources do too, and `novel` is in unlabelled bad ones alone."""
    rows = []
    for i in range(4000):
        bad, known = i % 4 == 0, i < 2400
        rows.append((i, f"w{i % 13} v{i % 7} " + (("poor" if known else "novel") if bad else "fine"), "en", "bad" if bad else "good"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs, docs.where("doc_id < 2400").selectExpr("doc_id", "int(source = 'good') AS quality", "int(doc_id % 2) AS toxic")


def word_weight(model, word):
    import pyarrow as pa

    _, _, ids, *_ = next(cotrain.views(pa.array([word]), ["en"], ["x"]))
    return min(model.heads["quality"][0][ids])


def test_all_documents_take_part(spark, monkeypatch):
    seen = []
    added = cotrain._added
    monkeypatch.setattr(cotrain, "_added", lambda *how: seen.append(added(*how)) or seen[-1])
    docs, labels = exchange_docs(spark)
    more = docs.unionByName(docs.where("doc_id >= 2400").crossJoin(spark.range(1, 9)).selectExpr("doc_id + 100000 * id AS doc_id", "text", "lang", "source"))
    model = cotrain.train(more, labels, rounds=1)
    assert seen[1][0, -1] == 9 * 1600  # the metadata view is sure of every other document, the content view of those without a new word
    assert seen[1][2, -1] == 9 * 1200
    edges = cotrain.train(docs.where("doc_id < 2400").unionByName(docs.where("doc_id >= 2400").withColumn("text", F.repeat("text", 50))), labels, rounds=0).edges
    assert max(edges[cotrain.NUMBERS.index("chars")]) > 6  # lengths that no labelled document has
    assert set(model.heads) == {"quality", "toxic"}


def test_words_of_pseudo_labelled_documents_count(spark):
    docs, labels = exchange_docs(spark)
    assert word_weight(cotrain.train(docs, labels, rounds=0), "novel") == 0
    assert word_weight(cotrain.train(docs, labels, rounds=1), "novel") < -0.5
