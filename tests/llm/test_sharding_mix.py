import zlib

from llm_samples import HARD, prose
from pyspark.sql import functions as F

from siltstone.llm import pareto_mix, queries, sharding

SF = "/root/testdata/sf0.001"


def check_shards(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(n))
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    return by


def test_equal_bytes_and_slots(docs):
    rows = sharding.shard(docs([(i, prose(i, 5 + i % 40)) for i in range(400)]), 8, ranges=16).collect()
    by = check_shards(rows, 8)
    sizes = [sum(len(r["text"].encode()) + 1 for r in s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(len(r["text"]) + 1 for r in rows)


def test_hot_text_is_split(docs):
    rows = sharding.shard(docs([(i, "copied " * 10) for i in range(300)] + [(i, prose(i, 10)) for i in range(300, 400)]), 4, ranges=8).collect()
    by = check_shards(rows, 4)
    assert max(map(len, by.values())) < 130


def test_result_does_not_depend_on_ranges(docs):
    d = docs([(i, prose(i % 50, 8)) for i in range(200)])
    a, b = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(d, 4, ranges=k).collect()) for k in (2, 40))
    assert a == b


def test_shard_hard_rows(docs, spark):
    d = docs(HARD).withColumn("shard", F.lit("clash")).withColumn("SLOT", F.lit(1))
    out = sharding.shard(d, 8)
    assert out.count() == len(HARD) and sorted(c.lower() for c in out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"])
    check_shards(out.collect(), 8)
    assert sharding.shard(docs([]), 8).count() == 0


def test_op1_contract(spark):
    rows = queries.op1_sampled_splitters(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check_shards(rows, 8)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def targets(sizes, share=1.5, most=2.0):
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= set(over)
    return out


def test_mix_targets(docs):
    rows = [(i, prose(i, 3 + i % 30), f"src{i % 5}" if i % 11 else None) for i in range(600)]
    out = pareto_mix.mix(docs(rows)).collect()
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    for s in sizes:
        got = sum(r["taken"] for r in out if r["source"] == s)
        assert abs(got - want[s]) <= max(r["size"] for r in out if r["source"] == s)
        assert abs(next(r["target"] for r in out if r["source"] == s) - want[s]) < 1e-6 * max(1, want[s])
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)


def test_mix_reruns_agree(docs):
    rows = [(i, prose(i, 6), f"s{i % 3}") for i in range(200)]
    get = lambda d: sorted((r["doc_id"], r["taken"]) for r in pareto_mix.mix(d).collect())
    assert get(docs(rows)) == get(docs(rows[::-1]).repartition(7))


def test_mix_odds(docs):
    d = docs([(i, "one two three four", f"s{i % 2}") for i in range(2000)]).withColumn("w", F.when(F.col("doc_id") % 4 < 2, 5.0).otherwise(0.2))
    out = pareto_mix.mix(d, odds_col="w", share=1.2).where("source = 's1' AND taken > 0").collect()
    assert sum(r["taken"] for r in out) == 2400
    assert sum(r["w"] > 1 for r in out) > 1.3 * sum(r["w"] < 1 for r in out)


def test_mix_hard_rows(docs):
    out = pareto_mix.mix(docs(HARD).withColumn("size", F.lit("clash")))
    assert out.count() == len(HARD) and {r["doc_id"]: r["size"] for r in out.collect()}[1] == 0
    assert pareto_mix.copies(out).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pareto_mix.mix(docs([])).count() == 0
    assert pareto_mix.mix(docs([(1, None), (2, "")])).where("taken > 0").count() == 0


def test_equal_texts_stay_together(docs):
    from test_search_models import brute_shards

    rows = [(i, f"text number {i // 3} " * 5) for i in range(6000)] + [(10_000 + i, "one text of a third of all rows " * 3) for i in range(2000)]
    got = sharding.shard(docs(rows), 8).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == brute_shards(rows)
    homes = {}
    for r in got:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert [len(h) for t, h in homes.items() if t.startswith("text")] == [1] * 2000 and len(homes["one text of a third of all rows " * 3]) > 1
    size = [sum(len(r["text"]) + 1 for r in got if r["shard"] == s) for s in range(8)]
    assert max(size) - min(size) < 0.03 * sum(size) / 8


def test_op1_against_brute_force(spark):
    from test_search_models import brute_shards

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op1_sampled_splitters(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == brute_shards(rows)
    text = dict(rows)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len((text[r["doc_id"]] or "").encode()) + 1, zlib.crc32((text[r["doc_id"]] or "").encode()), "bytes", None) for r in got)
