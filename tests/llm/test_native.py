"""Mixing and sharding."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from auditloom.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, stopped, left = {}, set(), float(sum(sizes.values()))
    while True:
        level = left / max(sum(weight[s] for s in names if s not in stopped), 1e-12)
        over = [s for s in names if s not in stopped and level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in stopped else level * weight[s] for s in names}
        for s in over:
            stopped.add(s)
            left -= most * sizes[s]
        target.clear()


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 50}, {"a": 1}, {"a": 0, "b": 7}, {f"s{i}": i * i + 1 for i in range(12)}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in got) and len(got) == len(sizes)


def test_mix(docs, texts, nothing):
    got = mixing.mix(docs.withColumnsRenamed({"lang": "_size", "n_chars": "s"})).collect()
    assert len(got) == len(texts)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        n = len(WORD.findall(r["text"] or ""))
        assert r["_size"] == n and 0 <= r["_taken"] <= 3 * n
        taken[r["source"]] += r["_taken"]
        size[r["source"]] += n
        target[r["source"]] = r["_target"]
    want = brute_targets(size)
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 0.5 for s in size)
    again = sorted((r["doc_id"] or -1, r["_taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((r["doc_id"] or -1, r["_taken"]) for r in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mix_rows(nothing).count() == 0


def test_mix_rows_come_near(docs):
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    per = defaultdict(int)
    for r in rows.collect():
        per[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = {r["source"]: r["_target"] for r in mixing.mix(docs).collect()}
    assert all(abs(per[s] - target[s]) <= 4600 for s in target)  # half of the longest document


def test_matrix_sums_and_law():
    counts, room = [5, 0, 17, 8], [8, 8, 7, 7]
    m = sharding.communication_matrix(counts, room, 3)
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == room and (m >= 0).all()
    draws = np.array([sharding.communication_matrix([10, 20], [15, 15], s)[0, 0] for s in range(3000)])
    assert abs(draws.mean() - 5) < 0.1 and abs(draws.var() - 10 * 0.25 * 20 / 29) < 0.2
    assert sharding.communication_matrix([10**10], [6 * 10**9, 4 * 10**9], 1).tolist() == [[6 * 10**9, 4 * 10**9]]


def test_shards(docs, texts, nothing):
    got = sharding.shuffle_into_shards(docs, 7).collect()
    assert len(got) == len(texts)
    per = defaultdict(list)
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        per[r["shard"]].append(r["slot"])
    assert sorted(len(x) for x in per.values())[0] >= len(texts) // 7 and max(map(len, per.values())) <= -(-len(texts) // 7)
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    again = sharding.shuffle_into_shards(docs.repartition(5), 7).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"] or -1, r["size"], r["shard"], r["slot"]) for r in got)
    other = sharding.shuffle_into_shards(docs, 7, seed=8).collect()
    assert sum((a["shard"], a["slot"]) != (b["shard"], b["slot"]) for a, b in zip(sorted(got, key=str), sorted(other, key=str), strict=True)) > len(texts) / 2
    assert sharding.shuffle_into_shards(nothing, 7).count() == 0


def test_shards_of_clashing_columns_and_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_GROUPS", 10)
    rows = [(1, "same", 7, 8, 9, "x")] * 900 + [(i, f"t{i}", i, 0, 0, None) for i in range(2, 302)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, shard int, slot int, __shard_rank string")
    got = sharding.shuffle_into_shards(docs.repartition(5), 7).collect()
    assert len(got) == 1200 and set(got[0].asDict()) == {"doc_id", "text", "size", "text_crc32", "shard", "slot"}
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and len({(r["shard"], r["slot"]) for r in got}) == 1200
    copies = Counter(r["shard"] for r in got if r["doc_id"] == 1)
    assert len(copies) == 7 and min(copies.values()) > 60  # each of 7 shards expects 129
    again = sharding.shuffle_into_shards(docs.repartition(3), 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_spreads_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, f"a b {i}", "s") for i in range(300)] + [(2, "a b", "t")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sum(r["_taken"] for r in got if r["source"] == "t") == 6 and sum(r["_taken"] for r in got if r["source"] == "s") in range(895, 900)
