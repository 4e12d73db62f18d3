import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slitloom.llm import bestfit, bitpack, captures, chaining, components, decontaminate, resample, sharding, simhash, suffixes


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 33), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=300)), np.int64)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    assert bitpack.unpack(packed, bits, len(ids)).tolist() == ids.tolist()
    for i in range(0, len(ids), 37):
        assert bitpack.token_at(packed, bits, i) == ids[i]
        assert bitpack.unpack(packed, bits, len(ids) - i, i).tolist() == ids[i:].tolist()


def test_width_and_misfits():
    assert [bitpack.width(n) for n in (1, 2, 3, 32000, 49408, 50257, 65537)] == [1, 1, 2, 15, 16, 16, 17]
    with pytest.raises(ValueError):
        bitpack.pack(np.array([4]), 2)


def test_pack_many_is_pack_of_each():
    ids, first = np.arange(300) % 128, np.array([0, 0, 5, 200, 200, 300])
    got = bitpack.pack_many(ids, first, 7)
    assert got == [bitpack.pack(ids[a:b], 7) for a, b in itertools.pairwise(first)]


@pytest.mark.parametrize("n", [1, 3, 30, 200])
def test_bit_sliced_pairs_are_those_of_brute_force(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (5, 4), dtype=np.uint64)
    sig = base[rng.integers(0, 5, n)]
    for i in range(n):  # flip 0 to 60 bits
        for b in rng.choice(256, rng.integers(0, 60), replace=False):
            sig[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bucket = rng.integers(0, 3, n)
    distance = np.bitwise_count(sig[:, None] ^ sig[None]).sum(-1)
    near = np.triu((distance <= 46) & (bucket[:, None] == bucket[None]), 1)
    want = [x.tolist() for x in components.spanning(*np.nonzero(near))]
    pairs = list(simhash.bucket_pairs(sig, bucket, 46))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    got = [x.tolist() for x in components.spanning(a, b)]
    assert sorted(zip(*got, strict=True)) == sorted(zip(*want, strict=True))
    assert (distance[a, b] <= 46).all() or n > simhash.SMALL


def test_pairs_of_middling_buckets_cost_little_each():
    rng = np.random.default_rng(3)
    n = 60_000
    sig = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
    sig[n // 2 : n // 2 + 500] = sig[:500]
    sig[n // 2 : n // 2 + 500, 3] ^= np.uint64(0xFFFF)
    bucket = rng.integers(0, n // 60, n)
    bucket[n // 2 : n // 2 + 500] = bucket[:500]
    began = time.thread_time()
    pairs = list(simhash.bucket_pairs(sig, bucket, 46))
    took = time.thread_time() - began
    size = np.bincount(bucket)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == {(i, n // 2 + i) for i in range(500)}
    assert took < 120e-9 * (size * (size - 1) // 2).sum()


def test_many_pairs_of_a_task_join_the_same(spark, monkeypatch):
    texts = [" ".join(f"w{j}" if j != i else "x" for j in range(200)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "ENOUGH", 10)
    assert sorted((r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(docs).collect()) == [(i, 0) for i in range(1, 60)]


def test_two_stage_order_is_that_of_plain_sorting():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, a, n) for n, a in ((1, 1), (2, 1), (7, 1), (60, 2), (400, 3), (900, 60))]
    texts += [np.tile(np.arange(5), 60), np.r_[np.tile([3, 1], 100), 9, np.tile([3, 1], 100), 8], np.zeros(300, int)]  # long common prefixes
    for t in texts:
        t, n = t.astype(np.int64), len(t)
        sa = suffixes.suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())  # noqa: B023
        for limit in (1, 8, 9, 50):
            shared = suffixes.common_prefixes(t, sa, limit)
            for i in range(1, n):
                c = 0
                while c < limit and max(sa[i], sa[i - 1]) + c < n and t[sa[i] + c] == t[sa[i - 1] + c]:
                    c += 1
                assert c == shared[i]


def places_of_a_line(n):
    """Words around n places of one line of 14 words, and for the last tenth the place whose edited copy it is."""
    rng = np.random.default_rng(5)
    wide, here = 2 * chaining.SIDE + chaining.K, chaining.SIDE - 4
    common = np.where(rng.random((wide, n)) < 0.6, rng.zipf(1.3, (wide, n)) % 300, rng.integers(300, 60_000, (wide, n)))
    words = common.astype(np.uint16)
    words[here : here + 14] = np.arange(61_000, 61_014)[:, None]
    for i in range(n - n // 10, n):
        j = i - n // 2
        words[here - 20 : here, i] = words[here - 20 : here, j]
        moved = i % 4  # words put in after the line
        words[here + 14 + moved : here + 44 + moved, i] = words[here + 14 : here + 44, j]
        words[rng.integers(here - 20, here + 44, 3), i] = 62_000
    return words


@pytest.mark.parametrize("parts", [1, 2])
def test_pairs_that_may_hold_a_passage_are_all_that_do(parts):
    words, n = places_of_a_line(400), 400
    near = slice(chaining.SIDE - chaining.REACH, chaining.SIDE + chaining.K + chaining.REACH)
    doc, part, open_ = np.arange(n) // 2, np.full(n, -1) if parts == 1 else np.arange(n) * 3 // n % 2, np.arange(n) % 7 > 0
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
    alike = (doc[j] < doc[i]) & open_[i] & ((part[i] < 0) | (part[i] != part[j]))
    i, j = i[alike], j[alike]
    same = np.concatenate([(words[near][:, i[k : k + 4096]] == words[near][:, j[k : k + 4096]]).sum(0) for k in range(0, len(i), 4096)])
    i, j, same = (x[same >= chaining.HALF] for x in (i, j, same))
    pairs = list(chaining._matching(words[near], doc, part, open_, np.array([0]), np.array([n])))
    got = np.concatenate([np.stack(x) for x in pairs], 1)
    assert sorted(zip(*got.tolist(), strict=True)) == sorted(zip(i.tolist(), j.tolist(), same.tolist(), strict=True))

    def holding(i, j):
        good = chaining._on_diagonal((words[near][:, i] == words[near][:, j]).T)[1] > 0
        good |= chaining._bent(words[:, i], words[:, j])[2] == 1
        return set(zip(i[good].tolist(), j[good].tolist(), strict=True))

    kept = [np.concatenate(x) for x in zip(*chaining._hopeful(iter(pairs), chaining.Nearby(words)), strict=True)]
    want = holding(i, j)
    assert holding(*kept) == want and len(want) > 20
    assert len(kept[0]) < len(i) / 4


def test_pairs_of_places_of_a_line_cost_little_each():
    words, n = places_of_a_line(1500), 1500
    near = slice(chaining.SIDE - chaining.REACH, chaining.SIDE + chaining.K + chaining.REACH)
    began = time.thread_time()
    pairs = list(chaining._matching(words[near], np.arange(n), np.full(n, -1), np.ones(n, bool), np.array([0]), np.array([n])))
    alike, kept = sum(len(x[0]) for x in pairs), sum(len(x) for x, _ in chaining._hopeful(iter(pairs), chaining.Nearby(words)))
    took = time.thread_time() - began
    assert kept < alike / 4 and took < 120e-9 * n * (n - 1) / 2 + 6e-6 * alike


def test_fenwick_chain_is_the_best_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        m = rng.randrange(1, 8)
        b, a = [rng.randrange(60) for _ in range(m)], [rng.randrange(60) for _ in range(m)]
        n = [rng.randrange(3, 9) for _ in range(m)]

        def score(path):
            s = n[path[0]]
            for i, j in itertools.pairwise(path):
                if b[i] + n[i] > b[j] or a[i] + n[i] > a[j]:
                    return -1e9
                s += n[j] - chaining.GAP_COST * (b[j] - b[i] - n[i] + a[j] - a[i] - n[i])
            return s

        best = max(score(p) for k in range(1, m + 1) for p in itertools.permutations(range(m), k))
        got = chaining.chain(b, a, n)
        assert max(score(p) for p in got) == pytest.approx(best)
        assert sorted(i for p in got for i in p) == sorted({i for p in got for i in p})


def test_smith_waterman_against_a_plain_one():
    rng = np.random.default_rng(4)

    def plain(x, y):
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
            s = decontaminate.MATCH if x[i - 1] == y[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
        return h.max()

    pairs = [(rng.integers(2, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(2, 6, rng.integers(1, 40)).astype(np.uint64)) for _ in range(150)]
    got, begin, end = decontaminate.align(pairs)
    for k, (x, y) in enumerate(pairs):
        assert got[k] == plain(x, y)
        assert plain(x, y[begin[k] : end[k]]) == got[k]


def test_loser_tree_merges():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), i) for _ in range(rng.randrange(12))) for i in range(k)]
        got = [(x[0], x[1]) for x in captures.LoserTree([iter(r) for r in runs])]
        assert got == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))


def test_best_fit_takes_the_tightest_bin_that_has_no_conflict():
    rng = np.random.default_rng(0)
    for n, sources in ((0, 1), (1, 1), (300, 3), (300, 40)):
        size = np.sort(rng.integers(1, 100, n))[::-1]
        source, cluster = rng.integers(-1, sources, n), rng.integers(-1, 30, n)
        got = bestfit.best_fit(size, source, cluster, 100)
        bins: list[list[int]] = []
        for i in range(n):
            ok = [b for b, held in enumerate(bins) if sum(size[held]) + size[i] <= 100 and all((source[i] < 0 or source[j] != source[i]) and (cluster[i] < 0 or cluster[j] != cluster[i]) for j in held)]
            tightest = min((100 - sum(size[bins[b]]) for b in ok), default=None)
            if got[i] == len(bins):
                assert not ok
                bins.append([])
            else:
                assert got[i] in ok and 100 - sum(size[bins[got[i]]]) == tightest
            bins[got[i]].append(i)


def test_dot_product_placing_balances_all_dimensions():
    rng = np.random.default_rng(0)
    v = rng.lognormal(0, 1, (2000, 3))
    v = v[np.argsort(-(v / v.sum(0)).max(1))]
    at = sharding.place(v, 8)
    load = np.array([v[at == k].sum(0) for k in range(8)]) / (v.sum(0) / 8)
    assert np.abs(load - 1).max() < 0.05
    assert sharding.place(np.zeros((3, 3)), 2).tolist() == [0, 0, 0]


def test_log_ratio_shrinks_towards_nought():
    raw, target = np.array([1000.0, 1000, 4, 0]), np.array([20.0, 500, 0, 0])
    r = resample.log_ratios(raw, target, 1e6, 5e5)
    assert r[0] < -2 and r[1] == r[2] == r[3] == 0
    assert (resample.log_ratios(raw, target * 0, 1e6, 0) == 0).all()


def test_gumbel_top_k_samples_in_proportion():
    hits = np.zeros(3)
    for seed in range(3000):
        hits[(np.log([1, 2, 5]) + resample.gumbel(np.arange(3), seed)).argmax()] += 1
    assert np.abs(hits / 3000 - np.array([1, 2, 5]) / 8).max() < 0.03


def test_signatures_of_very_many_short_texts():
    texts = pa.array([f"w{i % 7}" for i in range(70_000)])
    sig, count = simhash.signatures(texts)
    small, _ = simhash.signatures(texts.slice(0, 7))
    assert sig.shape == (70_000, 4) and (count == 1).all() and (sig.reshape(-1, 7, 4) == small).all()


def test_keys_have_the_recall_that_is_stated():
    rng = np.random.default_rng(3)
    for n in (1000, 10**9):
        bits, tables = simhash.plan_tables(n)
        sampled = [rng.choice(simhash.BITS, bits, replace=False) for _ in range(tables)]
        found = 0
        for _ in range(400):
            differ = np.zeros(simhash.BITS, bool)
            differ[rng.choice(simhash.BITS, simhash.RADIUS, replace=False)] = True
            found += any(not differ[s].any() for s in sampled)
        assert found >= 0.86 * 400
