"""Operators against brute force, on made and on fixture rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from slitloom.llm import bestfit, bitpack, chaining, components, decontaminate, fertility, resample, sharding, simhash, suffixes
from slitloom.llm import text as T
from slitloom.llm import vocab as V

from .conftest import SCHEMA, sentence

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    """300 documents: plain ones, exact and edited copies, shared passages, copied items."""
    rng = random.Random(9)
    texts = [sentence(rng, rng.randrange(20, 400)) for _ in range(200)]
    passage = sentence(rng, 60)
    items = [sentence(rng, 25) for _ in range(6)]
    for i in range(30):
        texts.append(texts[i])
    for i in range(30):
        texts.append(" ".join(w if rng.random() > 0.04 else "edited" for w in texts[i + 40].split()))
    for i in range(20):
        texts.append(f"{sentence(rng, 80)} {passage} {sentence(rng, 50)}")
    for i in range(20):
        item = [w for w in items[i % 6].split() if rng.random() > 0.1 * (i > 9)]
        texts.append(f"{sentence(rng, 30)} {' '.join(item)} {sentence(rng, 30)}")
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6), dict(enumerate(texts)), dict(enumerate(items))


def split(texts):
    h, first, *_ = T.words(pa.array([texts[i] for i in sorted(texts)]))
    return {d: h[first[k] : first[k + 1]].tolist() for k, d in enumerate(sorted(texts))}


def test_simhash_recall_and_precision(corpus):
    docs, texts, _ = corpus
    order = sorted(texts)
    sig, count = simhash.signatures(pa.array([texts[i] for i in order]))
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(-1) <= simhash.RADIUS
    a, b = components.spanning(*np.nonzero(np.triu(near, 1)))
    want = dict(zip(b.tolist(), a.tolist(), strict=True))
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(docs).collect()}
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.9 * len(want)
    assert all(200 + i in got and 230 + i in got for i in range(30))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(texts) - set(got)


def test_suffix_repeats_are_those_of_a_dictionary(corpus):
    docs, texts, _ = corpus
    n, want, first = 50, defaultdict(set), {}
    for d, ws in split(texts).items():
        for p in range(len(ws) - n + 1):
            if first.setdefault(tuple(ws[p : p + n]), (d, p)) != (d, p):
                want[d] |= set(range(p, p + n))
    got = defaultdict(set)
    for r in suffixes.repeated(docs).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert got == want and len(want) > 40


def test_passages_cover_every_exact_repeat(corpus):
    docs, texts, _ = corpus
    words, n, first, want = split(texts), chaining.MIN_WORDS, {}, defaultdict(set)
    for d, ws in words.items():
        for p in range(len(ws) - n + 1):
            if first.setdefault(tuple(ws[p : p + n]), d) != d:
                want[d] |= set(range(p, p + n))
    got = defaultdict(set)
    for r in chaining.passages(docs).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        x, y = words[r["doc_id"]][r["start_word"] : r["end_word"]], words[r["source_id"]][r["source_start"] : r["source_end"]]
        assert r["source_id"] < r["doc_id"] and r["matched"] >= 0.75 * len(x)
        assert sum((Counter(x) & Counter(y)).values()) >= r["matched"]
    total = sum(map(len, want.values()))
    assert sum(len(want[d] & got[d]) for d in want) >= 0.98 * total
    edited = [230 + i for i in range(30) if len(words[230 + i]) > 60]
    assert sum(len(got[d]) > 0.9 * len(words[d]) for d in edited) >= 0.9 * len(edited)
    clean = [d for d in got if d < 200]
    assert not clean


def test_leaks(corpus, spark):
    docs, texts, items = corpus
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    words, target = split(texts), split(items)
    want = set()
    for d, x in words.items():
        for i, y in target.items():
            if set(x) & set(y):
                score, *_ = decontaminate.align([(np.array(y, np.uint64), np.array(x, np.uint64))])
                if score[0] / (2 * len(y)) >= decontaminate.THRESHOLD:
                    want.add((d, i))
    assert got == want and {d for d, _ in got} == set(range(280, 300))


def test_packing_of_documents(corpus):
    docs, texts, _ = corpus
    tokens = dict(zip(sorted(texts), V.token_counts(pa.array([texts[i] for i in sorted(texts)]), bestfit.VOCAB).tolist(), strict=True))
    for capacity, shard_docs in ((256, 1000), (4096, 60)):
        rows = bestfit.packed(docs, capacity, shard_docs).collect()
        total, bins = Counter(), defaultdict(list)
        for r in rows:
            total[r["doc_id"]] += r["n_tokens"]
            bins[r["bin_id"]].append(r)
        assert total == tokens
        for held in bins.values():
            assert sum(r["n_tokens"] for r in held) <= capacity
            owners = [r["doc_id"] for r in held]
            assert len({i % 5 for i in owners}) == len(owners) and len({texts[i] for i in owners}) == len(owners)


def test_packed_tokens_round_trip(corpus):
    docs, texts, _ = corpus
    model = V.byte_level(bitpack.VOCAB)
    for r in bitpack.packed_tokens(docs).collect():
        want = model.encode_ordinary(texts[r["doc_id"]])
        assert bitpack.unpack(r["packed"], r["bits"], r["n_tokens"]).tolist() == want
        for k, at in enumerate(r["block_offsets"]):
            block = want[k * bitpack.BLOCK : (k + 1) * bitpack.BLOCK]
            assert bitpack.unpack(r["packed"][at:], r["bits"], len(block)).tolist() == block


def test_fertility_measures_and_bands(spark):
    rng = random.Random(1)
    syllables = ["the", "er", "in", "on", "at", "en", "ti", "st", "and", "re"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, prose(rng.randrange(40, 300)), "en", "a", 0) for i in range(300)]
    bad = {300: "Of " * 200, 301: " ".join(w + "%%%###" for w in prose(150).split()), 302: prose(200).upper(), 303: "", 304: "зщъ" * 300}
    rows += [(i, t, "en", "a", 0) for i, t in bad.items()]
    docs = spark.createDataFrame(rows, SCHEMA)
    measured = {r["doc_id"]: r for r in fertility.metrics(docs).collect()}
    level, (piece, byte) = V.byte_level(fertility.LEVEL_VOCAB), V.pieces(fertility.PIECE_VOCAB)
    for d in (0, 17, 301, 304):
        text = rows[d][1]
        ids = level.encode_ordinary(text)
        share = Counter(ids)
        assert measured[d]["n_tokens"] == len(ids)
        assert measured[d]["chars_per_token"] == pytest.approx(len(text) / len(ids))
        assert measured[d]["entropy"] == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in share.values()))
        got = [i for w in text.split() for i in piece.encode(w)]
        assert measured[d]["byte_share"] == pytest.approx(sum(i in byte for i in got) / len(got))
    kept = {r["doc_id"] for r in fertility.fertile(docs).collect()}
    assert not kept & set(bad) and len(kept) >= 294


def test_resampling_leaves_out_what_the_target_lacks(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        text = sentence(rng, 150, 300)
        toxic = i % 9 == 0
        if toxic:
            ws = text.split()
            for j in rng.sample(range(150), 8):
                ws[j] = rng.choice(["idiot", "moron", "clown"])
            text = " ".join(ws)
        rows.append((i, text, "en", "a", len(text)))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    docs, labelled = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"] for r in resample.resampled(docs, labelled).collect()}
    assert abs(len(got) - 800) <= 2
    held_out = [i for i in range(0, 900, 2)]
    assert sum(i in got for i in held_out if i % 9 == 0) <= 0.1 * sum(i % 9 == 0 for i in held_out)
    assert sum(i in got for i in held_out if i % 9) >= 0.95 * sum(i % 9 > 0 for i in held_out)
    assert got == {r["doc_id"] for r in resample.resampled(docs.repartition(3), labelled).collect()}


def test_top_k_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([round(rng.gauss(0, 50), 6), 1.5, -3.25])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, noisy double")
    for k in (0, 1, 7, 250, 499, 500, 900):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        assert sorted(tuple(r) for r in resample.top_k(df, k).collect()) == sorted(want)


def test_shards_are_even_and_groups_whole(corpus):
    docs, texts, _ = corpus
    rows = sharding.assigned(docs, shard_bytes=20_000, cell_shards=4).collect()
    shard = {r["doc_id"]: r["shard"] for r in rows}
    assert set(shard) == set(texts)
    assert all(shard[i] == shard[200 + i] for i in range(30))
    whole = sharding.assigned(docs, shard_bytes=60_000, cell_shards=64).collect()
    sums = defaultdict(lambda: np.zeros(3))
    for r in whole:
        sums[r["shard"]] += [r["n_bytes"], r["n_tokens"], r["n_rows"]]
    load = np.array(list(sums.values()))
    assert (np.abs(load / load.mean(0) - 1) < 0.15).all()


def test_pipeline_is_its_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in fertility.fertile(docs).collect()}
    one = {d: texts[d] for d in kept}
    order = sorted(one)
    sig, _ = simhash.signatures(pa.array([one[i] for i in order]))
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(-1) <= simhash.RADIUS
    _, b = components.spanning(*np.nonzero(np.triu(near, 1)))
    two = {d: one[d] for k, d in enumerate(order) if k not in set(b.tolist())}
    three = {r["doc_id"]: r["text"] for r in chaining.cut_words(docs.where(docs.doc_id.isin(list(two))), chaining.passages(docs.where(docs.doc_id.isin(list(two))))).collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    words, target, leaky = split(three), split(items), set()
    for d, x in words.items():
        for y in target.values():
            if len(set(x) & set(y)) > 2:
                score, *_ = decontaminate.align([(np.array(y, np.uint64), np.array(x, np.uint64))])
                if score[0] / (2 * len(y)) >= decontaminate.THRESHOLD:
                    leaky.add(d)
    want = set(three) - leaky
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == {d for d in want if three[d]}
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    count = V.token_counts(pa.array([three[d] for d in sorted(want)]), bestfit.VOCAB)
    assert total == dict(zip(sorted(want), count.tolist(), strict=True))


def test_lines_seen_apart_that_recur_together(spark):
    rng = random.Random(12)
    texts: dict[int, str] = {}
    want = {}
    for group in range(40):
        one, two = sentence(rng, 30), sentence(rng, 30)
        apart = lambda: [f"{sentence(rng, 20)} {line} {sentence(rng, 20)}" for line in (one, two) for _ in range(group // 2)]  # noqa: B023, E731
        both = f"{one} {two}".split()
        edited = " ".join(w if group < 20 or rng.random() > 0.05 else "edited" for w in both)
        rows = [*apart(), f"{sentence(rng, 20)} {' '.join(both)} {sentence(rng, 20)}", *apart(), f"{sentence(rng, 20)} {edited} {sentence(rng, 20)}"]
        for k, t in enumerate(rows):
            texts[1000 * group + k] = t
        want[1000 * group + len(rows) - 1] = 1000 * group + group // 2 * 2
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], SCHEMA)
    found = chaining.passages(docs).collect()
    got = {r["doc_id"] for r in found if want.get(r["doc_id"]) == r["source_id"] and r["end_word"] - r["start_word"] >= 50}
    assert all(d in got for d in want if d < 20_000)  # word for word
    assert len(got) >= 0.9 * len(want)
    assert all(r["doc_id"] in want for r in found)


def test_leaks_of_much_edited_copies(spark):
    rng = random.Random(21)
    common = [f"c{i}" for i in range(60)]
    items = {i: " ".join(rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(14, 60))) for i in range(60)}
    texts = {}
    for i, t in items.items():
        texts[3 * i] = f"{sentence(rng, 40)} {t} {sentence(rng, 40)}"  # exact copies make the grams that are kept the most frequent
        for k, rate in ((1, 0.3), (2, 0.4)):
            gone = set(rng.sample(range(len(t.split())), round(rate * len(t.split()))))
            texts[3 * i + k] = f"{sentence(rng, 40)} {' '.join(f'x{rng.randrange(9000)}' if j in gone else w for j, w in enumerate(t.split()))} {sentence(rng, 40)}"
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts.items()], SCHEMA)
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    words, target = split(texts), split(items)
    want = set()
    for d, x in words.items():
        y = target[d // 3]
        score, *_ = decontaminate.align([(np.array(y, np.uint64), np.array(x, np.uint64))])
        if score[0] / (2 * len(y)) >= decontaminate.THRESHOLD:
            want.add((d, d // 3))
    edited = {(d, i) for d, i in want if d % 3}
    assert len(edited) > 60 and len(got & edited) >= 0.97 * len(edited)
    assert all(i == d // 3 for d, i in got)


def test_copies_behind_short_quotes(spark):
    rng = random.Random(31)
    texts = {}
    for group, (n, size, apart) in enumerate(((20, 25, 5), (11, 17, 10), (40, 38, 2), (0, 0, 0))):
        passage = sentence(rng, 120).split()
        for k in range(n):
            at = k * apart % (120 - size)
            texts[1000 * group + k] = f"{sentence(rng, 30)} {' '.join(passage[at : at + size])} {sentence(rng, 30)}"
        for k in (100, 101):
            texts[1000 * group + k] = f"{sentence(rng, 20)} {' '.join(passage)} {sentence(rng, 20)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = defaultdict(set)
    for r in chaining.passages(docs).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    want = {r["doc_id"]: set(range(r["start_word"], r["end_word"])) for r in suffixes.repeated(docs).collect() if r["doc_id"] != r["source_id"]}
    assert set(want) == {101, 1101, 2101, 3101} <= set(got)
    assert all(want[d] <= got[d] for d in want)


def test_weights_are_log_ratios_of_plain_counts(spark):
    """Every document's weight, over a whole table, against counts in dictionaries."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    token = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\\x09-\\x0d\\x1c-\\x20]+")
    number: dict = {}

    def bucket(gram: str) -> int:
        if gram not in number:
            found, _ = resample.features(pa.array([gram]))
            number[gram] = int(found[-1])  # the last is the pair, if there is one
        return number[gram]

    held = {}
    for d, t in texts.items():
        ws = token.findall(t)
        held[d] = Counter(bucket(w) for w in ws) + Counter(bucket(f"{a} {b}") if a[0].isalnum() == b[0].isalnum() or ord(a[0]) > 127 or ord(b[0]) > 127 else bucket(a + b) for a, b in zip(ws, ws[1:], strict=False))
    raw, target = sum(held.values(), Counter()), sum((h for d, h in held.items() if d in good), Counter())
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = n_target / n_raw

    def ratio(b: int) -> float:
        r = math.log(((target[b] + 0.5) / n_target) / ((raw[b] + 0.5 / share) / n_raw))
        error = math.sqrt((1 - share) / (share * raw[b] + 0.5))
        return math.copysign(max(0, abs(r) - resample.SURE * error), r)

    got = {r["doc_id"]: r["log_weight"] for r in resample.weights(docs, labels)[0].collect()}
    assert set(got) == set(texts)
    for d, h in held.items():
        assert got[d] == pytest.approx(sum(n * ratio(b) for b, n in h.items()), abs=1e-5)
    k = round(len(texts) * len(good & {r["doc_id"] for r in labels.collect()}) / len({r["doc_id"] for r in labels.collect() if r["quality"] is not None}))
    noisy = {d: got[d] + float(resample.gumbel(np.array([d]))[0]) for d in got}
    assert {r["doc_id"] for r in resample.resampled(docs, labels).collect()} == set(sorted(noisy, key=lambda d: (-round(noisy[d], 6), d))[:k])


def test_shards_are_those_of_a_plain_placing(spark):
    """Every document's shard, over a whole table, against a loop over lists."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    order = sorted(rows)
    words = split({d: rows[d]["text"] for d in order})
    tokens = dict(zip(order, V.token_counts(pa.array([rows[d]["text"] for d in order]), sharding.VOCAB).tolist(), strict=True))
    got = {r["doc_id"]: r for r in sharding.assigned(docs, shard_bytes=100_000, cell_shards=1000).collect()}
    weight = {d: (len((rows[d]["text"] or "").encode()), tokens[d], 1) for d in order}
    assert {d: (r["n_bytes"], r["n_tokens"], r["n_rows"]) for d, r in got.items()} == weight
    shards = math.ceil(sum(w[0] for w in weight.values()) / 100_000)
    groups = defaultdict(list)
    for d in order:
        groups[tuple(words[d]) or (-d,)].append(d)
    total = [sum(w[k] for w in weight.values()) for k in range(3)]
    unit = {g: [sum(weight[d][k] for d in ds) / total[k] * shards for k in range(3)] for g, ds in groups.items()}
    residual = [[1.0] * 3 for _ in range(shards)]
    taken = {got[ds[0]]["shard"] for ds in groups.values()}
    assert taken <= set(range(shards)) and all(len({got[d]["shard"] for d in ds}) == 1 for ds in groups.values())
    key = {r["doc_id"]: r["cluster"] for r in sharding.weighed(docs).collect()}
    for g in sorted(unit, key=lambda g: (-max(unit[g]), key[groups[g][0]])):
        u, mine = unit[g], got[groups[g][0]]["shard"]
        fits = [k for k in range(shards) if all(r >= x - 1e-9 for r, x in zip(residual[k], u, strict=True))] or list(range(shards))
        best = max(sum(r * x for r, x in zip(residual[k], u, strict=True)) for k in fits)
        assert mine in fits and sum(r * x for r, x in zip(residual[mine], u, strict=True)) == pytest.approx(best, rel=1e-6)
        residual[mine] = [r - x for r, x in zip(residual[mine], u, strict=True)]


def test_short_items_and_excerpts_of_long_ones(spark):
    rng = random.Random(6)
    long_ = sentence(rng, 600).split()
    items = {1: "what is the highest mountain there", 2: "one two three", 3: "Paris", 4: "", 5: " ".join(long_), 6: "new york"}
    texts = {
        1: f"{sentence(rng, 30)} What is the highest mountain there? {sentence(rng, 30)}",  # item 1
        2: f"{sentence(rng, 30)} what is the highest hill there {sentence(rng, 30)}",
        3: "Paris!",  # item 3
        4: f"{sentence(rng, 10)} paris {sentence(rng, 10)}",
        5: f"{sentence(rng, 40)} {' '.join(long_[200:260])} {sentence(rng, 40)}",  # item 5, a tenth of it
        6: f"{sentence(rng, 40)} {' '.join(long_[200:240])} {sentence(rng, 40)}",
        7: "New York",  # item 6
        8: f"{sentence(rng, 9)} one two, three",  # item 2
        9: "",
    }
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 3), (5, 5), (7, 6), (8, 2)}
    assert got[5, 5]["score"] == 0.1 and (got[5, 5]["start_word"], got[5, 5]["end_word"]) == (40, 100) and got[1, 1]["score"] == 1


@pytest.mark.parametrize("limit", [0, 3, 100])
def test_frequent_seeds_are_left_out_without_loss(corpus, spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "LEAST_FREQUENT", limit)
    docs, _, items = corpus
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()} == set(range(280, 300))


def test_hot_buckets_are_dealt_to_several_tasks(corpus, monkeypatch):
    docs, *_ = corpus
    want = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    monkeypatch.setattr(simhash, "LARGE", 6)
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "ONE_TASK", at_once)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(7, 7), (500, 499)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(label) and {r["node"]: r["root"] for r in got} == label


def test_groups_of_more_than_a_shard_are_dealt(spark):
    rng = random.Random(2)
    copy = sentence(rng, 100)
    rows = [(i, copy) for i in range(300)] + [(300 + i, "") for i in range(60)] + [(400 + i, sentence(rng, 100)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.assigned(docs, shard_bytes=len(copy) * 40).collect()
    load_ = defaultdict(lambda: np.zeros(3))
    for r in got:
        load_[r["shard"]] += [r["n_bytes"], r["n_tokens"], r["n_rows"]]
    load_ = np.array(list(load_.values()))
    assert len(got) == 460 and len(load_) == 10 and (load_ / load_.mean(0)).max() < 1.5


def test_bands_and_what_they_keep_by_plain_loops(spark):
    """Every document's verdict, over a whole table, from lists and sorting."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = fertility.metrics(docs).collect()
    half_up = lambda x: math.floor(x + 0.5)
    octave = lambda r, m: int(math.log2(max(r["n_tokens"], 1))) if m == "entropy" else 0
    names = lambda r: {"band": r["lang"] or r["script"] or "none", "wide": r["script"] or "none", "all": ""}
    held = defaultdict(list)
    for r in rows:
        for m in fertility.FLOOR:
            if r[m] is not None:
                for level, key in names(r).items():
                    held[m, level, key, octave(r, m)].append((r[m] * 1000, max(r["n_tokens"], 1)))
    low = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    own = {}
    for cell, v in held.items():
        centre = low([half_up(x) for x, _ in v])
        spread = low([half_up(abs(x - centre) / math.sqrt(1 + fertility.HALF / n)) for x, n in v])
        own[cell] = (centre / 1000, max(spread * 1.4826 / 1000, fertility.FLOOR[cell[0]]), len(v))
    whole = {}
    for m in fertility.FLOOR:
        parent = None
        for o in sorted(c[3] for c in own if c[0] == m and c[1] == "all"):
            mine = own[m, "all", "", o]
            parent = fertility.leaning(mine, parent or (mine[0], fertility.PRIOR_SPREAD[m]))
            whole[m, o] = parent
    want = {}
    for r in rows:
        ok = r["n_tokens"] > 0
        for m in fertility.FLOOR:
            if r[m] is None:
                continue
            key = names(r)
            centre, spread = fertility.leaning(own[m, "band", key["band"], octave(r, m)], fertility.leaning(own[m, "wide", key["wide"], octave(r, m)], whole[m, octave(r, m)]))
            z = (r[m] - centre) / (spread * math.sqrt(1 + fertility.HALF / max(r["n_tokens"], 1)))
            ok = ok and (z if m == "byte_share" else abs(z)) < fertility.WIDTH
        want[r["doc_id"]] = ok
    got = {r["doc_id"]: r["kept"] for r in fertility.judged(docs).collect()}
    assert got == want and 0.5 < sum(want.values()) / len(want) < 1


def brute_passages(words, links):
    """Of links (doc, src, b, a) those whose words on the diagonal, or left and right of a gap, are a passage; by plain loops."""
    want = set()
    for d, s, b, a in links:
        x, y = words[d], words[s]
        hit = np.array([0 <= k + a - b < len(y) and x[k] == y[k + a - b] for k in range(len(x))])
        if any(lo <= b and b + chaining.K <= hi for lo, hi in chaining.stretches(hit)):
            want.add((d, s))
    return want


@pytest.mark.parametrize("large", [chaining.LARGE, 8])
def test_edited_passages_whose_lines_many_hold_apart(spark, monkeypatch, large):
    """Every earlier holder of a seed counts, however many come before the one that holds the passage."""
    monkeypatch.setattr(chaining, "LARGE", large)
    monkeypatch.setattr(chaining, "FEW", 12)
    rng = random.Random(77)
    texts: dict[int, str] = {}
    last = []
    for group in range(24):
        one, two = sentence(rng, 26).split(), sentence(rng, 26).split()
        apart = lambda: [f"{sentence(rng, 60)} {' '.join(line)} {sentence(rng, 60)}" for line in (one, two) for _ in range(4 + group // 2)]  # noqa: B023, E731
        hidden = [f"e{group}x{k}" for k in range(4)]  # the words about the seam, of which the longer seeds are made, differ
        source, copy = one + two, one[:-2] + hidden + two[2:]
        rows = [*apart(), f"{sentence(rng, 60)} {' '.join(source)} {sentence(rng, 60)}", *apart(), f"{sentence(rng, 60)} {' '.join(copy)} {sentence(rng, 60)}"]
        texts |= {1000 * group + k: t for k, t in enumerate(rows)}
        last.append((1000 * group + len(rows) - 1, 1000 * group + 8 + group // 2 * 2))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    words, places = split(texts), defaultdict(list)
    for d in texts:
        g, at = T.minimizers(np.array(words[d], np.uint64), np.array([0, len(words[d])]), chaining.K, chaining.W)
        for h, p in zip(g.tolist(), at.tolist(), strict=True):
            places[h].append((d, p))
    want = brute_passages(words, [(d, s, b, a) for held in places.values() for d, b in held for s, a in held if s < d])
    assert set(last) <= want
    got = {(r["doc_id"], r["source_id"]) for r in chaining.passages(docs).collect()}
    assert want <= got


def test_passages_with_words_put_in_where_many_hold_the_lines_apart(spark):
    rng = random.Random(78)
    texts, last = {}, []
    for group in range(24):
        one, two = sentence(rng, 28).split(), sentence(rng, 28).split()
        apart = lambda: [f"{sentence(rng, 60)} {' '.join(line)} {sentence(rng, 60)}" for line in (one, two) for _ in range(6)]  # noqa: B023, E731
        put = [f"e{group}x{k}" for k in range(1 + group % 5)]
        pair = [one + two, one[:-1] + put + two[1:]][:: 1 if group % 2 else -1]
        rows = [*apart(), f"{sentence(rng, 60)} {' '.join(pair[0])} {sentence(rng, 60)}", *apart(), f"{sentence(rng, 60)} {' '.join(pair[1])} {sentence(rng, 60)}"]
        texts |= {1000 * group + k: t for k, t in enumerate(rows)}
        last.append((1000 * group + len(rows) - 1, 1000 * group + 12))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["source_id"]) for r in chaining.passages(docs).collect()}
    assert set(last) <= got
