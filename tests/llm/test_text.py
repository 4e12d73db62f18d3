import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from slitloom.llm import text as T
from slitloom.llm import vocab as V

WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_words_are_those_of_a_plain_split(texts):
    h, first, start, end, raw = T.words(pa.array(texts, pa.string()))
    got = [[raw[s:e].tobytes().decode() for s, e in zip(start[first[d] : first[d + 1]], end[first[d] : first[d + 1]], strict=True)] for d in range(len(texts))]
    lowered = pa.compute.utf8_lower(pa.array([t or "" for t in texts], pa.string())).to_pylist()
    assert got == [WORD.findall(t) for t in lowered]
    by = {}
    for d, ws in enumerate(got):
        for w, x in zip(ws, h[first[d] : first[d + 1]].tolist(), strict=True):
            assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_hash_of_a_span_over_slabs_is_that_of_the_same_bytes_elsewhere():
    long_ = "ab" * (T._SLAB + 7)
    h, first, *_ = T.words(pa.array([long_, "pad " + long_]))
    assert h[0] == h[first[1] + 1]


def test_minimizers_guarantee():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    b = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    b[100:123] = a[200:223]
    k, w = 8, 16
    g, at = T.minimizers(np.concatenate([a, b]), np.array([0, 400, 700]), k, w)
    own = (at >= 400).astype(int)
    assert set(g[own == 0]) & set(g[own == 1])
    for lo, n in ((0, 400), (400, 300)):
        mine = sorted(at[(at >= lo) & (at < lo + n)] - lo)
        assert mine[0] < w and max(np.diff(mine)) <= w and mine[-1] >= n - k - w + 1


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 7, 43):
        assert T.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(200 - w + 1)]


def test_chunked_ids_are_those_of_the_whole_text():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n ", "\t", " ", " ", "　", "word", "Élan", "it's", "12", "3.5", "!!", "中文", "🙂", " a", "'s"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", " ", "  x"]
    model = V.byte_level("byte_bpe_50k.tiktoken")
    ids, first = V.token_ids(pa.array(texts, pa.string()), "byte_bpe_50k.tiktoken")
    count = V.token_counts(pa.array(texts, pa.string()), "byte_bpe_50k.tiktoken")
    for d, t in enumerate(texts):
        want = model.encode_ordinary(t or "")
        assert ids[first[d] : first[d + 1]].tolist() == want
        assert count[d] == len(want)
