"""Plain functions of the operators, against libraries and brute force."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from libris.llm import ann, bitslice, gbdt, jpeg, media, packing, simhash, toxicity, url_filter
from libris.llm.bpe import ByteBPE, RankQueue

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = ["a", "B", "the", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x1c", "\x85", "é", "é", "中文", "²", "12", "'s", "!", "...", ".", ",", "​", "　", "İ", "ß", "🙂", "Σ", "aaaaaaa", "<|endoftext|>", "\x00", "’s"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(14))) for _ in range(n)]


def test_rank_queue_gives_the_lowest_first():
    q = RankQueue(50_000)
    r = random.Random(0)
    ranks = r.sample(range(50_000), 500)
    for x in ranks:
        q.fill(x, [x])
    assert [q.pop()[0] for _ in ranks] == sorted(ranks) and q.pop() is None


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE.from_file(RANKS, P.PATTERN)


def test_bpe_is_that_of_the_library(bpe):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    texts = [*odd_texts(2000), "a" * 50_000, "ab" * 20_000, "".join(r.choice("abcde") for _ in range(60_000)), "", " "]
    got = bpe.encode_all(texts)
    rows = np.split(got.flat, np.cumsum(got.counts)[:-1])
    assert [x.tolist() for x in rows] == [library.encode_ordinary(t) for t in texts]
    assert all(bpe.decode(x.tolist()) == t.encode() for x, t in zip(rows, texts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=8))
def test_bpe_round_trip(texts):
    own = ByteBPE({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"aa": 259, b"aaa": 260}, P.PATTERN)
    for wide in (1, 40):
        pieces = [t.encode() for t in texts if t]
        got = own.merge(pieces, wide)
        assert b"".join(own.tokens[i] for i in got.flat.tolist()) == b"".join(pieces)


def test_words_one_by_one_are_the_tokenizers():
    cache = packing.WordCache(WORDS)
    texts = odd_texts(3000)
    got = cache.encode_all(texts)
    want = [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(got.flat, np.cumsum(got.counts)[:-1])] == want


@pytest.mark.parametrize("radius", [0, 2, 4, 7, 9, 30])
def test_bitslice_against_brute_force(radius):
    rng = np.random.default_rng(radius)
    n = 400
    v = rng.integers(0, 2**63, (12, 2), dtype=np.uint64)[rng.integers(0, 12, n)]
    for _ in range(8):
        bit = np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64)
        v = np.where(rng.random((n, 2)) < 0.4, v ^ bit, v)
    near = np.bitwise_count(v[:, None] ^ v[None]).sum(2) <= radius
    i, j = rng.integers(0, n, (2, 3000))
    assert (bitslice.near_pairs(v[i], v[j], radius) == near[i, j]).all()
    for side in (np.zeros(n, int), rng.integers(1, 3, n)):
        ok = near & ((side[:, None] == 0) | (side[:, None] != side[None]))
        label = np.arange(n)
        for _ in range(n):
            label = np.minimum(label, np.array([label[ok[k]].min(initial=label[k]) for k in range(n)]))
        parent = list(range(n))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        edges = bitslice.forest(v, side, radius, tile=500)
        assert all(ok[a, b] for a, b in edges)
        for a, b in edges:
            x, y = root(a), root(b)
            assert x != y  # a forest
            parent[max(x, y)] = min(x, y)
        assert [root(k) for k in range(n)] == label.tolist()


def test_fingerprints():
    def slow(text, k):
        w = text.lower().split()
        runs = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    r = random.Random(3)
    texts = ["", " \n", "one", "a b c", "É a\x0bB c d e e e e e", " ".join(r.choice("abcdefgh") for _ in range(700))]
    got = simhash.fingerprints([t.encode() for t in texts] + [None], 4)
    assert got[:, 0].tolist() == [slow(t.encode(), 4) for t in texts] + [0]
    assert (simhash.fingerprints([t.encode() for t in texts], 4, 3)[:, 0] == got[:-1, 0]).all()


def test_exact_tables_miss_nothing():
    rng = np.random.default_rng(0)
    tables = simhash.exact_tables(64, 4)
    for _ in range(300):
        flipped = rng.choice(64, 4, replace=False)
        assert any(not set(t.tolist()) & set(flipped.tolist()) for t in tables)


def test_jpeg_round_trip_and_damage():
    r = random.Random(0)
    zeros = [bytes(r.choice([128] * 20 + [200]) for _ in range(192 * 4)) for _ in range(10)]
    payloads = [r.randbytes(192 * r.randrange(1, 9)) for _ in range(20)] + [bytes([b]) * 384 for b in (0, 128, 255)] + zeros
    images = [jpeg.stored(p) for p in payloads]
    rows = media.read_images([*images, None, b"", images[0][:-30], b"\xff\xd8\xff\xe0"])
    assert [x[4] for x in rows[: len(payloads)]] == payloads
    assert rows[len(payloads)] == (None,) * 6 and all(x[5] for x in rows[len(payloads) + 1 :])
    assert rows[0][:2] == (24, 8 * len(payloads[0]) // 192)
    long = r.randbytes(192 * 9000)
    assert media.read_images([jpeg.stored(long)])[0][4] == long


def test_jpeg_without_restart_markers_and_with_colour():
    # two components, the first with 2 x 1 blocks: written here symbol by symbol
    dc, ac = jpeg.DC, jpeg.AC
    codes = [jpeg._codes(t) for t in (dc, ac)]
    rng = np.random.default_rng(1)
    blocks = rng.integers(-20, 20, (6, 64))  # two MCUs of three blocks
    blocks[:, 30:60] = 0
    bits, last = "", [0, 0]

    def put(table, symbol, size, value):
        nonlocal bits
        c, n = codes[table][0][symbol], codes[table][1][symbol]
        bits += f"{c:0{n}b}" + (f"{value if value >= 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    for k, block in enumerate(blocks.tolist()):
        which = 0 if k % 3 < 2 else 1
        d = block[0] - last[which]
        last[which] = block[0]
        put(0, abs(d).bit_length(), abs(d).bit_length(), d)
        run = 0
        end = max((i for i in range(1, 64) if block[i]), default=0)
        for v in block[1 : end + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                put(1, 0xF0, 0, 0)
                run -= 16
            put(1, run << 4 | abs(v).bit_length(), abs(v).bit_length(), v)
            run = 0
        if end < 63:
            put(1, 0, 0, 0)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    s = jpeg._segment
    image = b"\xff\xd8" + s(0xDB, bytes([0]) + bytes([16]) * 64) + s(0xC0, bytes([8, 0, 8, 0, 30, 2, 1, 0x21, 0, 2, 0x11, 0])) + s(0xC4, b"\x00" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1]) + s(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    head = jpeg.parse(image)
    got = jpeg.coefficients([image], [head])[0]
    assert (got.reshape(6, 64) == blocks).all()
    assert (jpeg.coefficients([image] * 20, [head] * 20)[19] == got).all()  # in lockstep too
    assert jpeg.thumbnail(head, got).tolist() == [[min(255, max(0, 128 + 2 * blocks[k][0])) for k in (0, 1, 3, 4)]]


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=0, max_size=12))
def test_plan_places_every_item_once(counts):
    plan = packing.plan(counts, 64)
    classes = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
    ranks = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.zeros(0, np.int64)
    sequence, slot = plan.place(classes, ranks.astype(np.int64))
    assert len(set(zip(sequence.tolist(), slot.tolist(), strict=True))) == len(classes)
    assert (np.bincount(sequence, classes, plan.sequences or 1) <= 64).all()


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(3.5, 0.8, 20_000), 1, 256).astype(int)
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    assert packing.plan(counts, 256).sequences <= 1.01 * sizes.sum() / 256 + 1


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        values = rng.random(4)
        best = max(sum(values[i] * k for i, k in enumerate((a, b, c, d))) for a in range(21) for b in range(21) for c in range(21) for d in range(21) if a * sizes[0] + b * sizes[1] + c * sizes[2] + d * sizes[3] <= 20)
        price, taken = packing.knapsack(sizes, values, 20)[0]
        assert abs(price - best) < 1e-9 and taken @ sizes <= 20


def test_toxicity_held_out():
    r = random.Random(0)
    syllables = ["an", "er", "th", "on", "in", "re", "st", "ou", "le", "ti"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    bad = ["zapquix", "morblax", "vuzzgorp"]

    def text(toxic):
        w = [word() for _ in range(r.randrange(5, 120))]
        for _ in range(r.randrange(1, 5) * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        return " ".join(w)

    rows = [(text(k % 4 == 0), int(k % 4 == 0), k // 4) for k in range(900)]
    model = toxicity.fit(rows, 0.25)
    test = [(text(k % 2), k % 2) for k in range(400)]
    scores = np.array([toxicity.score(t, model) for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((scores >= 0.7) == y).mean() > 0.93
    assert 0 <= toxicity.score("", model) < 0.7 and toxicity.score("x" * 200_000, model) < 0.7
    assert toxicity.score("a", toxicity.fit([], 0.0)) < 0.01


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    t = gbdt.train(x[:3000], y[:3000])
    assert ((t.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert len(gbdt.train(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((3, 2)))) == 3


def test_urls():
    assert url_filter.parts("HTTP://A.Example.COM?x=1&y#f") == ("a.example.com", "", "x=1&y")
    assert url_filter.parts(None) == ("", "", "") and url_filter.parts("no scheme")[:2] == ("", "")
    assert abs(url_filter.entropy("aabb") - 1) < 1e-12
    urls = [f"https://www.{'spam' if k % 3 == 0 else 'news'}{k}.example.org/{k}" for k in range(600)]
    model = url_filter.fit(urls[:400], [int(k % 3 == 0) for k in range(400)])
    assert np.isfinite(model.probability([*urls, None, "", "x"])).all()
    assert url_filter.fit([], []).probability(["a"])[0] < 0.5


def test_router_spreads_evenly():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    router, visits = ann.fit(x, 32)
    size = np.bincount(router.scores(x).argmax(axis=1), minlength=router.parts)
    assert router.parts == 32 and size.max() < 5 * size.mean() and visits < 16
    part = ann.balanced_parts(ann.unit(x), ann.neighbour_graph(ann.unit(x), 10), 32)
    assert np.bincount(part).max() <= np.ceil(3000 / 32 * 1.1)


