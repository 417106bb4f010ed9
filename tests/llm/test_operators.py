"""The operators on DataFrames: small cases against brute force, and every input that mustn't crash them."""

import hashlib
import itertools
import random
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from libris.llm import ann, media, packing, queries, simhash, spans, toxicity, url_filter
from libris.llm.bpe import ByteBPE, decoded, encoded
from libris.llm.line_dedup import dedup_lines, line_windows
from libris.llm.substring_dedup import dedup_substrings, sentence_runs
from libris.llm.token_counts import Rollup, byte_bpe_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def sentence(r, n=None):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) for _ in range(n or r.randrange(3, 12))).capitalize() + "."


def corpus(seed=0, n=40):
    r = random.Random(seed)
    shared = ["\n".join(sentence(r, 9) for _ in range(7)) for _ in range(3)]
    rows = []
    for i in range(n):
        body = ["\n".join(" ".join(sentence(r) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 8)))]
        if r.random() < 0.4:
            body.append(r.choice(shared))
        rows.append((i, "\n".join(body)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\n "), (None, rows[0][1]), (n + 3, rows[0][1]), (3, rows[3][1]), (n + 4, "word " * 30_000), (n + 5, "É🙂 ．\x1c\ttab")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def kept(rows, segment):
    """Texts after removal, by brute force over all spans; ``segment`` gives pieces and (first, last, normal form)."""
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None and t is not None), key=lambda x: x[0]):
        for a, _, s in segment(t)[1]:
            first.setdefault(s, (i, a))
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        pieces, found = segment(t)
        gone = {k for a, b, s in found if first[s] < (i, a) for k in range(a, b + 1)}
        out.append((i, "".join(x for k, x in enumerate(pieces) if k not in gone)))
    return sorted(out, key=str)


def slow_lines(text):
    pieces = re.findall(r"[^\n]*\n|[^\n]+$|^$|(?<=\n)$", text)
    full = [i for i, x in enumerate(pieces) if x.strip(" \t\r\f\v\n")]
    runs = [full[k : k + 3] for k in range(len(full) - 2)]
    return pieces, [(r[0], r[2], tuple(pieces[i].strip(" \t\r\f\v\n") for i in r)) for r in runs]


def slow_sentences(text):
    words = re.findall(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text)
    if not words:
        return [text], []
    words[0] = text[: len(text) - len("".join(words))] + words[0]
    raw, own = [], []
    for k, w in enumerate(words):
        own.append(w)
        if w.rstrip(" \t\n\v\f\r")[-1] in ".!?" or "\n" in (w.lstrip(" \t\n\v\f\r") if k == 0 else w) or k == len(words) - 1:
            raw.append(own)
            own = []
    whole, own = [], []
    for k, x in enumerate(raw):
        own += x
        if len(x) >= 5 or k == len(raw) - 1:
            whole.append(own)
            own = []
    pieces = []
    for x in whole:
        ends = list(range(len(x), 0, -12))[::-1]
        pieces += ["".join(x[max(0, e - 12) : e]) for e in ends]
    return pieces, [(k, k + 2, tuple(re.findall(r"[^ \t\n\v\f\r]+", "".join(pieces[k : k + 3])))) for k in range(len(pieces) - 2)]


@pytest.mark.parametrize(("dedup", "segment", "n"), [(dedup_lines, slow_lines, "n_lines"), (dedup_substrings, slow_sentences, "n_sentences")])
def test_span_removal(spark, docs, empty, dedup, segment, n):
    rows = corpus()
    got = dedup(docs.withColumn("N_Removed", F.lit("x")).withColumn("marks", F.lit(1))).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == kept([(r[0], r[1]) for r in rows], segment)
    assert any(r.n_removed for r in got) and all(r.n_removed == 0 for r in got if r.doc_id is None) and got[0].marks == 1
    assert dedup(empty).columns == [*empty.columns, n, "n_removed"] and dedup(empty).count() == 0


@pytest.mark.parametrize(("dedup", "segment"), [(dedup_lines, slow_lines), (dedup_substrings, slow_sentences)])
def test_an_id_on_a_third_of_all_rows(spark, dedup, segment):
    r = random.Random(6)
    shared = "\n".join(sentence(r, 8) for _ in range(5))
    rows = [(i, f"{sentence(r)}\n{shared}\n{sentence(r)}") for i in range(1, 200)] + [(100, f"own {k % 7}.\n{shared}\nend {k % 3}.") for k in range(120)]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == kept(rows, segment)


def test_repeats_within_a_text():
    text = "a\nb\nc\nx\na\nb\nc\n"
    assert spans.clean(text.encode(), line_windows(), []) == (b"a\nb\nc\nx\n", 8, 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bb", "c.", "d!", "é?", "\n", " ", "\t", "\x1c", "\xa0", "12. "]), max_size=80))
def test_pieces_and_spans(parts):
    text = " ".join(parts)
    for segment, slow in ((line_windows(), slow_lines), (sentence_runs(), slow_sentences)):
        got, (pieces, found) = segment(text.encode()), slow(text)
        if slow is slow_lines or text.strip(" \t\n\v\f\r"):
            assert [text.encode()[a:z].decode() for a, z in itertools.pairwise(got.cuts)] == pieces
        assert list(zip(got.first, got.last, strict=True)) == [(a, b) for a, b, _ in found]
        assert [got.keys[i] == got.keys[0] for i in range(len(found))] == [x[2] == found[0][2] for x in found]


def test_a_passage_is_found_whatever_stands_around(spark):
    r = random.Random(9)
    passage = " ".join(sentence(r, 11) for _ in range(5))
    one = " ".join(["w" + str(k) for k in range(60)]) + "."
    own = [f"Own start {i} is here. {p} Own end {i} stays there." for i, p in enumerate([passage, passage, one, one])]
    got = {x.doc_id: x.text for x in dedup_substrings(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    assert got[0] == own[0] and got[2] == own[2]
    assert all(got[i] == f"Own start {i} is here. Own end {i} stays there." for i in (1, 3))


def test_a_passage_spliced_into_a_sentence_is_found(spark):
    r = random.Random(11)
    shapes = [[51], [40, 15], [31, 6, 16], [15, 36], [15, 18, 18], [50, 1], [20, 20, 20]]
    for n in range(51, 61):
        for _ in range(4):
            cuts = sorted(r.sample(range(1, n), r.randrange(4)))
            shapes.append([b - a for a, b in zip([0, *cuts], [*cuts, n], strict=True)])
    rows, want = [], {}
    for k, shape in enumerate(shapes):
        words = [[f"p{k}s{i}w{j}" for j in range(n)] for i, n in enumerate(shape)]
        passage = " ".join(" ".join(x) + "." for x in words)
        for copy in range(2):
            own = [f"o{k}c{copy}w{j}" for j in range(r.randrange(1, 40))]
            rest = " ".join(f"e{k}c{copy}w{j}" for j in range(9)) + "."
            want[len(rows)] = (copy, " ".join(own), rest, sum(shape))
            rows.append((len(rows), f"{' '.join(own)} {passage} {rest}"))
    got = {x.doc_id: x.text for x in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (copy, own, rest, n) in want.items():
        left = got[i].split()
        assert got[i].startswith(own) and got[i].endswith(rest)
        assert got[i] == rows[i][1] if not copy else len(left) - len(own.split()) - 9 <= 11 + 4, (shapes[i // 2], got[i])


def links(rows, radius):
    f = [(i, simhash.fingerprints([(t or "").encode()], 4)[0, 0]) for i, t in rows]
    ids = np.array([i for i, _ in f if i is not None])
    v = np.array([x for i, x in f if i is not None], np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= radius
    root = ids.copy()
    for _ in range(len(ids)):
        root = np.array([root[near[k]].min() for k in range(len(ids))])
    return dict(zip(ids.tolist(), root.tolist(), strict=True))


@pytest.mark.parametrize("block", [4, 16384])
def test_simhash(spark, docs, empty, block):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(80)) for _ in range(6)]
    rows = [(i, t) for i, (_, t, *_) in enumerate(corpus())] + [(500 + k, " ".join(w for w in base[k % 6].split() if r.random() > 0.03)) for k in range(60)] + [(None, "x y"), (900, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("f0", F.lit(2))
    got = simhash.near_duplicates(df, block=block).collect()
    want = links(rows, 4)
    assert len(got) == len(rows) and all(x.component_id == want[x.doc_id] for x in got if x.doc_id is not None)
    assert [x.component_id for x in got if x.doc_id is None] == [900]
    assert next(x.fingerprint for x in got if x.doc_id == 41) == "0" * 16
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_similarity(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join([*w[:150], word(), *w[151:]])) for i, w in enumerate(base[:20])] + [(200, ""), (201, None), (None, rows[0][1])]
    left = {x.doc_id for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {*range(40), 200, None}


def test_near_duplicates_are_confirmed_by_jaccard(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))

    def edited(n, k):  # n shingles, 5 k of which change
        w = [word() for _ in range(n + 4)]
        step = n // k
        return w, [word() if i % step == 4 and i // step < k else x for i, x in enumerate(w)]

    def longer(n, more):
        w = [word() for _ in range(n + 4)]
        return w, [*w, *(word() for _ in range(more))]

    kinds = {"0.75": lambda: edited(280, 8), "0.8": lambda: edited(270, 6), "0.85": lambda: edited(270, 4), "0.9": lambda: edited(270, 3), "4 of 5": lambda: longer(4, 1), "12 of 15": lambda: longer(12, 3), "11 of 15": lambda: longer(11, 4)}
    rows, second = [], {}
    for kind, make in kinds.items():
        for _ in range(100):
            a, b = (" ".join(x) for x in make())
            second[len(rows) + 1] = kind
            rows += [(len(rows), a), (len(rows) + 1, b)]
    left = {x.doc_id for x in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=1 << 10).collect()}
    assert {i for i, _ in rows if i not in second} <= left
    gone = {kind: sum(k == kind and i not in left for i, k in second.items()) for kind in kinds}
    assert gone["0.75"] == gone["11 of 15"] == 0 and gone["0.8"] >= 99 and gone["0.85"] == gone["0.9"] == 100 and gone["4 of 5"] >= 99 and gone["12 of 15"] >= 99, gone


@pytest.mark.parametrize("block", [7, 20_000])
def test_nearest(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 12))[rng.integers(0, 30, 900)] + 0.2 * rng.normal(size=(900, 12))
    x[50:120] = x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (950, [float("inf")] + [1.0] * 11), (None, rows[1][1]), (904, [1.0, None] + [1.0] * 10), (905, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)).withColumn("part", F.lit(0))
    got = {}
    for g in ann.nearest(df, F.col("vec_id") % 50 == 0, block=block).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    n = x / np.sqrt((x * x).sum(1, keepdims=True))
    assert set(got) == {i for i in range(900) if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        s = n @ n[q]
        s[q] = -9
        s[50:120] = s[51] if q != 50 else s[51]
        if 50 <= q < 120:
            s[q] = -9
        order = np.lexsort((np.arange(900), -s))[:5].tolist()
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hit += len(set(order) & {f[1] for f in found})
    assert [f[1] for f in got[50]] == [51, 52, 53, 54, 55] and hit >= 0.9 * 5 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert [r["rank"] for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_url_filter(spark):
    urls = ["http://a.example.com/en/x", "https://www.EXAMPLE.com/en/", "http://b.net/es/1", "http://b.net/esx", "http://notcom/", None, "", "nope", "http://com", "http://x.com?u=http://y.net/es/", "ftp://example.com/en/#f"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("Host", F.lit("old"))
    got = {r.page_id: r for r in url_filter.filter_urls(df, url_filter.rules(queries.URL_RULES)).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, None, None, None, "example.com/en/"]
    assert [got[i].verdict for i in (0, 1, 2, 10)] == ["block", "allow", "block", "block"] and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert (got[9].host, got[9].path, got[1].host, got[5].host, got[7].path) == ("x.com", "", "www.example.com", "", "")
    assert got[8].path == ""
    com = url_filter.filter_urls(spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string"), url_filter.rules(queries.URL_RULES)).first()
    assert (com.rule, com.verdict) == ("com/", "allow")
    assert url_filter.filter_urls(df.limit(0), url_filter.rules(queries.URL_RULES)).count() == 0


def test_ties_of_url_rules(spark):
    df = spark.createDataFrame([(1, "http://b.com/abcd"), (2, "http://x.org/")], "page_id long, url string")
    lines = ["allow b.com/ab", "block com/abcd", "block x.org/", "allow x.org/"]
    for order, want in ((lines, [("b.com/ab", "allow"), ("x.org/", "block")]), (lines[::-1], [("com/abcd", "block"), ("x.org/", "allow")])):
        assert [(r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules("\n".join(order))).orderBy("page_id").collect()] == want


def test_url_training_takes_the_smallest_hashes(spark):
    urls = spark.range(9000).select(F.concat(F.lit("http://h/"), F.col("id") % 4000).alias("url"), (F.col("id") % 2).alias("blocked"))
    seen = []
    real = url_filter.fit
    url_filter.fit = lambda u, y: seen.append(dict(zip(u, y, strict=True))) or real(u, y)
    try:
        url_filter.train(urls, most=50)
    finally:
        url_filter.fit = real
    order = urls.groupBy("url").agg(F.max("blocked").alias("y")).orderBy(F.xxhash64("url")).limit(50)
    assert seen == [{r.url: r.y for r in order.collect()}]


def test_token_rollup(spark, tmp_path):
    kinds = "change string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), kinds)
    r = Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("a/1 %", batch(("insert", "s", "en", "t", 10, None, None, None), ("insert", None, "en", "t", 5, None, None, None)))
    assert not r.commit("a/1 %", batch(("insert", "s", "en", "t", 99, None, None, None)))
    assert r.commit("b", batch(("revise", "s2", "en", "t", 12, "s", "en", 10), ("delete", None, "en", "t", 5, None, None, None)))
    want = {("s2", "en", "t", 1, 12)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and not r.commit("b", batch()) and r.committed() == {"a/1 %", "b"}
    assert r.commit("c", batch(("insert", "s2", "en", "t", 1, None, None, None)))
    r.compact()
    assert {tuple(x) for x in Rollup(spark, str(tmp_path / "r")).totals().collect()} == {("s2", "en", "t", 2, 13)}
    with pytest.raises(Exception, match="not a change"):
        r.commit("d", batch((None, "s", "en", "t", 1, None, None, None)))
    assert "d" not in r.committed()


def test_one_of_two_writers_of_a_batch_counts(spark, tmp_path):
    kinds = "change string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokens long"
    r = Rollup(spark, str(tmp_path / "r"))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: r.commit("same", spark.createDataFrame([("insert", "s", "en", "t", 10 + k, None, None, None)], kinds)), range(4)))
    assert done.count(True) == 1 and [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 1, 10 + done.index(True))]


def test_counts_of_very_long_texts(spark):
    texts = [None, "", " " * 5_000_000, "a" * 1_000_000, "\t" * 200_000 + "x", "plain text", ("word " * 400_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: (r.n, r.w) for r in df.select("i", byte_bpe_counts("text", BYTES, P.PATTERN).alias("n"), packing.token_counts("text", WORDS).alias("w")).collect()}
    assert got[0] == got[1] == (0, 0) and got[2][1] == 0 and got[2][0] > 0 and got[5] == (2, 2) and got[6][1] == 400_000
    ids = {r.i: r.n for r in df.select("i", F.size(encoded("text", BYTES, P.PATTERN)).alias("n")).collect()}
    assert ids == {i: n for i, (n, _) in got.items()}


def test_little_is_remembered_of_odd_texts(spark):
    bpe = ByteBPE.from_file(BYTES, P.PATTERN)
    for k in range(60):
        bpe.encode_all(["\t".join(f"w{k}x{i}" for i in range(50_000)), f"{k}" * 300_000])
        assert len(bpe.kept.numbers) <= bpe.kept.most + 50_000 and max(map(len, bpe.kept.numbers)) <= 48 and not bpe.kept.numbers.long


def test_bpe_columns(spark, docs, empty):
    rows = docs.withColumn("ids", encoded("text", BYTES, P.PATTERN)).withColumn("back", decoded("ids", BYTES)).collect()
    assert all(bytes(r.back) == (r.text or "").encode() for r in rows)
    assert empty.select(encoded("text", BYTES, P.PATTERN).alias("ids")).select(decoded("ids", BYTES)).count() == 0


def test_media_columns(spark, docs, empty):
    rows = docs.withColumn("media", media.stored_text("text")).withColumn("read", media.image_features("media")).collect()
    assert all(bytes(r.read.payload) == media.padded(r.text) and r.read.error is None for r in rows)
    assert empty.select(media.image_features(media.stored_text("text"))).count() == 0


def test_packing(spark, docs, empty):
    got = queries.packed(docs).collect()
    tokenizer = packing.WordCache(WORDS).tokenizer
    by_doc = {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
    texts = {}
    for i, t, *_ in corpus():
        texts.setdefault(i, []).append(t)
    for i, copies in texts.items():
        ids = np.array([*tokenizer.encode(copies[0] or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) * len(copies)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in own)
    assert_packed(got)
    assert queries.packed(empty).count() == 0


def assert_packed(got, capacity=4096):
    """Sequences without a gap, none over capacity; their number."""
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_short_pieces_are_bundled_and_a_hot_id_is_dealt_out(spark):
    r = random.Random(4)
    rows = [(7, 0, n, n) for n in [1] * 9000 + [r.randrange(1, 12) for _ in range(4000)]] + [(i, 0, n, n) for i, n in enumerate(r.randrange(1, 400) for _ in range(2000))]
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, doc_tokens long").repartition(5)
    got = packing.pack(cut, bucket_rows=500).collect()
    assert len(got) == len(rows) and assert_packed(got) <= 1.06 * sum(x[2] for x in rows) / 4096 + 1
    assert sorted(p.length for p in got if p.doc_id == 7) == sorted(x[2] for x in rows if x[0] == 7)


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def test_toxicity_learns_from_the_allowed_rows_only(spark, sf):
    rows = queries.op8_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_on_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)] * 3 + [(None, True)], "doc_id long, bad boolean").select("doc_id", F.col("bad").cast("int").alias("toxic"))
    both = docs.unionByName(docs).withColumn("text", F.when(F.col("doc_id") == 5, F.repeat(F.lit("long text "), 300_000)).otherwise(F.col("text")))
    for table in (both, empty):
        model = toxicity.train(table, labels)
        scores = [r.s for r in table.select(toxicity.toxicity("text", model).alias("s")).collect()]
        assert len(scores) == table.count() and all(0 <= x <= 1 for x in scores)
    assert toxicity.train(both, labels.limit(0)).weights[0] == -40


def test_toxicity_finds_most_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    found = [r.predicted for r in rows if r.toxic == 1]
    assert sum(found) > 0.6 * len(found) and sum(r.predicted for r in rows if r.toxic == 0) <= 0.03 * len(rows)


def test_token_count_query_is_the_plain_sum(spark, sf):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    count = {"byte_bpe_50k": lambda t, e=tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}): len(e.encode_ordinary(t))}
    tokenizer = packing.WordCache(WORDS).tokenizer
    count["word_bpe_49k"] = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for v, f in count.items():
            a, b = want.get((d.source, d.lang, v), (0, 0))
            want[d.source, d.lang, v] = (a + 1, b + f(d.text or ""))
    assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in queries.op5_token_counts(spark, sf).collect()} == want


def test_digests_of_queries(spark, sf):
    texts = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_media(spark, sf).collect():
        p = media.padded(texts[r.doc_id].decode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest() for r in queries.op7_bpe(spark, sf).collect())


def test_pipeline(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    seen = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == source.columns and 0 < after.count() <= seen.count()
        seen = after
    texts = [r.text for r in seen.collect()]
    assert len(texts) == len(set(texts))
    assert len(corpus_pipeline.STAGES) == 5
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in seen.collect()}


def similar_roots(rows):
    """Smallest id that links of an exact Jaccard similarity of 0.8 on five-word shingles reach."""
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^ \t-\r]+", (t or "").encode().lower())
        runs = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sets.append((i, runs))
    root = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        before = dict(root)
        for (i, a), (j, b) in itertools.combinations(sets, 2):
            if len(a & b) >= 0.8 * len(a | b):
                root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


def test_pipeline_by_brute_force(spark, sf):
    """Every stage's rows against plain Python on the stage's own input; only the model of toxicity is the operator's."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({i for i, _ in rows}) == len(rows)

    def edited(segment, rows):
        new = dict(kept(rows, segment))
        return [(i, new[i]) for i, t in rows if t is None or new[i] == t or re.search(r"\S", new[i])]

    rows = [(i, t) for i, t in rows if toxicity.score(t or "", model) < 0.7]
    rows = edited(slow_lines, rows)
    root = similar_roots(rows)
    rows = [(i, t) for i, t in rows if root[i] == i]
    rows = edited(slow_sentences, rows)
    tokenizer = packing.WordCache(WORDS).tokenizer
    got = corpus_pipeline.run(spark, sf).collect()
    assert_packed(got)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert {p.doc_id: p.doc_tokens for p in got} == {i: len(x) for i, x in ids.items()}
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in got)
    assert sum(p.length for p in got) == sum(map(len, ids.values()))


def test_queries_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        rel, df = con.sql(sql), queries.QUERIES[name](spark, sf)
        names = sorted(rel.columns)
        assert sorted(df.columns) == names
        mine = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
        assert mine == sorted(repr(tuple(r[rel.columns.index(c)] for c in names)) for r in rel.fetchall()), name


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
