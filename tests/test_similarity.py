import random

import pytest

from libris.functions.similarity import jaro_winkler, near_strings, search_scores, similar_pairs, similarity


def slow(a, b):
    if not a and not b:
        return 1.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [y for y, u in zip(b, used, strict=True) if u]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [
        (("Mistborn: The Final Empire", "Brandon Sanderson"), ("The Final Empire", "Brandon Sanderson"), 0.757, 0.777),
        (("The Hobbit, or There and Back Again", "J.R.R. Tolkien"), ("The Hobbit", "J.R.R. Tolkien"), 0.85, 1),
        (("Genesis", "William Shakespeare"), ("Genesis", "John Steinbeck"), 0, 0.8499),
        (("Words of Radiance", "Brandon Sanderson"), ("The Way of Kings", "Brandon Sanderson"), 0, 0.8499),
        (("the great gatsby", "F. Scott Fitzgerald"), ("The Great Gatsby", "F. Scott Fitzgerald"), 0.85, 1),
    ],
)
def test_contract(a, b, low, high):
    assert low <= similarity([a[0]], [a[1]], [b[0]], [b[1]])[0] <= high


def test_search():
    assert search_scores(["The Hobbit", ""], ["J.R.R. Tolkien", ""], "Hobitt")[0] >= 0.72


def test_against_brute_force():
    r = random.Random(4)
    pairs = [("".join(r.choice("abcé夏") for _ in range(r.randrange(9))), "".join(r.choice("abcé夏") for _ in range(r.randrange(9)))) for _ in range(3000)]
    got = jaro_winkler([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(g - slow(a, b)) < 1e-12 for g, (a, b) in zip(got, pairs, strict=True))


def test_no_pair_is_lost(spark):
    r = random.Random(5)
    words = ["red", "river", "dune", "a", "of", "kings", "x"]
    books = list({(" ".join(r.choice(words) for _ in range(r.randrange(5))), r.choice(["ann lee", "anna lee", "", "bo"])) for _ in range(120)})
    df = spark.createDataFrame([*books, (None, None)], "title string, author string")
    got = {(x.left_title, x.left_author, x.right_title, x.right_author) for x in similar_pairs(df, df).collect()}
    books = list({*books, ("", "")})
    both = [(a, b) for a in books for b in books]
    scores = similarity([a[0] for a, _ in both], [a[1] for a, _ in both], [b[0] for _, b in both], [b[1] for _, b in both])
    assert got == {(*a, *b) for (a, b), s in zip(both, scores, strict=True) if s >= 0.85}
    names = df.select("title")
    texts = {b[0] for b in books}
    assert {(x["left"], x["right"]) for x in near_strings(names, names).collect()} == {(a, b) for a in texts for b in texts if slow(a, b) >= 0.85}
