"""SimHash near-dedup with bit-sliced comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations, groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from libris.llm.bitslice import forest, near_pairs
from libris.llm.common import OWN, checkpointed, slices, without
from libris.operators.components import components

#: Shingles hashed before their bits are counted.
_CHUNK = 1 << 16
#: A bucket of more rows than this is split into a grid of blocks.
BLOCK = 16384
#: Groups up to this size are compared by shifting the sorted rows against themselves.
_SMALL = 24
_TURN = 0x3C6EF372
#: Hot buckets (rows of 12 bytes) that are broadcast; more are joined by a shuffle.
_MOST_BROADCAST = 1 << 20
#: Sets of up to this many shingles are too small for sampled keys to be sure.
_SHORT = 40


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``shingle`` words, repeats included, in chunks.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D.  A
    text of fewer words is one shingle, a text of none has none.
    """
    words = text.lower().split()
    if 0 < len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    n = len(words) - shingle + 1
    for start in range(0, n if words else 0, _CHUNK):
        stop = min(n, start + _CHUNK)
        runs = map(b" ".join, zip(*(words[start + i : stop + i] for i in range(shingle)), strict=True))
        yield np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, stop - start)


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hashes, then further hashes of them (SplitMix64's finaliser on h plus multiples of its increment)."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for w in range(1, words):
        z = h + np.uint64((0x9E3779B97F4A7C15 * w) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, w] = z ^ (z >> np.uint64(31))
    return out


def fingerprints(texts: Sequence[bytes | None], shingle: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """(len(texts), words) uint64.  A bit is 1 if it is set in over half the shingles' hashes; no shingle: zero."""
    counts = np.zeros((len(texts), 64 * words), np.int64)
    totals = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        if not held:
            return
        sizes = [len(x) for x in held]
        bits = np.unpackbits(_mixed(np.concatenate(held), words).view(np.uint8).reshape(sum(sizes), 8 * words), axis=1, bitorder="little")
        # eight counters of 8 bits in a word; at most 255 rows are added to one
        starts, of, at = [], [], 0
        for owner, size in zip(owners, sizes, strict=True):
            for s in range(0, size, 255):
                starts.append(at + s)
                of.append(owner)
            at += size
        sums = np.add.reduceat(bits.view(np.uint64), starts, axis=0).view(np.uint8)
        np.add.at(counts, of, sums)
        np.add.at(totals, owners, sizes)
        held.clear()
        owners.clear()

    pending = 0
    for i, text in enumerate(texts):
        for h in shingle_hashes(text, shingle, seed) if text else ():
            held.append(h)
            owners.append(i)
            pending += len(h)
            if pending >= _CHUNK:
                count()
                pending = 0
    count()
    return np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view(np.uint64)


def prints_of(sets: Sequence[np.ndarray], words: int) -> np.ndarray:
    """:func:`fingerprints` of given sets of hashes."""
    out = np.zeros((len(sets), words), np.uint64)
    for i, h in enumerate(sets):
        if len(h):
            ones = sum(np.unpackbits(_mixed(h[a : a + _CHUNK], words).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").sum(0, dtype=np.int64) for a in range(0, len(h), _CHUNK))
            out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)
    return out


def exact_tables(bits: int, radius: int, keep: int = 2) -> list[np.ndarray]:
    """Bit positions of keys such that any two fingerprints within ``radius`` agree on one key at least.

    The bits are cut into radius + keep bands; that many differing bits leave keep
    of them untouched, so every choice of keep bands is a key.
    """
    bands = np.array_split(np.arange(bits), radius + keep)
    return [np.concatenate(x) for x in combinations(bands, keep)]


def sampled_tables(bits: int, tables: int, width: int, seed: int = 1) -> list[np.ndarray]:
    """``tables`` keys of ``width`` bit positions, chosen once by the seed."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(tables)]


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(id, f0, f1, ...), a row per document; a null text counts as empty."""
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            f = fingerprints(batch.column("text").cast(pa.binary()).to_pylist(), shingle, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(f[:, w])) for w in range(words))], names=["id", *names])

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, "id long, " + ", ".join(f"{x} long" for x in names))


def _expand(names: list[str], tables: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per fingerprint and table: the bucket (table and key), the fingerprint's id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                f = np.stack([batch.column(x).to_numpy() for x in names], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
                buckets = np.concatenate([(bits[:, at] @ (np.int64(1) << np.arange(len(at), dtype=np.int64))) + (np.int64(t) << 48) for t, at in enumerate(tables)])
                n = len(tables)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.tile(batch.column("id").to_numpy(), n)), *(pa.array(np.tile(f[:, w], n)) for w in range(len(names)))], names=["bucket", "id", *names])

    return run


def _link(names: list[str], radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges that join what is near within each (bucket, cell) of rows sorted by them."""

    def links(group: np.ndarray, side: np.ndarray, ids: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
        n = len(group)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, n])
        out: list[tuple[int, int]] = []
        for a, size in zip(first[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
            own = ids[a : a + size]
            out += [(int(own[x]), int(own[y])) for x, y in forest(f[a : a + size], side[a : a + size], radius)]
        room = np.repeat(np.where(sizes <= _SMALL, sizes, 0), sizes) - (np.arange(n) - np.repeat(first, sizes)) - 1  # rows after it in its small group
        pairs = []
        for d in range(1, _SMALL):
            at = np.flatnonzero(room >= d)
            if not len(at):
                break
            at = at[(side[at] == 0) | (side[at] != side[at + d])]
            for s in range(0, len(at), 1 << 15):
                i = at[s : s + (1 << 15)]
                i = i[near_pairs(f[i], f[i + d], radius)]
                pairs.append(np.stack([ids[i], ids[i + d]], axis=1))
        if pairs:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            for x, y in np.unique(np.concatenate(pairs), axis=0).tolist():
                if (rx := root(x)) != (ry := root(y)):
                    parent[max(rx, ry)] = min(rx, ry)
                    out.append((x, y))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            get = lambda c: rows.column(c).to_numpy()
            bucket, cell = get("bucket"), get("cell")
            group = np.cumsum(np.r_[0, (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])])
            found = links(group, get("side"), get("id"), np.stack([get(x) for x in names], axis=1).view(np.uint64))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 16:
                continue
            whole = pa.Table.from_batches(held)
            bucket, cell = whole.column("bucket").to_numpy(), whole.column("cell").to_numpy()
            same = (bucket == bucket[-1]) & (cell == cell[-1])
            cut = len(same) - int(same.sum())
            if cut:
                yield done(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            rows = whole.num_rows - cut
        if rows:
            yield done(pa.Table.from_batches(held))

    return run


def _grid_cells(own: Column) -> Column:
    """The cells of a row of block ``own``: one for each of the ``grid`` blocks, with the row's side in it."""
    return F.transform(
        F.sequence(F.lit(0), F.col("grid") - 1),
        lambda j: F.struct((F.least(own, j).cast("long") * F.col("grid") + F.greatest(own, j)).alias("cell"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")),
    )


def fitting_tables(bits: int, radius: int, prints: int) -> list[np.ndarray]:
    """:func:`exact_tables` with keys so long that a table's keys are no fewer than a hundredth of the fingerprints."""
    keep = 2
    while 100 << (bits * keep // (radius + keep)) < prints and keep < 4:
        keep += 1
    return exact_tables(bits, radius, keep)


def near_classes(prints: DataFrame, radius: int, tables: list[np.ndarray] | None = None, block: int = BLOCK, sample: int = 16) -> DataFrame:
    """(f0, ..., root) for every fingerprint in ``prints`` (id, f0, ...).

    Fingerprints are linked when they share a key of ``tables`` (by default :func:`fitting_tables`, which
    miss no pair) and differ in at most ``radius`` bits; root is the smallest id of all that links reach.  Equal
    fingerprints are one row from here on.  A bucket of over ``block`` rows is cut
    into blocks, each pair of which is compared by a task of its own; of the links
    found at one place only those of a spanning forest are passed on.  The sizes of buckets are
    estimated from one row in ``sample``; they decide the blocks only.
    """
    names = [c for c in prints.columns if c != "id"]
    reps = checkpointed(prints.where("id is not null").groupBy(*names).agg(F.min("id").alias("id")))
    tables = tables or fitting_tables(64 * len(names), radius, reps.count())
    keyed = reps.mapInArrow(_expand(names, tables), "bucket long, id long, " + ", ".join(f"{x} long" for x in names))
    counted = reps.select("id", *names).where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(sample)) == 0)
    sizes = counted.mapInArrow(_expand(names, tables), keyed.schema).groupBy("bucket").count().withColumn("count", F.col("count") * sample).where(F.col("count") > block)
    hot = checkpointed(sizes.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("grid")))
    if hot.count() <= _MOST_BROADCAST:
        hot = F.broadcast(hot)
    own = F.pmod(F.xxhash64("id"), F.col("grid")).cast("int")
    cells = F.when(F.col("grid").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side")))).otherwise(_grid_cells(own))
    dealt = keyed.join(hot, "bucket", "left").withColumn("at", F.explode(cells)).select("bucket", F.col("at.cell").alias("cell"), F.col("at.side").alias("side"), "id", *names)
    edges = dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(_link(names, radius), "a long, b long")
    roots = components(edges)
    return reps.join(roots, reps["id"] == roots["node"], "left").select(*names, F.coalesce("root", "id").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, radius: int = 4, tables: list[np.ndarray] | None = None, block: int = BLOCK) -> DataFrame:
    """(id_col, fingerprint, component_id), a row per row of ``docs``.

    Without ``tables`` every pair of fingerprints within ``radius`` is linked.
    component_id is the smallest id that links reach, the row's own included.  Null
    and empty texts have the fingerprint zero, linked like any other.  A row
    whose id is null gets a fingerprint, and the component of equal fingerprints that have
    an id (null if there is none), but is no member itself.
    fingerprint is lowercase hex, 16 digits for each of the words.
    """
    prints = checkpointed(with_fingerprint(docs, id_col, text_col, shingle, words))
    classes = near_classes(prints, radius, tables, block)
    names = [f"f{w}" for w in range(words)]
    joined = prints.join(classes, names, "left")
    return joined.select(F.col("id").alias(id_col), F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in names])).alias("fingerprint"), F.col("root").alias("component_id"))


def similar_bits(bits: int, similarity: float) -> int:
    """Bits in which fingerprints differ on average at that Jaccard similarity of the shingles (for sets of one size)."""
    return round(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The different hashes of :func:`shingle_hashes`, ascending."""
    found = [np.unique(h) for h in shingle_hashes(text, shingle)] if text else []
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def prefix(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest of a set's hashes, so many that two sets of that similarity share one of theirs."""
    n = len(hashes)
    return hashes[: n - math.ceil(n * similarity - 1e-9) + 1] if n else hashes


def _with_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int, similarity: float) -> DataFrame:
    """(id, f0, ..., digest, size, prefix) of each row's shingle set; the prefix only of sets of up to ``_SHORT``."""
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingle_set(x, shingle) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            f = prints_of(sets, words).view(np.int64)
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            first = pa.array([prefix(x, similarity).view(np.int64).tolist() if len(x) <= _SHORT else [] for x in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(f[:, w])) for w in range(words)), digests, sizes, first], names=["id", *names, "digest", "size", "prefix"])

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, "id long, " + ", ".join(f"{x} long" for x in names) + ", digest binary, size long, prefix array<long>")


def _sets_again(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The text of each row replaced by its shingle set; rows whose set isn't the wanted one (another text of that id) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingle_set(x, shingle).tobytes() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            fits = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("root"), batch.column("grid"), pa.array(sets, pa.binary())], names=["id", "root", "grid", "hashes"]).filter(fits)

    return run


def similar_links(ids: list[int], sides: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose exact Jaccard similarity is that or more.

    Sets of side 1 are compared with those of side 2 only, sets of side 0 with all.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    side = np.array(sides)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1]
    counts = np.bincount(inverse)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(inverse, kind="stable")]
    first = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for q in np.flatnonzero(side != 2).tolist():
        at = inverse[ends[q] - sizes[q] : ends[q]]
        m = counts[at]
        shared = np.bincount(holders[np.repeat(first[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=n)
        near = shared / np.maximum(sizes + sizes[q] - shared, 1) >= similarity
        for r in np.flatnonzero(near & ((side == 0) | (side != side[q]))).tolist():
            if (x := root(q)) != (y := root(r)):
                up[max(x, y)] = min(x, y)
                if ids[q] != ids[r]:
                    out.append((ids[q], ids[r]))
    return out


def _confirm(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each (root, cell) of rows sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, c, s, i, h) for b in batches for r, c, s, i, h in zip(*(b.column(x).to_pylist() for x in ("root", "cell", "side", "id", "hashes")), strict=True))
        for _, group in groupby(rows, key=lambda x: x[:2]):
            _, _, sides, ids, sets = zip(*group, strict=True)
            found = np.array(similar_links(ids, sides, [np.frombuffer(x, np.uint64) for x in sets], similarity), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["a", "b"])

    return run


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 4, tables: int = 96, width: int = 16, slack: int = 25, block: int = 1 << 18) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id.

    Linked are texts whose shingle sets have an exact Jaccard similarity of
    ``similarity`` or more.  Fingerprints of 64 * words bits only propose: candidates
    share one of ``tables`` sampled keys of ``width`` bits and differ in at most
    ``slack`` bits more than documents at that similarity do on average
    (:func:`similar_bits`); sets of up to ``_SHORT`` shingles are also candidates
    if they share a hash of their :func:`prefix`, which misses no pair of them.  Within each group
    that candidates connect every pair is compared by its sets; a group of over
    ``block`` shingles is cut into blocks, each pair of which is a task's own.  Null
    texts and texts without a word are equal, so one of them stays.  Rows whose id is
    null are kept and hide none; of several rows of a surviving id all stay.
    """
    judged = docs.where(F.col(f"`{id_col}`").isNotNull())
    bits = 64 * words
    names = [f"f{w}" for w in range(words)]
    prints = checkpointed(_with_sets(judged, id_col, text_col, shingle, words, similarity))
    reps = checkpointed(prints.groupBy("digest").agg(F.min("id").alias("id"), *[F.first(x).alias(x) for x in (*names, "size", "prefix")]))
    classes = near_classes(reps.select("id", *names), similar_bits(bits, similarity) + slack, sampled_tables(bits, tables, width))
    placed = checkpointed(reps.join(classes, names).select("id", "digest", "size", "prefix", "root"))
    heads = placed.select("root", F.explode("prefix").alias("head")).distinct()
    least = heads.groupBy("head").agg(F.min("root").alias("b"), F.max("root").alias("most")).where("b < most").select(F.col("head").alias("same"), "b")
    merged = components(heads.join(least, heads["head"] == least["same"]).select(F.col("root").alias("a"), "b")).withColumnRenamed("root", "top")
    grouped = placed.join(merged, placed["root"] == merged["node"], "left").select("id", "digest", "size", F.coalesce("top", "root").alias("root"))
    grids = grouped.groupBy(F.col("root").alias("of")).agg(F.count("*").alias("n"), F.ceil(F.sum("size") / block).cast("int").alias("grid")).where("n > 1 and grid > 0")
    # the key is changed, so that a large group is an ordinary skewed join
    turned = lambda x: F.col(x).bitwiseXOR(F.lit(_TURN).cast("long"))
    members = grouped.join(grids.select(turned("of").alias("of"), "grid"), turned("root") == F.col("of")).select(F.col("id").alias("member"), "digest", "root", "grid")
    texts = judged.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sets = texts.join(members, texts["id"] == members["member"]).select("id", "text", "digest", "root", "grid").mapInArrow(_sets_again(shingle), "id long, root long, grid int, hashes binary")
    own = F.pmod(F.xxhash64("id"), F.col("grid")).cast("int")
    dealt = sets.withColumn("at", F.explode(_grid_cells(own))).select("root", F.col("at.cell").alias("cell"), F.col("at.side").alias("side"), "id", "hashes")
    links = dealt.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(_confirm(similarity), "a long, b long")
    roots = components(links)
    same = reps.select(F.col("digest").alias("of"), F.col("id").alias("rep"))
    found = prints.join(same, prints["digest"] == same["of"]).join(roots, F.col("rep") == roots["node"], "left")
    gone = found.where(F.col("id") != F.coalesce("root", "rep")).select(F.col("id").alias(f"{OWN}id")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(f"{OWN}id"), "left_anti")
