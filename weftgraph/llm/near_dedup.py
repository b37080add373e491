"""Near-duplicates by DartMinHash, banded joining and exact verification.

A text is a weighted set: its shingles of five words, each with the number of its occurrences as weight; the
similarity of two texts is their weighted Jaccard similarity, and texts at ``SIMILARITY`` or more are linked.

Signature. An element of weight w owns the region [0, w) x [0, phi) of a plane (weight x rank). Each unit cell
of the plane receives Poisson(1) darts, all derived from a hash of element and cell: position in the cell,
one of ``COORDINATES`` coordinates and a name. A document of total weight W keeps the darts in its elements'
regions up to the rank phi = t / W, about t = k ln k + 2 k darts whatever its size, and for each coordinate
the dart of lowest rank; documents with an empty coordinate double phi. Two documents agree in a coordinate
with probability equal to their similarity.

Join. ``BANDS`` bands of ``ROWS`` coordinates are hashed; texts that share a band are candidates: a pair at 0.8
shares one with probability 1 - (1 - 0.8^5)^25 > 0.9999. Texts with the same words are first folded into one
representative, so copies cost one row each. In each bucket the representative that shares most buckets with
others is the pivot, and every other member is compared with it on the whole texts; members that end up in
another component than their pivot are dealt with again, with a pivot of their own, for ``ROUNDS`` rounds.
So a bucket of m texts gives at most ROUNDS (m - 1) pairs, and most groups are one component by then.
Buckets that still hold several components are compared exactly: their members, in families of buckets that
touch, are dealt into blocks of about ``BLOCK`` texts, the members of one large component into blocks of
their own, and each pair of blocks but those of one component is one task, which counts shared shingles
block against block in memory and gives only links between components. No task holds more than two blocks.
Components of all links are the classes.

Defined results: each row of a text without words (null, empty, white space) is a class of its own, named by
its doc_id; a text of fewer than five words is one shingle; a very long text is compared whole; classes are
named by their smallest doc_id; rows of one doc_id that repeat are in one class if their texts are linked, else
in several, of which the one with the smallest digest of words has the doc_id for a name and each other a
negative number hashed from its digest; rows without doc_id are not linked and have a null class; an empty
table gives an empty result; other columns, whatever their names, are not read by classes() and decide ties in
keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import broadcast_if_small, keep_rows, kept, materialize, named, row_key, scratch, text_slices

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 125
ROWS = 5
BANDS = COORDINATES // ROWS
ROUNDS = 1
BLOCK = 1_000
BLOCK_CHARS = 5_000_000
#: A shingle in so many texts of two blocks is counted by matrix product, else pair by pair.
DENSE = 24
SLICE = 500_000
#: Cells of the plane looked at at once.
CELLS = 300_000

#: Odd, so it has an inverse modulo 2^64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x):
    """Finaliser of a 64-bit hash, on a uint64 array."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(texts: list[str]):
    """Hash of each word, and the number of words of each text."""
    import numpy as np

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    power = np.empty(len(data) + 1, np.uint64)
    power[0] = 1
    power[1:] = BASE
    power = np.cumprod(power, dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    power[1:] = INVERSE
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    hashes = mix((total[ends] - total[starts]) * power[starts])
    limits = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))


def elements_of(words, sizes, shingle: int = SHINGLE):
    """Unit elements (shingle, number of occurrence) of each text as hashes, grouped by text, and their number."""
    import numpy as np

    counts = np.where(sizes > 0, np.maximum(1, sizes - shingle + 1), 0)
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(doc))
    end = np.repeat(begin + sizes, counts)
    h = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([words, np.zeros(shingle, np.uint64)])
    for k in range(shingle):
        inside = at + k < end
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[np.minimum(at + k, len(padded) - 1)], np.uint64(0)) + np.uint64(k + 1))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occurrence = (np.arange(len(h)) - first).astype(np.uint64)
    return mix(h + occurrence * np.uint64(0xD1342543DE82EF95)), counts


def dart_signatures(elements, counts, k: int = COORDINATES):
    """(texts, k) array: for each coordinate the earliest dart as rank (40 bits) and name (24 bits)."""
    import math

    import numpy as np

    none = np.uint64(2**64 - 1)
    out = np.full((len(counts), k), none, np.uint64)
    begin = np.cumsum(counts) - counts
    cdf = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
    limits = (cdf * 2**32).astype(np.uint64)
    todo, darts = np.flatnonzero(counts > 0), k * math.log(k) + 2 * k
    done = np.zeros(len(counts))  # ranks below this are thrown
    while len(todo):
        phi = darts / counts[todo]
        low, high = np.floor(done[todo]).astype(np.int64), np.ceil(phi).astype(np.int64)
        cells = (high - low) * counts[todo]
        for part in np.split(np.arange(len(todo)), np.flatnonzero(np.diff(np.cumsum(cells) // CELLS)) + 1):
            d = todo[part]
            wide = (high - low)[part]
            doc = np.repeat(part, cells[part])
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(cells[part]) - cells[part], cells[part])
            e = elements[np.repeat(begin[d], cells[part]) + nth // np.repeat(wide, cells[part])]
            cell = nth % np.repeat(wide, cells[part]) + np.repeat(low[part], cells[part])
            h = mix(e ^ mix(cell.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
            n = np.searchsorted(limits, h & np.uint64(0xFFFFFFFF), "right")
            src = np.repeat(np.arange(len(h)), n)
            nth = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(h[src] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rank = (cell[src].astype(np.uint64) << np.uint64(30)) | (dart >> np.uint64(34))
            keep = rank < (phi[doc[src]] * 2**30).astype(np.uint64)
            src, dart, rank = src[keep], dart[keep], rank[keep]
            coordinate = (dart & np.uint64(0xFFFF)) % np.uint64(k)
            packed = (rank << np.uint64(24)) | (mix(dart) & np.uint64(0xFFFFFF))
            np.minimum.at(out.reshape(-1), todo[doc[src]] * k + coordinate.astype(np.int64), packed)
        done[todo] = phi
        todo = todo[(out[todo] == none).any(1)]
        darts *= 2
    return out


def band_keys(signatures, rows: int = ROWS):
    """(texts, bands) int64."""
    import numpy as np

    bands = signatures.shape[1] // rows
    s = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2])
    for r in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return h.view(np.int64)


def sequence_digest(words, sizes):
    """128 bits of each text's word sequence."""
    import numpy as np

    begin = np.cumsum(sizes) - sizes
    nth = np.arange(len(words)) - np.repeat(begin, sizes)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        v = np.concatenate([mix(words ^ mix(nth.astype(np.uint64) * np.uint64(salt) + np.uint64(salt))), [np.uint64(0)]])
        total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        out.append(mix(total[begin + sizes] - total[begin] + sizes.astype(np.uint64)).view(np.int64))
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the row key k1, k2, d1, d2 (digest of the words), bands; null bands for a text without words."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                words, sizes = words_of([t or "" for t in part.column("text").to_pylist()])
                d1, d2 = sequence_digest(words, sizes)
                keys = band_keys(dart_signatures(*elements_of(words, sizes)))
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)), mask=pa.array(sizes == 0))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(d1), pa.array(d2), bands], ["doc_id", "k1", "k2", "d1", "d2", "bands"])

    k1, k2 = row_key(docs)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, d1 long, d2 long, bands array<long>")


def similarities(left: list[str], right: list[str]):
    """Weighted Jaccard similarity of each pair of texts, on the whole texts."""
    import numpy as np

    n = len(left)
    e, counts = elements_of(*words_of(left + right))
    pair = np.repeat(np.arange(2 * n) % n, counts)
    key = np.sort(mix(e + mix(pair.astype(np.uint64) + np.uint64(1))))
    # Elements of one text differ, so a key that comes twice is in both texts of its pair.
    twice = key[1:][key[1:] == key[:-1]]
    mine = mix(e + mix(pair.astype(np.uint64) + np.uint64(1)))[: counts[:n].sum()]
    both = np.bincount(pair[: len(mine)][np.isin(mine, twice)], minlength=n)
    return both / np.maximum(1, counts[:n] + counts[n:] - both)


def verified(edges: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The edges(rep, pivot) whose texts(id, text) are at least so similar."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                for k in range(0, part.num_rows, 2_000):
                    some = part.slice(k, 2_000)
                    s = similarities(some.column("text").to_pylist(), some.column("other").to_pylist())
                    yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("pivot")], ["rep", "pivot"]).filter(pa.array(s >= least - 1e-12))

    pairs = edges.join(texts.select(F.col("id").alias("rep"), "text"), "rep").join(texts.select(F.col("id").alias("pivot"), F.col("text").alias("other")), "pivot")
    return pairs.select("rep", "pivot", "text", "other").mapInArrow(run, "rep long, pivot long")


def linked(texts: list[str], least: float):
    """Index pairs (i < j) of texts at least so similar, by counting shared elements of all with all in memory."""
    import numpy as np

    n = len(texts)
    parts = [elements_of(*words_of(texts[k : k + 200])) for k in range(0, n, 200)]
    e, counts = np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])
    doc = np.repeat(np.arange(n), counts)
    order = np.argsort(e, kind="stable")
    e, doc = e[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    df = np.diff(np.concatenate([first, [len(e)]]))
    both = np.zeros((n, n), np.float32)
    dense = np.flatnonzero(df >= DENSE)
    for k in range(0, len(dense), 2_048):
        some = dense[k : k + 2_048]
        m = np.zeros((n, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), df[some])
        at = np.repeat(first[some], df[some]) + np.arange(len(column)) - np.repeat(np.cumsum(df[some]) - df[some], df[some])
        m[doc[at], column] = 1
        both += m @ m.T
    flat = both.reshape(-1)
    for size in range(2, DENSE):
        some = first[df == size]
        a, b = np.triu_indices(size, 1)
        for k in range(0, len(some), 4_000):
            d = doc[some[k : k + 4_000, None] + np.arange(size)]
            np.add.at(flat, (d[:, a] * n + d[:, b]).ravel(), 1)
    i, j = np.nonzero(np.triu(both, 1))
    shared = both[i, j]
    keep = shared / (counts[i] + counts[j] - shared) >= least - 1e-6
    # Counts are whole numbers below 2^24, so the product is exact; the limit is tested again in double precision.
    i, j, shared = i[keep], j[keep], shared[keep].astype(np.float64)
    keep = shared >= (least - 1e-12) * (counts[i] + counts[j] - shared)
    return i[keep], j[keep]


def block_links(buckets: DataFrame, component: DataFrame, texts: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """rep, pivot: the links between members of one bucket that are in different components, found block against block."""
    rows = buckets.join(component.select(F.col("id").alias("rep"), "component"), "rep", "left").select("bucket", "rep", "weight", F.coalesce("component", "rep").alias("c"))
    rows = materialize(rows, "near-rest")
    mixed = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.struct("weight", "rep"))["rep"].alias("head")).filter("low <> high").select("bucket", "head")
    rows = materialize(rows.join(mixed, "bucket").select("rep", "c", "head").distinct(), "near-mixed")
    # A member's family is that of its first head; heads of one member are of one family.
    firsts = materialize(rows.groupBy("rep", "c").agg(F.min("head").alias("first")), "near-firsts")
    family = connected_components(rows.join(firsts.select("rep", "first"), "rep").select("first", "head").distinct(), "first", "head").select(F.col("id").alias("first"), F.col("component").alias("family"))
    members = firsts.join(family, "first").select("rep", "c", "family").join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    members = materialize(members.withColumn("chars", F.length("text").cast("long")), "near-members")
    blocks_for = lambda: F.ceil(F.greatest(F.sum("n") / block, F.sum("chars") / BLOCK_CHARS)).cast("int")

    comps = members.groupBy("family", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    # The pool of a component: its own if it fills a block, else the family's common one; small families share pools.
    comps = comps.withColumn("pool", F.when((F.col("n") >= block) | (F.col("chars") >= BLOCK_CHARS), F.col("c")))
    comps = materialize(comps, "near-comps")
    total = comps.groupBy("family").agg(F.sum("n").alias("m"), F.sum("chars").alias("total_chars"))
    small = (F.col("m") < block // 4) & (F.col("total_chars") < BLOCK_CHARS // 4)
    size = total.filter(small).agg(F.sum("m"), F.sum("total_chars")).first()
    bins = max(1, -(-(size[0] or 0) // (block // 2)), -(-(size[1] or 0) // (BLOCK_CHARS // 2)))
    total = materialize(total.select("family", F.when(small, -1 - F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.col("family")).alias("place"), small.alias("small")), "near-total")
    comps = comps.join(total, "family")
    pools = materialize(comps.groupBy("place", "pool", "small").agg(blocks_for().alias("blocks")).withColumn("blocks", F.when(F.col("small"), 1).otherwise(F.col("blocks"))), "near-pools")
    each = pools.select("place", "pool", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("name", F.xxhash64("place", "pool", "block"))
    each = materialize(each, "near-blocks")
    two = each.select("place", F.col("pool").alias("pool2"), F.col("name").alias("name2"))
    same = F.coalesce(F.col("pool") == F.col("pool2"), F.lit(False))  # of one large component
    pairs = each.join(two, "place").filter((F.col("name") <= F.col("name2")) & ~same)
    pairs = materialize(pairs.select("name", "name2", F.xxhash64("name", "name2").alias("task")), "near-pairs")
    sides = pairs.select("task", "name").union(pairs.filter("name <> name2").select("task", F.col("name2").alias("name")))

    own = comps.join(pools.select("place", F.col("pool").alias("p"), "blocks"), "place").filter(F.col("pool").eqNullSafe(F.col("p"))).select("family", "c", "place", "pool", "blocks")
    dealt = members.join(own, ["family", "c"]).withColumn("name", F.xxhash64("place", "pool", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")))
    dealt = dealt.select("name", "rep", "c", "text").join(sides, "name").select("task", "rep", "c", "text")

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("rep")
        rep, c = table.column("rep").to_numpy(), table.column("c").to_numpy()
        i, j = linked(table.column("text").to_pylist(), least) if len(np.unique(c)) > 1 else (np.array([], int), np.array([], int))
        other = c[i] != c[j]
        return pa.table({"rep": pa.array(rep[j[other]], pa.int64()), "pivot": pa.array(rep[i[other]], pa.int64())})

    return dealt.groupBy("task").applyInArrow(run, "rep long, pivot long")


def _representatives(docs: DataFrame, id_col: str, text_col: str, least: float, rounds: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and of each different sequence of words (d1, d2) its class: class_id, class_size and the row key
    (k1, k2) of the class's first row. The sketches are written inside the caller's scratch block."""
    sketched = materialize(sketch(docs, id_col, text_col), "near-sketch")
    found = sketched.filter("bands IS NOT NULL AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    # Written once, the numbers are fixed: a doc_id may name several texts, so it can't stand for one.
    copies = materialize(found.withColumn("rep", F.monotonically_increasing_id()), "near-copies")

    rows = copies.select("rep", F.explode("bands").alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = materialize(rows.join(shared, "bucket"), "near-buckets")
    weight = live.groupBy("rep").agg(F.sum("n").alias("weight"))
    buckets = live = materialize(live.join(weight, "rep").select("bucket", "rep", "weight"), "near-weighted")

    wanted = materialize(live.select("rep").distinct().join(copies.select("rep", "first.k1", "first.k2"), "rep"), "near-wanted")
    k1, k2 = row_key(docs)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), named(text_col).alias("text"))
    texts = materialize(texts.join(broadcast_if_small(wanted, wanted.count()), ["k1", "k2"]).select(F.col("rep").alias("id"), "text").dropDuplicates(["id"]), "near-texts")

    links = tried = None
    for k in range(rounds):
        pivots = live.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("low"))).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", (-F.col("top.low")).alias("pivot"))
        paired = live.join(materialize(pivots, "near-pivots"), "bucket")
        edges = paired.filter("rep <> pivot").select("rep", "pivot").distinct()
        edges = materialize(edges if tried is None else edges.join(tried, ["rep", "pivot"], "left_anti"), "near-edges")
        tried = edges if tried is None else tried.unionByName(edges)
        found = materialize(verified(edges, texts, least), "near-links")
        links = found if links is None else links.unionByName(found)
        component = connected_components(links, "rep", "pivot")
        one, two = component.select(F.col("id").alias("rep"), F.col("component").alias("c")), component.select(F.col("id").alias("pivot"), F.col("component").alias("d"))
        open_rows = paired.join(one, "rep", "left").join(two, "pivot", "left").filter(F.coalesce("c", "rep") != F.coalesce("d", "pivot"))
        live = materialize(open_rows.select("bucket", "rep", "weight"), "near-open")
        if live.isEmpty():
            break
    else:
        rest = materialize(block_links(buckets, component, texts, least, block), "near-rest-links")
        if not rest.isEmpty():
            component = connected_components(links.unionByName(rest), "rep", "pivot")
    labelled = copies.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "first", "n", F.coalesce("component", "rep").alias("c"))
    labelled = materialize(labelled, "near-labelled")
    groups = labelled.groupBy("c").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"), F.min(F.struct("d1", "d2")).alias("tie"))
    groups = materialize(groups.withColumn("name", F.col("first.doc_id")), "near-groups")
    owner = groups.groupBy("name").agg(F.min("tie").alias("owner"))
    other = -1 - F.shiftrightunsigned(F.xxhash64("tie.d1", "tie.d2"), 1)
    groups = groups.join(owner, "name").select("c", F.when(F.col("tie") == F.col("owner"), F.col("name")).otherwise(other).alias("class_id"), "class_size", "first.k1", "first.k2")
    return sketched, labelled.select("d1", "d2", "c").join(groups, "c").drop("c")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, class_size for every row."""
    with scratch(docs.sparkSession):
        sketched, texts = _representatives(docs, id_col, text_col, least, rounds, block)
        texts = materialize(texts.select("d1", "d2", "class_id", "class_size"), "near-texts-classes")
        linked_rows = sketched.filter("bands IS NOT NULL AND doc_id IS NOT NULL").join(texts, ["d1", "d2"]).select("doc_id", "class_id", "class_size")
        own = sketched.filter("bands IS NULL AND doc_id IS NOT NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
        unnamed = sketched.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
        return kept(linked_rows.unionByName(own).unionByName(unnamed), "near-classes")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, that of smallest doc_id (ties by the hash of the whole row), all columns.

    Rows without words or without doc_id stay; rows alike in all columns stay once."""
    with scratch(docs.sparkSession):
        sketched, texts = _representatives(docs, id_col, text_col, least, ROUNDS, BLOCK)
        alone = sketched.filter("bands IS NULL OR doc_id IS NULL").select("k1", "k2")
        keys = kept(texts.select("k1", "k2").distinct().unionByName(alone.distinct()), "near-kept")
    return keep_rows(docs, keys)
