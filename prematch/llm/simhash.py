"""SimHash fingerprints and their exact links by tiled comparison.

Two fingerprints within 2 bits agree on at least two of four 16-bit fields, so
all links lie inside the six families of tiles that share two fields.  Inside
a tile fingerprints are ordered by the population count of the other two
fields and cut into pieces; a pair of pieces whose counts differ by more than
the radius is skipped, every other pair is compared whole with exclusive-or
and bit counts.  A tile sends on the edges of a spanning forest, never all its
pairs, and large tiles are dealt out as pairs of pieces.

With a Jaccard similarity to reach, the radius is too wide for shared fields.
Tiles are then made by equal bands of MinHash values; pairs within the radius
are candidates only, and each of their components is settled by the exact
similarity of its shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, mixed, release, shuffle_parts, slices, text_buffer, written
from .graph import components

SEED, SHINGLE, RADIUS = 42, 3, 2
FIELDS = list(combinations(range(4), 2))
#: Fingerprints of one tile that a task holds against another such piece.
PIECE = 4096
#: Sets of shingles of one component of candidates that a task holds against another such piece.
PIECE_SETS = 2048
#: MinHash values in a band, and bands: at a similarity of 0.8, 3 pairs in a million share none.
BAND, BANDS = 4, 24
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text (see ``fingerprints``)."""
    return int(_fold([_shingle_hashes(text, shingle)])[0])


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.translate(_LOWER).split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())]


_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _fold(hashes: list[list[int]], step: int = 1 << 16) -> np.ndarray:
    """For each list of hashes: a bit is 1 if it is set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    at = 0
    while at < len(hashes):
        to, held = at, 0
        while to < len(hashes) and (to == at or held + sizes[to] <= step):
            held += sizes[to]
            to += 1
        counts = np.zeros((to - at, 64), np.int64)
        have = np.flatnonzero(sizes[at:to])
        if len(have) == 1 and held > step:  # one long document, in stretches
            flat = np.array(hashes[at + have[0]], np.uint64)
            for k in range(0, len(flat), step):
                counts[have[0]] += np.unpackbits(flat[k : k + step].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        elif len(have):
            flat = np.array([x for h in hashes[at:to] for x in h], np.uint64)
            bits = np.unpackbits(flat.view(np.uint8), bitorder="little").reshape(-1, 64)
            begins = np.concatenate([[0], np.cumsum(sizes[at:to][have])[:-1]])
            counts[have] = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[at:to] = ((2 * counts > sizes[at:to, None]) * _BITS).sum(1, dtype=np.uint64)
        at = to
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        data, offsets = text_buffer(batch.column(1))
        whole, cuts = data.tobytes(), offsets.tolist()
        values = _fold([_shingle_hashes(whole[a:b], SHINGLE) for a, b in zip(cuts, cuts[1:])])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], ["doc_id", "key", "bits"])


def _key() -> Column:
    """Tells rows apart that share a doc_id: a hash of the text, null apart from empty."""
    return F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _key().alias("key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): XXH64 (seed 42) of all three-word shingles of the text, A-Z lower-cased, folded bit by bit.

    Fewer than three words make one shingle of them all; no words, or null,
    give 0.  ``bits`` is the fingerprint as a signed long.
    """
    return _fingerprints(docs).select("doc_id", "bits")


def _fingerprints(docs: DataFrame) -> DataFrame:
    return _texts(docs).mapInArrow(_prints, "doc_id long, key long, bits long")


# --- links ---------------------------------------------------------------------


def _field(bits, k: int):
    return F.shiftrightunsigned(bits, 16 * k).bitwiseAND(F.lit(0xFFFF))


def _tiles(prints: DataFrame) -> DataFrame:
    """One row per fingerprint and family: the tile's family and key, and the population count outside the shared fields."""
    bits, rows = F.col("bits"), []
    for n, (a, b) in enumerate(FIELDS):
        key = F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(_field(bits, a), 16) + _field(bits, b)
        rest = F.bit_count(bits) - F.bit_count(_field(bits, a)) - F.bit_count(_field(bits, b))
        rows.append(F.struct(key.alias("tile"), rest.cast("int").alias("ones")))
    return prints.select("bits", "node", F.explode(F.array(*rows)).alias("t")).select("t.tile", "t.ones", "bits", "node")


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Join the given pairs in root (union by find with halving); the edges that joined something."""
    used = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
        ra, rb = a, b
        while root[ra] != ra:
            root[ra] = root[root[ra]]
            ra = int(root[ra])
        while root[rb] != rb:
            root[rb] = root[root[rb]]
            rb = int(root[rb])
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            used.append((a, b))
    return used


def tile_links(bits: np.ndarray, ones: np.ndarray, split: int = 0, radius: int = RADIUS, step: int = 256) -> list[tuple[int, int]]:
    """Spanning-forest edges (row numbers) among pairs within the radius; rows come in order of ``ones``.

    With split, only pairs of one row before and one from it on (each of the
    two runs in order).  A pair of steps whose population counts are more than
    the radius apart is skipped.
    """
    n = len(bits)
    root, edges = np.arange(n), []
    for i in range(0, split or n, step):
        i_to = min(i + step, split or n)
        low, high = ones[i] - radius, ones[i_to - 1] + radius
        for j in range(split or i, n, step):
            if ones[j] > high:
                break
            j_to = min(j + step, n)
            if ones[j_to - 1] < low:
                continue
            near = np.bitwise_count(bits[i:i_to, None] ^ bits[None, j:j_to]) <= radius
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            apart = root[x] != root[y]
            edges += _forest(x[apart], y[apart], root)
    return edges


def _compare(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (tile, i, j): compare each run of equal ones, holding one run at a time."""
    release()
    held: list[pa.RecordBatch] = []

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([rows.column(c).to_numpy() for c in ("tile", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        cuts = [0, *cuts.tolist(), rows.num_rows]
        own, ones, node = (rows.column(c).to_numpy() for c in ("own", "ones", "node"))
        bits, (_, i, j) = rows.column("bits").to_numpy().view(np.uint64), keys
        a, b = [], []
        for s, e in zip(cuts, cuts[1:]):
            split = int(np.searchsorted(own[s:e], j[s])) if i[s] != j[s] else 0
            for x, y in tile_links(bits[s:e], ones[s:e], split, radius) if e - s > 1 else ():
                a.append(node[s + x])
                b.append(node[s + y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        last = tuple(rows.column(c)[-1].as_py() for c in ("tile", "i", "j"))
        keys = np.stack([rows.column(c).to_numpy() for c in ("tile", "i", "j")])
        begun = np.flatnonzero((keys != np.array(last)[:, None]).any(0))
        whole = int(begun[-1]) + 1 if len(begun) else 0
        if whole:
            yield from run(rows.slice(0, whole))
        held = rows.slice(whole).to_batches()
    if held:
        yield from run(pa.Table.from_batches(held).combine_chunks())


def links(prints: DataFrame, piece: int = PIECE) -> DataFrame:
    """prints (bits, node), bits distinct, to spanning-forest edges (a, b) of all pairs within the radius."""
    return _linked(_tiles(prints), RADIUS, piece)


def _linked(tiles: DataFrame, radius: int, piece: int = PIECE) -> DataFrame:
    """Tiles (tile, ones, bits, node) to spanning-forest edges (a, b) of each tile's pairs within the radius.

    Sizes are counted per tile and population count.  Pieces follow one another
    in order of population count; one count with over ``piece`` fingerprints is cut into
    several by hash.  Two pieces meet only if some of their counts are within the radius.
    """
    parts = shuffle_parts(tiles.sparkSession)
    own, near = Window.partitionBy("tile").orderBy("ones"), Window.partitionBy("tile").orderBy("ones").rangeBetween(-radius, radius)
    sizes = tiles.groupBy("tile", "ones").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("*", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy("tile")).alias("total")).where("total > 1")
    first = F.floor((F.col("upto") - F.col("n")) / piece).cast("int")
    cut = sizes.select("tile", "ones", first.alias("first"), F.ceil(F.col("n") / piece).cast("int").alias("cuts"))
    cut = cut.select("*", F.min("first").over(near).alias("low"), F.max(F.col("first") + F.col("cuts") - 1).over(near).alias("high"))
    # a piece is one unit of work with itself and with each piece in reach
    mine = F.col("first") + F.pmod(F.xxhash64("bits"), F.col("cuts")).cast("int")
    dealt = tiles.join(cut, ["tile", "ones"]).withColumn("own", mine)
    span = dealt.groupBy("tile", "own").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    meets = span.select("tile", "own", F.explode(F.sequence("low", "high")).alias("other"))
    # both pieces of a pair must come, whichever of them sees the other
    both = meets.unionByName(meets.select("tile", F.col("other").alias("own"), F.col("own").alias("other"))).distinct()
    pairs = dealt.join(both, ["tile", "own"]).select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ones", "bits", "node")
    return pairs.repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "own", "ones", "bits").mapInArrow(lambda batches: _compare(batches, radius), "a long, b long")


# --- exact similarity ------------------------------------------------------------


def _sets(batch: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text of the second column, ascending."""
    data, offsets = text_buffer(batch.column(1))
    whole, cuts = data.tobytes(), offsets.tolist()
    return [np.unique(np.array(_shingle_hashes(whole[a:b], shingle), np.uint64)) for a, b in zip(cuts, cuts[1:])]


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One number per set of shingles, the same for equal sets."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys per set, each of BAND MinHash values; sets that are alike share some. 0 for empty sets."""
    sizes = np.array([len(x) for x in sets], np.int64)
    have = np.flatnonzero(sizes)
    out = np.zeros((len(sets), BANDS), np.uint64)
    if not len(have):
        return out
    flat = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum(sizes[have])[:-1]])
    factors = mixed(np.arange(1, BANDS * BAND + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(BANDS):
        key = np.full(len(have), k + 1, np.uint64)
        for a in factors[k * BAND : (k + 1) * BAND]:
            key = mixed(key ^ np.minimum.reduceat(mixed(flat * a), begins))
        out[have, k] = key
    return out


def alike_links(sets: list[np.ndarray], least: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning-forest edges (row numbers) among all pairs of sets whose Jaccard similarity is ``least`` or more.

    Shingles are ordered from rare to common: two such sets share one of their
    first n - ceil(least * n) + 1.  Pairs that are joined already, or whose labels are equal, are skipped,
    so in a group of copies each set is compared with a few others.
    """
    n = np.array([len(x) for x in sets], np.int64)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(values))
    cuts = np.concatenate([[0], np.cumsum(n)])
    ranked = [np.sort(x) for x in np.split(place[inverse], cuts[1:-1])]
    firsts = [x[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1] for x in ranked]
    # sets by shingle, ascending
    listed = np.concatenate(firsts)
    order = np.argsort(listed, kind="stable")
    holders = np.repeat(np.arange(len(sets)), [len(x) for x in firsts])[order]
    begins = np.searchsorted(listed[order], np.arange(len(values) + 1))
    root = np.arange(len(sets)) if labels is None else np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]]
    mark, edges = np.zeros(len(values), bool), []
    for i, own in enumerate(ranked):
        met = np.zeros(len(sets), bool)
        for v in firsts[i].tolist():
            if begins[v + 1] - begins[v] > 1:
                met[holders[begins[v] : begins[v + 1]]] = True
        near = np.flatnonzero(met[:i] & (np.minimum(n[:i], n[i]) >= least * np.maximum(n[:i], n[i]) - 1e-9))
        mark[own] = True
        step = 8
        while len(near := near[root[near] != root[i]]):
            some, near = near[:step], near[step:]
            sizes = n[some]
            both = np.add.reduceat(mark[np.concatenate([ranked[j] for j in some.tolist()])], np.cumsum(sizes) - sizes, dtype=np.int64)
            for j in some[both >= least * (sizes + n[i] - both) - 1e-9].tolist():
                if root[i] != root[j]:
                    edges.append((i, j))
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root[root == old] = new
            step *= 2
        mark[own] = False
    return edges


def _confirm(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """rows (by, node, label, shingles) to edges (a, b) among the nodes of each unit ``by``; a node that comes twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, nodes, labels, sets = None, [], [], []

        def settle() -> Iterator[pa.RecordBatch]:
            found = alike_links(sets, least, np.array(labels, np.int64)) if len(sets) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            nodes.clear(), labels.clear(), sets.clear()

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(len(by))))
            for key, node, label, shingles in zip(keys, batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist(), batch.column(len(by) + 2)):
                if key != now:
                    yield from settle()
                    now = key
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    labels.append(label)
                    sets.append(np.frombuffer(shingles.as_py(), np.uint64))
        yield from settle()

    parts = shuffle_parts(rows.sparkSession)
    return rows.select(*by, "node", "label", "shingles").repartition(parts, *by).sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, loose: DataFrame, held: DataFrame, least: float, piece: int) -> DataFrame:
    """Edges between nodes of other labels: rows with loose (component, node, label), piece by piece."""

    count = lambda nodes, name: nodes.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias(name))
    both = count(rows, "ps").join(count(loose, "qs"), "component")
    one = rows.join(both, "component").select("*", F.pmod(F.xxhash64("node"), F.col("ps")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"))
    other = loose.join(both, "component").select("*", F.pmod(F.xxhash64("node"), F.col("qs")).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"))
    units = one.select("component", "p", "q", "node", "label").unionByName(other.select("component", "p", "q", "node", "label"))
    return _confirm(units.join(held.select("node", "shingles"), "node"), ["component", "p", "q"], least)


def confirmed(held: DataFrame, least: float, piece: int = PIECE_SETS) -> DataFrame:
    """Edges (a, b) that span the classes of similar sets; held: component (of candidates), node, shingles.

    A component of up to ``piece`` sets is one unit.  A larger one is cut in pieces by
    hash; each finds its own links.  Then the leaders of the classes so found are compared, which joins the
    pieces of a group of copies; and last every set outside the component's largest class is compared
    with all sets of other classes, pieces against pieces.  So no pair is left out, and no unit holds more than two pieces.
    """
    sizes = written(held.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    cuts = sizes.select("component", F.ceil(F.col("n") / piece).cast("int").alias("cuts"))
    rows = held.join(cuts, "component").select("*", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("p"), F.col("node").alias("label"))
    edges = _confirm(rows, ["component", "p"], least)
    if sizes.where(F.col("n") > piece).isEmpty():
        return edges
    edges = written(edges, "edges")
    large = held.select("component", "node").join(cuts.where("cuts > 1"), "component").select("component", "node")

    def labelled(found: DataFrame) -> DataFrame:
        return written(large.join(components(found).withColumnRenamed("component", "label"), "node", "left").select("component", "node", F.coalesce("label", "node").alias("label")), "labels")

    labels = labelled(edges)
    leaders = labels.groupBy("component", "label").agg(F.min("node").alias("node"))
    edges = written(edges.unionByName(_across(leaders, leaders, held, least, piece)), "edges")
    labels = labelled(edges)
    main = labels.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    loose = written(labels.join(main, "component").where("label != main").drop("main"), "loose")
    return edges.unionByName(_across(labels, loose, held, least, piece))


def _alike(docs: DataFrame, shingle: int, radius: int, least: float) -> DataFrame:
    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sets = _sets(batch, shingle)
            tiles = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands(sets).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_set_keys(sets)), pa.array(_fold([x.tolist() for x in sets]).view(np.int64)), tiles], ["doc_id", "key", "node", "bits", "tiles"])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sets = _sets(batch, shingle)
            yield pa.RecordBatch.from_arrays([pa.array(_set_keys(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    named = _texts(docs)
    prints = written(named.mapInArrow(profiles, "doc_id long, key long, node long, bits long, tiles array<long>"), "prints")
    classes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("tiles").alias("tiles"), F.count(F.lit(1)).alias("n")), "classes")
    tiles = classes.select(F.explode("tiles").alias("tile"), F.bit_count("bits").cast("int").alias("ones"), "bits", "node").where("tile != 0")
    candidates = written(components(_linked(tiles, radius)), "candidates")
    # one document of each candidate set
    asked = prints.join(candidates, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("row")).select("row.*")
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("key") == F.col("_key"))
    sets = named.join(asked.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), same, "left_semi").mapInArrow(whole_sets, "node long, shingles binary")
    held = written(sets.join(candidates, "node").groupBy("component", "node").agg(F.first("shingles").alias("shingles")), "sets")
    edges = confirmed(held, least)
    return _named(prints, classes.select("node", "least", "n"), written(components(edges), "components"), prints["node"])


def _named(prints: DataFrame, classes: DataFrame, found: DataFrame, node: Column) -> DataFrame:
    """doc_id, key, bits, component (a node) and component_id of prints: each component takes the smallest doc_id of its classes (node, least, n)."""
    names = classes.join(found, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    hot, _ = hot_keys(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    linked = join_hot(found, names, "component", hot, "inner").select("node", "component", "component_id")
    own = classes.select("node", "least").join(linked, "node", "left")
    own = own.select("node", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    hot, _ = hot_keys(classes, "node")
    return join_hot(prints.select("doc_id", "key", "bits", node.alias("node")), own, "node", hot).select("doc_id", "key", "bits", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, jaccard: float | None = None) -> DataFrame:
    """doc_id, bits and component_id for every row of docs (doc_id, text).

    Fingerprints (see ``fingerprints``) link at two or fewer differing bits;
    component_id is the smallest doc_id reachable over links, a document's own
    included.  Null or empty texts share fingerprint 0 and link like others;
    repeated rows are kept, with the same component; rows with a null doc_id
    are kept and link like others, but lend their component no name (one of null ids alone
    has a null id); rows that share a doc_id are documents of their own.  Other columns are ignored, an empty table gives an empty
    result.

    With ``jaccard``, documents link whose sets of ``shingle`` words are that
    similar; fingerprints (of the sets) within ``radius`` are candidates, and the
    exact similarity decides.  The set of a text without words is like no
    other but itself.  Without it, shingle and radius must be the fixed ones.
    """
    return _classified(docs, shingle, radius, jaccard).select("doc_id", "bits", "component_id")


def _classified(docs: DataFrame, shingle: int, radius: int, jaccard: float | None) -> DataFrame:
    if jaccard is not None:
        return _alike(docs, shingle, radius, jaccard)
    if (shingle, radius) != (SHINGLE, RADIUS):
        raise ValueError("fields are made for the fixed shingle and radius; other ones need jaccard")
    prints = written(_fingerprints(docs), "prints")
    classes = written(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    found = written(components(links(classes.select("bits", F.col("bits").alias("node")))), "components")
    return _named(prints, classes.select(F.col("bits").alias("node"), "least", "n"), found, prints["bits"])


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, jaccard: float | None = None) -> DataFrame:
    """The rows of docs, all columns, whose doc_id names their component: one document of each group of near duplicates.

    Of rows of a group that share this doc_id one stays; unlike rows that share a
    doc_id are groups of their own, and rows with a null doc_id can't be
    named and stay.  An empty table gives an empty result.
    """
    near = _classified(docs, shingle, radius, jaccard)
    chosen = near.where(F.col("doc_id") == F.col("component_id")).groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.key").alias("_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), _key().alias("_key"))
    at = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.col("row.text")))
    one = rows.join(chosen, ["_id", "_key"], "left_semi").withColumn("_at", at).where("_at = 1").select("row.*")
    return one.unionByName(docs.where("doc_id is null"))
