"""MinHash near-dedup: fast similarity sketches, bands, exact verification on whole sets.

A sketch fills its bins in rounds. In each round every feature falls into one bin
by a hash, with a value beyond all of earlier rounds, and a bin keeps its least value;
after as many rounds as there are bins, round i gives bin i to every feature, so that
none stays empty. A long text needs one or two rounds, a short one as many as
fill its bins. Two sets agree in a bin with the probability of their similarity.

Documents of equal sets are one class. Classes that share a band and whose set
sizes allow the similarity are candidates. Bands travel packed by bucket; among the
entries of one band and size a task sends on the first only and links the others with it,
and a band's sizes are linked with the next larger one, so a frequent band stays
small and no pairs are made. Candidates' groups are then compared on the shingles
of their whole texts, as exact products of 0/1 matrices: in tiles of bounded size,
then the tiles' representatives, and at last tiles of parts that are not yet
connected, with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import spans
from pagelens.llm.graph import connected_components, settle
from pagelens.sources.shared import materialize, quoted

WORDS, PERCENT = 2, 80  # words of a shingle; similarity of linked sets
BANDS, ROWS = 72, 7  # at similarity 0.8 a pair shares no band in one case of 20 million
TILE, TILE_CHARS = 512, 4_000_000  # texts and characters of a candidate group that are read together
FLUSH = 8192  # classes whose bands leave a task together
COLUMNS = 4096  # shingles of a block of a product

_G = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of `width` words of texts, A-Z lower-cased; of all words if there are fewer, none without words."""
    words, starts = spans.words([spans.utf8(x).lower() for x in texts])
    size = np.diff(starts)
    own = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    ends = np.cumsum(own)
    at = np.arange(int(own.sum())) - np.repeat(ends - own - starts[:-1], own)
    stop = np.repeat(starts[1:], own)
    padded = np.r_[words, np.zeros(width, np.uint64)]
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = spans.mix(out + np.where(at + j < stop, padded[at + j], np.uint64(0)) + _G)
    return [np.unique(x) for x in np.split(out, ends[:-1])] if len(texts) else []


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches of sets that are not empty, a row each: a bin's round and least value in it."""
    empty = np.uint64(2**64 - 1)
    out = np.full(len(sets) * bins, empty)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    features, of = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), size)
    left = np.full(len(sets), bins)  # bins yet to be filled
    rounds = np.arange(1, 2 * bins + 1, dtype=np.uint64) * _G
    for i in range(2 * bins):
        if not len(features):
            break
        h = spans.mix(features + rounds[i])
        value = (np.uint64(i) << np.uint64(32)) | (h & _LOW)
        at = of * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if i < bins else of * bins + i - bins
        free = out[at] == empty
        at, value = at[free], value[free]
        np.minimum.at(out, at, value)
        left -= np.bincount(np.unique(at) // bins, minlength=len(sets))
        if not left[of].all():
            features, of = features[left[of] > 0], of[left[of] > 0]
    return out.reshape(len(sets), bins)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands of sketches, a row each."""
    parts = sketch.reshape(len(sketch), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, parts.shape[:2])
    for j in range(rows):
        keys = spans.mix(keys ^ parts[:, :, j]) + _G
    return keys


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in spans.chunks(texts):
                sets = shingle_sets(texts[part], width)
                full = [i for i, x in enumerate(sets) if len(x)]
                keys = band_keys(sketches([sets[i] for i in full], bands * rows), bands, rows)
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[np.array(full, np.int64) + 1] = bands
                digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                own = [batch[x].slice(part.start, part.stop - part.start) for x in ("id", "k1", "k2")]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), lists], ["id", "k1", "k2", "digest", "n", "keys"])

    return run


def _firsts(key: np.ndarray, n: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries ordered by key, size and node; which of them are the first of their key and size; the place of each one's first."""
    order = np.lexsort((node, n, key))
    key, n = key[order], n[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (n[1:] != n[:-1])][: len(key)]
    return order, first, np.flatnonzero(first)[np.cumsum(first) - 1]


def _packed(buckets: int):
    """Bands of classes as packs by bucket, and links (u, v) between the classes of one band and size of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, FLUSH):
                own = batch.slice(lo, FLUSH)
                keys = own["keys"].flatten().to_numpy().view(np.uint64)
                many = np.diff(own["keys"].offsets.to_numpy())
                node, n = (np.repeat(own[x].to_numpy(), many) for x in ("node", "n"))
                to = (keys >> np.uint64(32)) % np.uint64(buckets)
                order, first, of = _firsts(keys, n, node)
                node, n, keys, to = node[order], n[order], keys[order], to[order].astype(np.int64)
                links = np.unique(np.stack([node[~first], node[of[~first]]], axis=1), axis=0)
                node, n, keys, to = node[first], n[first], keys[first], to[first]
                order = np.argsort(to, kind="stable")
                buckets_, begins = np.unique(to[order], return_index=True)
                ends = np.r_[begins, len(order)].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (keys.astype(np.uint32).view(np.int32), n.astype(np.int32), node)]
                yield _rows([pa.array(buckets_.astype(np.int32)), *lists], len(buckets_), 0)
                at = pa.array((np.arange(len(links)) % buckets).astype(np.int32))
                yield _rows([at, pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], len(links), 4)

    types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def _rows(columns: list, n: int, skip: int) -> pa.RecordBatch:
        """skip: 0 for a pack, 4 for links, which have a bucket only to be dealt."""
        filled = columns + [pa.nulls(n, t) for t in types[4:]] if not skip else [columns[0], *(pa.nulls(n, t) for t in types[1:4]), *columns[1:]]
        return pa.RecordBatch.from_arrays(filled, ["bucket", "keys", "sizes", "nodes", "u", "v"])

    return run


def _bucket_links(percent: int):
    """Links of the classes that a band of a bucket connects: those of one size with their first, a size with the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            local = batch.filter(batch["u"].is_valid())
            yield pa.RecordBatch.from_arrays([local["u"], local["v"]], ["u", "v"])
            packs = batch.filter(batch["nodes"].is_valid())
            for i, bucket in enumerate(packs["bucket"].to_pylist()):
                if bucket != now:
                    yield from done(held)
                    now, held = bucket, []
                held.append(tuple(packs[x][i].values.to_numpy() for x in ("keys", "sizes", "nodes")))
        yield from done(held)

    def done(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            key, n, node = (np.concatenate(x) for x in zip(*held))
            order, first, of = _firsts(key, n, node)
            key, n, node = key[order], n[order], node[order]
            u, v = [node[~first]], [node[of[~first]]]
            key, n, node = key[first], n[first].astype(np.int64), node[first]
            step = np.flatnonzero((key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            links = np.unique(np.stack([np.concatenate([*u, node[step + 1]]), np.concatenate([*v, node[step]])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["u", "v"])

    return run


def similar(sets: list[np.ndarray], percent: int, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets whose intersection is `percent` of their union or more; with a cut only pairs across it."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), counts[column] > 1
    row, column = row[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        if cut is None:
            both += block @ block.T
        else:
            both[:cut, cut:] += block[:cut] @ block[cut:].T
    u, v = np.nonzero(np.triu((100 + percent) * both >= percent * (size[:, None] + size[None, :]), 1) & (both > 0))
    return u, v


def _tile_links(width: int, percent: int):
    """Links of each tile's nodes with the least of their part of it, their own ones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                nodes = batch["nodes"][i].values.to_numpy()
                parent = np.arange(len(nodes))
                if len(nodes) > 1:
                    parent = settle(parent, *similar(shingle_sets(batch["texts"][i].as_py(), width), percent))
                u.append(nodes)
                v.append(nodes[parent])
                group.append(np.full(len(nodes), batch["group"][i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (group, u, v)], ["group", "u", "v"])

    return run


def _pair_links(width: int, percent: int):
    """Links between the nodes of two tiles that connect all parts that similar pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                nodes, more = (batch[x][i].values.to_numpy() for x in ("nodes", "more_nodes"))
                texts = batch["texts"][i].as_py()
                if batch["tile"][i].as_py() == batch["later"][i].as_py():
                    all_, cut = nodes, None
                else:
                    all_, cut, texts = np.r_[nodes, more], len(nodes), texts + batch["more_texts"][i].as_py()
                parent = settle(np.arange(len(all_)), *similar(shingle_sets(texts, width), percent, cut))
                moved = parent != np.arange(len(all_))
                u.append(all_[moved])
                v.append(all_[parent[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], ["u", "v"])

    return run


def _tiles_of(members: DataFrame, by: list[str]) -> DataFrame:
    """members with the number of tiles that each of their groups `by` needs."""
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("text")) / TILE_CHARS)).cast("int")
    return members.join(members.groupBy(*by).agg(tiles.alias("tiles")), by)


def _gathered(tiled: DataFrame, by: list[str]) -> DataFrame:
    """Nodes and texts of each tile, which is of bounded size."""
    rows = tiled.groupBy(*by).agg(F.collect_list(F.struct("node", "text")).alias("a"))
    return rows.select(*by, F.col("a.node").alias("nodes"), F.col("a.text").alias("texts"))


def verified_links(members: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """u, v: nodes of similar texts, which connect each candidate group (group, node, text) as all its similar pairs do."""

    def compared(rows: DataFrame, salt: int) -> DataFrame:
        tiled = _tiles_of(rows, ["group"]).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("tiles")).cast("int"))
        links = _gathered(tiled, ["group", "tile"]).mapInArrow(_tile_links(width, percent), "group long, u long, v long")
        return materialize(links, "tile-links")

    levels = [compared(members, 0)]
    large = materialize(_tiles_of(members, ["group"]).where("tiles > 1").drop("tiles"), "large-groups")
    rows, before = large, large.count()
    while before:  # representatives of a group's tiles, as long as each round halves their number
        heads = levels[-1].where("u = v").select("group", F.col("u").alias("node"))
        rows = rows.join(heads, ["group", "node"], "left_semi")
        now = rows.count()
        if 2 * now > before:
            break
        levels.append(compared(rows, len(levels)))
        before = now
    links = levels[0].select("u", "v")
    for level in levels[1:]:
        links = links.unionByName(level.select("u", "v"))
    if not large.isEmpty():
        links = links.unionByName(_across(large, connected_components(links), width, percent))
    return links.where("u != v")


def _across(large: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between parts of groups that are not yet connected. Parts of a tile and more have tiles of their own, smaller ones share some."""
    labelled = large.join(roots.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = labelled.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("group")
    labelled = _tiles_of(labelled.join(parts, "group", "left_semi"), ["group", "label"]).withColumn("part", F.when(F.col("tiles") > 1, F.col("label")).otherwise(-1)).drop("tiles")
    spread = F.when(F.col("part") < 0, F.xxhash64("label")).otherwise(F.xxhash64("node"))
    tiled = _tiles_of(labelled, ["group", "part"]).withColumn("tile", F.xxhash64("part", F.pmod(spread, F.col("tiles"))))
    tiles = materialize(_gathered(tiled, ["group", "part", "tile"]), "part-tiles")
    names = tiles.select("group", "part", "tile")
    later = names.select("group", F.col("part").alias("other"), F.col("tile").alias("later"))
    pairs = names.join(later, "group").where("tile <= later and (part != other or part < 0)")  # numbers of tiles only
    fetched = pairs.join(tiles.select("group", "tile", "nodes", "texts"), ["group", "tile"])
    more = tiles.select("group", F.col("tile").alias("later"), F.col("nodes").alias("more_nodes"), F.col("texts").alias("more_texts"))
    fetched = fetched.repartition("group", "tile", "later").join(more, ["group", "later"])
    return fetched.mapInArrow(_pair_links(width, percent), "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id_col, n_shingles, component_id, kept (id = component_id) of each row.

    Sets hold the distinct runs of `width` words between spaces and the control characters
    from tab to carriage return, A-Z lower-cased, or all words as one if there are
    fewer. Rows whose sets have `percent` of their union in common are linked; a row
    without a word, or with a null text, only with itself. component_id is the smallest id
    reachable. Rows of a null id link others, but are never the smallest: where no other row is
    reached, component_id is null and they are kept. Rows of one id are rows of their
    own: each has the result of its text, so that a row repeated is kept as often. Shingles are compared by
    64-bit hashes. Other columns are not read. Texts may be of any length.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).select("id", "text", F.xxhash64("id", "text").alias("k1"), F.hash("id", "text").alias("k2"))
    kind = source.schema["id"].dataType.simpleString()
    sketched = source.mapInArrow(_sketched(width, bands, rows), f"id {kind}, k1 long, k2 int, digest binary, n long, keys array<long>")
    sketched = materialize(sketched, "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first")
    classes = sketched.where("digest is not null").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "n", "keys"), "classes")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = classes.select("node", "n", "keys").mapInArrow(_packed(buckets), "bucket int, keys array<int>, sizes array<int>, nodes array<long>, u long, v long")
    candidates = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(percent), "u long, v long")
    groups = connected_components(candidates).withColumnRenamed("root", "group")
    wanted = groups.join(classes.select("node", "first.k1", "first.k2"), "node")
    texts = source.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).groupBy("group", "node").agg(F.first("text").alias("text"))
    linked = connected_components(verified_links(materialize(texts, "candidate-texts"), width, percent))
    rooted = classes.select("node", "digest", "first.id").join(linked, "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("digest", "component_id")
    out = sketched.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
