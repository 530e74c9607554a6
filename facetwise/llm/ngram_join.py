"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct 5-word shingles (A-Z lower-cased; with fewer words the
whole sequence is one shingle). Two documents link when their sets' Jaccard similarity is
0.75 or more. All links between different sets are found:

* Documents with equal sets are one node, whatever their number.
* Cells: of a set of n shingles the n - ceil(0.75 n) + 1 first ones in one global order
  are its prefix; linked sets share a prefix shingle, so pairs are only sought among the
  nodes of a shingle. The order is rarest first (frequency classes from a sketch of fixed
  size over all documents, then hash), so passages that very many documents share come
  last.
* Each node is first verified against one partner, the smallest node of the cells it
  shares most, then in ``ROUNDS`` rounds against its best partner of another component;
  this joins most nodes of a group of copies without comparing them all with each other.
  Links inside a component cannot change it, so afterwards only cells that span
  components are searched, and only for pairs across them: all of those.
* There, shingles are hashed into ``GROUPS`` groups; a node's group counts are its point.
  The points of a cell are packed into an R-tree, and pairs of nodes, then points, are
  cut off when the sum of their coordinate minima cannot reach the overlap needed. Cells
  above ``CELL_ROWS`` are cut into pairs of blocks, each its own task.
* Surviving pairs are verified on the whole sets; links go through distributed union-find.

Defined results: null, empty or blank text has an empty set, links with nothing and is
its own component. Component ids ignore null doc_ids (null if there is no other). Repeated
rows are copies. Extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.llm import textkit as K
from facetwise.llm.tables import components, id_and_text, written

SHINGLE = 5
GROUPS = 512
CELL_ROWS = 4096
#: Rounds in which each node is verified against its best partner only, before all
#: remaining pairs are; they change the work, never the result.
ROUNDS = 2
FANOUT = 16
#: Counters of the frequency sketch: 2 ** SKETCH_BITS, handled in slices.
SKETCH_BITS = 20
_SLICE = 1024

_ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("d2", pa.int64()), ("point", pa.binary())])
_PREFIX = pa.schema([("token", pa.int64()), ("node", pa.int64())])
_TEXT = pa.schema([("node", pa.int64()), ("z", pa.binary())])
_BEST = pa.schema([("node", pa.int64()), ("partner", pa.int64()), ("score", pa.float64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(na, nb):
    """Least overlap of sets of these sizes with similarity 3/4: 7 * overlap >= 3 * (na + nb)."""
    return (3 * (na + nb) + 6) // 7


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = K.Words(texts, lower=True)
    grams, _ = words.grams(shingle)
    h, f, out = words.hashes, words.first, []
    for i in range(words.n_texts):
        a, b = int(f[i]), int(f[i + 1])
        if b - a >= shingle:
            out.append(np.unique(grams[a:b - shingle + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = K.mix(whole, h[k:k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketch(shingle: int):
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for _, texts in K.slices(batches):
            words = K.Words(texts, lower=True)
            grams, ok = words.grams(shingle)
            spots = (grams[ok] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            total += np.bincount(spots, minlength=len(total)).astype(np.int32)
        for k in range(0, len(total), _SLICE):
            part = total[k:k + _SLICE]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k // _SLICE], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})
    return run


def _sum_sketch(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int32).astype(np.int64)
    for k, v in sums.items():
        classes = np.frexp(v.astype(np.float64))[1].astype(np.uint8)  # 0 for none, else 1 + floor(log2)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "counts": pa.array([classes.tobytes()], pa.binary())})


def frequency_classes(source: DataFrame, shingle: int) -> np.ndarray:
    """log2 classes of the shingle counts over all documents, by the hash's upper bits
    (one byte for each of 2 ** SKETCH_BITS counters, whatever the input's size)."""
    ddl = "slice int, counts binary"
    sums = source.mapInArrow(_sketch(shingle), ddl).repartition("slice").mapInArrow(_sum_sketch, ddl)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in sums.toLocalIterator():
        out[r["slice"] * _SLICE:(r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], np.uint8)
    return out


def _scan_rows(shingle: int, groups: int):
    def run(batches):
        for rows, texts in K.slices(batches):
            sets = _sets(texts, shingle)
            node, d2 = K.digests([s.tobytes() for s in sets])
            points = [_packed_point(np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups)) for s in sets]
            yield K.batch_of(_ROW, doc_id=rows.column(0), n=[len(s) for s in sets], node=node, d2=d2, point=points)
    return run


def _scan_prefixes(classes, shingle: int):
    def run(batches):
        seen: set[int] = set()
        table = np.frombuffer(classes.value, np.uint8)
        for _, texts in K.slices(batches):
            sets = _sets(texts, shingle)
            node, _ = K.digests([s.tobytes() for s in sets])
            tokens, sizes, nodes = [np.zeros(0, np.uint64)], [], []
            for s, d in zip(sets, node.tolist()):
                if len(s) and d not in seen:
                    seen.add(d)
                    order = np.argsort(table[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    tokens.append(s[order[:prefix_size(len(s))]])
                    sizes.append(len(tokens[-1]))
                    nodes.append(d)
            yield K.batch_of(_PREFIX, token=K.long_column(np.concatenate(tokens)), node=np.repeat(np.array(nodes, np.int64), np.array(sizes, np.int64)))
    return run


def _pack_texts(shingle: int):
    def run(batches):
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3)
        for _, texts in K.slices(batches):
            node, _ = K.digests([s.tobytes() for s in _sets(texts, shingle)])
            raw, offsets = K.buffer_of(texts)
            out = {}
            for i, d in enumerate(node.tolist()):
                if d not in seen and offsets[i + 1] > offsets[i]:
                    seen.add(d)
                    out[d] = pack.compress(raw[offsets[i]:offsets[i + 1]].tobytes())
            yield K.batch_of(_TEXT, node=np.array(list(out), np.int64), z=list(out.values()))
    return run


def _verify(shingle: int):
    """Pairs with both packed texts in; those that link out."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                texts = dict(zip(a, part.column("za").to_pylist())) | dict(zip(b, part.column("zb").to_pylist()))
                raw = pa.array([unpack.decompress(z) for z in texts.values()], pa.large_binary()).cast(pa.large_string())
                sets = dict(zip(texts, _sets(raw, shingle)))
                good = []
                for x, y in zip(a, b):
                    p, q = sets[x], sets[y]
                    if len(p) > len(q):
                        p, q = q, p
                    spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    good.append(int((q[spot] == p).sum()) >= needed(len(p), len(q)))
                keep = pa.array(good, pa.bool_())
                yield part.select(["a", "b"]).filter(keep)
    return run


def _packed_point(counts: np.ndarray) -> bytes:
    """Group counts as bytes, then what is above 255 in all groups together."""
    low = np.minimum(counts, 255)
    return low.astype(np.uint8).tobytes() + int((counts - low).sum()).to_bytes(4, "little")


def _points(column: pa.Array, groups: int) -> tuple[np.ndarray, np.ndarray]:
    raw, _ = K.buffer_of(column.cast(pa.large_binary()))
    both = np.frombuffer(raw.tobytes(), np.uint8).reshape(-1, groups + 4)
    return both[:, :groups], np.ascontiguousarray(both[:, groups:]).view("<u4").ravel().astype(np.int64)


def _bound(a: tuple[np.ndarray, np.ndarray], i, b: tuple[np.ndarray, np.ndarray], j) -> np.ndarray:
    """Most shingles that points i of a and j of b can share: summed coordinate minima."""
    return np.minimum(a[0][i], b[0][j]).sum(1, dtype=np.int64) + np.minimum(a[1][i], b[1][j])


def _bounded(groups: int):
    """Pairs (a, b, na, nb, pa, pb) whose points allow a link."""
    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            most = _bound(_points(batch.column("pa"), groups), slice(None), _points(batch.column("pb"), groups), slice(None))
            yield batch.select(["a", "b"]).filter(pa.array(most >= needed(na, nb)))
    return run


class Forest:
    """One R-tree for each group of points, packed bottom up in order of set size; level 0
    are the points, a node of a higher level holds up to FANOUT of the level below."""

    def __init__(self, group: np.ndarray, n: np.ndarray, points: tuple[np.ndarray, np.ndarray]):
        self.high, self.n_low, self.n_high, self.child = [points], [n], [n], [None]
        while True:
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(first, len(group)))
            inner = np.arange(len(group)) - np.repeat(first, size)
            begin = np.flatnonzero(inner % FANOUT == 0)
            self.child.append(np.append(begin, len(group)))
            self.high.append(tuple(np.maximum.reduceat(x, begin) for x in self.high[-1]))
            self.n_low.append(np.minimum.reduceat(self.n_low[-1], begin))
            self.n_high.append(np.maximum.reduceat(self.n_high[-1], begin))
            group = group[begin]
            if size.max() <= FANOUT:
                break

    def _may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = self.n_low[level], self.n_high[level]
        ok = (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
        a, b = a[ok], b[ok]
        need = needed(low[a], low[b])
        good = np.zeros(len(a), bool)
        for at in range(0, len(a), 8192):
            part = slice(at, at + 8192)
            good[part] = _bound(self.high[level], a[part], self.high[level], b[part]) >= need[part]
        ok[ok] = good
        return ok

    def pairs(self, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different points of a group that may link; ``wanted`` filters points."""
        found = []

        def down(level: int, a: np.ndarray, b: np.ndarray) -> None:
            if not level:
                keep = (a != b) & wanted(a, b)
                a, b = a[keep], b[keep]
            ok = self._may_link(level, a, b)
            a, b = a[ok], b[ok]
            if not level:
                found.append((a, b))
                return
            child = self.child[level]
            for at in range(0, len(a), 2048):
                x, y = a[at:at + 2048], b[at:at + 2048]
                wide, tall = child[x + 1] - child[x], child[y + 1] - child[y]
                area = wide * tall
                k = np.arange(int(area.sum())) - np.repeat(np.cumsum(area) - area, area)
                p = np.repeat(child[x], area) + k // np.repeat(tall, area)
                q = np.repeat(child[y], area) + k % np.repeat(tall, area)
                once = p <= q
                down(level - 1, p[once], q[once])

        top = np.arange(len(self.n_low[-1]))
        down(len(self.n_low) - 1, top, top)
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (top[:0], top[:0])


def _search(t: pa.Table, groups: int, best: bool) -> pa.RecordBatch:
    """Pairs of a cell's nodes that may link and are of different components, smaller node
    first; or (``best``) for each node only the partner whose bound is highest over need."""
    column = lambda name: t.column(name).to_numpy()
    cell, n = column("cell"), column("n")
    order = np.lexsort([n, cell])
    cell, n, node, root, side = cell[order], n[order], column("node")[order], column("root")[order], column("side")[order]
    points = tuple(x[order] for x in _points(t.column("point").combine_chunks(), groups))
    # side 1 and 2: the two blocks of a pair, which are only searched against each other; 0: the cell itself
    a, b = Forest(cell, n, points).pairs(lambda x, y: (root[x] != root[y]) & ((side[x] == 0) | (side[x] != side[y])))
    if not best:
        pairs = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], 1), axis=0)
        return K.batch_of(_PAIR, a=pairs[:, 0], b=pairs[:, 1])
    score = np.empty(len(a))
    for at in range(0, len(a), 8192):
        x, y = a[at:at + 8192], b[at:at + 8192]
        score[at:at + 8192] = _bound(points, x, points, y) / needed(n[x], n[y])
    own, other, score = node[np.append(a, b)], node[np.append(b, a)], np.append(score, score)
    order = np.lexsort([other, -score, own])
    own, other, score = own[order], other[order], score[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else order
    return K.batch_of(_BEST, node=own[first], partner=other[first], score=score[first])


def _trees(groups: int, best: bool, limit: int = 8192):
    """Cells come sorted; whole cells are searched together up to ``limit`` rows."""
    def run(batches):
        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                held.append(part)
                count += part.num_rows
                if count < limit:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                cell = t.column("cell").to_numpy()
                cut = int(np.searchsorted(cell, cell[-1]))
                if cut:
                    yield _search(t.slice(0, cut), groups, best)
                held, count = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if count:
            yield _search(pa.Table.from_batches(held).combine_chunks(), groups, best)
    return run


def _links(spark: SparkSession, texts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    both = (pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").select("a", "b", "za", "zb"))
    return written(spark, both.mapInArrow(_verify(shingle), "a bigint, b bigint"), "ngram-links")


def _open_members(spark: SparkSession, cells: DataFrame, nodes: DataFrame, roots: DataFrame, cell_rows: int) -> DataFrame:
    """Members of the cells that span components, with their points, dealt out by cell."""
    named = cells.join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
    named = written(spark, named, "ngram-named")
    key = F.xxhash64("node")
    split = (named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.sum(key.cast("decimal(20,0)")).alias("sum"), F.bit_xor(key).alias("xor"))
             .where("lo < hi"))
    split = split.groupBy("size", "sum", "xor").agg(F.min("token").alias("token"))  # cells of the same nodes: one
    part = named.join(split.select("token", "size"), "token").withColumn("n_blocks", F.ceil(F.col("size") * 2 / cell_rows))
    part = part.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_blocks")))
    small = part.where(F.col("size") <= cell_rows).select(F.xxhash64("token").alias("cell"), "node", "root", F.lit(0).alias("side"))
    large = part.where(F.col("size") > cell_rows).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    large = large.select(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "node", "root",
                         F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    members = small.unionByName(large).join(nodes.select("node", "n", "point"), "node").select("cell", "node", "root", "side", "n", "point")
    return members.repartition("cell").sortWithinPartitions("cell")


def ngram_join(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, groups: int = GROUPS, cell_rows: int = CELL_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, node (the set's id; 64 bits
    of its digest), root (the component's smallest node), head (whether the node holds the
    component's smallest doc_id)."""
    source = id_and_text(docs)
    rows = written(spark, source.mapInArrow(_scan_rows(shingle, groups), "doc_id bigint, n bigint, node bigint, d2 bigint, point binary"), "ngram-rows")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.max("n").alias("n"), F.min("d2").alias("x"), F.max("d2").alias("y"), F.first("point").alias("point"))
    nodes = written(spark, nodes, "ngram-nodes")
    if nodes.where("x <> y").limit(1).count():
        raise RuntimeError("two shingle sets share a 64-bit digest; give the hash in textkit another constant")

    classes = spark.sparkContext.broadcast(frequency_classes(source, shingle).tobytes())
    prefixes = source.mapInArrow(_scan_prefixes(classes, shingle), "token bigint, node bigint").repartition("token")
    shared = prefixes.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token", "lo")
    cells = written(spark, prefixes.join(shared, "token").select("token", "node", "lo").distinct(), "ngram-cells")
    packed = source.mapInArrow(_pack_texts(shingle), "node bigint, z binary")
    texts = written(spark, packed.join(cells.select("node").distinct(), "node").dropDuplicates(["node"]), "ngram-texts")

    point = lambda df, end: df.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("point").alias(f"p{end}")), end)
    votes = cells.where("node <> lo").groupBy("node", "lo").count()
    partner = votes.groupBy("node").agg(F.max(F.struct("count", "lo"))["lo"].alias("a")).select("a", F.col("node").alias("b"))
    first = point(point(partner, "a"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_bounded(groups), "a bigint, b bigint")
    links = _links(spark, texts, first, shingle)
    cells = cells.select("token", "node")
    for _ in range(rounds):
        members = _open_members(spark, cells, nodes, components(spark, links, "ngram"), cell_rows)
        best = members.mapInArrow(_trees(groups, True), "node bigint, partner bigint, score double").groupBy("node").agg(F.max(F.struct("score", "partner"))["partner"].alias("p"))
        links = links.unionByName(_links(spark, texts, best.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), shingle))
    members = _open_members(spark, cells, nodes, components(spark, links, "ngram"), cell_rows)
    links = links.unionByName(_links(spark, texts, members.mapInArrow(_trees(groups, False), "a bigint, b bigint").distinct(), shingle))
    roots = components(spark, links, "ngram")

    joined = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.min(F.struct(F.col("low").isNull(), "low", "node"))["node"].alias("head"))
    named = joined.join(lowest, "root").select("node", "root", "component_id", (F.col("head") == F.col("node")).alias("head"))
    out = rows.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      "node", F.coalesce("root", "node").alias("root"), F.coalesce("head", F.lit(True)).alias("head"))


def one_per_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The input rows, of each group of linked documents only one: of the set that holds
    the smallest doc_id, the row with that id (of repeated rows any one). Documents with
    an empty set all stay."""
    found = written(spark, ngram_join(spark, docs).where("n_shingles > 0 and head").select("node", F.col("component_id").alias("keep_id")).distinct(), "ngram-kept")
    whole = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = whole.select("row").schema.add("node", "long").add("id", "long").add("n", "long")
    tagged = whole.mapInArrow(_tag(SHINGLE), schema)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last()))
    firsts = tagged.where("n > 0").withColumn("rank", rank).where("rank = 1").join(found, "node", "left_semi")
    return firsts.select("row.*").unionByName(tagged.where("n = 0").select("row.*"))


def _tag(shingle: int):
    def run(batches):
        for rows, texts in K.slices(batches):
            sets = _sets(texts, shingle)
            node, _ = K.digests([s.tobytes() for s in sets])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(node), rows.column(1), pa.array([len(s) for s in sets], pa.int64())], ["row", "node", "id", "n"])
    return run
