"""Near-duplicate join on word n-gram Jaccard similarity: a MinHash LSH forest finds candidates, exact set comparison verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from treegrain.llm.graph import connected_components
from treegrain.llm.textblock import Words, mix, ngram_hashes, raw, signed, slices, tidy
from treegrain.session import discard, fresh_names, ship_code, spill_table, spread

NGRAM = 3
#: At 0.5, texts that differ in up to an eighth of their words are linked.
THRESHOLD = 0.5
TREES = 56
DEEPEST = 12
RECALL = 0.97
#: Sketch agreement that joins two members of a bucket for verification, and agreement above which a member leaves its place to a pivot.
LOOSE, TIGHT = 0.32, 0.95
#: Pivots of each component that a new member is sure to look at.
HEADS = 8
#: Members of a bucket that are passed over at once; larger ones in parts, and then, if too many pairs are left, DEEPER in the trie at most so many times, by SPLITS values each time.
CROWD, SPLITS, DEEPER = 2000, 12, 4
#: Pairs of members from different components, in units of CROWD squared, that one bucket may have before it is taken deeper.
PAIRS = 25
#: Members of a component that are compared at once. Larger components are cut into blocks, a task for each pair of them: eight blocks of at least so many members,
#: or else blocks of WIDEST times as many, since every text is sent once for each block.
BLOCK, WIDEST = 512, 4


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """Shorten the matched prefixes from the tries' full depth until pairs at the threshold are found with the target probability."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, sorted, one after another; and where each document's begin (with one more at the end).

    A text of fewer than n words has one n-gram, all its words; a text without words has none.
    """
    words = Words(data, offsets)
    h = words.hashes()
    grams = ngram_hashes(h, n)
    docs = len(offsets) - 1
    of = words.doc[: len(grams)]
    inside = of == words.doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    doc, value = of[inside], grams[inside]
    count = np.diff(words.first)
    for d in np.flatnonzero((count > 0) & (count < n)):
        a, b = words.first[d], words.first[d + 1]
        doc, value = np.append(doc, d), np.append(value, mix(ngram_hashes(h[a:b], b - a) + np.uint64(b - a)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(docs + 1))


def signatures(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """width MinHash values (32 bits) of each document's set; documents without n-grams get the largest value."""
    docs = len(first) - 1
    out = np.full((width, docs), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        seeds = mix(np.arange(1, 2 * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = first[full]
        for k in range(width):
            out[k, full] = np.minimum.reduceat(((values ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))) >> np.uint64(32), at).astype(np.uint32)
    return out


SIGNED = "doc_id long, did long, th long, nk long, nk2 long, keys array<long>, sketch binary"


def _sign(ngram: int, trees: int, depth: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for part in slices(b):
                data, at = raw(pc.utf8_lower(part.column(names.index("text")).fill_null("")))
                values, first = shingles(data, at, ngram)
                sig = signatures(values, first, trees * depth)
                docs = len(at) - 1
                sizes = np.diff(first).astype(np.uint64)
                cum = np.zeros((2, len(values) + 1), np.uint64)
                cum[0, 1:], cum[1, 1:] = np.cumsum(mix(values)), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))
                node = [mix(c[first[1:]] - c[first[:-1]] + sizes) for c in cum]
                keys = np.zeros((docs, trees), np.uint64)
                for t in range(trees):
                    x = np.full(docs, t + 1, np.uint64)
                    for k in range(depth):
                        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[t * depth + k])
                    keys[:, t] = x
                sketch = (sig.T * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * trees), pa.array(signed(keys.ravel())))
                binary = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((np.arange(docs + 1, dtype=np.int32) * trees * depth).tobytes()), pa.py_buffer(np.ascontiguousarray(sketch).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(names.index("doc_id")), part.column(names.index("did")), part.column(names.index("th")), pa.array(signed(node[0])), pa.array(signed(node[1])), flat, binary], names=[x.split()[0] for x in SIGNED.split(", ")])

    return each


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row's content without nulls: did, th."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


class Bucket:
    """The pivots of a bucket, each with the component that it belongs to so far.

    A new member looks at the first HEADS pivots of every component, then at the other pivots of those components only that it hasn't joined by then. So one that joins a
    large family at once costs as much as one that joins a small family.
    """

    def __init__(self, width: int):
        self.sketches, self.ids = np.empty((64, width), np.uint8), np.empty(64, np.int64)
        self.root, self.head = np.empty(64, np.int64), np.zeros(64, bool)
        self.used, self.roots, self.seen = 0, 0, set()

    def add(self, x: int, s: np.ndarray) -> list[tuple[int, int]]:
        """Edges from x to one pivot of each component that it resembles. A member close to a pivot (TIGHT) is not kept, since whatever resembles it also resembles its pivot loosely."""
        if x in self.seen:
            return []
        self.seen.add(x)
        n = self.used
        near, joined, edges = 0.0, np.zeros(0, np.int64), []
        for again in (False, True):
            if again and (len(joined) == self.roots or not n):
                break
            asked = np.flatnonzero(~self.head[:n] & ~np.isin(self.root[:n], joined) if again else self.head[:n])
            if not len(asked):
                continue
            agree = np.count_nonzero(self.sketches[asked] == s, axis=1) / len(s)
            near = max(near, agree.max())
            roots, first = np.unique(self.root[asked[agree >= LOOSE]], return_index=True)
            edges += [(x, int(self.ids[j])) for j in asked[agree >= LOOSE][first]]
            joined = np.append(joined, roots)
        own = int(joined[0]) if len(joined) else x
        if len(joined) > 1:
            self.root[:n][np.isin(self.root[:n], joined[1:])] = own
        self.roots -= len(joined) - 1
        if near < TIGHT:
            if n == len(self.ids):
                grow = lambda a: np.concatenate([a, np.zeros_like(a)])
                self.sketches, self.ids, self.root, self.head = map(grow, (self.sketches, self.ids, self.root, self.head))
            self.sketches[n], self.ids[n], self.root[n] = s, x, own
            self.head[n] = np.count_nonzero(self.head[:n] & (self.root[:n] == own)) < HEADS
            self.used += 1
        return edges


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the members of each bucket that agree, emitting a forest. Rows come sorted by bucket."""
    key, bucket, edges = None, None, []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["a", "b"])
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        keys, nodes = batch.column(names.index("bk")).to_numpy(), batch.column(names.index("nk")).to_numpy()
        data, at = raw(batch.column(names.index("sketch")))
        sketches = data.reshape(-1, int(at[1] - at[0]))
        for i in range(len(keys)):
            if bucket is None or keys[i] != key:
                key, bucket = keys[i], Bucket(sketches.shape[1])
            edges += bucket.add(int(nodes[i]), sketches[i])
        if len(edges) > 50_000:
            yield pack()
            edges = []
    if edges:
        yield pack()


def _forest(level: DataFrame) -> DataFrame:
    """(a, b): loose links between the members of each bucket.

    Rows are brought together by a hash of bk: an exchange by bk itself would be dropped after a join by bk, which Spark may then turn into one that leaves rows where they are.
    """
    rows = level.repartition(F.xxhash64("bk")).sortWithinPartitions("bk", F.xxhash64("bk", "nk"))
    return rows.select("bk", "nk", "sketch").mapInArrow(tidy(_edges), "a long, b long")


def candidates(meeting: DataFrame, sketches: DataFrame, width: int, *, crowd: int | None = None) -> DataFrame:
    """(a, b): loose links between the members (nk) of each bucket (bk).

    A bucket of more than `crowd` members is first passed over in random parts of that many. That joins large families, whose members share most buckets, at once and
    without a copy of a row. What is left to do in it are pairs from different components; one in which these are too many (strangers) is taken deeper in the trie: its members go on
    to buckets that share one more value, by SPLITS different values, so that few pairs that meet above fail to meet below (at a similarity of 0.5 one of 4,000 such
    meetings), and so again while there are crowded ones, DEEPER times at most. Buckets of one component are left aside.
    """
    spark, crowd = meeting.sparkSession, CROWD if crowd is None else crowd
    level = spill_table(spark, meeting.join(sketches, "nk").select("bk", "nk", "sketch"), "meeting")
    large = level.groupBy("bk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    if not large.limit(1).count():
        return _forest(level)
    part = F.xxhash64("bk", F.pmod(F.xxhash64("nk", "bk"), F.ceil(F.col("n") / crowd)))
    parts = level.join(large, "bk", "left").withColumn("bk", F.when(F.col("n").isNull(), F.col("bk")).otherwise(part))
    out = spill_table(spark, _forest(parts), "loose")
    known = connected_components(out, "loose-components").select(F.col("node").alias("nk"), "component")
    crowded = level.join(large, "bk", "left_semi").join(known, "nk", "left").withColumn("component", F.coalesce("component", "nk"))
    before, level = level, spill_table(spark, crowded.select("bk", "nk", "sketch", "component"), "meeting")
    discard(before)
    for depth in range(DEEPER + 1):
        across = level.groupBy("bk", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bk").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs"))
        too_many = across.where(F.col("pairs") > PAIRS * crowd * crowd).select("bk")
        split = depth < DEEPER and too_many.limit(1).count() > 0
        here = level.join(across.where((F.col("pairs") > 0) & ((F.col("pairs") <= PAIRS * crowd * crowd) | F.lit(not split))), "bk", "left_semi")
        out = out.unionByName(spill_table(spark, _forest(here), "loose"))
        if split:
            place = F.pmod(F.xxhash64("bk", "i", F.lit(depth)), F.lit(width)).cast("int") + 1
            deeper = level.join(too_many, "bk", "left_semi").withColumn("i", F.explode(F.array(*map(F.lit, range(SPLITS)))))
            deeper = deeper.select(F.xxhash64("bk", "i", F.lit(depth), F.substring("sketch", place, F.lit(1))).alias("bk"), "nk", "sketch", "component")
            shared = deeper.groupBy("bk").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bk")
            before, level = level, spill_table(spark, deeper.join(shared, "bk", "left_semi"), "meeting")
            discard(before)
        else:
            discard(level)
            break
    return out


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections between sets (of sorted distinct hashes) and others (default: the sets themselves).

    Values found in one set only are left out; the rest are columns of 0/1 matrices, whose product counts what is shared.
    """
    rows = sets if others is None else sets + others
    n, m = len(sets), len(rows)
    if n == 0 or m == 0:
        return np.zeros((n, m if others is None else len(others)), np.int64)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(m), [len(s) for s in rows])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column) > 1
    keep = many[column]
    column, row = (np.cumsum(many) - 1)[column[keep]], row[keep]
    total = np.zeros((n, m if others is None else m - n), np.float64)
    width = max(64, min(4096, (8 << 20) // max(1, m)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        matrix = np.zeros((m, width), np.float32)
        matrix[row[lo:hi], column[lo:hi] - at] = 1
        total += matrix[:n] @ (matrix if others is None else matrix[n:]).T
    return np.rint(total).astype(np.int64)


VERIFIED = "kind string, a long, a2 long, b long, b2 long, n long"


def _verify(ngram: int, threshold: float):
    """Links of each node and a verified spanning forest, for every (component, pair of blocks). Rows come sorted by those."""

    def task(pair: tuple, rows: list[tuple]) -> list[tuple]:
        _, i, j = pair
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        # Members are numbered through both blocks; each has a tree of the forest so far.
        members, shift = (left, 0) if i == j else (left + right, len(left))
        links, root, out = np.zeros(len(members), np.int64), list(range(len(members))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for s in range(0, len(left), BLOCK):
            for t in range(s if i == j else 0, len(right), BLOCK):
                own, other, same = left[s : s + BLOCK], right[t : t + BLOCK], i == j and s == t
                both = overlaps([r[4] for r in own], None if same else [r[4] for r in other])
                sizes = [np.array([len(r[4]) for r in side]) for side in (own, other)]
                linked = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9
                if same:
                    np.fill_diagonal(linked, False)
                links[s : s + len(own)] += linked @ np.array([r[3] for r in other])
                if not same:
                    links[shift + t : shift + t + len(other)] += linked.T @ np.array([r[3] for r in own])
                # Trees first as labels of the whole tile, then only links between different ones.
                mine, theirs = (np.array([find(x) for x in range(k, k + n)]) for k, n in ((s, len(own)), (shift + t, len(other))))
                for x in np.flatnonzero(linked.any(axis=1)):
                    to = np.flatnonzero(linked[x] & (theirs != mine[x]))
                    for y in to[np.unique(theirs[to], return_index=True)[1]]:
                        a, b = find(s + int(x)), find(shift + t + int(y))
                        if a != b:
                            root[b] = a
                            out.append(("edge", *members[s + x][1:3], *members[shift + t + y][1:3], None))
        return out + [("links", r[1], r[2], None, None, int(c)) for r, c in zip(members, links) if c]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["kind", "a", "a2", "b", "b2", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows, out = None, [], []
        for b in batches:
            names = b.schema.names
            for part in slices(b):
                values, first = shingles(*raw(pc.utf8_lower(part.column(names.index("text")).fill_null(""))), ngram)
                cols = [part.column(names.index(c)).to_pylist() for c in ("component", "bi", "bj", "block", "nk", "nk2", "copies")]
                for k, (c, i, j, own, nk, nk2, copies) in enumerate(zip(*cols)):
                    if (c, i, j) != pair:
                        if rows:
                            out += task(pair, rows)
                        pair, rows = (c, i, j), []
                        if len(out) > 20_000:
                            yield batch(out)
                            out = []
                    rows.append((own, nk, nk2, copies, values[first[k] : first[k + 1]].copy()))
        if rows:
            out += task(pair, rows)
        if out:
            yield batch(out)

    return each


def near_duplicates(docs: DataFrame, *, ngram: int = NGRAM, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copies, and the row's key (did, th).

    Two documents are linked if the Jaccard similarity of their sets of word n-grams (lower case) is at least the threshold; n_links counts the other
    documents so linked, exact copies included; a class is what links connect, named by its smallest doc_id. Null text counts as empty; texts
    without words are copies of each other; a null doc_id is the smallest (class_id null); repeated rows are copies; an
    empty table gives no rows; other columns are ignored.

    Copies are counted first and stand for one node. Nodes meet in the forest's buckets (prefixes as short as the target recall asks, longer in those crowded with strangers);
    in a bucket, 1-byte sketches decide who goes on, against pivots, never all pairs; what is joined forms components, whose texts are brought together
    and compared exactly, in blocks, so a component of any size is spread over tasks.
    """
    spark = docs.sparkSession
    ship_code(spark)
    depth = prefix_depth(threshold, trees, recall)
    signed_docs = spill_table(spark, spread(keyed(docs)).mapInArrow(tidy(_sign(ngram, trees, depth)), SIGNED), "signatures")
    nodes = signed_docs.groupBy("nk", "nk2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("did", "th")).alias("row"))
    members = signed_docs.select("nk", F.explode("keys").alias("bk"))
    shared = members.groupBy("bk").agg(F.min("nk").alias("lo"), F.max("nk").alias("hi")).where("lo != hi").select("bk")
    meeting = members.join(shared, "bk", "left_semi").distinct()
    sketches = signed_docs.select("nk", "sketch").dropDuplicates(["nk"])
    components = connected_components(candidates(meeting, sketches, trees * depth), "candidates")

    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = components.join(sizes, "component").select(F.col("node").alias("nk"), "component", F.ceil(F.col("size") / F.least(F.greatest(F.col("size") / 8, F.lit(BLOCK)), F.lit(WIDEST * BLOCK))).cast("int").alias("blocks"))
    compared = nodes.join(placed, "nk").withColumn("block", F.pmod(F.xxhash64("nk", "nk2"), F.col("blocks")).cast("int"))
    rows = keyed(docs).select("did", "th", "text").join(compared.select(F.col("row.did").alias("did"), F.col("row.th").alias("th"), "nk", "nk2", "copies", "component", "blocks", "block"), ["did", "th"]).dropDuplicates(["did", "th"])
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) AS bi, greatest(x, block) AS bj))")
    tasks = rows.withColumn("pair", F.explode(pairs)).select("component", "pair.bi", "pair.bj", "block", "nk", "nk2", "copies", "text")
    verified = spill_table(spark, tasks.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj").mapInArrow(tidy(_verify(ngram, threshold)), VERIFIED), "links")

    # Nodes are told apart by both hashes; a 64-bit name made of both serves for the graph of verified links.
    name = lambda x, y: F.xxhash64(x, y)
    classes = connected_components(verified.where("kind = 'edge'").select(name("a", "a2").alias("a"), name("b", "b2").alias("b")), "classes")
    links = verified.where("kind = 'links'").groupBy(F.col("a").alias("nk"), F.col("a2").alias("nk2")).agg(F.sum("n").alias("links"))
    named = nodes.select("nk", "nk2", "copies", F.col("row.did").alias("least"), name("nk", "nk2").alias("node")).join(classes, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("class_did"))
    result = named.join(least, "component").join(links, ["nk", "nk2"], "left").select("nk", "nk2", "copies", "class_did", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = F.lit(-(1 << 63))
    return signed_docs.select("doc_id", "did", "th", "nk", "nk2").join(result, ["nk", "nk2"]).select("doc_id", F.when(F.col("class_did") != smallest, F.col("class_did")).alias("class_id"), F.col("n_links").cast("long").alias("n_links"), F.col("copies").cast("long").alias("copies"), "class_did", "did", "th")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near duplicates: of each class the row with the smallest doc_id stays (of equal ids the smallest hash of its text, of equal rows one).

    Rows keep all their columns. See near_duplicates() for nulls, empty texts and empty tables.
    """
    found = spill_table(docs.sparkSession, near_duplicates(docs, **options).select("class_did", "did", "th"), "classes-of-rows")
    did, th = fresh_names(docs, "__did", "__th")
    chosen = found.groupBy("class_did").agg(F.min(F.struct("did", "th")).alias("row")).select(F.col("row.did").alias(did), F.col("row.th").alias(th))
    own = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = own.join(chosen, [did, th], "left_semi")
    # Only equal rows can be left; they are looked for among keys before any text is moved for their sake.
    if found.groupBy("did", "th").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([did, th])
    return kept.select(*[f"`{c}`" for c in docs.columns])
