"""N-gram Jaccard join: a MinHash LSH forest finds candidates, shared word shingles decide.

Each different text is a node. A tree of the forest is a prefix trie of labels of DEEPEST MinHash values, held as labels
in sorted order; nodes that share a prefix are candidates. Matched prefixes begin at the deepest level and are shortened
per text: at once to the shallowest level where few texts share that prefix, which costs little, and in crowded places
step by step, the least crowded one first, until the text's matches over all trees find a pair at the wanted similarity
with the target probability. Texts of one place take the shortest prefix that one of them needs. The bound holds trees
to be independent. A pair is looked at in the first tree that brings it together, and nowhere else, by the exact Jaccard
similarity of its sets of five-word shingles.

Texts of fewer than five words, but not none, are one shingle. A null text is empty; texts without words link to none
but their own copies, which are always one class. Rows that agree in id and text are copies too. An empty table gives
an empty result. Only the id and text columns are read.

Exact copies are folded before anything else, so a text that a third of all rows repeat is one node. A prefix that
many nodes share is cut into blocks, and every pair of blocks is a group of its own: no group exceeds two blocks, no
pair is skipped, and no pair leaves its task, only each node's number of links and its local component.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from watchmere.llm.common import MEMORY_WORDS, resident, scan_rows, small_batches, schema_of, table, words_of
from watchmere.llm.components import components
from watchmere.session import scratch_path

SHINGLE = 5
SIMILAR = 0.8
TREES = 32
DEEPEST = 8
TARGET = 1 - 1e-6
BLOCK = 1024
CROWD = 1024
COLUMNS = 4096


def prefix_depth(similar: float, trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET) -> int:
    """The longest prefix that still brings pairs of this similarity together with the target probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - similar**depth) ** trees < target:
        depth -= 1
    return depth


@dataclass(frozen=True)
class Forest:
    """Shape of the tries: labels of `deepest` values, of which at least `shallow` must match."""

    shallow: int
    similar: float = SIMILAR
    target: float = TARGET
    trees: int = TREES
    deepest: int = DEEPEST

    @property
    def bits(self) -> int:
        """Of each value below the shallowest level; together they fit one number."""
        return min(15, 60 // max(1, self.deepest - self.shallow))

    def weight(self, depth: int) -> float:
        """What a match of this many values in one tree adds: minus the logarithm of the chance that it misses a pair."""
        return -math.log1p(-(self.similar**depth))

    def depths(self, crowded: dict[int, list[int]]) -> dict[int, int]:
        """Matched prefixes in the crowded trees of one text, given how many texts share each from `shallow` on."""
        found = dict.fromkeys(crowded, self.deepest)
        reached = (self.trees - len(crowded)) * self.weight(self.shallow) + len(crowded) * self.weight(self.deepest)
        ways = [(sizes[-2], tree, self.deepest - 1) for tree, sizes in crowded.items() if self.deepest > self.shallow]
        heapq.heapify(ways)
        while ways and reached < -math.log(1 - self.target):
            _, tree, depth = heapq.heappop(ways)
            found[tree] = depth
            reached += self.weight(depth) - self.weight(depth + 1)
            if depth > self.shallow:
                heapq.heappush(ways, (crowded[tree][depth - 1 - self.shallow], tree, depth - 1))
        return found


class Signer:
    """Labels of a text: for each tree one number for the values of its shallowest prefix, one for those below."""

    def __init__(self, forest: Forest, size: int = SHINGLE):
        draw = np.random.default_rng(20240501)
        self.size, self.forest = size, forest
        trees, shallow, deepest = forest.trees, forest.shallow, forest.deepest
        self.factors = draw.integers(1, 1 << 32, deepest * trees, dtype=np.uint32) | np.uint32(1)
        self.offsets = draw.integers(0, 1 << 32, deepest * trees, dtype=np.uint32)
        self.mix = draw.integers(1, 1 << 63, (trees, shallow), dtype=np.uint64) | np.uint64(1)
        self.fold = draw.integers(1, 1 << 32, (trees, deepest - shallow), dtype=np.uint32) | np.uint32(1)
        self.shifts = np.arange(deepest - shallow, dtype=np.uint64)[::-1] * np.uint64(forest.bits)
        self.places = draw.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
        self.known: dict[bytes, int] = {}

    def shingle_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 2 * MEMORY_WORDS:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        row = np.fromiter([known[w] for w in words], np.uint64, len(words))
        if len(row) < self.size:
            return np.array([(row * self.places[: len(row)]).sum()], np.uint64)
        n = len(row) - self.size + 1
        out = row[:n] * self.places[0]
        for i in range(1, self.size):
            out = out + row[i : i + n] * self.places[i]
        return out

    def __call__(self, text: bytes):
        words = words_of(text)
        if not words:
            return 0, None, None
        hashes = np.unique((self.shingle_hashes(words) >> np.uint64(32)).astype(np.uint32))
        least = np.full(len(self.factors), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(hashes), 256):
            part = hashes[at : at + 256, None] * self.factors
            part += self.offsets
            np.minimum(least, part.min(axis=0), out=least)
        values = least.reshape(self.forest.trees, -1)
        shallow = self.forest.shallow
        heads = (values[:, :shallow] * self.mix).sum(axis=1, dtype=np.uint64)
        low = (values[:, shallow:] * self.fold) >> np.uint32(32 - self.forest.bits)
        tails = (low.astype(np.uint64) << self.shifts).sum(axis=1, dtype=np.uint64)
        return len(words), heads.view(np.int64).tolist(), tails.view(np.int64).tolist()


def text_print(text_col: str):
    """Two hashes of a text that together name it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(text).alias("hi"), F.xxhash64(F.lit(20240501), text).alias("lo")


def groups_in(
    frame: DataFrame, keys: list[str], ddl: str, work: Callable[[list[np.ndarray | list]], list[list]]
) -> DataFrame:
    """`work` on each group of `frame`, which is dealt out and sorted by `keys`; groups are read one after the other."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)
    n_keys = len(keys)
    dealt = frame.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("", None)
        held: list[pa.RecordBatch] = []
        before = None
        made: list[list[list]] = []
        size = 0

        def flush():
            columns = [[v for part in made for v in part[i]] for i in range(len(arrow))]
            made.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow
            )

        def finish():
            group = pa.Table.from_batches(held)
            held.clear()
            return work([group.column(i) for i in range(group.num_columns)]) if group.num_rows > 1 else None

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.zeros(batch.num_rows, np.bool_)
            for i in range(n_keys):
                values = batch.column(i).to_numpy(zero_copy_only=False)
                cuts[1:] |= values[1:] != values[:-1]
            key = tuple(batch.column(i)[0].as_py() for i in range(n_keys))
            cuts[0] = key != before
            starts = np.flatnonzero(cuts).tolist()
            if not cuts[0]:
                starts.insert(0, 0)
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if cuts[start] and held:
                    rows = finish()
                    if rows and rows[0]:
                        made.append(rows)
                        size += len(rows[0])
                        if size >= 10_000:
                            yield flush()
                            size = 0
                held.append(batch.slice(start, end - start))
            before = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(n_keys))
        if held:
            rows = finish()
            if rows and rows[0]:
                made.append(rows)
        if made:
            yield flush()

    return small_batches(dealt).mapInArrow(run, schema)


def new_pairs(labels: np.ndarray, tree: int, sides: np.ndarray) -> np.ndarray:
    """Which pairs of rows meet here first: no tree before this one has them together. Upper triangle only.

    Where rows come from two blocks, pairs within a block are left to that block's own group.
    """
    n = len(labels)
    fresh = np.triu(np.ones((n, n), np.bool_), 1)
    if (sides != sides[0]).any():
        fresh &= sides[:, None] != sides[None, :]
    for earlier in range(tree):
        if not fresh.any():
            break
        column = labels[:, earlier]
        fresh &= column[:, None] != column[None, :]
    return fresh


def shingle_sets(texts: list[bytes], size: int) -> tuple[list[np.ndarray], int]:
    """Each text's shingles as numbers that all texts share; the words themselves are the keys."""
    numbers: dict[tuple[bytes, ...], int] = {}
    sets = []
    for text in texts:
        words = words_of(text)
        if len(words) < size:
            shingles = {tuple(words)}
        else:
            shingles = set(zip(*[words[i:] for i in range(size)], strict=False))
        sets.append(np.fromiter([numbers.setdefault(s, len(numbers)) for s in shingles], np.int64, len(shingles)))
    return sets, len(numbers)


def links_of(texts: list[bytes], fresh: np.ndarray, size: int, similar: float) -> np.ndarray:
    """The pairs among `fresh` whose shingle sets are similar enough."""
    sets, n_shingles = shingle_sets(texts, size)
    counts = np.array([len(s) for s in sets])
    n = len(texts)
    common = np.zeros((n, n), np.float32)
    if n <= 3:
        for i, j in np.argwhere(fresh):
            common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        rows = np.repeat(np.arange(n), counts)
        flat = np.concatenate(sets)
        shared = np.bincount(flat, minlength=n_shingles) > 1
        place = np.cumsum(shared) - 1
        held = shared[flat]
        rows, flat = rows[held], place[flat[held]]
        order = np.argsort(flat, kind="stable")
        rows, flat = rows[order], flat[order]
        n_columns = int(shared.sum())
        for start in range(0, n_columns, COLUMNS):
            part = slice(*np.searchsorted(flat, (start, start + COLUMNS)))
            matrix = np.zeros((n, min(COLUMNS, n_columns - start)), np.float32)
            matrix[rows[part], flat[part] - start] = 1
            common += matrix @ matrix.T
    union = counts[:, None] + counts[None, :] - common
    return fresh & (common >= similar * union - 1e-6)


def local_roots(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row that links lead to."""
    near = links | links.T
    roots = np.arange(len(near))
    while True:
        lowest = np.where(near, roots[None, :], len(near)).min(axis=1)
        following = np.minimum(roots, lowest)
        following = following[following]
        if (following == roots).all():
            return roots
        roots = following


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


GROUP = ["bucket", "left", "right"]
MEMBER = "bucket long, left int, right int, tree int, side int, hi long, lo long"
LINKS = "hi long, lo long, links long, root_hi long, root_lo long"
SIGNED = "n_words long, heads array<long>, tails array<long>"
TRIE = "tree int, head long, depth int, prefix long, n long"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def text_nodes(documents: DataFrame, id_col: str, text_col: str, forest: Forest, size: int) -> DataFrame:
    """One row per different text: its print, smallest id, copies and labels, written to the shared folder."""
    rows = documents.select(F.col(id_col).alias("id"), *text_print(text_col), F.col(text_col).alias("body"))
    signed = scan_rows(rows, ["id", "hi", "lo"], "body", SIGNED, lambda: Signer(forest, size))
    nodes = signed.groupBy("hi", "lo").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first(F.struct("heads", "tails")).alias("label")
    )
    return kept(nodes.select("hi", "lo", "first_id", "copies", "label.heads", "label.tails"), "text-nodes")


def trie_nodes(crowded: DataFrame, forest: Forest) -> DataFrame:
    """How many texts share each prefix below the shallowest level: tree, head, depth, prefix, n.

    Labels are sorted over all tasks, so a prefix is a run of rows. Tasks count runs batch by batch, hold no run and may
    each have a part of one; the parts are added up.
    """
    arrow = to_arrow_schema(schema_of(TRIE))
    order = ["tree", "head", "tail", "hi"]
    levels = range(forest.shallow + 1, forest.deepest + 1)
    bits, deepest = forest.bits, forest.deepest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, head, tail = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for depth in levels if len(tree) else ():
                prefix = tail >> (bits * (deepest - depth))
                new = np.ones(len(tree), np.bool_)
                new[1:] = (tree[1:] != tree[:-1]) | (head[1:] != head[:-1]) | (prefix[1:] != prefix[:-1])
                at = np.flatnonzero(new)
                sizes = np.diff(np.append(at, len(tree)))
                columns = [tree[at], head[at], np.full(len(at), depth), prefix[at], sizes]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    ordered = crowded.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = ordered.mapInArrow(count, schema_of(TRIE))
    return runs.groupBy("tree", "head", "depth", "prefix").agg(F.sum("n").alias("n"))


def prefix_of(depth, forest: Forest):
    return F.expr(f"shiftright(tail, CAST({forest.bits} * ({forest.deepest} - {depth}) AS INT))").alias("prefix")


def matched_prefixes(crowded: DataFrame, forest: Forest) -> DataFrame:
    """The prefixes that must match in crowded places: tree, head, depth. Rows are crowded nodes of the shallowest level."""
    depths = f"sequence({forest.shallow + 1}, {forest.deepest})" if forest.deepest > forest.shallow else "array(0)"
    levels = crowded.select("tree", "head", "tail", "hi", "lo", "n", F.explode(F.expr(depths)).alias("depth"))
    levels = levels.withColumn("prefix", prefix_of("depth", forest)).drop("tail").withColumnRenamed("n", "whole")
    sized = levels.join(trie_nodes(crowded, forest), ["tree", "head", "depth", "prefix"], "left")
    # At most one row for each tree and level of a text.
    texts = sized.groupBy("hi", "lo").agg(F.collect_list(F.struct("tree", "head", "depth", "whole", "n")).alias("places"))
    ddl = "tree int, head long, depth int"
    arrow = to_arrow_schema(schema_of(ddl))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for places in batch.column(0).to_pylist():
                sizes = {p["tree"]: [p["whole"]] * (forest.deepest - forest.shallow + 1) for p in places}
                for p in places:
                    if p["n"] is not None:
                        sizes[p["tree"]][p["depth"] - forest.shallow] = p["n"]
                heads = {p["tree"]: p["head"] for p in places}
                rows += [{"tree": t, "head": heads[t], "depth": d} for t, d in forest.depths(sizes).items()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    chosen = small_batches(texts.select("places")).mapInArrow(choose, schema_of(ddl))
    return chosen.groupBy("tree", "head").agg(F.min("depth").alias("depth"))


def shared_prefixes(nodes: DataFrame, forest: Forest, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Texts by the prefixes that they share with others, and the labels that stand for longer prefixes.

    The first has a row (bucket, tree, hi, lo, n) for each text and prefix that n texts share; the second a row (hi, lo,
    longer) for each text that stands in crowded places, a map from trees to labels.
    """
    spots = nodes.filter("heads IS NOT NULL").select("hi", "lo", "tails", F.posexplode("heads").alias("tree", "head"))
    tail = F.element_at("tails", F.col("tree") + 1).alias("tail")
    spots = spots.select(F.xxhash64("tree", "head").alias("bucket"), "tree", "head", tail, "hi", "lo")
    crowds = spots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = kept(spots.join(crowds, "bucket"), "shared-prefixes")
    crowded = shared.filter(F.col("n") > crowd)
    chosen = crowded.join(matched_prefixes(crowded, forest), ["tree", "head"])
    label = F.xxhash64("tree", "head", "depth", prefix_of("depth", forest)).alias("bucket")
    longer = kept(chosen.select(label, "tree", "hi", "lo"), "longer-prefixes")
    again = longer.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = shared.filter(F.col("n") <= crowd).select("bucket", "tree", "hi", "lo", "n")
    members = members.unionByName(longer.join(again, "bucket"))
    labels = longer.groupBy("hi", "lo").agg(F.map_from_entries(F.collect_list(F.struct("tree", "bucket"))).alias("longer"))
    return members, labels


def candidate_groups(members: DataFrame, block: int) -> DataFrame:
    """Texts of shared prefixes, dealt to groups of at most two blocks."""
    sided = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("side", F.pmod("hi", "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = sided.select("bucket", "tree", "side", "hi", "lo", other)
    return paired.select(
        "bucket", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "tree", "side", "hi", "lo"
    )


def similar_links(
    documents: DataFrame, nodes: DataFrame, text_col: str, size: int, forest: Forest, block: int, crowd: int
) -> DataFrame:
    """Verified links, folded in their tasks: per node and group its number of links and its local root."""

    def meet(columns):
        tree = columns[3][0].as_py()
        fresh = new_pairs(_labels(columns[7]), tree, columns[4].to_numpy())
        wanted = np.flatnonzero(fresh.any(axis=0) | fresh.any(axis=1))
        return [c.take(pa.array(wanted)).to_pylist() for c in columns[:8]]

    def verify(columns):
        tree = columns[3][0].as_py()
        fresh = new_pairs(_labels(columns[7]), tree, columns[4].to_numpy())
        links = links_of(columns[8].cast(pa.binary()).to_pylist(), fresh, size, forest.similar)
        counts = links.sum(axis=0) + links.sum(axis=1)
        found = np.flatnonzero(counts)
        roots = local_roots(links)
        hi, lo = columns[5].to_numpy(), columns[6].to_numpy()
        return [v.tolist() for v in (hi[found], lo[found], counts[found], hi[roots[found]], lo[roots[found]])]

    members, longer = shared_prefixes(nodes, forest, crowd)
    own = F.transform("heads", lambda head, tree: F.coalesce(F.col("longer")[tree], head)).alias("labels")
    labels = nodes.join(longer, ["hi", "lo"], "left").select("hi", "lo", F.when(F.col("longer").isNull(), F.col("heads")).otherwise(own).alias("labels"))
    dealt = candidate_groups(members, block).join(labels, ["hi", "lo"]).select(*GROUP, "tree", "side", "hi", "lo", "labels")
    met = kept(groups_in(dealt, GROUP, MEMBER + ", labels array<long>", meet), "candidates")
    texts = documents.select(*text_print(text_col), F.col(text_col).cast("string").alias("body"))
    bodies = texts.join(met.select("hi", "lo").distinct(), ["hi", "lo"], "left_semi").dropDuplicates(["hi", "lo"])
    return groups_in(met.join(bodies, ["hi", "lo"]).select(*met.columns[:3], "tree", "side", "hi", "lo", "labels", "body"), GROUP, LINKS, verify)


def classes(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similar: float = SIMILAR,
    target: float = TARGET,
    block: int = BLOCK,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per different text: (hi, lo) name it; class_id, links to other texts, copies, and whether it leads.

    A class is what links connect; its id is the smallest document id in it. A prefix that more than `crowd` texts share is
    crowded: it is matched at a greater depth where the target allows it.
    """
    forest = Forest(prefix_depth(similar, target=target), similar, target)
    nodes = text_nodes(documents, id_col, text_col, forest, size)
    found = kept(similar_links(documents, nodes, text_col, size, forest, block, crowd), "links")
    edges = found.select(F.struct("hi", "lo").alias("a"), F.struct(F.col("root_hi").alias("hi"), F.col("root_lo").alias("lo")).alias("b"))
    roots = components(edges).select("node.hi", "node.lo", "root")
    counts = found.groupBy("hi", "lo").agg(F.sum("links").alias("n_links"))
    member = nodes.drop("heads", "tails").join(roots, ["hi", "lo"], "left").join(counts, ["hi", "lo"], "left")
    own = F.coalesce("root", F.struct("hi", "lo"))
    leads = F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "hi", "lo")
    by_class = member.groupBy(own.alias("own")).agg(F.min(leads).alias("lead"))
    return member.join(by_class, own == F.col("own")).select(
        "hi",
        "lo",
        F.col("lead.first_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("copies").alias("n_copies"),
        F.col("first_id"),
        ((F.col("lead.hi") == F.col("hi")) & (F.col("lead.lo") == F.col("lo"))).alias("leads"),
    )


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its class, links of its text to other texts, and copies of its text."""
    rows = documents.select(F.col(id_col), *text_print(text_col))
    found = classes(documents, id_col, text_col, **options).drop("first_id", "leads")
    return rows.join(found, ["hi", "lo"]).select(id_col, "class_id", "n_links", "n_copies")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, of one document of each class: that of the smallest id; repeated rows once."""
    leads = classes(documents, id_col, text_col).filter("leads")
    leads = leads.select(F.col("hi").alias("__lead_hi"), F.col("lo").alias("__lead_lo"), F.col("first_id").alias("__first"))
    hi, lo = text_print(text_col)
    keyed = documents.withColumns({"__hi": hi, "__lo": lo})
    same = (F.col("__hi") == F.col("__lead_hi")) & (F.col("__lo") == F.col("__lead_lo"))
    same &= F.col(id_col).eqNullSafe(F.col("__first"))
    kept = keyed.join(leads, same, "left_semi").dropDuplicates(["__hi", "__lo", id_col])
    return kept.drop("__hi", "__lo")


def op6_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "documents"))
