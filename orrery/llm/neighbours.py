"""N-gram Jaccard join: documents whose shingle sets are alike, and their components.

Equal sets form a class, and only its first document goes on. Count-min sketches of
these say for each shingle about how many of them have it; a document needs enough shingles that others have to have
any neighbour at all. What is left is joined with a token-group matrix: similar
documents are partitioned into groups of bounded size by their least shingle, and are
linked inside their group; each group stores the union of its members' shingles, as a bitmap.
Groups that share a rare shingle are compared: the bitmaps bound the overlap of
anything in one with anything in the other, and only where the bound can
reach the threshold are both opened and their members compared. Nothing is capped: a hot group is
split, and the parts meet again as groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm import sketch
from orrery.llm.components import components
from orrery.llm.store import PORTION, discard, in_portions, keyed, settled, small_batches
from orrery.llm.textscan import WHITE, Hasher, give_back, mix, scan, window_starts

#: Words of a shingle; a text of fewer words is one shingle.
WIDTH = 5
#: Per cent of the union that two sets must share.
PERCENT = 75
#: Shingles of a group, about; the largest documents exceed it alone.
GROUP_SHINGLES = 100_000
#: Bits of a union's bitmap for each shingle of the largest member, at least.
UNION_BITS = 4


def need(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of that size with any set it is linked with."""
    return -(-size * percent // 100)


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a slice, their sets one after another (each sorted), and the sets' edges."""
    hasher = Hasher(53)
    for words in scan(texts, WHITE, lower=True):
        plain = hasher.spans(words.data, words.start, words.end)
        start, length, doc = window_starts(words.first, width, short=True)
        key = hasher.windows(plain, start, length) + length.astype(np.uint64)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[keep], doc[keep]
        yield np.arange(words.low, words.high), key, np.searchsorted(doc, np.arange(words.docs + 1))


def _digests(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: two sums of mixed shingles."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.append(np.uint64(0), np.cumsum(mix(sets ^ np.uint64(salt)), dtype=np.uint64))
        out.append(mix(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(np.uint64)).astype(np.int64))
    return out[0], out[1]


def shingle_sets(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, _row, size of the shingle set, and 128 bits that stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sets, edges in _sets(batch.column(2), width):
                a, b = _digests(sets, edges)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(int(own[0]), len(own)) for i in (0, 1)), pa.array(np.diff(edges)), pa.array(a), pa.array(b)], ["doc_id", "_row", "n_shingles", "set_a", "set_b"])
        give_back()

    return rows.select("doc_id", "_row", "text").mapInArrow(run, "doc_id long, _row long, n_shingles long, set_a long, set_b long")


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return total[edges[1:]] - total[edges[:-1]]


def _chosen(texts: pa.Table, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sets and edges of those rows."""
    own = texts.filter(pa.array(np.isin(texts["_row"].to_numpy(), rows)))
    parts = list(_sets(own["text"], width))
    sets = np.concatenate([np.zeros(0, np.uint64), *(x for _, x, _ in parts)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(e) for _, _, e in parts)])
    return own["doc_id"].to_numpy(), sets, np.append(0, np.cumsum(sizes))


CANDIDATES = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("sets", pa.binary()), ("prefix", pa.list_(pa.int64())), ("rest", pa.list_(pa.int32())), ("key", pa.int64())])


def _candidates(placed: DataFrame, firsts: DataFrame, size: float, width: int, percent: int) -> DataFrame:
    """doc_id, size, set, prefix, rest and key of first documents that may have neighbours.

    placed: doc_id, text, _row, portion; firsts: portion and _row of each class's first document.
    A document goes on if enough of its shingles may be in others, and one of them in its prefix: the rarest
    shingles, one more than a set may lack of a linked set;
    those that no other document has are left out. Rest: how many shingles of the set
    stand at a shingle of the prefix or after it, which bounds the overlap with a set that shares no rarer one. Key: a random shingle that
    others may have; linked documents agree on it more often than not.
    """
    bits = sketch.width_bits(size)

    def outline(texts: pa.Table, chosen: pa.Table) -> pa.Table:
        if not texts.num_rows or not chosen.num_rows:
            return sketch.CELLS.empty_table()
        _, sets, _ = _chosen(texts, chosen["_row"].to_numpy(), width)
        found = sketch.cells(sets, texts["portion"][0].as_py(), bits)
        give_back()
        return found

    def pick(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows or not marks.num_rows:
            return CANDIDATES.empty_table()
        known = marks["_row"].is_valid()
        ids, sets, edges = _chosen(texts, marks.filter(known)["_row"].to_numpy(), width)
        level = sketch.levels(sets, marks.filter(pc.invert(known)), bits)
        some = _sums(level > 0, edges) >= need(np.diff(edges), percent)
        rows: list[tuple] = []
        for i in np.flatnonzero(some).tolist():
            own, rarity = sets[edges[i] : edges[i + 1]], level[edges[i] : edges[i + 1]]
            first = np.lexsort((own, rarity))[: len(own) - need(len(own), percent) + 1]
            at = np.flatnonzero(rarity[first] > 0)
            if len(at):
                rows.append((int(ids[i]), len(own), own.tobytes(), own[first][at].astype(np.int64), len(own) - at, int(mix(own[rarity > 0]).min().astype(np.int64))))
        give_back()
        columns = list(zip(*rows, strict=True)) or [()] * len(CANDIDATES)
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(columns, CANDIDATES.types, strict=True)], schema=CANDIDATES)

    chosen = firsts.groupBy("portion")
    answers = sketch.merged(placed.groupBy("portion").cogroup(chosen).applyInArrow(outline, sketch.CELLS_DDL), bits, levels=True)
    marks = answers.unionByName(firsts, allowMissingColumns=True)
    return placed.groupBy("portion").cogroup(marks.groupBy("portion")).applyInArrow(pick, "doc_id long, size long, sets binary, prefix array<long>, rest array<int>, key long")


def _bitmap(tokens: np.ndarray, width: int) -> bytes:
    """A bitmap of 2**width bits with a bit for each token."""
    out = np.zeros(1 << width, bool)
    out[(mix(tokens) & np.uint64((1 << width) - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap of that many bytes that has the same tokens."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size), axis=0)


def bound(a: bytes, size_a: int, b: bytes, size_b: int) -> int:
    """Most that two unions of those bitmaps and sizes can have in common: a bit that only one has stands for a token that the other lacks."""
    width = min(len(a), len(b))
    x, y = _folded(a, width), _folded(b, width)
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _linked(overlap: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


GROUPS = "group long, members array<long>, sizes array<long>, sets array<binary>, prefix array<struct<token:long,rest:int>>, least long, most long, bitmap binary, tokens long"


def _form(percent: int):
    """Components inside a group, each with its members, their sets and the unions of their prefixes and of their shingles."""

    def form(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in rows["sets"]]
        size = rows["size"].to_numpy()
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        edges = np.append(0, np.cumsum(size))
        union, parts, mark = _Union(len(sets)), len(sets), np.zeros(int(token.max()) + 1, bool)
        for i in range(len(sets)):
            if parts == 1:
                break
            mine = token[edges[i] : edges[i + 1]]
            mark[mine] = True
            near = np.flatnonzero(_linked(np.bincount(owner[mark[token]], minlength=len(sets)), size, int(size[i]), percent))
            mark[mine] = False
            for j in near.tolist():
                a, b = union.root(i), union.root(j)
                if a != b:
                    union.up[max(a, b)] = min(a, b)
                    parts -= 1
        roots = np.array([union.root(i) for i in range(len(sets))])
        out = []
        for root in np.unique(roots).tolist():
            own = np.flatnonzero(roots == root)
            shared, place = np.unique(np.concatenate([rows["prefix"][i] for i in own.tolist()]), return_inverse=True)
            rest = np.zeros(len(shared), np.int32)
            np.maximum.at(rest, place, np.concatenate([rows["rest"][i] for i in own.tolist()]))
            prefix = [{"token": t, "rest": r} for t, r in zip(shared.tolist(), rest.tolist(), strict=True)]
            whole = np.unique(np.concatenate([sets[i] for i in own.tolist()])) if len(own) > 1 else sets[own[0]]
            bitmap = _bitmap(whole, max(6, int(np.ceil(np.log2(UNION_BITS * size[own].max())))))
            out.append((int(rows["doc_id"][root]), rows["doc_id"][own].tolist(), size[own].tolist(), [rows["sets"][i] for i in own.tolist()], prefix, int(size[own].min()), int(size[own].max()), bitmap, len(whole)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in GROUPS.split(", ")])

    return form


def _check(pairs: DataFrame, groups: DataFrame, percent: int, name: str) -> DataFrame:
    """Those pairs of groups (u, v) that have a link between them.

    Bitmaps of the unions rule out most; only what they leave is opened.
    """

    def qualify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            least = -(-(rows["least_a"] + rows["least_b"]) * percent // (100 + percent))
            most = [bound(*x) for x in zip(rows["bitmap_a"], rows["tokens_a"], rows["bitmap_b"], rows["tokens_b"], strict=True)]
            yield rows.loc[np.array(most, np.int64) >= least.to_numpy(), ["u", "v"]]

    def reach(sets: list[np.ndarray], other: np.ndarray) -> list[np.ndarray]:
        return [x for x in sets if np.isin(x, other, assume_unique=True).sum() >= need(len(x), percent)]

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            hit = []
            for a, b in zip(rows["sets_a"], rows["sets_b"], strict=True):
                left, right = ([np.frombuffer(x, np.uint64) for x in side] for side in (a, b))
                # members against the exact union of the other side
                left = reach(left, np.unique(np.concatenate(right))) if len(right) > 1 else left
                right = reach(right, np.unique(np.concatenate(left))) if len(left) > 1 else right
                hit.append(any(bool(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)) for x in left for y in right))
            yield rows.loc[hit, ["u", "v"]]

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        for end, side in (("u", "a"), ("v", "b")):
            pairs = pairs.join(groups.select(F.col("group").alias(end), *(F.col(c).alias(f"{c}_{side}") for c in columns)), end)
        return pairs

    left = settled(sides(pairs, "least", "tokens", "bitmap").mapInPandas(qualify, "u long, v long"), "qualified")
    found = settled(sides(left, "sets").mapInPandas(opened, "u long, v long"), name, release=True)
    discard(left)
    return found


def _links(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between groups; with those inside groups they connect all that is connected."""
    postings = groups.select("group", "least", "most", F.explode("prefix").alias("p")).select("group", "least", "most", "p.token", "p.rest")

    def fits(a: str, b: str) -> Column:
        """Sizes that can be linked, and a shared shingle early enough in both prefixes to be the rarest of a large enough overlap."""
        sizes = (F.col(f"{a}.least") * percent <= F.col(f"{b}.most") * 100) & (F.col(f"{b}.least") * percent <= F.col(f"{a}.most") * 100)
        wanted = F.ceil((F.col(f"{a}.least") + F.col(f"{b}.least")) * percent / (100 + percent))
        return sizes & (F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest")) >= wanted)

    several = settled(postings.groupBy("token").agg(F.min("group").alias("first"), F.max("group").alias("last")).filter(F.col("first") < F.col("last")).select("token", "first"), "several")
    shared = settled(postings.join(several, "token"), "shared")  # shingles of several groups; the others link nothing
    # each group against the first group with the same shingle
    a, b = shared.filter(F.col("group") == F.col("first")).alias("a"), shared.alias("b")
    star = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.group") < F.col("b.group")) & fits("a", "b")).select(F.col("a.group").alias("u"), F.col("b.group").alias("v")).distinct()
    near = _check(star, groups, percent, "near")
    known = settled(components(near), "known")
    # all groups that share a shingle and are not connected yet
    named = shared.join(known, shared["group"] == known["node"], "left").select("token", "group", "least", "most", "rest", F.coalesce("component", "group").alias("part"))
    named = settled(named, "named")
    discard(several, shared, known)
    mixed = settled(named.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter(F.col("a") < F.col("b")).select("token"), "mixed")
    rest = settled(named.join(mixed, "token", "left_semi"), "rest")
    discard(named, mixed)
    a, b = rest.alias("a"), rest.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.part") < F.col("b.part")) & fits("a", "b")).select(F.col("a.group").alias("u"), F.col("b.group").alias("v")).distinct()
    far = _check(pairs, groups, percent, "far")
    discard(rest)
    return near, far


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES, portion: int = PORTION, row: str | None = None) -> DataFrame:
    """Components of documents under links of shingle sets.

    docs needs an id and a text; other columns are ignored. Result: one row per row
    of docs: doc_id, n_shingles, component_id (the least id that links reach, itself
    included). A null or empty text has no set and no link; a long one counts whole. Rows without an id
    are their own component, with a null id. Rows of one id with equal sets are copies; with
    different sets ids do not tell rows apart, and the result is the same for
    both where labels meet. An empty table gives no rows.
    portion: bytes of text that a task handles at once, about; row: a long column that tells rows apart and is the same at
    each read, if there is one.
    """
    small_batches(docs.sparkSession)
    own = [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    rows = docs.select(*own, F.col(row).alias("_row")) if row else keyed(docs, *own)
    sets = settled(shingle_sets(rows, width), "sets")
    known = sets.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = settled(known.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "_row")).alias("first"), F.max("doc_id").alias("last"), F.max("n_shingles").alias("size")), "classes")
    size, total = classes.agg(F.sum("size")).first()[0] or 0, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = in_portions(rows, total, portion)
    firsts = in_portions(classes.select(F.col("first._row").alias("_row")), total, portion)
    some = settled(_candidates(placed, firsts, size, width, percent), "candidates", release=True)
    hot = settled(some.groupBy("key").agg(F.sum("size").alias("total")).filter(F.col("total") > group_shingles), "hot")
    parts = F.ceil(F.coalesce("total", F.lit(0)) / group_shingles)
    keys = some.join(hot, "key", "left").withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("doc_id"), parts)).otherwise(0).cast("long"))
    groups = settled(keys.groupBy("key", "part").applyInPandas(_form(percent), GROUPS), "groups", release=True)
    discard(some, hot)
    inside = groups.select(F.col("group").alias("u"), F.explode("members").alias("v"))
    near, far = _links(groups, percent)
    labels = settled(components(near.unionByName(far).unionByName(inside)), "components", release=True)
    discard(groups, near, far)
    several = classes.filter(F.col("first.doc_id") < F.col("last")).select("set_a", "set_b", F.col("first.doc_id").alias("first"))
    copies = sets.join(several, ["set_a", "set_b"], "left")
    named = copies.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("first"))
    done = named.join(labels, named["first"] == labels["node"], "left")
    return done.select(named["doc_id"], "n_shingles", F.coalesce("component", "first").alias("component_id"))
