"""All similar pairs between set-valued records: sorted sketch forests.

Every distinct set gets minhash signatures, one per tree, of VALUES values each. A tree orders the sets lexicographically by its
signature; sets that share the first d values stand together in that order. Within the order each set's neighbourhood is the
largest common-prefix group that isn't crowded: groups that share one value, and where these are crowded, two values, and so on. The
sets of a neighbourhood are compared with each other.

Two sets of similarity s share d values in at least one of T trees with probability 1 - (1 - s^d)^T. So a set is done once T trees
reach the target recall at the threshold with the depth of its deepest neighbourhood in any of them: whatever shares that many
values with it has been compared. The others go on to a round of more trees, until the target is reached for all; a pair is safe if
either of its sets is done. The last round has no limit on a neighbourhood: those of equal prefixes are cut into blocks, and each
pair of blocks is a task's work. What is met is verified by the exact similarity.

Rows move once per tree and round. Prefixes shared by so many sets that they'd fill a good part of a task are found by a probe, and
their sets are sent on by longer prefixes. Equal sets are put into one class first and compared once, so copies never meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.session import checkpointed

#: Values of a signature.
VALUES = 12
#: A neighbourhood of more sets is deepened.
CROWD = 256
#: Trees that the first round may have, and the last one.
FIRST, LAST = 12, 300
#: Share of sets (by hash) whose prefixes are counted to find those that are shared by very many sets before anything is moved.
PROBE = 64
#: Minhash values in the sketch that travels with a signature, two bits of each; pairs that agree in fewer of them than 4 sigma below the
#: mean at the threshold aren't verified, which loses about 4 in 10^5 of the pairs at the threshold itself. The trees have the other
#: part of what the recall lets miss.
SKETCH, SIGMA, TREES_PART = 128, 4, 0.6


@dataclass(frozen=True)
class Round:
    """``trees`` further ones; afterwards the target is reached for sets whose neighbourhoods are at most ``depth`` deep."""

    depth: int
    trees: int
    last: bool = False


def trees_for(threshold: float, recall: float, depth: int) -> int:
    p = threshold**depth
    return math.ceil(math.log((1 - recall) * TREES_PART) / math.log1p(-p)) if p > 1e-12 else 1 << 40


def rounds(threshold: float, recall: float) -> list[Round]:
    """From the depth that FIRST trees reach to that which LAST trees reach, at least 1 and at most VALUES."""
    depth_of = lambda n: max([1, *(d for d in range(1, VALUES + 1) if trees_for(threshold, recall, d) <= n)])
    first, last = depth_of(FIRST), depth_of(LAST)
    depths = [first, *(d for d in (first + 1, first + 3, first + 6) if d < last)]
    total = [trees_for(threshold, recall, d) for d in depths]
    return [*(Round(d, n - before) for d, n, before in zip(depths, total, [0, *total])), Round(last, trees_for(threshold, recall, last), True)]


def least_agreement(threshold: float) -> int:
    p = threshold + (1 - threshold) / 4
    return math.floor(SKETCH * p - SIGMA * math.sqrt(SKETCH * p * (1 - p)))


_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that equal low bits or small differences of the input don't show."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 20)
    v = _mix(at * _MUL)
    return v[:n] | np.uint64(1), v[n:]


_SKETCH = ("s0", "s1", "s2", "s3")  # the first bits of all values, then the second ones
_ROW = "key bigint, deep tinyint, sig binary, rep bigint, size int, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
#: Bytes of a signature: 4 of the first value, 2 of each other one.
_WIDTH = 4 + 2 * (VALUES - 1)


def _signatures(trees: int, seed: int, hot: dict[int, np.ndarray]):
    """Arrow batches (rep, size, set) -> one row per tree. ``key`` is the hash of the tree and the first values; rows are sent by it.

    hot: by depth, the sorted hashes of prefixes that too many sets share; their rows are sent by longer prefixes. ``deep`` is the depth
    up to which all prefixes of a row are hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(trees * VALUES, SKETCH)
        mul, add = _functions(n, seed)
        with np.errstate(over="ignore"):
            for whole in batches:
                for start in range(0, whole.num_rows, 2000):
                    b = whole.slice(start, 2000)
                    sets = b.column("set")
                    lens = np.diff(sets.offsets.to_numpy()).astype(np.int64)
                    flat = _mix(sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64) * _MUL)
                    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
                    low = np.empty((n, len(lens)), np.uint64)
                    for f in range(n):
                        h = flat * mul[f] + add[f]
                        h ^= h >> np.uint64(32)
                        low[f] = np.minimum.reduceat(h, at)
                    mixed = _mix(low[:SKETCH])
                    bits = np.stack([(mixed >> np.uint64(k)) & np.uint64(1) for k in (17, 31)]).reshape(4, 64, -1)
                    sketch = [pa.array(x) for x in (bits << np.arange(64, dtype=np.uint64)[None, :, None]).sum(axis=1, dtype=np.uint64).view(np.int64)]
                    rep, size = b.column("rep"), b.column("size")
                    for t in range(trees):
                        values = _mix(low[t * VALUES : (t + 1) * VALUES])
                        sig = np.empty((len(lens), _WIDTH), np.uint8)
                        sig[:, :4] = (values[0] >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
                        sig[:, 4:] = np.ascontiguousarray((values[1:] >> np.uint64(48)).astype(">u2").T).view(np.uint8).reshape(-1, _WIDTH - 4)
                        key = _prefix_hash(np.full(len(lens), np.uint64(t + 1) * _MUL), sig, 1)
                        deep, on = np.zeros(len(lens), np.int8), np.ones(len(lens), bool)
                        for d in range(1, VALUES):
                            if d not in hot:
                                break
                            on &= np.isin(key, hot[d])
                            if not on.any():
                                break
                            deep[on] = d
                            key[on] = _prefix_hash(key[on], sig[on], d + 1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(deep), _binary(sig), rep, size, *sketch], names=["key", "deep", "sig", "rep", "size", *_SKETCH]
                        )

    return run


def _binary(sig: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(0, (len(sig) + 1) * _WIDTH, _WIDTH, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(sig))])


def _prefix_hash(before: np.ndarray, sig: np.ndarray, depth: int) -> np.ndarray:
    """The hash of the first ``depth`` values, from that of one less."""
    own = sig[:, :4] if depth == 1 else sig[:, 2 * depth : 2 * depth + 2]
    value = own.astype(np.uint64) @ (np.uint64(256) ** np.arange(own.shape[1], dtype=np.uint64))
    with np.errstate(over="ignore"):
        return _mix(before * np.uint64(31) + value + np.uint64(depth))


def _worthwhile(threshold: float, need: int, size: np.ndarray, sketch: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches of rows ``i`` and ``j`` allow the threshold."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    good = small >= threshold * large
    x, y = i[good], j[good]
    differ = sum(np.bitwise_count(((sketch[k][x] ^ sketch[k][y]) | (sketch[k + 2][x] ^ sketch[k + 2][y])).view(np.uint64)).astype(np.int64) for k in (0, 1))
    good[good] &= SKETCH - differ >= need
    return good


def _met(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], names=["a", "b"])


def _neighbours(threshold: float, crowd: int, enough: int):
    """Rows sorted by key and signature -> (a, b) of neighbours worth verifying, and (a, null) of sets with a neighbourhood deeper than ``enough``.

    A row's neighbourhood is its largest common-prefix group of at most ``crowd`` rows. Groups are runs of the sorted rows; at the
    end of a batch only the run that may go on is kept, at most ``crowd`` rows, with the depth up to which it is known to be crowded.
    """
    need = least_agreement(threshold)

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        sig = b.column("sig")
        at = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset]
        raw = np.frombuffer(sig.buffers()[2], np.uint8)[at : at + b.num_rows * _WIDTH].reshape(-1, _WIDTH)
        return [raw, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "deep", "rep", "size", *_SKETCH))]

    def common(sig, key):
        """How many first values each row shares with the one before it; -1 where the key differs."""
        same = sig[1:] == sig[:-1]
        values = np.concatenate([same[:, :4].all(1)[:, None], same[:, 4:].reshape(len(same), VALUES - 1, 2).all(2)], 1)
        out = np.where(values.all(1), VALUES, np.argmin(values, 1)).astype(np.int8)
        out[key[1:] != key[:-1]] = -1
        return np.concatenate(([-1], out)).astype(np.int8)

    def depths(lcp, deep, known):
        """Of each row, the depth of its neighbourhood; VALUES + 1 where even full signatures are crowded."""
        out = np.full(len(lcp), VALUES + 1, np.int8)
        for d in range(VALUES, 0, -1):
            group = np.cumsum(lcp < d) - 1
            n = np.bincount(group)
            if d <= known:
                n[0] = crowd + 1
            out[(n[group] <= crowd) & (deep < d)] = d
        return out

    def met(cols, lcp, own):
        sig, key, deep, rep, size, *sketch = cols
        start = lcp < np.minimum(own, VALUES)  # neighbourhoods: runs that share as many values as their depth
        start[1:] |= own[1:] != own[:-1]
        group = np.cumsum(start)
        at, step, out_a, out_b = np.flatnonzero(own <= VALUES), 1, [], []
        while True:
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            good = at[_worthwhile(threshold, need, size, sketch, at, at + step)]
            if len(good):
                out_a.append(np.minimum(rep[good], rep[good + step]))
                out_b.append(np.maximum(rep[good], rep[good + step]))
            step += 1
        if out_a:
            pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
            yield _met(pairs[:, 0], pairs[:, 1])
        late = own > enough
        if late.any():
            yield _met(np.unique(rep[late]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, known = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = columns(b)
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
            lcp = common(cols[0], cols[1])
            own = depths(lcp, cols[2], known)
            cut, over = len(lcp), 0
            for d in range(1, VALUES + 1):  # the last run that may go on and isn't known to be crowded
                first = int(np.flatnonzero(lcp < d)[-1])
                if len(lcp) - first <= crowd and not (first == 0 and d <= known):
                    cut, over = first, d - 1
                    break
            else:
                over = VALUES
                cut = len(lcp) - 1  # one row is kept to see whether the run goes on
            if cut:
                yield from met([c[:cut] for c in cols], lcp[:cut], own[:cut])
                known = over
            else:
                known = max(known, over)
            rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]):
            lcp = common(rest[0], rest[1])
            yield from met(rest, lcp, depths(lcp, rest[2], known))

    return run


def _blocks(threshold: float):
    """Rows sorted by key, i and j, with the block each is of -> pairs of block i with block j worth verifying."""
    need = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for cols in ([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "block", "rep", "size", *_SKETCH)] for b in batches if b.num_rows):
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
            new = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))))
            for a, b in zip(new[:-1], new[1:]):
                yield from task([c[a:b] for c in cols])
            rest = [c[new[-1] :] for c in cols]
        if rest is not None:
            yield from task(rest)

    def task(cols):
        _, i, j, block, rep, size, *sketch = cols
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        for x in left:
            y = right[right > x] if i[0] == j[0] else right
            if len(y):
                y = y[_worthwhile(threshold, need, size, sketch, np.full(len(y), x), y)]
                if len(y):
                    yield _met(np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y]))

    return run


def set_classes(rows: DataFrame, id_col: str, set_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of equal sets.

    ``rows`` has one row per delivered record; of an id delivered with different sets the one with the greatest hash counts. Null
    and empty sets take no part. members: (id, rep), rep being the smallest id with that set. classes: (rep, size, set, copies).
    """
    usable = rows.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(F.array_compact(F.col(set_col)))).alias("set")).where("id is not null and size(set) > 0")
    marked = usable.select("id", "set", F.xxhash64("set").alias("h1"), F.xxhash64(F.reverse("set"), F.size("set")).alias("h2"))
    ids = marked.groupBy("id").agg(F.max(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    groups = ids.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = marked.groupBy("h1", "h2").agg(F.first("set").alias("set"))
    classes = groups.join(sets, ["h1", "h2"]).select("rep", F.size("set").alias("size"), "set", "copies")
    shared = groups.where("copies > 1").select("h1", "h2", "rep")
    members = ids.join(shared, ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return members, classes


def _hot(sample: DataFrame, trees: int, seed: int, crowd: int) -> dict[int, np.ndarray]:
    """By depth, the hashes of prefixes that more sets share than a quarter of a task's fair share; so at most 4 x partitions of a depth.

    ``sample`` has one set in PROBE. A prefix counts only if it is crowded by a wide margin as well.
    """
    parts, hot = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")), {}
    total = sample.count() * trees
    least = max(16, 4 * crowd // PROBE, total // (4 * parts))
    for d in range(1, VALUES):
        if total < least:
            break
        rows = sample.mapInArrow(_signatures(trees, seed, hot), _ROW).where(F.col("deep") == d - 1)
        found = rows.groupBy("key").count().where(F.col("count") > least).select("key").collect()
        if not found:
            break
        hot[d] = np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))
    return hot


def _unlimited(sent: DataFrame, threshold: float, depth: int, crowd: int) -> DataFrame:
    """(a, b) of all sets that share ``depth`` values, however many: a group is cut into blocks of about ``crowd``, each pair of which moves by itself."""
    keyed = sent.select(F.xxhash64("key", F.substring("sig", 1, 2 * depth + 2)).alias("key"), "rep", "size", *_SKETCH)
    n = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", "n")
    blocked = keyed.join(n, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    tasks = blocked.select("key", "block", "rep", "size", *_SKETCH, other.alias("o")).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "size", *_SKETCH)
    return tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(_blocks(threshold), "a bigint, b bigint")


def similar_classes(classes: DataFrame, threshold: float, recall: float = 0.9999, crowd: int = CROWD, seed: int = 7, plan: list[Round] | None = None) -> DataFrame:
    """(a, b, similarity) of classes of ``set_classes`` with similarity >= threshold, a < b; each pair once.

    A threshold of at most 0 or above 1 is refused; at 1 there are no pairs, as classes differ. ``recall`` is that of a pair at the
    threshold itself; more similar ones are met more surely. No pair is dropped for the size of a neighbourhood. An empty table gives
    no rows. ``plan``: other rounds than those of ``rounds``.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = classes.sparkSession
    if threshold == 1:
        return spark.createDataFrame([], "a bigint, b bigint, similarity double")
    classes = checkpointed(classes)
    at, candidates = classes.select("rep", "size", "set"), None
    for i, r in enumerate(plan or rounds(threshold, recall)):
        hot = {} if r.last else _hot(at.where(F.pmod(F.xxhash64("rep"), F.lit(PROBE)) == 0), r.trees, seed + i, crowd)
        sent = at.mapInArrow(_signatures(r.trees, seed + i, hot), _ROW)
        if r.last:
            met = _unlimited(sent, threshold, r.depth, crowd)
        else:
            met = sent.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(_neighbours(threshold, crowd, r.depth), "a bigint, b bigint")
        met = checkpointed(met.distinct())
        pairs = met.where("b is not null")
        candidates = pairs if candidates is None else candidates.unionByName(pairs)
        if r.last:
            break
        again = met.where("b is null").select("a")
        if again.isEmpty():
            break
        at = classes.join(again, classes.rep == again.a, "left_semi").select("rep", "size", "set")
    sets = classes.select("rep", "set")
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = candidates.distinct().join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    similarity = F.col("n") / (F.size("sa") + F.size("sb") - F.col("n"))
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of classes and the pairs inside a class, written out for every member.

    Its size is that of the result; use ``members`` and ``pairs`` themselves where copies needn't be written out. A class of very
    many copies is written out by as many tasks as it has thousands of members.
    """
    one, two = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    shared = members.groupBy("rep").count().where("count > 1").select("rep", F.ceil(F.col("count") / 1000).cast("int").alias("n"))
    own = members.join(shared, "rep")
    left = own.select(F.col("id").alias("x"), "rep", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("part"))
    right = own.select(F.col("id").alias("y"), "rep", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    inside = left.join(right, ["rep", "part"]).where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_between(left: DataFrame, right: DataFrame, id_col: str, set_col: str, threshold: float, **how) -> DataFrame:
    """(id_a, id_b, similarity) of a record of ``left`` and one of ``right``: one forest over both tables, pairs of one side left out.

    Ids of the two tables are independent of each other; the same id may stand in both, and every 64-bit id is possible. Null ids, null
    and empty sets take no part; of an id delivered with different sets on one side the one with the greatest hash counts.
    """
    tag = lambda df, side: df.select(F.lit(side).alias("side"), F.col(id_col).cast("bigint").alias("id"), F.sort_array(F.array_distinct(F.array_compact(F.col(set_col)))).alias("set"))
    both = tag(left, 0).unionByName(tag(right, 1)).where("id is not null and size(set) > 0")
    marked = both.select("side", "id", "set", F.xxhash64("set").alias("h1"), F.xxhash64(F.reverse("set"), F.size("set")).alias("h2"))
    ids = checkpointed(marked.groupBy("side", "id").agg(F.max(F.struct("h1", "h2")).alias("h")).select("side", "id", "h.h1", "h.h2"))
    sets = marked.groupBy("h1", "h2").agg(F.first("set").alias("set"))
    used = ids.groupBy("h1", "h2").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    classes = checkpointed(used.join(sets, ["h1", "h2"]).select("h1", "h2", "set", (F.col("lo") != F.col("hi")).alias("on_both"), F.monotonically_increasing_id().alias("rep")))
    pairs = checkpointed(similar_classes(classes.select("rep", F.size("set").alias("size"), "set"), threshold, **how))
    same = classes.where("on_both").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(same)
    members = ids.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("side", "id", "rep")
    one = members.where("side = 0").select(F.col("id").alias("id_a"), F.col("rep").alias("a"))
    two = members.where("side = 1").select(F.col("id").alias("id_b"), F.col("rep").alias("b"))
    return links.join(one, "a").join(two, "b").select("id_a", "id_b", "similarity")
