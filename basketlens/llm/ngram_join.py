"""Self-join of documents on the Jaccard similarity of their shingle sets, exactly.

Method: pigeonhole over a partition of the universe. Sets with similarity t and sizes r, s differ
in at most d = (1-t)/(1+t) (r+s) shingles. Sizes fall in bands a factor 1/t apart, so partners are
in the same or the next band; a label L joins bands L-1 and L. Under a label the universe of
hashes is cut into segments. A segment of value 1 is indexed by its subset, one of value 2 by its
subset and all subsets with one shingle deleted, which agree as long as at most one shingle
differs. If the values add up to d + 1 + e, similar sets agree on segments worth 1 + e. So a set
needs its first d + 1 subsets only, in an order that all sets share: large subsets first, so the e
weakest (empty ones, single shingles of common passages) are left out and nothing is lost. How
many segments there are of each value and how large e is follows from a cost model of signatures
and chance agreements, fed with the number of sets per band.

Sets with equal shingles are one class from the start. In a group that shares a signature every
member is first paired with the group's smallest one, and the links found make components. Only
pairs that lie in different components are then compared, in tasks of two blocks of members each,
by parity sketches of the sets, which can rule a link out but never lose one. Of what they leave,
the closest pairs that could join components are verified on the full sets first, and all pairs
that are still open last. Copies collapse in the first steps, strangers that share a long passage
fail without their pairs ever becoming rows; no pair is dropped.

Defined results: null or empty texts and texts without words have no shingles and link with
nothing; fewer words than a shingle make one shingle of the whole text; similarity equal to the
threshold links; repeated rows get equal results; rows without an id link with nothing and have no
component; other columns are dropped. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ready, stored, texts_of, tidied, width
from .components import components
from .lm_scoring import pack_keys, squeeze, unpack_keys, widen
from .shingles import GAP, Hasher, mix, node_of

SIZE = 5
PERCENT = 80  # similarity 0.8
BLOCK_SHINGLES = 600_000
SHARD_ENTRIES = 1 << 20
SMALL_SIDE = 1_000_000  # ids up to which those asked for are broadcast to the texts; more are joined by a shuffle
GROUP_BLOCK = 512  # members of a group that one task compares with as many others

DOC_DDL = "doc_id bigint, t bigint, n_shingles bigint, node bigint, sketch binary"  # t: hash of the text
ENTRY_DDL = "shard int, keys binary, nodes binary, at binary"
GROUP_DDL = "kind int, g bigint, a bigint, b bigint"
PAIR_DDL = "a bigint, b bigint"


@dataclass
class Label:
    """Allocation for one label: ``doubles`` segments of value 2, then ``singles`` of value 1, of
    which ``spare`` may be left out."""

    low: int
    high: int
    doubles: int
    singles: int
    spare: int

    @property
    def segments(self) -> int:
        return self.doubles + self.singles


def edges(largest: int, percent: int = PERCENT) -> list[int]:
    found = [1]
    while found[-1] <= largest:
        found.append(max(found[-1] + 1, -(-found[-1] * 100 // percent)))
    return [*found, max(found[-1] + 1, -(-found[-1] * 100 // percent))]


def differ(total: int, percent: int = PERCENT) -> int:
    """Most shingles by which two sets of ``total`` shingles together may differ."""
    return total * (100 - percent) // (100 + percent)


def allocate(low: int, high: int, sets: int, percent: int = PERCENT) -> Label:
    """Cheapest allocation for sets of low..high shingles: signatures per set, plus what chance
    agreements on weak subsets (at most one shingle left) cost, which grows with the number of sets."""
    need = differ(2 * high, percent) + 1
    size = (low + high) / 2
    best = None
    for doubles in range(need // 2 + 1 if need <= 4 else 1):
        for share in (0, 0.1, 0.2, 0.3):
            spare = math.ceil(share * need)
            singles = need - 2 * doubles + spare
            if doubles + singles == 0 or spare >= singles > 0:
                continue
            mean = size / (doubles + singles)
            weak = lambda k: math.exp(-mean) * sum(mean ** i / math.factorial(i) for i in range(k + 1))
            signatures = singles - spare + doubles * (1 + mean)
            chance = max(0.0, singles * weak(1) - spare) + doubles * weak(2)
            cost = signatures + chance * min(1000.0, sets / 20)
            if best is None or cost < best[0]:
                best = (cost, Label(low, high, doubles, singles, spare))
    return best[1]


def labels_for(histogram: dict[int, int], bounds: list[int], percent: int = PERCENT) -> list[Label]:
    """One label per band and one beyond."""
    return [allocate(bounds[max(0, k - 1)], bounds[k + 1] - 1, histogram.get(k - 1, 0) + histogram.get(k, 0), percent)
            for k in range(len(bounds) - 1)]


def partner_limit(size: int, label: Label, percent: int = PERCENT) -> int:
    return min(size * 100 // percent, label.high)


def subset_keys(sets: list[np.ndarray], which: list[int], labels: list[Label]) -> tuple[np.ndarray, ...]:
    """(owner, segment, size, key) of every segment's subset, set by set."""
    counts = np.array([labels[k].segments for k in which], dtype=np.int64)
    base = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    segment = ((tokens * GAP) >> np.uint64(33)).astype(np.int64) % counts[owner]
    place = base[owner] + segment
    size = np.bincount(place, minlength=int(counts.sum()))
    # Subsets are named by the sum of their shingles' mixed hashes, which wraps around.
    order = np.argsort(place, kind="stable")
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens[order]), dtype=np.uint64)])
    ends = np.cumsum(size)
    total = running[ends] - running[ends - size]
    whose = np.repeat(np.arange(len(sets)), counts)
    number = np.arange(len(whose)) - np.repeat(base, counts)
    tag = np.repeat(np.array(which, dtype=np.uint64), counts) * np.uint64(1 << 32) + number.astype(np.uint64)
    return whose, number, size, mix(total + mix(tag * GAP))


def signatures(sets: list[np.ndarray], bands: list[int], labels: list[Label], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of all signatures of the sets, under the label of their band and the next."""
    owners, keys = [], []
    for step in (0, 1):
        who = [i for i, b in enumerate(bands) if labels[b + step].segments and differ(2 * labels[b + step].high, percent) > 0]
        if not who:
            continue
        which = [bands[i] + step for i in who]
        own = [sets[i] for i in who]
        whose, number, size, key = subset_keys(own, which, labels)
        doubles = np.array([labels[k].doubles for k in which])[whose]
        ids = np.array(who)
        single = number >= doubles
        order = np.lexsort((key[single], -size[single], whose[single]))
        w = whose[single][order]
        first = np.searchsorted(w, np.arange(len(who)))
        rank = np.arange(len(w)) - first[w]
        # d + 1, less what the segments of value 2 are worth.
        keep = np.array([max(0, differ(len(s) + partner_limit(len(s), labels[k], percent), percent) + 1 - 2 * labels[k].doubles) for s, k in zip(own, which)])
        kept = rank < keep[w]
        owners.append(ids[w[kept]])
        keys.append(key[single][order][kept])
        for j in np.nonzero([labels[k].doubles > 0 for k in which])[0]:
            label, tokens = labels[which[j]], own[j]
            segment = ((tokens * GAP) >> np.uint64(33)).astype(np.int64) % label.segments
            for n in range(label.doubles):
                part = mix(tokens[segment == n])
                total = part.sum(dtype=np.uint64)
                tag = mix(np.array([which[j] * (1 << 32) + n], dtype=np.uint64) * GAP)[0]
                names = mix(np.concatenate([np.array([total], dtype=np.uint64), total - part]) + tag)
                owners.append(np.full(len(names), ids[j]))
                keys.append(names)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles' hashes in 2n to 4n bits (64 at least). Two sketches differ in no
    more bits than the sets differ in shingles, also after folding the longer one."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    place = (shingles >> np.uint64(20)) & np.uint64(bits - 1)
    odd = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches side by side, folded to the shortest."""
    words = [np.frombuffer(x, dtype=np.uint64) for x in sketches]
    least = min(map(len, words))
    return np.stack([np.bitwise_xor.reduce(w.reshape(-1, least), axis=0) for w in words])


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Matrix of pairs that the sketches and sizes do not rule out."""
    return distances(a, na, b, nb)[1]


def distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the bits that differ, and of pairs that may link."""
    apart = np.zeros((len(a), len(b)), dtype=np.uint16 if a.shape[1] < 1000 else np.uint32)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    total = na[:, None] + nb[None, :]
    return apart, (apart <= total * (100 - PERCENT) // (100 + PERCENT)) & (np.minimum(na[:, None], nb[None, :]) * 100 >= PERCENT * np.maximum(na[:, None], nb[None, :]))


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(SIZE)
    for batch in batches:
        sets = hasher.sets(texts_of(batch.column("text")))
        cols = [batch.column("doc_id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t", "n_shingles", "node", "sketch"])


def emit(labels: list[Label], bounds: list[int], bits: int):
    cuts = np.array(bounds)

    def block(sets: dict[int, np.ndarray]) -> pa.RecordBatch | None:
        nodes = np.array(list(sets), dtype=np.int64)
        own = list(sets.values())
        bands = (np.searchsorted(cuts, [len(s) for s in own], side="right") - 1).tolist()
        owner, key = signatures(own, bands, labels)
        if not len(key):
            return None
        order = np.argsort(key, kind="stable")
        owner, key = owner[order].astype(np.uint32), key[order]
        at = np.searchsorted(key, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
        parts = [(i, pack_keys(k), nodes.tobytes(), squeeze(o)) for i, (k, o) in enumerate(zip(np.split(key, at), np.split(owner, at))) if len(k)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "keys", "nodes", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sets, size = Hasher(SIZE), {}, 0
        for batch in batches:
            for shingles in map(hasher.of, texts_of(batch.column("text"))):
                if len(shingles) and (node := node_of(shingles)) not in sets:
                    sets[node] = shingles
                    size += len(shingles)
                if size >= BLOCK_SHINGLES:
                    if (out := block(sets)) is not None:
                        yield out
                    sets, size = {}, 0
        if sets and (out := block(sets)) is not None:
            yield out
    return run


def group(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups of a shard: pairs (kind 0: smallest member a, other member b) and, of groups with more
    than two members, the members (kind 1: group g, member b). Equal groups are one."""
    keys, nodes = [], []
    for k, n, at in zip(rows["keys"], rows["nodes"], rows["at"]):
        keys.append(unpack_keys(k))
        nodes.append(np.frombuffer(n, dtype=np.int64)[widen(at, np.uint32)])
    key, node = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    return grouped(key, node)


def grouped(key: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.nonzero(first)[0]
    size = np.diff(np.append(start, len(key)))
    many = np.repeat(size > 1, size)
    key, node = key[many], node[many]
    size = size[size > 1]
    start = np.cumsum(size) - size
    if not len(size):
        return pd.DataFrame({"kind": [], "g": [], "a": [], "b": []}).astype({"kind": "int32", "g": "int64", "a": "int64", "b": "int64"})
    name = np.add.reduceat(mix(node.view(np.uint64) + GAP), start)  # of the set of members
    _, once = np.unique(name, return_index=True)
    chosen = np.zeros(len(size), dtype=bool)
    chosen[once] = True
    inside = np.repeat(chosen, size)
    head, member = np.repeat(node[start], size)[inside], node[inside]
    g, wide = np.repeat(name, size)[inside].view(np.int64), np.repeat(size, size)[inside] > 2
    pairs = np.unique(np.stack([head, member], axis=1)[head != member], axis=0)
    out = np.concatenate([np.column_stack([np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), pairs]),
                          np.column_stack([np.ones(int(wide.sum()), np.int64), g[wide], g[wide], member[wide]])])
    return pd.DataFrame(out, columns=["kind", "g", "a", "b"]).astype({"kind": "int32"})


def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the classes asked for, once per task; another text under the same id is left out."""
    hasher, done = Hasher(SIZE), set()
    for batch in batches:
        nodes, sets = [], []
        for node, text in zip(batch.column("node").to_pylist(), texts_of(batch.column("text"))):
            shingles = hasher.of(text)
            if node not in done and len(shingles) and node_of(shingles) == node:
                done.add(node)
                nodes.append(node)
                sets.append(shingles.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
        good = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p.as_buffer(), dtype=np.uint64), np.frombuffer(q.as_buffer(), dtype=np.uint64)
            found = np.searchsorted(p, q)
            found[found == len(p)] = 0
            same = int((p[found] == q).sum()) if len(p) else 0
            good.append(same * 100 >= PERCENT * (len(p) + len(q) - same))
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough."""
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node").select("node", "rep"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL_SIDE else wanted
    sets = stored(rows.join(wanted, rows["doc_id"] == wanted["rep"]).select("node", "text").mapInArrow(tidied(to_sets), "node bigint, shingles binary"), "sets")
    named = lambda key, value: sets.select(F.col("node").alias(key), F.col("shingles").alias(value))
    return stored(pairs.join(named("b", "y"), "b").join(named("a", "x"), "a").mapInArrow(tidied(verify), PAIR_DDL), "similar")


def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule the link out."""
    for batch in batches:
        good = []
        for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "x", "y"))):
            both = folded([x, y])
            good.append(bool(may_link(both[:1], np.array([na]), both[1:], np.array([nb]))[0, 0]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    named = lambda key, size, value: classes.select(F.col("node").alias(key), F.col("n").alias(size), F.col("sketch").alias(value))
    return pairs.join(named("b", "nb", "y"), "b").join(named("a", "na", "x"), "a").mapInArrow(tidied(promising), PAIR_DDL)


def open_members(members: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (g, b) of groups that hold more than one component: component c, group size m, and
    size and sketch of the set."""
    known = members.join(comp, members["b"] == comp["node"], "left").select("g", "b", F.coalesce("component", "b").alias("c"))
    state = known.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).filter("low < high").select("g", "m")
    own = classes.select(F.col("node").alias("b"), "n", "sketch")
    return known.join(state, "g").join(own, "b")


def dealt(members: DataFrame, parts: int) -> DataFrame:
    """Members with the tasks that compare them: small groups many to a task, a large group cut into
    blocks, each pair of which is a task (side 0 against side 1; a block with itself has side 0)."""
    blocks = F.ceil(F.col("m") / GROUP_BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("b"), blocks).cast("int")
    pair = lambda j: F.struct(F.concat_ws(":", F.col("g").cast("string"), F.least(mine, j).cast("string"), F.greatest(mine, j).cast("string")).alias("task"),
                              F.when(j < mine, 1).otherwise(0).alias("side"))
    few = F.array(F.struct(F.concat(F.lit("s"), F.pmod(F.xxhash64("g"), F.lit(parts)).cast("string")).alias("task"), F.lit(0).alias("side")))
    return members.withColumn("t", F.explode(F.when(blocks > 1, F.transform(F.sequence(F.lit(0), blocks - 1), pair)).otherwise(few))).select("t.*", "g", "b", "c", "n", "sketch")


def forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of components join trees that no closer pair has joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    taken = np.zeros(len(a), dtype=bool)
    open_ = len(np.unique(np.concatenate([a, b]))) - 1
    for i in np.argsort(apart, kind="stable").tolist():
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[x] = y
            taken[i] = True
            open_ -= 1
            if not open_:
                break
    return taken


def compare(every: bool):
    """Pairs of different components in one group that sketches do not rule out: all, or only the
    closest that would make one component of those that they connect."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g", kind="stable")
        task = rows["task"].iloc[0]
        two_blocks = not task.startswith("s") and task.split(":")[1] != task.split(":")[2]
        g = rows["g"].to_numpy()
        starts = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0]
        node, c, n, side = (rows[x].to_numpy() for x in ("b", "c", "n", "side"))
        data, out = rows["sketch"].tolist(), []
        for low, high in zip(starts, np.append(starts[1:], len(g))):
            words = folded(data[low:high])
            left = np.nonzero(side[low:high] == 0)[0]
            right = np.nonzero(side[low:high] == 1)[0] if two_blocks else left
            if not len(left) or not len(right):
                continue
            own_c, own_n, own = c[low:high], n[low:high], node[low:high]
            apart, may = distances(words[left], own_n[left], words[right], own_n[right])
            a, b = np.nonzero(may & (own_c[left][:, None] != own_c[right][None, :]))
            if not len(a):
                continue
            if not every:
                taken = forest(own_c[left[a]], own_c[right[b]], apart[a, b])
                a, b = a[taken], b[taken]
            a, b = own[left[a]], own[right[b]]
            out.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])
    return run


def linked(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row per document: ``doc_id, t, n_shingles, component_id``, and the component's own name ``c``,
    null without shingles or id."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    told = stored(rows.withColumn("t", F.xxhash64("text")).mapInArrow(tidied(describe), DOC_DDL), "shingle-counts")
    classes = stored(told.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")), "shingle-classes")
    largest, total = classes.agg(F.coalesce(F.max("n"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bounds = edges(largest)
    band = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("n"))) - 1
    labels = labels_for({r["band"]: r["k"] for r in classes.groupBy(band.alias("band")).agg(F.count("*").alias("k")).collect()}, bounds)
    bits = max(0, math.ceil(math.log2(max(1, total // 2) / SHARD_ENTRIES)))
    entries = rows.filter("doc_id IS NOT NULL").select("text").mapInArrow(tidied(emit(labels, bounds, bits)), ENTRY_DDL)
    found = stored(entries.groupBy("shard").applyInPandas(group, GROUP_DDL), "shingle-groups")

    first = stored(sketched(found.filter("kind = 0").select("a", "b").distinct(), classes), "pairs")
    links = verified(first, classes, rows)
    comp = components(links)
    members = found.filter("kind = 1").select("g", "b").distinct()
    # Twice the closest pairs that could join components, then whatever is still open.
    checked = first
    for every in (False, False, True):
        rest = dealt(open_members(members, comp, classes), 4 * width(docs.sparkSession))
        more = rest.groupBy("task").applyInPandas(compare(every), PAIR_DDL).distinct()
        more = stored(more.join(checked, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            checked = checked.union(more)
            links = links.union(verified(more, classes, rows))
            comp = components(links)
    # Components are named by their smallest class; documents want the smallest id.
    named = classes.join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("least"))
    final = named.join(least, "c").select("node", "least", "c")
    whole = told.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("node"))).drop("node").join(final, F.col("key") == F.col("node"), "left")
    return whole.select("doc_id", "t", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "c")


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``doc_id, n_shingles, component_id``."""
    return linked(docs, id_col, text).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its columns: of its smallest id, one text (by hash), and of rows
    that repeat both the first by a hash of the row. Texts without shingles are a group per id and
    text; rows without an id are all kept."""
    mine = linked(docs, id_col, text).filter("doc_id = component_id").groupBy("doc_id", "c", "t").agg(F.count("*").alias("n"))
    one = mine.filter("c IS NOT NULL").groupBy("doc_id", "c").agg(F.min(F.struct("t", "n")).alias("x")).select("doc_id", "x.t", "x.n")
    keep = stored(one.union(mine.filter("c IS NULL").select("doc_id", "t", "n")).toDF("_kept_id", "_kept_text", "_kept_rows"), "kept")
    place = docs[id_col].cast("bigint")
    found = docs.withColumn("_row_text", F.xxhash64(docs[text].cast("string"))).join(keep, (place == keep["_kept_id"]) & (F.col("_row_text") == keep["_kept_text"]))
    once = found.filter("_kept_rows = 1").select(*docs.columns)
    row = F.struct(*docs.columns)
    # Copies are reduced before the shuffle, so thousands of one row are one row per task.
    repeated = found.filter("_kept_rows > 1").groupBy("_kept_id", "_kept_text").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_row")).select("_row.*")
    return once.union(repeated).union(docs.filter(place.isNull()))
