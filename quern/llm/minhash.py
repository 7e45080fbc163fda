"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. ``sketches``: every text's set of word shingles gives a class key (equal sets
   are one class), the set's size, and a SuperMinHash signature: the elements'
   correlated permutation ranks are drawn level by level, all elements of a batch
   at once, and a text stops as soon as no later level can lower a value.
2. ``neighbours``: classes that share a band of four values meet in buckets. A
   bucket's members are compared by whole signatures; those that might reach the
   similarity (six standard deviations of slack) are united, and only the star of
   each union is emitted, never all pairs.
3. ``verified``: the unions are grouped into families; members travel once, with
   their text, to their family, where pairs not yet united are compared on full
   shingle sets.
4. Components of the confirmed links, over the whole table; smallest id is kept.

A bucket or family of more than ``MEET`` members is cut into blocks. Members meet in
their block, and then the smallest of each union of each block meet. Only in groups that
are not one union by then do the members outside the largest union meet all others, in
pairs of blocks. So every pair is compared or united, and tasks stay bounded.

32 bands of 4 values find a pair of similarity 0.8 with probability 1 - 5e-8.

Null text and text without words: an empty set, linked with nothing. Fewer words
than the shingle length: the whole sequence is the only shingle. Rows with a null
id are grouped like others, and the smallest non-null id names the component (null
if there is none). Repeated rows are copies. Empty tables give no rows. Extra
columns are ignored by ``groups``; ``deduplicated`` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import arrow_batches, distinct, give_back, mix, pieces, stored, windows, words
from quern.llm.components import UnionFind, components

VALUES, ROWS = 128, 4
#: Members of a bucket or family that meet in one task (two blocks of half as many).
MEET = 1024
SHINGLE, SIMILARITY = 4, 80

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(texts, fold=True)
    runs = windows(w.hash, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(distinct(runs[a : b - size + 1]))
        else:
            out.append(windows(w.hash[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], m: int = VALUES) -> np.ndarray:
    """Signatures, one row for each set; an empty set has the highest value everywhere."""
    sig = np.full((len(sets), m), _TOP, np.uint64)
    flat = sig.ravel()
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    order = None  # permutations so far, once few elements are left
    for j in range(m):
        if not len(h):
            break
        x = mix(h + np.uint64((j + 1) * int(_GOLD) % 2**64))
        k = (j + (x & np.uint64(0xFFFF)) % np.uint64(m - j)).astype(np.int64)
        if order is None:
            at = k.copy()
            for t in range(len(swaps) - 1, -1, -1):
                at = np.where(at == t, swaps[t], np.where(at == swaps[t], t, at))
            swaps.append(k)
        else:
            rows = np.arange(len(h))
            at = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = at
        np.minimum.at(flat, doc * m + at, (np.uint64(j) << np.uint64(48)) | (x >> np.uint64(16)))
        # a text goes on while a value could still fall at the next level
        going = (sig >= np.uint64(j + 1) << np.uint64(48)).any(axis=1)[doc]
        if not going.all():
            h, doc = h[going], doc[going]
            swaps = [s[going] for s in swaps]
            order = order[going] if order is not None else None
        if order is None and len(swaps) == 5:
            order = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
            rows = np.arange(len(h))
            for t, s in enumerate(swaps):
                other = order[rows, s].copy()
                order[rows, s] = order[:, t]
                order[:, t] = other
            swaps = []
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = sig.shape
    grouped = sig.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * _GOLD, grouped.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ grouped[:, :, r])
    return key


def _class_key(s: np.ndarray) -> bytes:
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _GOLD).sum(dtype=np.uint64)], ">u8").tobytes()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The stored sketch of each row: class key, set size, bands and 8-bit signature (null for an empty set), with a hash of the text."""

    def run(batches):
        for batch, texts in pieces(batches, "text", 1 << 19):
            sets = shingle_sets(texts, size)
            sig = superminhash(sets)
            bands = band_keys(sig).astype(np.int64)
            short = (mix(sig) >> np.uint64(56)).astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_key(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                    pa.array([b.tobytes() if f else None for b, f in zip(bands, full)], pa.binary()),
                    pa.array([b.tobytes() if f else None for b, f in zip(short, full)], pa.binary()),
                    batch.column("text_key"),
                ],
                names=["id", "n_shingles", "key", "bands", "sig", "text_key"],
            )

    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return stored(picked.mapInArrow(run, f"id {kind}, n_shingles bigint, key binary, bands binary, sig binary, text_key bigint"), "sketches")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, node, union, _n members in the group, ...) dealt to blocks of their group, which meet each on its own."""
    blocks = F.when(F.col("_n") > MEET, F.ceil(F.col("_n") / MEET)).otherwise(1).cast("int")
    dealt = rows.withColumn("_lo", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_hi", F.col("_lo"))
    return _sorted(dealt.drop("_n"), key)


def _paired(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group, one of which holds members outside the group's largest union.

    The members of the largest union need not meet each other; the others, which are
    blocks 0 to k - 1, meet all.
    """
    sizes = rows.groupBy(key, "union").agg(F.count(F.lit(1)).alias("_m"))
    main = sizes.groupBy(key).agg(F.max(F.struct("_m", "union")).alias("_main"), F.sum("_m").alias("_all")).select(key, F.col("_main.union").alias("_main"), F.col("_main._m").alias("_most"), "_all")
    blocks = lambda n: F.ceil(n / (MEET // 2)).cast("int")
    joined = rows.drop("_n").join(main, key)
    few, most = blocks(F.col("_all") - F.col("_most")), blocks(F.col("_most"))
    other = F.col("union") != F.col("_main")
    h = F.xxhash64("node")
    at = joined.withColumn("_b", F.when(other, F.pmod(h, few)).otherwise(few + F.pmod(h, most)).cast("int"))
    met = at.withColumn("_j", F.explode(F.sequence(F.lit(0), F.when(other, few + most).otherwise(few) - 1)))
    return _sorted(met.withColumn("_lo", F.least("_b", "_j")).withColumn("_hi", F.greatest("_b", "_j")).drop("_b", "_j", "_main", "_most", "_all"), key)


def _sorted(dealt: DataFrame, key: str) -> DataFrame:
    return dealt.repartition(key, "_lo", "_hi").sortWithinPartitions(key, "_lo", "_hi", "node")


def _united(rows: DataFrame, key: str, large: bool, meet) -> DataFrame:
    """Stars (u, v) of the members (node, key, _n, ...) that ``meet`` links in their groups; ``large``: some group has more than ``MEET``."""
    kind = rows.schema[key].dataType.simpleString()
    alone = rows.withColumn("union", F.col("node"))
    met = lambda dealt: dealt.mapInArrow(meet, f"{key} {kind}, u bigint, v bigint")
    if not large:
        return met(_dealt(alone, key)).select("u", "v").distinct()
    alone = stored(alone, "members")
    first = stored(met(_dealt(alone, key)), "stars")
    # of a member's block: the smallest of its union
    known = alone.where(F.col("_n") > MEET).join(first.select(key, F.col("u").alias("node"), F.col("v").alias("_v")), [key, "node"], "left").withColumn("union", F.coalesce("_v", "node")).drop("_v")
    known = stored(known, "united")
    least = known.where("node = union").drop("_n")
    sizes = least.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    second = stored(met(_dealt(least.join(sizes, key).select(*alone.columns), key)), "stars")
    again = known.join(second.select(key, F.col("u").alias("union"), F.col("v").alias("_v")), [key, "union"], "left").withColumn("union", F.coalesce("_v", "union")).drop("_v")
    apart = stored(again.groupBy(key).agg(F.min("union").alias("_u"), F.max("union").alias("_w")).where("_u <> _w").select(key), "apart")
    stars = first.unionByName(second)
    if apart.take(1):
        stars = stars.unionByName(met(_paired(again.join(apart, key, "left_semi").select(*alone.columns), key)))
    return stars.select("u", "v").distinct()


def _runs(batches, *keys: str):
    """Tables of whole groups from sorted batches, of a few thousand rows at most or one group."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, t]) if held is not None else t
        if held.num_rows < 2000 and held.nbytes < 8 << 20:
            continue
        label = _labels(held, keys)
        cut = int(np.searchsorted(label, label[-1]))
        if cut:
            yield held.slice(0, cut), label[:cut]
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held, _labels(held, keys)
    give_back()


def _labels(t: pa.Table, keys) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for k in (*keys, "_lo", "_hi"):
        c = t.column(k).combine_chunks()
        v = c.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _unite(label: np.ndarray, union: np.ndarray, sig: np.ndarray, least: int, confirm=None) -> UnionFind:
    """Unites rows of one label whose signatures agree in ``least`` places (and that ``confirm``), pair by pair, skipping united pairs."""
    n = len(label)
    sets = UnionFind(n)
    first: dict[tuple, int] = {}
    for x, at in enumerate(zip(label.tolist(), union.tolist())):
        sets.union(first.setdefault(at, x), x)
    root = np.array([sets.find(x) for x in range(n)])
    lag = 1
    while lag < n:
        i = np.flatnonzero(label[lag:] == label[:-lag])
        if not len(i):
            break
        i = i[root[i] != root[i + lag]]
        if len(i):
            changed = False
            for a in range(0, len(i), 20000):
                part = i[a : a + 20000]
                part = part[(sig[part] == sig[part + lag]).sum(axis=1) >= least]
                for x in part.tolist():
                    if sets.find(x) != sets.find(x + lag) and (confirm is None or confirm(x, x + lag)):
                        sets.union(x, x + lag)
                        changed = True
            if changed:
                root = np.array([sets.find(x) for x in range(n)])
        lag += 1
    return sets


def _stars(t: pa.Table, key: str, sets: UnionFind) -> pa.RecordBatch:
    """Each member that is not the first of its union, with that."""
    pairs = [(x, r) for x in range(t.num_rows) if (r := sets.find(x)) != x]
    some, first = (t.take(pa.array([p[k] for p in pairs], pa.int64())) for k in (0, 1))
    columns = [some.column(key), some.column("node"), first.column("node")]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in columns], names=[key, "u", "v"])


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)


def neighbours(classes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Stars (u, v) that unite the classes of a bucket which may reach the similarity."""
    p = similarity / 100
    least = int(VALUES * p - 6 * (VALUES * p * (1 - p)) ** 0.5)

    def explode(batches):
        for batch in batches:
            bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(np.repeat(batch.column("node").to_numpy(), VALUES // ROWS))], names=["band", "node"])

    def meet(batches):
        for t, label in _runs(batches, "band"):
            yield _stars(t, "band", _unite(label, t.column("union").to_numpy(), _signatures(t), least))

    banded = classes.select("node", "bands").mapInArrow(explode, "band bigint, node bigint")
    shared = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared")
    members = banded.join(shared, "band").join(classes.select("node", "sig"), "node")
    return _united(members, "band", bool(shared.where(F.col("_n") > MEET).take(1)), meet)


def verified(docs: DataFrame, families: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Stars (u, v) of confirmed links. families: node, root, key, rep and text_key (id and hash of a text of the class), sig."""
    p = similarity / 100
    least = int(VALUES * p - 6 * (VALUES * p * (1 - p)) ** 0.5)
    counts = families.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    member = families.join(counts, "root").withColumnRenamed("text_key", "_key")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")).where("text is not null")
    rows = texts.join(member, (F.col("text_key") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("rep"))).select("root", "node", "key", "sig", "text", "_n")
    schema = rows.schema

    def once(batches):
        """One of the rows that are equal in id and text: the join leaves them next to each other."""
        last = None
        for batch in batches:
            node = batch.column("node").to_pylist()
            new = [a != b for a, b in zip(node, [last, *node])]
            last = node[-1] if node else last
            yield batch.filter(pa.array(new, pa.bool_()))

    def meet(batches):
        for t, label in _runs(batches, "root"):
            # of copies in several tasks one counts, and of equal hashes the text of the class
            new = (np.diff(t.column("node").to_numpy(), prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0)
            t, label = t.filter(pa.array(new)), label[new]
            sets = []
            for a in range(0, t.num_rows, 256):
                sets += shingle_sets([x.encode() for x in t.column("text").slice(a, 256).to_pylist()], size)
            where = np.flatnonzero([len(s) > 0 and _class_key(s) == x for s, x in zip(sets, t.column("key").to_pylist())])
            sets = [sets[i] for i in where]

            def linked(x: int, y: int) -> bool:
                a, b = sets[x], sets[y]
                if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    return False
                both = len(np.intersect1d(a, b, assume_unique=True))
                return 100 * both >= similarity * (len(a) + len(b) - both)

            t = t.take(pa.array(where))
            yield _stars(t, "root", _unite(label[where], t.column("union").to_numpy(), _signatures(t), least, linked))

    return _united(rows.mapInArrow(once, schema), "root", bool(counts.where(F.col("_n") > MEET).take(1)), meet)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """Per row: id, n_shingles, class key, component_id (smallest id reachable) and kept; root, the component's own key, and a hash of the text."""
    rows = sketches(docs, id_col, text_col, size)
    least_row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("_least")
    named = rows.where("key is not null").groupBy("key").agg(least_row, F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # the number of a class is fixed when the table is stored
    classes = stored(named.select(F.monotonically_increasing_id().alias("node"), "key", F.col("_least.id").alias("rep"), "_least.text_key", "bands", "sig"), "classes")
    near = stored(neighbours(classes, similarity), "near")
    families = components(near).join(classes.select("node", "key", "rep", "text_key", "sig"), "node")
    links = stored(verified(docs, families, id_col, text_col, size, similarity), "links")
    joined = components(links).join(classes.select("node", "rep"), "node")
    least = joined.groupBy("root").agg(F.min("rep").alias("_least"))
    named = classes.select("node", "key", "rep").join(joined.select("node", "root"), "node", "left").join(least, "root", "left").select("node", "key", F.coalesce("_least", "rep").alias("_component"), F.coalesce("root", "node").alias("root"))
    out = rows.drop("bands", "sig").join(named, "key", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("_component"))
    return out.select("id", "n_shingles", "node", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "root", "text_key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and of rows equal in id and text one.

    Rows go by id and text, so other texts of an id that goes, or of no id, stay.
    """
    found = groups(docs, id_col, text_col, size, similarity)
    dropped = found.where(~F.col("kept")).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    again = bool(found.groupBy("id").count().where("count > 1").take(1))
    if again:  # several texts may bear the id of their group: one of them stays
        named = found.where("kept and node is not null")
        first = named.groupBy("root").agg(F.min("text_key").alias("_first"))
        dropped = dropped.unionByName(named.join(first, "root").where("text_key <> _first").select(F.col("id").alias("_id"), F.col("text_key").alias("_key")))
    dropped = dropped.distinct()
    stay = docs.join(dropped, docs[id_col].eqNullSafe(dropped["_id"]) & (F.xxhash64(docs[text_col]) == dropped["_key"]), "left_anti")
    return stay.dropDuplicates([id_col, text_col]) if again else stay
