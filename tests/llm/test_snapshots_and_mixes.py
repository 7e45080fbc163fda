"""Snapshot difference, importance resampling and mixing against plain restatements."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import zip_longest

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import importance, mixing, queries, snapshot_diff

COLUMNS = ["text", "lang", "source"]


def first(x):
    """Nulls before all others."""
    return (x is not None, x if x is not None else 0)


def digest(v):
    return (v is not None, b"" if v is None else v.encode() if len(v.encode()) < 32 else hashlib.sha256(v.encode()).digest())


def plain_diff(old, new):
    by_key = defaultdict(lambda: ([], []))
    for side, rows in enumerate((old, new)):
        for r in rows:
            by_key[r[0]][side].append(r)
    out, left = [], ([], [])
    row = lambda r: tuple(digest(v) for v in r[1:])
    whole = lambda r: hashlib.sha256("\n".join("~" if v is None else v for v in r[1:]).encode()).hexdigest()
    changed = lambda a, b: ",".join(c for c, x, y in zip(COLUMNS, a[1:], b[1:]) if x != y)
    for olds, news in by_key.values():
        for a, b in zip_longest(sorted(olds, key=row), sorted(news, key=row)):
            if a and b:
                out.append((b[0], a[0], "update" if changed(a, b) else "same", changed(a, b), whole(b)))
            else:
                left[b is not None].append(a or b)
    by_text = defaultdict(lambda: ([], []))
    for side, rows in enumerate(left):
        for r in rows:
            by_text[r[1]][side].append(r)
    for olds, news in by_text.values():
        order = lambda r: (first(r[0]), row(r))
        for a, b in zip_longest(sorted(olds, key=order), sorted(news, key=order)):
            if a and b:
                out.append((b[0], a[0], "rekey", changed(a, b), whole(b)))
            elif a:
                out.append((a[0], a[0], "delete", "", None))
            else:
                out.append((b[0], None, "insert", "", whole(b)))
    return Counter(out)


def got_diff(spark, old, new, extra=False):
    schema = "doc_id bigint, text string, lang string, source string"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    if extra:
        for c in ("side", "key", "values", "tie", "sha", "group"):
            a, b = a.withColumn(c, F.lit(1)), b.withColumn(c, F.lit("x"))
    out = snapshot_diff.compare(a, b, "doc_id", COLUMNS, "text")
    return Counter(tuple(r) for r in out.select("key", "old_key", "op", "changed", "row_sha256").collect())


def rows_of(seed, n):
    r = random.Random(seed)
    long = "x" * 5000
    return [(r.choice([None, r.randrange(-40, 40), r.randrange(10**6)]), r.choice([None, "", "a", "b", long, f"t{r.randrange(30)}"]), r.choice([None, "en", "fr"]), r.choice([None, "s", "~"])) for _ in range(n)]


@pytest.mark.parametrize("looks, held", [(4096, 4096), (4096, 2), (48, 2), (48, 4096)])
def test_diff(spark, monkeypatch, looks, held):
    """Nulls, repeated keys and rows, empty and long texts; with bounds so small that groups are dealt in pieces and by place."""
    monkeypatch.setattr(snapshot_diff, "LOOKS", looks)
    monkeypatch.setattr(snapshot_diff, "PIECE", 2)
    monkeypatch.setattr(snapshot_diff, "HELD", held)
    old, new = rows_of(1, 300), rows_of(2, 320)
    new += old[:100]
    assert got_diff(spark, old, new) == plain_diff(old, new)


def test_diff_of_empty_tables_and_clashing_names(spark):
    rows = rows_of(3, 20)
    assert got_diff(spark, [], []) == Counter()
    assert got_diff(spark, rows, [], extra=True) == plain_diff(rows, [])
    assert got_diff(spark, [], rows) == plain_diff([], rows)
    same = got_diff(spark, rows, rows, extra=True)
    assert {k[2] for k in same} == {"same"} and sum(same.values()) == 20


def test_diff_large_group_is_dealt_out(spark, monkeypatch):
    """A content with most rows goes to many partitions, and no task holds more than its pieces."""
    monkeypatch.setattr(snapshot_diff, "LOOKS", 256)
    rows = [(i, "hot", "en", "s") for i in range(2000)]
    old = snapshot_diff.facts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 0, "doc_id", COLUMNS)
    fixed = snapshot_diff.stored(old.withColumn("tie", F.monotonically_increasing_id()), "test")
    large = snapshot_diff._large(fixed, lambda r: (snapshot_diff._bytes(r[2][0]), (snapshot_diff._number(r[1]),)))
    ends = large[b"\x01hot"]
    assert len(ends) > 10 and ends == sorted(ends)
    assert snapshot_diff._large(fixed, lambda r: (snapshot_diff._number(r[1]), ())) == {}


def test_later_snapshot(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", "source").limit(100)
    old = [tuple(r) for r in docs.collect()]
    new = []
    for i, text, lang, source in old:
        r = zlib.crc32(str(i).encode()) % 16
        if r == 1:
            text = (text or "") + "+"
        if r == 2:
            lang, source = source, lang
        if r == 4:
            source = None
        new += [] if r == 0 else [(-1 - i, text, lang, source)] if r in (3, 4) else [(i, text, lang, source), (-1 - i, text, lang, source)] if r == 5 else [(i, text, lang, source)]
    assert Counter(tuple(r) for r in queries.later_snapshot(spark.createDataFrame(old, docs.schema)).collect()) == Counter(new)


def plain_resample(docs, target, size, percent=10, least=20):
    def grams(t):
        w = brute.ALNUM.findall((t or "").translate(brute.LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, size + 1) for i in range(len(w) - k + 1)]

    s = Counter(b for _, t in docs for b in grams(t)[1])
    t = Counter(b for x in target for b in grams(x)[1])
    s_all, t_all = s.total() + 10_000, t.total() + 10_000
    out = []
    for i, text in docs:
        n, g = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in g)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], first(r[0])))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("size", [1, 3])
def test_resample(spark, size):
    r = random.Random(5)
    vocabulary = ["Ab", "é", "ÀB", "x9", "the", "of", "日本", "z-z", "I'm"] + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randrange(0, 60))) for i in range(120)] + [(None, text(30)), (500, None), (501, ""), (502, "..."), (503, text(40_000)), (7, text(25)), (7, text(25))]
    docs += [(600, docs[3][1]), (600, docs[3][1])]
    target = [text(50), None, "", "x9 x9 the"]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"buckets": F.lit(1), "rank": F.lit(2), "id": F.lit(3), "w": F.lit(4)})
    b = spark.createDataFrame([(t,) for t in target], "text string").withColumn("b", F.lit(0))
    got = importance.resample(a, b, size=size)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain_resample(docs, target, size)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert importance.resample(none, some).count() == 0
    assert importance.resample(some, none).first()["rank"] is None  # a tenth of one document


def test_resample_plan(spark, tiny):
    """Scoring explodes nothing and exchanges nothing; the gains are one literal."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    df = importance.scored(importance.features(docs, "doc_id", "text", 1), [1] * importance.BUCKETS, "2024")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "split(1" not in plan and "element_at([1,1," in plan


def plain_seats(votes, most, seats):
    out, heap = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if most[i]]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        out[i] += 1
        seats -= 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-(votes[i] / (2 * out[i] + 1)), i))
    return out


def test_highest_quotients(spark):
    r = random.Random(9)
    for case in range(60):
        n = r.randrange(1, 12)
        votes = [float(r.choice([0, 1, 7, 7, 100, r.randrange(1000)])) for _ in range(n)]
        most = [r.choice([0, 1, 5, 1000]) if v else 0 for v in votes]
        seats = r.randrange(0, 60)
        want = plain_seats(votes, most, seats)
        assert mixing.highest(np.array(votes), np.array(most), seats).tolist() == want, (votes, most, seats)
        if case < 6:
            total = round(sum(votes))
            rows = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(votes, most))], "place long, target double, most_blocks long")
            got = {x.place: x.quota for x in mixing.quotas(rows, 1).collect()}
            assert [got[i] for i in range(n)] == plain_seats(votes, most, total)


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values()) * 1.5
    while True:
        rest = total - sum(2 * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in names if s not in stopped)
        out = {s: 2.0 * sizes[s] if s in stopped else rest * weight[s] / open_ for s in names}
        over = {s for s in names if s not in stopped and out[s] > 2 * sizes[s]}
        if not over:
            return out
        stopped |= over


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(11)
    docs = [(i, "w " * r.choice([0, 1, 30, 200, r.randrange(90)]), r.choice(["a", "hot", "hot", "é", "z", None, "B"])) for i in range(1500)]
    docs += [(1501, None, "only-null"), (None, "one two", "a"), (None, "one two", "a"), (1502, "x " * 30_000, "hot"), (3, docs[3][1], docs[3][2]), (1503, "three", "tiny")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({"size": F.lit("x"), "place": F.lit(1), "shard": F.lit(2), "h": F.lit(3)})
    return docs, frame, mixing.mix(frame).collect()


def test_mix(mixed):
    docs, frame, got = mixed
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in docs)
    sizes, source = Counter(), {}
    for i, t, s in docs:
        sizes[s] += len((t or "").split())
        source[i] = s
    want = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[source[r.doc_id]]
        assert math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-12)
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(8, 0.01 * t), (s, taken[s], t)


def test_mix_again(spark, mixed):
    """Another partitioning gives the same rows; another seed doesn't."""
    docs, frame, got = mixed
    as_counter = lambda rows: Counter((r.doc_id, r["size"], r.taken) for r in rows)
    assert as_counter(mixing.mix(frame.repartition(7)).collect()) == as_counter(got)
    assert as_counter(mixing.mix(frame, seed="5").collect()) != as_counter(got)


def test_mix_blocks_are_even(spark, monkeypatch):
    """Shards of a source take the same share, and each block at most twice: against a plain walk over every word."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 40)
    docs = spark.createDataFrame([(i, "w " * (i % 17), "ab"[i % 3 % 2]) for i in range(300)], "doc_id bigint, text string, source string")
    got = mixing.mix(docs, block=5).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        x = by[r.source_size]
        x[0] += r.taken
        x[1] = r.target
    for n, t, _ in by.values():
        assert abs(n - t) <= 0.03 * t


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).collect() == []
    zero = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id bigint, text string, source string")).collect()
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in zero} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
