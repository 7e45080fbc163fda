import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, common, components, decontam, html_text, langid, lm, minhash, packing, quality, queries, sharding, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
random.seed(11)
VOCABULARY = ["the", "of", "and"] * 60 + ["".join(random.choice("abcdefgéß") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, step, mark):
    w = text.split()
    w[step::150] = [mark] * len(w[step::150])
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    """Near and exact copies, shared passages, edge cases."""
    passage, base = prose(60, 1), prose(400, 2)
    texts = [base, base, base.upper(), edited(base, 7, "x1"), edited(base, 31, "x2"), prose(300, 3) + " " + passage, passage + "\n" + prose(200, 4), prose(50, 5) + "\t" + passage + "\x0b" + prose(9, 6)]
    texts += [None, "", " \n\t ", "one", "one two three", "One two three", "a b c d", "ha " * 300, prose(35, 7), prose(35, 7), prose(34, 8), prose(34, 8)]
    texts += [prose(n, 100 + n) for n in (49, 50, 51, 120, 700)] + ["# " * 80 + prose(60, 9), (prose(12, 10) + "\n") * 9, prose(30000, 12), "﻿😀 é́ " + prose(70, 13)]
    return [(i, t, ("en", "fr", None)[i % 3], "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_agree_with_pattern(rows):
    texts = [t for _, t, *_ in rows] + ["x" * 3_000_000 + " y", " ".join(["ab"] * 700_000)]
    for sep, fold, find in ((common.SPACE, True, brute.WORD), (common.NON_ALNUM, True, brute.ALNUM)):
        w = common.words([t.encode() if t is not None else None for t in texts], sep, fold)
        data = w.data.tobytes()
        for k, t in enumerate(texts):
            want = [x.encode() for x in find.findall((t or "").translate(brute.LOW))]
            got = [data[w.start[i] : w.end[i]] for i in range(w.first[k], w.first[k + 1])]
            assert got == want
    assert len(set(common.words([b"ab ba a b abab"]).hash.tolist())) == 5


def test_windows_depend_on_content_only():
    a = common.words([b"p q a b c d e f z", b"a b c d e f"])
    for size in (3, 6):
        h = common.windows(a.hash, size)
        assert h[2] == h[9] and len(set(h.tolist())) >= 5


def test_quality(spark, docs, rows, none):
    got = by_id(quality.apply_rules(docs))
    for i, t, *_ in rows:
        n, chars, symbols, dup, rep, failed = brute.quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, rep, failed)
        assert not (r.base_failed and r.kept)
    assert got[25].kept is False and got[24].kept is True
    assert quality.apply_rules(none).count() == 0
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("extra", F.lit(None).cast("string"))
    assert by_id(quality.apply_rules(clash))[24].n_words == 700
    odd = docs.withColumns({c: F.lit("mine") for c in ("_t", "_W", "_n", "fails")})
    assert by_id(quality.apply_rules(odd))[24][:] and by_id(quality.apply_rules(odd))[24]["_t"] == "mine"


def test_quality_plan_is_native(docs):
    plan = quality.apply_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_judges_labels(spark, tiny):
    got = quality.apply_rules(spark.read.parquet(f"{tiny}/documents.parquet")).join(spark.read.parquet(f"{tiny}/labels.parquet"), "doc_id")
    bad = got.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] or 0
    good = got.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert bad <= 0.05 and good >= 0.98


def test_language(spark, tiny):
    out = queries.op2_language_id(spark, tiny).join(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark, docs, none, rows):
    model = langid.train(docs)
    assert model.languages == ["en", "fr"]
    got = by_id(langid.predict(docs.withColumn("score", F.lit("x")).withColumn("_text", F.lit(1)), model))
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {8, 9, 10}
    assert langid.predict(none, model).count() == 0
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def plain_buckets(text):
    """Bucket counts of the n-grams of a text, one by one."""
    low, count = text.lower(), Counter()
    for n in langid.ORDERS:
        for k in range(len(low) - n + 1):
            x = 0
            for j, c in enumerate(low[k : k + n]):
                x = (x * 0x100000001B3 + ord(c) + j + 1) % 2**64
            count[(x * 0x9E3779B97F4A7C15) % 2**64 >> 50] += 1
    return count


@pytest.mark.parametrize("chars", [5, 64, 1 << 18])
def test_language_equals_plain_naive_bayes(spark, chars):
    long, langid.CHARS = langid.CHARS, chars
    try:
        texts = [(prose(90, 50 + k) + " ÄÉİ" * (k % 3), ("en", "fr", "de")[k % 3]) for k in range(12)] + [("a", "en"), ("ß", "de"), (prose(9, 80), None)]
        model = langid.train(spark.createDataFrame(texts, "text string, lang string"))
        counts, docs = {k: Counter() for k in ("de", "en", "fr")}, Counter(k for _, k in texts if k)
        for t, k in texts:
            if k:
                counts[k] += plain_buckets(t)
        asked = ["ab", "x", prose(70, 99), prose(3, 98) + "É", texts[0][0], texts[1][0], "12", None]
        names, scores = model.predict(asked)
        assert model.predict(asked[3:4]) == (names[3:4], scores[3:4])
        for t, name, score in zip(asked[:6], names, scores):
            post = {}
            for k, c in counts.items():
                size = sum(c.values()) + langid.BUCKETS * langid.ALPHA
                post[k] = math.log((docs[k] + 1) / (sum(docs.values()) + 3)) + sum(n * math.log((c[b] + langid.ALPHA) / size) for b, n in plain_buckets(t).items())
            best = max(sorted(post), key=post.get)
            assert name == best and math.isclose(score, 1 / sum(math.exp(x - post[best]) for x in post.values()), rel_tol=1e-9)
        assert names[6:] == ["und", "und"]
    finally:
        langid.CHARS = long


def backoff(split, trained):
    """A trie of seen n-grams with failure arcs, of plain dictionaries: state -> {word: (weight, next state)}, state -> (weight, shorter state)."""
    count = Counter()
    for i, w in split.items():
        if i in trained:
            s = ["^", *w]
            for k in range(1, len(s)):
                count.update(tuple(s[j : k + 1]) for j in range(max(0, k - 2), k + 1))
            count["^",] += 1
    floor = sum(n for g, n in count.items() if len(g) == 1 and g != ("^",)) + len([g for g in count if len(g) == 1 and g != ("^",)]) + 1
    seen = lambda g: (count[g] - lm.DISCOUNT) / count[g[:-1]] if len(g) > 1 else (count[g] + 1) / floor
    arcs, fail = defaultdict(dict), {}
    states = [(), *(g for g in count if len(g) < 3)]
    for g in count:
        if g != ("^",):
            to = g[-2:]
            while to and to not in count:
                to = to[1:]
            arcs[g[:-1]][g[-1]] = (seen(g), to)
    for h in states:
        if h and arcs[h]:
            left = 1 - sum(p for p, _ in arcs[h].values())
            fail[h] = (left / (1 - sum(seen((*h[1:], x)) for x in arcs[h])), h[1:])
    return arcs, fail, floor


def walk(arcs, fail, floor, w):
    state, p = ("^",) if ("^",) in fail else (), 0.0
    for x in w:
        while x not in arcs[state] and state:
            weight, state = fail[state]
            p += math.log10(weight)
        weight, state = arcs[state].get(x, (1 / floor, ()))
        p += math.log10(weight)
    return p


def test_lm(spark, docs, rows):
    train = F.col("doc_id") % 7 != 2
    got = by_id(lm.score(docs, train), "id")
    split = {i: [*brute.words(t, low=True), "$"] for i, t, *_ in rows}
    arcs, fail, floor = backoff(split, {i for i in split if i % 7 != 2})
    words = {x: p for x, (p, _) in arcs[()].items()}
    total = sum(len(w) for i, w in split.items() if i % 7 != 2)
    for i, w in split.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in words for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10(words.get(x, 1 / floor)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, walk(arcs, fail, floor, w), rel_tol=1e-9)


def test_lm_is_a_distribution():
    split = {k: [*prose(60, 90 + k).split(), "$"] for k in range(4)}
    arcs, fail, floor = backoff(split, set(split))
    known = [*arcs[()], "unknown"]
    for h in [*list(fail)[:40], ()]:
        p = 0.0
        for x in known:
            state, q = h, 1.0
            while x not in arcs[state] and state:
                weight, state = fail[state]
                q *= weight
            p += q * arcs[state].get(x, (1 / floor, ()))[0]
        assert math.isclose(p, 1)


@pytest.mark.parametrize("segment", [3, 7, 512])
def test_lm_segments_carry_the_state(segment):
    r = random.Random(segment)
    first = np.array([0, 40, 41, 90, 600])
    ids = np.array([r.randrange(9 if k < 90 else 12) for k in range(600)])
    ids[first[1:] - 1] = 12
    grams = lm.Grams(np.arange(13, dtype=np.uint64) + np.uint64(7), ids, first)
    c1, c2, c3 = grams.counts(np.array([True, False, True, False]))
    assert (c2 == 0).any() and (c3[grams.place3[100:]] > 0).any()
    one, many = lm.Automaton(grams, c1, c2, c3, 2).traverse(10**6), lm.Automaton(grams, c1, c2, c3, 2).traverse(segment)
    assert all(np.array_equal(a, b) for a, b in zip(one[:2], many[:2]))
    assert sorted(zip(*map(list, one[2:]))) == sorted(zip(*map(list, many[2:])))


def test_lm_repeated_and_null_ids(spark):
    text = [prose(50, 77), prose(80, 78), None, ""]
    table = spark.createDataFrame([(1, text[0], 5), (1, text[0], 5), (None, text[1], 6), (None, text[2], 7), (1, text[3], 8), (2, text[1], 9)], "doc_id bigint, text string, n_tokens int")
    got = sorted((str(r.id), r.n_tokens, r.train_tokens) for r in lm.score(table, F.lit(True)).collect())
    assert got == sorted([("1", 51, 266), ("1", 51, 266), ("None", 81, 266), ("None", 1, 266), ("1", 1, 266), ("2", 81, 266)])


def test_lm_blocks_agree(spark, docs, none):
    one = by_id(lm.score(docs, F.col("doc_id") % 7 != 2), "id")
    size, lm.BLOCK_BYTES = lm.BLOCK_BYTES, 5000
    try:
        many = by_id(lm.score(docs, F.col("doc_id") % 7 != 2), "id")
        assert lm.score(none, F.lit(True)).count() == 0
    finally:
        lm.BLOCK_BYTES = size
    for i, r in one.items():
        assert r[:4] == many[i][:4] and math.isclose(r.score, many[i].score, rel_tol=1e-9)
    untrained = lm.score(docs, F.lit(False)).first()
    assert untrained.n_known == 0 and untrained.train_tokens == 0


def test_lm_texts_unlike_many_copies(spark, tmp_path):
    """A text of the same words in another order isn't scored below what its words give, however many copies were trained on; a copy keeps its score."""
    said = [f"w{k}" for k in range(60)]
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 == 2]
    text = F.when(F.col("doc_id") == held[0], " ".join(said[::-1])).when(F.col("doc_id") == held[1], "new words only").otherwise(" ".join(said))
    spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text")).where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2) | F.col("doc_id").isin(*held[:3])).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op4_backoff_lm(spark, str(tmp_path)), "doc_id")
    assert len(got) == 400 - len(held) + 3 and all(math.isfinite(r.score) for r in got.values())
    assert all(got[k].held_out and got[k].score > got[k].base_score - 0.31 for k in held[:3])
    assert got[held[2]].score > got[held[2]].base_score + 90


def test_byte_planes():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    assert np.array_equal(lm.unpack_keys(lm.pack_keys(keys)), keys) and len(lm.unpack_keys(lm.pack_keys(keys[:0]))) == 0


def test_near_duplicates(docs, rows, none):
    got = by_id(minhash.groups(docs), "id")
    for i, (n, component) in brute.near([(i, t) for i, t, *_ in rows]).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i)
    assert minhash.groups(none).count() == 0


@pytest.mark.parametrize("meet", [4, 1024])
def test_near_duplicates_large_family(spark, meet):
    """Copies that are near the first text only, with buckets and families cut into blocks."""
    base = prose(300, 77)
    texts = [base] + [" ".join(f"e{k}x{j}" if j % 50 == k % 50 else w for j, w in enumerate(base.split())) for k in range(25)] + [prose(300, 78)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    size, minhash.MEET = minhash.MEET, meet
    try:
        got = by_id(minhash.groups(docs), "id")
    finally:
        minhash.MEET = size
    for i, (_, component) in brute.near(list(enumerate(texts))).items():
        assert got[i].component_id == component


def test_near_duplicates_around_the_threshold(spark, monkeypatch):
    """Two bases with copies of many degrees: unions, stragglers and links between blocks, against all pairs."""
    monkeypatch.setattr(minhash, "MEET", 6)
    r = random.Random(8)
    texts = []
    for base in (prose(120, 301), prose(140, 302)):
        for k in range(35):
            w = base.split()
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
                w[r.randrange(len(w))] = f"z{r.randrange(4)}"
            texts.append(" ".join(w))
    got = {x.id: (x.n_shingles, x.component_id) for x in minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = brute.near(list(enumerate(texts)))
    assert got == want and 3 < len({c for _, c in want.values()}) < 60


def test_superminhash_estimates():
    r = np.random.default_rng(3)
    errors = []
    for shared in (0, 50, 160, 200):
        x = r.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = x[:200], x[200 - shared : 400 - shared]
        s = minhash.superminhash([a, b, a[:1], a[:0]])
        errors.append(abs((s[0] == s[1]).mean() - shared / (400 - shared)))
        assert len(set((s[2] >> np.uint64(48)).tolist())) == minhash.VALUES and (s[3] == 2**64 - 1).all()
    assert max(errors) < 0.13


def test_deduplicated_keeps_columns_and_one_of_repeated_rows(spark, docs):
    out = minhash.deduplicated(docs.unionByName(docs.where("doc_id in (0, 24)")).withColumn("kept", F.lit("x")))
    ids = sorted(r.doc_id for r in out.collect())
    assert ids == sorted(set(ids)) and 0 in ids and 1 not in ids and out.columns[-1] == "kept"


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 60)] + [(100, 103), (103, 101), (200, 200), (300, 299), (300, 299)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[103] == 100 and got[300] == 299 and 200 not in got


@pytest.mark.parametrize("hot", [1, 2, 1 << 15])
def test_substring(docs, rows, hot, none):
    """Gathered anchors and counted windows give the same."""
    out = substring.deduplicated(docs, hot=hot).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256))
    got = by_id(out)
    want = brute.substring([t for _, t, *_ in rows])
    for (i, *_), w in zip(rows, want):
        assert (got[i].n_words, got[i].n_removed, got[i].sha) == w
    assert substring.deduplicated(none).count() == 0


def test_substring_spans_come_from_the_automaton(monkeypatch):
    a, b = prose(40, 1), prose(50, 2)
    passages = [p.encode() for p in (a, a, "x " + a, b, b + " y", prose(45, 3))]
    anchors = np.array([1, 1, 1, 2, 2, 3])
    assert substring.locate(anchors, passages, 35) == [[(0, 40)], [(0, 40)], [(1, 41)], [(0, 50)], [(0, 50)], []]
    assert substring.locate(np.arange(6), passages, 35) == [[]] * 6

    class Blind:
        def __init__(self, *args):
            self.n = 0

        def add_word(self, *args):
            self.n += 1

        def make_automaton(self):
            pass

        def __len__(self):
            return self.n

        def iter(self, text):
            return iter(())

    monkeypatch.setattr(substring.ahocorasick, "Automaton", Blind)
    assert substring.locate(anchors, passages, 35) == [[]] * 6


def test_substring_random_texts(spark):
    """Few different words: many chance repeats and repeats inside one text."""
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(30, 400))) for _ in range(30)] + ["a " * 200, "a " * 34, "a " * 35, "a b " * 100] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(substring.deduplicated(docs))
    for i, w in enumerate(brute.substring(texts)):
        assert (got[i].n_words, got[i].n_removed) == w[:2]


def test_substring_repeated_rows_null_ids_and_columns(spark):
    t = prose(50, 1)
    docs = spark.createDataFrame([(1, t, 5), (1, t, 6), (None, prose(60, 2), 7), (2, None, 8)], "doc_id bigint, text string, spans int")
    out = sorted(substring.deduplicated(docs, keep=docs.columns).select("doc_id", "spans", "n_removed").collect(), key=lambda r: r.spans)
    assert [(r.doc_id, r.spans, r.n_removed) for r in out] == [(1, 5, 50), (1, 6, 50), (None, 7, 0), (2, 8, 0)]


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    cut = packing.cut(docs, path, with_ids=True)
    out = packing.place(cut).collect()
    whole = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        ids = b"".join(bytes(r.ids) for r in mine)
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in mine] == [4096 * k for k in range(len(mine))] and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in mine)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.place(packing.cut(none, path)).count() == 0


def test_packing_rule():
    r = np.random.default_rng(2)
    lengths = np.concatenate([r.integers(1, 4096, 2000), [4096, 4096]])
    bins, offsets, n = packing.pack(lengths)
    load = np.bincount(bins, lengths)
    assert load.max() <= 4096 and len(load) == n
    fitted = []  # first-fit decreasing
    for s in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, x in enumerate(fitted) if x + s <= 4096), None)
        if k is None:
            fitted.append(s)
        else:
            fitted[k] += s
    assert n <= 1.02 * len(fitted)


def test_tokens_equal_the_tokenizer():
    t = packing.Tokens(queries.tokenizer_path())
    r = random.Random(5)
    letters = "aZé'sÉ²½ǅİΣσς\u0085 \x1c\x1f ,.!<|>_9٣漢𝔘éﬁßẞ\t\n"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["a<|endoftext|>b <|STARTOFTEXT|> x", "it's THEY'LL l'été"]
    for text, e in zip(texts, t.encoder.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(t.encode(text.encode()), "<u4").tolist() == e.ids


def test_sharding(docs, none):
    out, versions = sharding.assign(docs, 3)
    rows = out.collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    for s in load:
        assert sorted(r.place for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == brute.crc(text[r.doc_id]) for r in rows)
    assert versions.groupBy("version").agg(F.countDistinct("slot").alias("n")).where(f"n <> {sharding.SLOTS}").count() == 0
    assert sharding.assign(none, 3)[0].count() == 0


def test_sharding_balances_and_grows(spark):
    first = sharding.first_map(spark, 8)
    sizes = spark.range(sharding.SLOTS).select(F.col("id").cast("int").alias("slot"), (100 + F.pmod(F.xxhash64("id"), F.lit(900))).alias("bytes"))
    load = [r.b for r in sharding.rebalanced(first, sizes, 8).join(sizes, "slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(load) - min(load) < 0.001 * sum(load)
    new = sharding.grown(first, 8).join(first.select("slot", F.col("shard").alias("old")), "slot")
    assert new.where("shard <> old and shard <> 8").count() == 0 and abs(new.where("shard = 8").count() - sharding.SLOTS / 9) < 9


def test_sharding_goes_on_with_the_stored_map(spark, tmp_path):
    path = f"{tmp_path}/map"
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    first, now = sharding.assign(docs, 8, map_path=path)
    assert {r.version for r in now.select("version").distinct().collect()} == {1} and sharding.SlotMap(spark, path).versions() == [0, 1]
    _, same = sharding.assign(docs, 8, map_path=path)
    assert sharding.SlotMap(spark, path).versions() == [0, 1] and same.exceptAll(now).count() == 0
    more = docs.unionByName(spark.range(20000, 30000).select("id", F.repeat(F.lit("y"), F.when(F.col("id") % 4096 < 40, 9000).otherwise(9)).alias("text")).withColumnRenamed("id", "doc_id"))
    out, next_ = sharding.assign(more, 8, map_path=path)
    assert sharding.SlotMap(spark, path).versions() == [0, 1, 2]
    moved = next_.alias("a").join(now.alias("b"), "slot").where("a.shard <> b.shard").count()
    load = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert 0 < moved < sharding.SLOTS / 2 and max(load) - min(load) < 0.05 * sum(load)
    with pytest.raises(ValueError):
        sharding.assign(docs, 4, map_path=path)


def test_sharding_repeated_null_and_clashing_rows(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (None, "a", 7), (None, None, 8), (2, "", 9)], "doc_id bigint, text string, size int")
    out, _ = sharding.assign(docs, 2, keep=["size", "doc_id"])
    assert sorted(out.columns) == ["doc_id", "place", "shard", "size", "text_crc32", "virtual_slot"]
    rows = out.collect()
    assert sorted((str(r.doc_id), r.size) for r in rows) == [("1", 2), ("1", 2), ("2", 1), ("None", 1), ("None", 2)]
    for k in {r.shard for r in rows}:
        assert sorted(r.place for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_sharding_equals_plain_counts(spark, docs, rows):
    """Slots, sizes, checksums and a balance that greedy placement in plain Python reaches as well."""
    out, now = sharding.assign(docs, 3)
    shard = {r.slot: r.shard for r in now.collect()}
    got = out.collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, brute.crc(t)) for i, t, *_ in rows)
    assert all(r.shard == shard[r.virtual_slot] for r in got)
    slots = Counter()
    for r in got:
        slots[r.virtual_slot] += r.size
    loads = [0] * 3
    for b in sorted(slots.values(), reverse=True):
        loads[loads.index(min(loads))] += b
    mine = Counter()
    for r in got:
        mine[r.shard] += r.size
    assert max(mine.values()) <= max(loads) * 1.01


def test_decontamination(spark, docs, rows, none):
    t24, t5 = rows[24][1], rows[5][1]
    items = [(1, " ".join(t24.upper().split()[5:30])), (2, prose(40, 999)), (3, "one, two; three"), (4, None), (5, " .. "), (10, " ".join(t5.split()[295:315])), (10, "ha ha"), (None, " ".join(t24.split()[28:40]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    named = [("null" if k is None else k, t) for k, t in items]
    want = brute.leaks([t for _, t, *_ in rows], named)
    bench = bench.unionByName(bench.where("item_id = 1"))  # a repeated item is one
    size, decontam.PHRASE_BYTES = decontam.PHRASE_BYTES, decontam.PHRASE_BYTES
    try:
        for decontam.PHRASE_BYTES in (size, 1000):  # one block of phrases, and several
            found = decontam.search(decontam.build_index(docs), bench)
            got = by_id(found.withColumn("sha", F.sha2(F.array_join("items", ",").cast("binary"), 256)), "id")
            for (i, *_), w in zip(rows, want):
                assert (got[i].n_words, got[i].n_hit, len(got[i]["items"]), got[i].sha) == w
    finally:
        decontam.PHRASE_BYTES = size
    assert decontam.search(decontam.build_index(none), bench).count() == 0
    assert decontam.search(decontam.build_index(docs), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_repeated_null_and_clashing_rows(spark):
    t = prose(40, 60)
    docs = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, t, 0), (None, prose(30, 61), 0), (2, None, 0)], "doc_id bigint, text string, n_hit int")
    bench = spark.createDataFrame([(5, " ".join(t.split()[3:20]), 1)], "item_id bigint, text string, id int")
    got = sorted((str(r.id), r.n_words, r.n_hit, r["items"]) for r in decontam.search(decontam.build_index(docs), bench).collect())
    assert got == [("1", 40, 17, ["5"]), ("1", 40, 17, ["5"]), ("2", 0, 0, []), ("None", 30, 0, []), ("None", 40, 17, ["5"])]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha beta q gamma y"), (2, "alpha q q q beta gamma"), (3, "gamma beta alpha")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    index = decontam.build_index(docs)
    hits = lambda slop: {r.id for r in decontam.search(index, items, slop=slop).where("n_hit > 0").collect()}
    assert hits(0) == set() and hits(1) == {1} and hits(3) == {1, 2}


def test_html():
    page = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- c --><div class='ad'>Buy, now, this.</div>"
    body = "<article><h1>Head &amp; co</h1><p><b>First, one.<br><p>Second&nbsp; two,\n three &lt;x&gt;.</p><p>S.</p></article><aside>Side, text.</aside><div id=comments><p>A long, long comment, really. It goes on, and on.</p></div><footer>&copy; f</footer></body></html>"
    assert html_text.main_text(page + body) == "Head & co\nFirst, one.\nSecond two, three <x>.\nS."
    plain = "<body><div class=menu><a>a</a></div><div class=content><h2>Title</h2><p>" + "Some text, with marks. " * 9 + "</p><p>Short.</p><p>" + "More text, and more. " * 9 + "</p></div><div class=footer>x</div></body>"
    assert html_text.main_text(plain).split("\n")[::2] == ["Title", "Short."]
    marked = "<body><nav>m</nav><div class='page with-sidebar'><p>" + "Some text, with marks. " * 5 + "</p><p>End.</p></div></body>"
    assert html_text.main_text(marked).endswith("\nEnd.")
    parts = "<body><article><header><p>By me, today.</p></header><section><p>" + "One, two. " * 9 + "</p></section><ul><li>Item, a.</li></ul><div class=comments><p>" + "No, never. " * 30 + "</p></div><blockquote><p>Quote.</p></blockquote></article></body>"
    assert html_text.main_text(parts).split("\n")[1:] == ["Item, a.", "Quote."]
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<p>" * 50_000 + "x, y." + "<" * 1000).startswith("x, y.")


def test_html_attributes():
    body = "One, two. " * 9
    page = lambda x: f"<body><article><p>{body}</p>{x}<p>{body}</p></article></body>"
    for kept in ("<div data-id='menu'><p>Kept, x.</p></div>", "<div class='article-comment-count'><p>Kept, x.</p></div>", "<div title='class=ad'><p>Kept, x.</p></div>", "<div class='article-header'><p>Kept, x.</p></div>", "<div class='not-hidden menus'><p>Kept, x.</p></div>"):
        assert html_text.main_text(page(kept)).split("\n")[1] == "Kept, x."
    for gone in ("<div hidden><p>Gone, x.</p></div>", "<div class='wide hidden-x' hidden=''><p>Gone, x.</p></div>", "<div class='site-footer big'><p>Gone, x.</p></div>", "<div id=comments><p>Gone, x.</p></div>", "<div aria-hidden=true><p>Gone, x.</p></div>", "<div role='navigation'><p>Gone, x.</p></div>"):
        assert html_text.main_text(page(gone)) == "\n".join([body.strip()] * 2)


def test_html_selects_by_path():
    """A strong path outside the subtree of the others is kept, weak ones far from both are not."""
    text = "Some text, with marks. " * 12
    page = f"<body><div><div><section><p>{text}</p><p>{text}</p><h3>Weak</h3></section></div></div><table><tr><td><blockquote>{text}</blockquote></td></tr></table>" + "<dl><dt><a href=x>Far</a></dt></dl>" * 9 + "</body>"
    assert html_text.main_text(page).split("\n") == [text.strip(), text.strip(), "Weak", text.strip()]


@pytest.mark.parametrize("seed", range(30))
def test_html_round_trip(seed):
    """Random articles in random pages, from blocks to html and back."""
    r = random.Random(seed)
    said = lambda n: " ".join(r.choice(["word,", "été", "a & b", "x < y", "end.", "naïve;"]) for _ in range(n))
    escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("é", r.choice(["é", "&eacute;", "&#233;"]))
    want, parts = [], []
    for _ in range(r.randint(3, 12)):
        t = said(r.randint(6, 60))
        tag = r.choice(["p", "p", "p", "blockquote", "pre", "h2"])
        want.append(t)
        spaced = escaped(t).replace(" ", r.choice([" ", "\n  ", " \t"]))
        parts.append(r.choice([f"<{tag}>{spaced}</{tag}>", f"<{tag}><em>{spaced}</em></{tag}>", f"<section><{tag} class='c{seed}'>{spaced}</{tag}></section>"]))
        parts.append(r.choice(["", "", f"<aside><p>{said(30)}</p></aside>", f"<div class='ad'>{said(20)}</div>", "<script>if (a < b) x('</p>');</script>", f"<!-- {said(5)} -->", f"<form><label>{said(3)}</label><button>ok</button></form>", f"<ul class='share-buttons'><li>{said(2)}</li></ul>"]))
    holder = r.choice(["article", "main", "article id=top"])
    html = f"<html><head><title>t</title></head><body><header>{said(9)}</header><nav><ul><li><a href=x>{said(2)}</a></li></ul></nav><{holder}>{''.join(parts)}</{holder.split()[0]}><div class='comments-area'><p>{said(80)}</p></div><footer>{said(6)}</footer></body></html>"
    assert html_text.main_text(html) == "\n".join(want)


def test_html_pages_hold_a_document(spark, tiny):
    texts = {r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    pages = queries.op10_html_text(spark, tiny).collect()
    assert pages and all(r.n_chars == len(r.text) for r in pages)
    headed = [r.text.split("\n", 1) for r in pages]
    assert sum(len(h) == 2 and h[1] in texts for h in headed) == len(pages)
    assert all(not line.strip() != line and "  " not in line for r in pages for line in r.text.split("\n"))


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>a, b.</p>", 2)], "page_id bigint, url string, html string, n_chars int")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "", "a, b."]
    assert html_text.extract(pages.limit(0)).count() == 0


CONV = "conv_id bigint, turn bigint, role string, text string"


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "x")]
    rows += [(4, 0, "user", "a"), (4, 5, "assistant", "x"), (5, 0, "user", None), (6, 0, "user", ""), (6, 0, "user", ""), (7, 0, None, "z"), (None, 0, "user", "n")]
    rows += [(8, k, "user", f"t{k}") for k in range(1000)] + [(9, k, "user", f"t{k}") for k in range(700)]
    out = {r.conv_id: r for r in chat.render(spark.createDataFrame(rows, CONV)).collect()}
    assert set(out) == {2, 3, 5, 6, 7, None, 8}
    assert out[2].rendered == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n" and out[3].n_copies == 2 and out[8].n_turns == 1000
    assert out[8].rendered.split("\n")[1::2][:2] == ["t0<|end|>", "t1<|end|>"]
    assert chat.render(spark.createDataFrame([], CONV)).count() == 0


def test_chat_plan_is_native(spark):
    plan = chat.render(spark.createDataFrame([], CONV))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digest_queries(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = by_id(queries.op9_decontaminate(spark, tiny))
    for r, w in zip(docs, brute.leaks([r.text for r in docs], items)):
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (*w, w[1] > 0)
    got = by_id(queries.op6_substring_dedup(spark, tiny))
    for r, w in zip(docs, brute.substring([r.text for r in docs])):
        assert tuple(got[r.doc_id])[1:] == w
    got = by_id(queries.op5_minhash(spark, tiny))
    for i, (n, component) in brute.near([(r.doc_id, r.text) for r in docs]).items():
        assert tuple(got[i]) == (i, n, component, i == component)


@pytest.mark.parametrize("name", ["op1_chat_format", "op3_quality_rules", "op5_minhash", "op6_substring_dedup", "op9_decontaminate"])
def test_sql(spark, tiny, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tiny}/{f}'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, tiny).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
