"""Operators over documents against plain versions, on texts with every odd case."""

import collections
import hashlib
import math
import random
import zlib

import fixtures as fx
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, files, language, neardup, ngram, quality, shards, tokens

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_row(rows, *index):
    return collections.Counter(tuple(r[i] for i in index) for r in rows)


def test_quality_counts_and_verdicts(docs, rows):
    got = quality.judge(docs).collect()
    want = by_row([(r[0], *fx.base_counts(r[1])) for r in rows], *range(6))
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(verdict[i].kept for i in range(58))
    junk = [r[0] for r in rows if r[0] and r[1] and ("***" in r[1] or r[1].startswith(("THE", "ING", "WH", "OU", "ER", "TH", "TION")) and "!!" in r[1])]
    assert len(junk) >= 8 and not any(verdict[i].kept for i in junk)


def test_quality_keeps_rows_and_columns(docs, empty, rows):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter(r.doc_id for r in quality.judge(docs).where("kept").collect()) and ids[2] == 2
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_plan_is_native(docs):
    plan = quality.text_counts(docs.select("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_trusts_rules_that_agree(spark):
    good, bad = [0] * 9, [0] * 9
    good[1] = good[6] = good[8] = 1
    bad[0] = -1
    m = quality.fit(spark.createDataFrame([(good, 900), (bad, 100)], "v array<int>, n long")).first()["m"]
    assert m.bn[0] > 0.8 and m.gn[0] < 0.01 and 0.85 < m.pi < 0.95


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards(docs, rows, n):
    got = shards.shard_documents(docs, n).collect()
    want = by_row([(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows], 0, 1, 2)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) == set(range(n)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(n):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    mix = collections.Counter((r.shard, r.stratum) for r in got)
    for s, total in collections.Counter(r.stratum for r in got).items():
        assert all(abs(mix[k, s] - total / n) <= 2 for k in range(n))


def test_shards_are_seeded_and_written(spark, docs, empty, tmp_path):
    a, b = (sorted((r.doc_id or -1, r.shard) for r in shards.shard_documents(docs, 4, seed).collect()) for seed in (1, 2))
    assert a != b and a == sorted((r.doc_id or -1, r.shard) for r in shards.shard_documents(docs.repartition(2), 4, 1).collect())
    shards.write_shards(docs.drop("shard"), str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    assert shards.shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        shards.shard_documents(docs, 0)


def test_near_duplicates(docs, rows, empty):
    want = fx.components(rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(set(fx.shingles(r[1]))) for r in rows}
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.n_shingles == size[r.doc_id]
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_near_copies_of_one_text(spark):
    """Chains of copies, where most pairs of the group are no links, and a bucket of more than one block."""
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(700):
        w = list(base)
        for j in range(1 + k % 6):
            w[(7 * k + 23 * j) % 120] = f"x{k}_{j}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == fx.components([(i, t) for i, t in rows])


def test_near_duplicates_of_short_texts(spark):
    """Texts of 7 words and ones of 8 that they begin: 3 of 4 shingles are shared, and the longer ones don't resemble each other."""
    texts = [" ".join([f"f{k}w{i}" for i in range(7)] + [f"end{e}"] * (e > 0)) for k in range(400) for e in range(5)]
    rows = [(i * 7919 % len(texts), t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == fx.components(rows)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for a, b in ((pool[:700], pool[100:800]), (pool[:30], pool[5:35]), (pool[:3], pool[:3])):
        sig = neardup.superminhash(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.13
        for s in sig:  # with one element, every place holds another rank
            assert s.max() < 0xFFFFFFFF
    one = neardup.superminhash(pool[:1], np.array([0]), 1)[0]
    assert sorted((one >> 24).tolist()) == list(range(neardup.PLACES))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    want = by_row([(r[0], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows], 0, 1, 2)
    got = tokens.count_tokens(docs, path, 100).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert tokens.count_tokens(empty, path).count() == 0


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BPE), special_tokens={})


def test_bpe_round_trip(docs, rows, empty):
    enc = tiktoken_encoding()
    got = bpe.encode(docs, BPE, public_tokenizers.PATTERN, outputs=["n_tokens", "ids_sha256", "decoded_sha256"]).collect()
    want = collections.Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want
    ids = bpe.encode(docs, BPE, public_tokenizers.PATTERN, keep=["doc_id", "text"])
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in bpe.decode(ids, BPE).collect())
    assert bpe.encode(empty, BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_clashing_names(docs, rows):
    odd = docs.withColumnRenamed("source", "ids").withColumnRenamed("lang", "decoded").withColumn("k0", F.lit(1))
    with pytest.raises(ValueError):
        bpe.encode(odd, BPE, public_tokenizers.PATTERN, keep=["doc_id", "ids"])
    got = bpe.encode(odd, BPE, public_tokenizers.PATTERN, keep=["k0", "ids", "text"], outputs=["n_tokens", "round_trip"])
    assert got.columns == ["k0", "ids", "text", "n_tokens", "round_trip"] and all(r.round_trip for r in got.collect())
    with pytest.raises(ValueError):
        bpe.decode(docs.select(F.array(F.lit(1)).alias("ids"), F.lit(1).alias("decoded")), BPE)


def test_bpe_fold_equals_merges(spark, rows):
    rng = random.Random(4)
    ranks, words = bpe.read_ranks(BPE), {w.encode() for r in rows[:30] for w in (r[1] or "").split()} | {b"", b" ", b"\xff\x00", " über".encode(), b"x" * 3000}
    words |= {bytes(rng.choice(b"aaabnt e\xc3") for _ in range(rng.randint(1, 60))) for _ in range(300)}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word binary")
    for found in (df.select("word", bpe.fold_merges(F.col("word"), ranks).alias("ids")), bpe.merge_long(df, BPE)):
        assert all(list(r.ids) == fx.merges(bytes(r.word), ranks) for r in found.collect())


def test_bpe_parts_cut_at_word_borders():
    import regex

    find, rng = regex.compile(public_tokenizers.PATTERN).findall, random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b1", " ", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "'s", "'", "!", "日本", "\u2003", "\x85"]) for _ in range(rng.randint(0, 12)))
        heads, rest, number, off = bpe.encoded_parts(pa.array([text, "x y", None, text]))
        got = [[(rest[k] if k >= 0 else None) for k in number[a:b]] for a, b in zip(off, off[1:])]  # noqa: B905
        assert [w for p in [heads[3], *(" " + p for p in got[3][1:])] for w in find(p)] == find(text), repr(text)
        assert got[0] == got[3] and got[1] == [None, "y"] and got[2] == [None] and heads[2] == ""


def test_word_tables(spark, tmp_path, monkeypatch):
    words = [f"w{i}".encode() for i in range(500)] + [b"", b"\xff\x00", b"x" * 10000]
    rows = [(w, list(range(i % 5))) for i, w in enumerate(words)]
    table = files.write_words(spark.createDataFrame(rows, "word binary, ids array<int>"), f"file://{tmp_path}/t", len(rows))
    found = files.WordTable(table)
    asked = rows[::-1] + rows[:3]
    ids, sizes = found.look([w for w, _ in asked])
    assert ids.tolist() == [i for _, x in asked for i in x] and sizes.tolist() == [len(x) for _, x in asked] and not len(found.look([])[0])
    with pytest.raises(KeyError):
        found.look([b"w1", b"not there"])
    # words of one 64-bit hash are told apart by the other
    monkeypatch.setattr(files, "_keys", lambda ws: (np.zeros(len(ws), np.uint64), np.array([int(w[1:]) for w in ws], np.uint64)))
    order = np.arange(20)
    files.write(f"file://{tmp_path}/u/0", {"n": 20}, {"hi": order * 0, "lo": order, "off": np.arange(21), "ids": order * 3})
    same = files.WordTable({"where": f"file://{tmp_path}/u", "bits": 5, "shards": [0]})
    assert same.look([b"w7", b"w0", b"w19"])[0].tolist() == [21, 0, 57]
    with pytest.raises(KeyError):
        same.look([b"w20"])


def test_language(docs, rows, empty):
    learn = docs.where(~language.in_fold(3, 1))
    prototypes = language.learn(learn)
    assert sorted(prototypes) == ["de", "en"]
    got = language.predict(docs.select("doc_id", "lang", "text", language.in_fold(3, 1).alias("held_out")), prototypes).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (fx.fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 50]
    assert len(held) > 5 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language.learn(empty) == {} and {r.lang_pred for r in language.predict(docs.select("text"), {}).collect()} == {"und"}
    assert language.predict(empty.select("text"), prototypes).count() == 0


def test_decontamination(spark, docs, rows):
    a, b = fx.words(rows[4][1]), fx.words(rows[30][1])
    items = [(10, " ".join(a[5:45])), (11, " ".join([*b[20:38], "other", *b[39:60]])), (12, "zz yy xx"), (13, None), (14, ""), (15, "Two words"), (16, "unseen words " * 10), (17, " ".join(a[5:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for r in rows:
        s, found = fx.shingles(r[1]), []
        w = fx.words((r[1] or "").translate(fx.LOWER))
        for i, text in items:
            t = collections.Counter(fx.shingles(text))
            n = sum(t.values())
            length = len(fx.words(text))
            spans = [[tuple(w[k : k + length])] for k in range(len(w) - length + 1)] if length < 5 else [s[k : k + n] for k in range(max(1, len(s) - n + 1))]
            if n and any(100 * sum((t & collections.Counter(p)).values()) >= 75 * sum((t | collections.Counter(p)).values()) for p in spans if p and (length < 5 or len(w) >= 5)):
                found.append(i)
        want[r[0], tuple(found)] += 1
    got = decontaminate.match_items(docs, bench).collect()
    assert collections.Counter((r.doc_id, tuple(x.item_id for x in r._items)) for r in got) == want
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for (i, f) in want if not f}
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("size", [100, 16 << 20])
def test_decontamination_by_items_without_id(docs, rows, spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    items = [(None, " ".join(fx.words(rows[4][1])[5:45])), (None, " ".join(fx.words(rows[4][1])[10:50])), (1, " ".join(fx.words(rows[4][1])[5:45])), (None, " ".join(fx.words(rows[30][1])[5:45])), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {(x.item_id, x.similarity) for x in r._items} for r in decontaminate.match_items(docs, bench).collect()}
    counts = {r.doc_id: len(r._items) for r in decontaminate.match_items(docs, bench).collect()}
    assert got[4] == {(1, 1.0), (None, 1.0)} and got[30] == {(None, 1.0)} and counts[4] == 2 and counts[30] == 1
    assert not {4, 30} & {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}


def test_decontamination_in_blocks(docs, rows, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    bench = spark.createDataFrame([(i, " ".join(fx.words(rows[i][1])[:30])) for i in range(6)], "item_id long, text string")
    got = {r.doc_id: {x.item_id for x in r._items} for r in decontaminate.match_items(docs, bench).collect()}
    assert all(i in got[i] for i in range(6))


def test_decontamination_fingerprints():
    """Windows with and without repeats have the fingerprint of their ranked shingles; all pairs at the least similarity
    are found; of other items, few are compared and none is within the radius."""
    rng = np.random.default_rng(5)
    for s in (rng.integers(0, 1 << 63, 200).astype(np.uint64), rng.integers(0, 30, 200).astype(np.uint64), np.zeros(50, np.uint64)):
        starts = np.array([0, 1, 2, 17, len(s) - 20])
        for a, f in zip(starts, decontaminate.Index.prints(s, starts, 20), strict=True):
            assert (f == decontaminate.fingerprint(decontaminate.signs(decontaminate.ranked(s[a : a + 20])).sum(axis=0)[None, :])[0]).all()
    one = lambda s: decontaminate.fingerprint(decontaminate.signs(decontaminate.ranked(s)).sum(axis=0)[None, :])[0]
    pairs = []
    for n, shared, heavy in [(4, 3, 0), (7, 6, 0), (14, 12, 0), (28, 24, 0), (28, 24, 4), (70, 60, 10)] * 60:  # heavy: copies of one shingle among those that differ
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[:shared], rng.integers(0, 1 << 63, n - shared if n > 4 else 0).astype(np.uint64)))
        if heavy:
            a[shared : shared + heavy] = a[shared]
        pairs.append((one(a), one(b)))
    table = decontaminate.Prints(list(range(len(pairs))), np.array([f for f, _ in pairs]))
    looked = [len(table.candidates(g)) / len(pairs) for _, g in pairs]
    assert [table.near(g) for _, g in pairs] == [[k] for k in range(len(pairs))] and np.mean(looked) < 0.6
    many = decontaminate.Prints(list(range(20000)), decontaminate.fingerprint(rng.normal(size=(20000, 256))))  # more values a block than changes
    assert max(len(b[0]) for b in many.blocks) > len(decontaminate._CHANGES)
    for k in range(50):
        f = many.wide[k].copy()
        f ^= np.packbits(rng.permutation(256) < 79).view(np.uint64)
        f = f.view(np.uint16)
        blocks = np.ascontiguousarray(many.wide).view(np.uint16)
        assert many.near(f) == [k] and many.candidates(f).tolist() == np.flatnonzero((np.bitwise_count(blocks ^ f) <= 4).any(axis=1)).tolist()


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 5), (200, 100), (300, 1 << 58)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    ef = ngram.EliasFano.build(v, universe)
    assert (ef.get(np.arange(n)) == v).all()
    q = np.concatenate((v, rng.integers(0, universe, 50, dtype=np.uint64)))
    at = ef.find(q)
    assert all((i >= 0) == (x in set(v.tolist())) and (i < 0 or v[i] == x) for x, i in zip(q.tolist(), at.tolist(), strict=True))


def test_ngram_scores(docs, rows, empty):
    toks = [(r[0], [w.encode() for w in fx.words((r[1] or "").translate(fx.LOWER))] + [b" "]) for r in rows]
    train = [t for i, t in toks if fx.fold(i, 10)]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for t in train for p in zip([b" ", *t], t) if c[p[0]] >= ngram.MIN_WORD and c[p[1]] >= ngram.MIN_WORD)  # noqa: B905
    pairs = {p: k for p, k in pairs.items() if k >= ngram.MIN_PAIR}
    mass = collections.Counter()
    for (u, _), k in pairs.items():
        mass[u] += (k - ngram.DISCOUNT) / c[u]
    want = collections.defaultdict(list)
    for i, t in toks:
        p1 = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        p = [((pairs[a, b] - ngram.DISCOUNT) / c[a] if (a, b) in pairs else 0) + max(1e-6, 1 - mass[a]) * q for a, b, q in zip([b" ", *t], t, p1)]  # noqa: B905
        want[i, len(t), sum(c[w] > 0 for w in t)].append((sum(map(math.log10, p1)), sum(map(math.log10, p))))
    source = docs.withColumn("held_out", ngram.held_out())
    got = ngram.score(source, ngram.train(docs.where(~ngram.held_out())), ["doc_id", "held_out"]).collect()
    assert len(got) == len(rows)
    for r in got:
        base, full = want[r.doc_id, r.n_tokens, r.n_known][0]
        assert r.train_tokens == n and r.held_out == (fx.fold(r.doc_id, 10) == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - full) < 5e-4 * r.n_tokens
    blank = ngram.score(source, ngram.train(empty), ["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in blank)
    assert ngram.score(empty, ngram.train(docs), ["doc_id"]).count() == 0


def test_ngram_keeps_rare_words_pairs_and_triples(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", 100)  # many groups
    toks = [(r[0], [w.encode() for w in fx.words((r[1] or "").translate(fx.LOWER))] + [b" "]) for r in rows]
    train = [t for i, t in toks if fx.fold(i, 10)]
    c1, c2, c3, after, types = (collections.Counter() for _ in range(5))
    for t in train:
        c1.update(t)
        c2.update(zip([b" ", *t], t))  # noqa: B905
        c3.update(zip([b" ", b" ", *t], [b" ", *t], t))  # noqa: B905
    n, v = sum(c1.values()), len(c1)
    for (u, w, _), k in c3.items():
        after[u, w] += k
        types[u, w] += 1
    followers = collections.Counter(u for u, _ in c2)
    d = ngram.DISCOUNT
    want = collections.defaultdict(list)
    for i, t in toks:
        total = 0.0
        for u, w, x in zip([b" ", b" ", *t], [b" ", *t], t):  # noqa: B905
            p = (c1[x] + 0.1) / (n + 0.1 * (v + 1))
            p = (max(c2[w, x] - d, 0) + d * followers[w] * p) / c1[w] if c1[w] else p
            p = (max(c3[u, w, x] - d, 0) + d * types[u, w] * p) / after[u, w] if after[u, w] else p
            total += math.log10(p)
        want[i, len(t)].append(total)
    model = ngram.train(docs.where(~ngram.held_out()), order=3)
    assert (model["V"], model["n_pairs"], model["n_triples"]) == (v, len(c2), len(c3)) and model["groups"] > ngram.GROUPS
    for r in ngram.score(docs, model, ["doc_id"]).collect():
        assert any(abs(r.score - x) < 5e-4 * r.n_tokens for x in want[r.doc_id, r.n_tokens])


def test_shards_spread_equal_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "same", "a")] * 3000 + [(i, f"t{i}", "b") for i in range(100)], "doc_id long, text string, source string").repartition(4)
    got = collections.Counter((r.stratum, r.shard) for r in shards.shard_documents(df, 4).collect())
    assert all(abs(got["=a", k] - 750) <= 1 and abs(got["=b", k] - 25) <= 1 for k in range(4))
    odd = df.withColumn("crc", F.lit(1)).withColumn("k", F.lit(2)).withColumn("_1", F.lit(3))
    shards.write_shards(odd, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).drop("shard", "slot").exceptAll(odd).isEmpty()
    with pytest.raises(ValueError):
        shards.write_shards(df.withColumn("slot", F.lit(1)), str(tmp_path / "no"), 4)


def test_language_profiles_against_plain_sums(docs, rows):
    """Prototypes and scores against vectors bound and summed window by window."""
    p = language.Profiles()

    def windows(text):
        gap = 0
        symbols = [gap]
        for ch in text:
            s = 0
            if ch.isalpha():
                low = ord(ch.lower()[0])
                s = low if low < 512 else 512 + (low * 2654435761 >> 7) % (language.SYMBOLS - 512)
            if s or symbols[-1]:
                symbols.append(s)
        if symbols[-1]:
            symbols.append(gap)
        return collections.Counter(zip(symbols, symbols[1:], symbols[2:]))  # noqa: B905

    def bundle(text):
        total = np.zeros(language.DIM)
        for (a, b, c), n in windows(text).items():
            total += n * (np.roll(p.letters[a], 2).astype(float) * np.roll(p.letters[b], 1) * p.letters[c])
        return total

    some = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    want = {}
    for r in some:
        if r[2] is not None:
            size = math.sqrt(sum(n * n for n in windows(r[1]).values()))
            want[r[2]] = want.get(r[2], 0) + bundle(r[1]) / size
    got = language.learn(docs)
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.allclose(got[k], v / np.linalg.norm(v), atol=1e-5)
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict(docs.select("doc_id", "text"), got).collect()}
    names = sorted(want)
    for r in some:
        v = bundle(r[1])
        cos = [float(want[k] @ v / np.linalg.norm(want[k]) / np.linalg.norm(v)) for k in names]
        assert found[r[0], r[1]][0] == names[int(np.argmax(cos))] and found[r[0], r[1]][1] == pytest.approx(max(0.0, max(cos)), abs=1e-4)


def test_em_against_a_plain_loop(docs):
    """Fitted parameters and posteriors against expectation-maximisation over the documents one by one."""
    counted = quality.text_counts(docs.select("doc_id", "text")).cache()
    votes = [list(r[0]) for r in counted.select(quality.votes()).collect()]
    k, w = len(quality.RULES), quality.WEIGHT
    pi, par = quality.PRIOR, {n: [x] * k for n, x in zip(("gn", "gp", "bn", "bp"), (*quality.GOOD, *quality.BAD), strict=True)}

    def posterior(v):
        llr = math.log(pi / (1 - pi))
        for j, x in enumerate(v):
            g, b = (par["gn"][j], par["bn"][j]) if x < 0 else (par["gp"][j], par["bp"][j]) if x > 0 else (1 - par["gn"][j] - par["gp"][j], 1 - par["bn"][j] - par["bp"][j])
            llr += math.log(g / b)
        return 1 / (1 + math.exp(-llr))

    for _ in range(40):
        p = [posterior(v) for v in votes]
        share = lambda q, x, j, start: max(0.0005, 0.999 * (w * start + sum(a for a, v in zip(q, votes, strict=True) if v[j] == x)) / (w + sum(q)))
        bad = [1 - a for a in p]
        new = {"gn": (p, -1, quality.GOOD[0]), "gp": (p, 1, quality.GOOD[1]), "bn": (bad, -1, quality.BAD[0]), "bp": (bad, 1, quality.BAD[1])}
        par = {n: [share(q, x, j, start) for j in range(k)] for n, (q, x, start) in new.items()}
        pi = min(0.999, max(0.001, (w * quality.PRIOR + sum(p)) / (w + len(p))))
    m = quality.estimate(counted)
    assert m["pi"] == pytest.approx(pi, rel=1e-9)
    for n in par:
        assert m[n] == pytest.approx(par[n], rel=1e-9)
    got = quality.score(counted, m).select("quality").collect()
    assert sorted(r[0] for r in got) == pytest.approx(sorted(posterior(v) for v in votes), rel=1e-9)
