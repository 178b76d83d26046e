"""Operators over pages and conversations, the queries' SQL, and the pipeline."""

import hashlib
import random

import duckdb
import fixtures as fx
import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import chat, decontaminate, language, neardup, quality, urls
from tidemark.llm.queries import ORACLES, QUERIES

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("a.com/x", "block"), ("a.com/x/y", "allow"), ("a.com/", "allow"), ("", "allow"), ("org", "block"), ("example-x.org/q", "block")]


def pages():
    rng = random.Random(2)
    hosts = ["example.org", "blog.example.org", "EXAMPLE.org", "xample.org", "a.com", "b.a.com", "aa.com", "example-x.org", "org", "", "x.example-x.org:80", "example.org."]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?q=://b", "/en/2#f/es/", "/fr/x", "/de/", "/x", "/x/y/z", "/q", "/\u00e9"]
    urls_ = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/es/", "://", "a://b://c", "://example.org?x"]
    return [(i, u, "html", "clash") for i, u in enumerate(urls_)] + [(3, urls_[3], None, None), (None, urls_[40], None, None)]


def judge(url, rules):
    host, path = urls.split_url(url)
    fit = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fit.append((len(rule), verdict == "block", rule, verdict))
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("partitions", [1, 7])
def test_urls(spark, partitions):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string").repartition(3)
    got = urls.filter_urls(df, spark.createDataFrame(RULES, "rule string, verdict string"), partitions=partitions).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *judge(r[1], RULES))) for r in rows)
    assert urls.filter_urls(df.limit(0), spark.createDataFrame(RULES, "rule string, verdict string")).count() == 0


def test_url_split_handles_the_parts():
    assert urls.split_url("http://A.Example.ORG/Es/?x#y") == ("a.example.org", "/Es/")
    assert urls.split_url("no") == ("", "") and urls.split_url(None) == ("", "")


def conversations():
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", ""), (None, "bye")]
    rows = [(c, t, *turns[t], "x") for c in range(6) for t in range(c % 5 + 1)]
    rows += [(9, 0, "user", "hi", "x"), (9, 1, "user", "other", "x"), (10, 0, "user", "hi", "x"), (10, 0, "user", "hi", "x"), (None, 0, "user", "alone", "x"), (11, None, "user", "zz", "x")]
    return rows


def test_chat(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string, copies string").repartition(3)
    got = chat.render(df, chat.maximal(df)).collect()
    kept = {r.conv_id: r for r in got}
    assert set(kept) == {4, 9, 10, 11, None}
    assert kept[4].n_turns == 5 and kept[4].copies == 1 and kept[10].n_turns == 2
    assert kept[9].chat == "<|user|>\nhi\n<|end|>\n<|user|>\nother\n<|end|>\n"
    assert chat.render(df.limit(0), chat.maximal(df.limit(0))).count() == 0


def test_chat_copies(spark):
    df = spark.createDataFrame([(c, t, "user", f"t{t}") for c in (7, 3, 5) for t in range(2)] + [(1, 0, "user", "t0")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns, r.copies) for r in chat.maximal(df).collect()] == [(3, 2, 3)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    documents = pd.DataFrame(fx.documents(), columns=[c.split()[0] for c in fx.SCHEMA.split(", ")])[["doc_id", "text", "lang", "source", "n_chars"]].astype({"doc_id": "Int64"})
    documents.to_parquet(d / "documents.parquet")
    text = documents.text
    pd.DataFrame({"item_id": [1, 2], "text": [" ".join(text[9].split()[5:45]), "nothing of the kind here at all"]}).to_parquet(d / "benchmark.parquet")
    pd.DataFrame(pages(), columns=["page_id", "url", "html", "x"])[["page_id", "url", "html"]].astype({"page_id": "Int64"}).to_parquet(d / "pages.parquet")
    pd.DataFrame(conversations(), columns=["conv_id", "turn", "role", "text", "x"])[["conv_id", "turn", "role", "text"]].astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(d / "conversations.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(str(r) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_return_a_row_a_document(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == len(fx.documents())


def test_pipeline_drops_unknown_languages(spark, sf_dir):
    rng = random.Random(8)
    clean = [(i, fx.prose(rng, 120, lang), lang) for i in range(60) for lang in [("en", "de")[i % 2]]]
    made_up = [" ".join(rng.choice(["zvo", "kly", "mra", "bje"]) + rng.choice(["zvo", "kly", "mra", "bje"]) for _ in range(200)) for _ in range(20)]
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x4E00, 0x5600))), "".join(map(chr, range(0x3B1, 0x3CA)))]
    junk = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(200)) for a in alphabets for _ in range(30)]
    rows = clean + [(1000 + i, t, None) for i, t in enumerate(made_up + junk)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    one = language.learn(spark.createDataFrame([(clean[0][1], "a"), (clean[0][1], "b")], "text string, lang string"))
    assert language.least_score(one) < 0.5 and language.least_score({}) > 0


def test_pipeline_decodes_what_it_encodes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.byte_bpe(spark, docs, sf_dir).collect()
    want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(r.decoded_sha256 for r in got) == want and all(r.round_trip for r in got)


def test_stages_keep_columns_whatever_their_names(spark, sf_dir):
    """Every stage but the last, on clashing names, nulls and no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("score", "lang_pred", "_items", "_0", "_row", "_gone", "kept", "n_words", "component_id", "quality", "Text2"):
        docs = docs.withColumn(name, docs["source"])
    want = {tuple(r): k for k, r in enumerate(docs.collect())}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        rows = got.collect()
        assert rows and all(tuple(r) in want for r in rows)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs.drop("text"))


def test_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    ids = [-1 if r.doc_id is None else r.doc_id for r in out.collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = quality.keep_good(docs)
    b = a.join(language.predict(a.select("doc_id", "text"), language.learn(a)).where("lang_pred != 'und'").select("doc_id").distinct(), "doc_id", "left_semi")
    c = neardup.keep_one(b)
    d = decontaminate.keep_clean(c, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    b_null = a.where("doc_id is null").count()  # a null doc_id is linked with nothing
    assert sorted(ids) == sorted([r.doc_id for r in d.where("doc_id is not null").collect()] + [-1] * b_null)
    assert 9 not in ids and 0 in ids and 51 not in ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "decontamination", "byte_bpe"]


def test_chat_orders_ties_by_text(spark):
    rows = [(c, 0, "user", t) for c, ts in {1: "ab", 2: "a", 3: "b", 4: "abz", 5: "q"}.items() for t in ts] + [(6, 0, "user", "q"), (6, 0, "user", None), (None, 0, "user", "q"), (None, 0, None, "a"), (7, 0, "user", "q" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    kept = {r.conv_id: r.chat for r in chat.render(df, chat.maximal(df), "", "\n").collect()}
    # 1 and 2 begin 4; 5 begins 7's text but isn't its first turn; 6 and the nameless one have the null first
    assert kept == {3: "userb\n", 4: "usera\nuserb\nuserz\n", 5: "userq\n", 6: "user\nuserq\n", None: "a\nuserq\n", 7: "user" + "q" * 200_000 + "\n"}


CONTRACT = {
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_stratified_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_superminhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_ngram_trie": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_return_the_agreed_columns(spark, sf_dir, name):
    """Names, kinds and plainly counted values of what the registered queries return."""
    rows = fx.documents()
    got = QUERIES[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    assert {c.split()[0]: kinds.get(c.split()[0]) for c in CONTRACT[name].split(", ")} == dict(c.split() for c in CONTRACT[name].split(", "))
    found = got.collect()
    if name == "op2_quality_rules":
        want = sorted(str((r[0], *fx.base_counts(r[1]))) for r in rows)
        assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in found) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in found)
    if name == "op3_stratified_shards":
        sizes = [sum(r.shard == k for r in found) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in found if r.shard == k) == list(range(sizes[k])) for k in range(8))
    if name == "op5_superminhash":
        assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == fx.components(rows)
        assert sorted(r.n_shingles for r in found) == sorted(len(set(fx.shingles(r[1]))) for r in rows)
    if name in ("op8_language_id", "op10_ngram_trie"):
        k, r0 = (3, 1) if name == "op8_language_id" else (10, 0)
        assert all(r.held_out == (fx.fold(r.doc_id, k) == r0) for r in found)
    if name == "op9_byte_bpe":
        assert sorted(r.decoded_sha256 for r in found) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    if name == "op6_token_counts":
        assert sorted(r.n_bytes for r in found) == sorted(len((r[1] or "").encode()) for r in rows) and all(r.over_limit == (r.n_tokens > 2048) for r in found)
