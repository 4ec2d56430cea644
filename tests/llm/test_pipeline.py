"""Stages of the pipeline on the given table, each written and read again, against brute force."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from starlens.llm.catalog import ORACLES, QUERIES, tokenizer_path
from tests.llm.test_shingle_dedup import shingles, similarity
from tests.llm.test_simhash_dedup import brute_components


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    out = [spark.read.parquet(f"{data}/documents.parquet")]
    for i, (_, apply) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        apply(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns


def test_language_keeps_clean_documents(steps):
    want = {r.doc_id for r in steps[0].collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in steps[1].collect()} == want


def test_lines_keep_all_documents(steps):
    assert steps[1].select("doc_id").exceptAll(steps[2].select("doc_id")).count() == 0
    assert steps[2].count() == steps[1].count()


def test_kept_documents_keep_their_texts(steps):
    same = {r.doc_id: r.text for r in steps[2].collect()}
    assert all(r.text == same[r.doc_id] for r in steps[3].collect())


def test_one_document_of_each_similar_group(steps):
    """A similarity of 0.8 or more on five-word shingles links."""
    texts = {r.doc_id: shingles(r.text) for r in steps[2].collect()}
    groups = brute_components(sorted(texts), lambda a, b: similarity(texts[a], texts[b]) >= 0.8)
    assert {r.doc_id for r in steps[3].collect()} == set(groups.values())


def test_fingerprints_link_documents(spark):
    """Texts that mostly repeat one phrase have near fingerprints, though few of their different shingles are shared."""
    phrase = "one phrase again " * 200
    own = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    rows = [(9, phrase + own[0]), (4, phrase + own[1]), (None, own[2]), (7, own[2] + " " + own[0]), (3, own[1] + " end"), (6, phrase + own[1])]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 7]


def test_null_ids_share_nothing(spark):
    """Of documents without ids one alone keeps a boilerplate line, and different ones all stay."""
    rows = [(None if i % 3 == 0 else i, f"own{i} a{i} b{i} c{i} d{i}\nsign up here", "en", f"s{i}", 0) for i in range(36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.remove_boilerplate(spark, docs, "")
    texts = [r.text for r in lines.collect()]
    assert sorted(t.split("\n")[0] for t in texts) == sorted(r[1].split("\n")[0] for r in rows)
    assert sum("sign up here" in t for t in texts) == 1
    assert corpus_pipeline.drop_near_duplicates(spark, lines, "").count() == len(rows)


def test_mix_reaches_targets(steps):
    size, mix = defaultdict(int), defaultdict(int)
    for r in steps[3].collect():
        size[r.source] += len(r.text.split())
    for r in steps[4].collect():
        mix[r.source] += len(r.text.split())
    assert abs(sum(mix.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(mix[s] <= 2 * size[s] for s in size)


def test_packs_every_document(steps):
    before = Counter(r.doc_id for r in steps[4].collect())
    after = Counter(r.doc_id for r in steps[5].where("start = 0").collect())
    assert before == after


def test_run(spark, data, steps):
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, data).collect())
    assert got == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in steps[5].collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(found.fetchall())


def test_tokenizer_is_a_parameter():
    assert tokenizer_path().endswith("word_bpe_49k.json")
