"""The pipeline's rows against a brute-force version of its stages after the first, and its stages on awkward rows."""

import hashlib
import struct

import pytest

import corpus_pipeline
from zonalis.llm import jaccard, mixing, substrings
from zonalis.llm.queries import tokenizer_path


def test_rows_equal_brute_force(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    kept = jaccard.brute_kept([(i, r["text"]) for i, r in rows.items()])
    rows = [rows[i] for i in kept]
    texts = [r["text"] for r in rows]
    texts = [t if not gone else left for t, (_, gone, left) in zip(texts, substrings.brute_remove(texts))]
    copies = mixing.brute_copies([(r["doc_id"], t, r["source"]) for r, t in zip(rows, texts)])
    want = []
    for r, t, n in zip(rows, texts, copies):
        ids = library.encode(t, add_special_tokens=False).ids
        want += [(r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())] * n
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), sf).columns == docs.columns


def test_ids_are_token_ids(spark, sf):
    row = corpus_pipeline.tokens(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(1), sf).first()
    assert len(struct.unpack(f"<{row['n_tokens']}I", row["ids"])) == row["n_tokens"]


#: Names that the operators use inside.
CLASHING = "doc_id bigint, text string, lang string, source string, key int, row string, size int, kept boolean, wanted int, found string"
LONG = " ".join(f"w{i}" for i in range(60))


def awkward(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG + " end"), (3, None), (4, ""), (5, " \n"), (None, "a b c"), (None, "a b c"), (6, "solo"), (7, "x" * 50_000)]
    return spark.createDataFrame([(i, t, None, None if (i or 0) % 2 else "s", 1, "r", 2, True, 3, "f") for i, t in rows], CLASHING)


@pytest.mark.parametrize("at, ids", [(0, None), (1, [1, 3, 6, 7, None]), (2, [1, 1, 2, 3, 4, 5, 6, 7, None, None]), (3, None)])
def test_stages_on_awkward_rows(spark, at, ids):
    stage = corpus_pipeline.STAGES[at][1]
    docs = awkward(spark)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    if ids is not None:
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted(ids, key=str)
    assert stage(spark, docs.where("key = 0"), "").count() == 0


def test_repeated_rows_lose_their_windows(spark):
    rows = corpus_pipeline.repeated_substrings(spark, awkward(spark), "").collect()
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 7)} == {1: "", 2: "end", 3: None, 4: "", 7: "x" * 50_000}


def test_mixture_of_awkward_rows_keeps_to_the_rates(spark):
    docs = awkward(spark)
    want = mixing.brute_copies([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert corpus_pipeline.mixture(spark, docs, "").count() == sum(want)


def test_tokens_of_awkward_rows(spark):
    rows = corpus_pipeline.tokens(spark, awkward(spark), "").collect()
    assert len(rows) == 10 and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (3, 4))
    assert corpus_pipeline.tokens(spark, awkward(spark).where("key = 0"), "").count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stages_pass_map_columns_on(spark, at):
    stage = corpus_pipeline.STAGES[at][1]
    docs = awkward(spark).selectExpr("*", "map('a', doc_id) as extra", "array(struct(map(1, text) as m)) as nested")
    out = stage(spark, docs, "")
    if at < 4:
        assert out.columns == docs.columns and all(r["extra"] == {"a": r["doc_id"]} for r in out.collect())
    else:
        assert out.count() == 10
