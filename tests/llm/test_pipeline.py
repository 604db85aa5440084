import collections

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from wattframe.llm.bpe import Coder
from .test_ngram_join import expected
from .test_substrings import without_repeated_bytes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "the and of the " * 20, "en", None, 1), (9001, None, None, "src1", None), (9002, "", "en", "src1", 0), (9003, "%% 12 !!", "en", "src2", 8),
           (9004, "漢字仮名交じり文の例文です。" * 30, None, "src2", 1), (9005, "the and in that was this " * 400, "en", "src3", 1)]
    return given.unionByName(spark.createDataFrame([*odd, odd[-1], odd[0]], SCHEMA)).cache()


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        out[name] = now.collect()
        assert name == "tokens" or now.columns == docs.columns
        now = spark.createDataFrame(out[name], now.schema)
    return out


def texts(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


def test_language(docs, stages):
    gone = texts(docs.collect()) - texts(stages["language"])
    assert {i for i, _ in gone} == {9001, 9002, 9003, 9004}


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages["language"]]
    kept = texts(stages["near_duplicates"])
    groups = expected(rows, 5, 80, 100)
    assert sum(kept.values()) == len({(c if c is not None else "none") for _, _, c in groups})
    assert {i for i, _ in kept} == {c for _, _, c in groups}


def test_suffixes(stages):
    want = without_repeated_bytes([(r.doc_id, r.text) for r in stages["near_duplicates"]], 400)
    want = sorted((str(i), bytes.fromhex(kept).decode("utf-8", "ignore")) for i, n, gone, _, kept in want if gone < n or n == 0)
    assert sorted((str(r.doc_id), r.text) for r in stages["suffixes"]) == want
    assert all(r.n_chars == len(r.text) for r in stages["suffixes"])


def test_mix(stages):
    size = collections.Counter()
    for r in stages["suffixes"]:
        size[r.source] += len(r.text.split())
    taken = collections.Counter()
    for r in stages["mix"]:
        taken[r.source] += len(r.text.split())
    assert not texts(stages["mix"]).keys() - texts(stages["suffixes"]).keys()
    assert max(texts(stages["mix"]).values()) <= 3
    assert abs(sum(taken.values()) / sum(size.values()) - 1) < 0.25


def test_tokens(stages):
    coder = Coder.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    want = sorted((str(r.doc_id), b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(r.text))) for r in stages["mix"])
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in stages["tokens"]) == want


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and set(got.columns) == {"doc_id", "n_tokens", "ids"}
