import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattframe.llm import bpe, token_counts
from wattframe.llm.batches import safe_parts
from wattframe.llm.bpe import Coder, MinimumTree

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "a", "it's we'll I'd  they've   two  ", "x" * 3000, "ab" * 2500, "   \x1c\x85 á ‍👩‍👧",
    "<|endoftext|> in <|endoftext|>text", "日本語のテキスト " * 40, "12345678901234567890 1,000.5", "a \t\n b\r\n\r\nc", "é" * 500, "\x00\x01\x7f",
    "word " * 30_000, "noblank" * 10_000, "the  the   the\n" * 5_000,
]


@pytest.fixture(scope="module")
def library():
    coder = Coder.of(RANKS, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_tree():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 7, 8, 9, 40):
        values = [rng.choice([1, 2, 3, MinimumTree.NONE]) for _ in range(n)]
        tree = MinimumTree(values)
        for _ in range(60):
            least = min(values, default=MinimumTree.NONE)
            assert tree.first() == (-1 if least == MinimumTree.NONE else values.index(least))
            if n:
                i = rng.randrange(n)
                values[i] = rng.choice([1, 2, 3, MinimumTree.NONE])
                tree.put(i, values[i])


def test_tree_of_few_nodes():
    rng = random.Random(4)
    for n in (7, 32, 33, 1_024, 1_025, 40_000):
        values = [rng.choice([5, 6, MinimumTree.NONE]) for _ in range(n)]
        tree = MinimumTree(list(values))
        assert sum(map(len, tree.levels)) <= n + n // 16  # short pieces: leaves only
        for _ in range(50):
            i = rng.randrange(n)
            values[i] = rng.choice([4, 5, MinimumTree.NONE])
            tree.put(i, values[i])
            assert tree.first() == values.index(min(values))


def test_every_character(library):
    coder = Coder.of(RANKS, P.PATTERN)
    wrong = []
    for start in range(0, 0x110000, 256):
        text = " ".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in range(start, start + 256) if not 0xD800 <= c < 0xE000)
        if text and coder.encode(text) != b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text)):
            wrong.append(start)
    assert not wrong


def test_round_trip(spark, library):
    rng = random.Random(1)
    alphabet = "aeiou thnrs'éß日😀\n\t ,.0159_"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(150)] + ["same", "same"]
    docs = spark.createDataFrame([(i // 2, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, data string")
    rows = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert rows.columns == ["doc_id", "ids", "data"]
    want = sorted((i // 2, b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(t or "")), (t or "").encode())
                  for i, t in enumerate(texts))
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.data)) for r in rows.collect()) == want
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_digests(spark, library):
    from wattframe.llm.queries import op2_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op2_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_counts(spark):
    own = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(docs, JSON).collect()
    want = [(i // 2, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False))) for i, t in enumerate(ODD)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_counts.token_counts(docs.limit(0), JSON).count() == 0


def test_counts_of_the_table(spark):
    from wattframe.llm.queries import op7_token_counts

    own = Tokenizer.from_file(JSON)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = op7_token_counts(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(own.encode(r.text or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)


def test_other_vocabularies(spark):
    import sentencepiece

    docs = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, "été " * 30_000)], "doc_id long, text string")
    texts = ["Hello  world", "", "été " * 30_000]
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(piece.encode(t)) for t in texts]
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_counts.token_counts(docs, P.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(word.encode(t, add_special_tokens=False)) for t in texts]


def test_safe_parts():
    text = "one two  three\nfour five six"
    assert list(safe_parts(text, 4)) == ["one two  three\nfour", " five", " six"]
    assert "".join(safe_parts(text * 50, 16)) == text * 50
    assert list(safe_parts("", 5)) == [""]


def test_counts_of_columns(spark):
    assert spark.range(1).select(F.lit("a b").alias("t"), "id").transform(
        lambda d: token_counts.token_counts(d, JSON, "id", "t")).collect()[0].n_tokens == 2
