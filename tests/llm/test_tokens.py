import hashlib
import random

import numpy as np
import public_tokenizers
import tokenizers

from loomgraph.llm import merging, sentencepiece_bpe, token_counts

PARTS = ["a", "b", " ", "  ", "\n", "▁", "é", "漢", "\t", "<s>", "<0x0A>", "<|endoftext|>", "'s", "'ll", "don't", "the", "ing", "🙂", "́", "1", "23", "\x00", "\x1c", " ", "\r\n", "ﬁ", "ｶ", "​", "²", "½", "_", "!!", "Ⅷ", "\x85", "　", " "]


def fuzz(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["ab" * 500, " " * 700 + "a", "\n" * 5, "漢字" * 300, ""]


def test_sentencepiece_equals_the_library():
    m = sentencepiece_bpe.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    texts = fuzz(4000)
    ids = m.library.encode(texts)
    for (n, joined, decoded), want, text in zip(m.encode(texts), ids, m.library.decode(ids), strict=True):
        assert decoded.decode() == text
    for (n, joined, _), want in zip(m.encode(texts), ids, strict=True):
        assert (n, joined.decode()) == (len(want), ",".join(map(str, want))) and m.decode(want) == m.library.decode(want)


def test_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    m, lib, texts = token_counts.ByteModel(path), tokenizers.Tokenizer.from_file(path), fuzz(6000)
    assert m.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(m.whole) > 50_000  # vocabulary strings proved to be one token alone


def test_heap_and_rounds_agree():
    m = sentencepiece_bpe.model(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(300):
        sym = m.char_id[[ord(c) for c in "".join(rng.choices("▁abetinohs", k=rng.randint(1, 60)))]]
        out, sizes = m.merges.run(sym, np.array([len(sym)]))
        assert out.tolist() == m.merges.one(sym.tolist())
    assert merging.LONG > 60


def test_queries_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "hello world"), (3, "x" * 50_000), (3, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as n_tokens")
    got = sentencepiece_bpe.encode(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and all(r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == empty for r in got if r.doc_id in (1, 2))
    counts = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(r.n_bytes for r in counts) == [0, 0, 11, 50_000, 50_000] and sum(r.over_limit for r in counts) == 2
    assert token_counts.token_counts(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert sentencepiece_bpe.encode(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_collector_is_on_again():
    import gc

    from loomgraph.llm.common import without_gc

    assert [gc.isenabled() for _ in without_gc(iter([1, 2]))] == [False, False] and gc.isenabled()


def test_written_tables_can_be_dropped(spark, tmp_path):
    from pathlib import Path

    from loomgraph.llm import common

    base = Path(common.shared_dir(spark).removeprefix("file:"))
    since = common.written()
    first, second = common.materialise(spark.range(3), "dropped"), common.materialise(spark.range(4), "kept")
    common.drop_written(spark, since, 1)
    assert second.count() == 4 and not list(base.glob("loomgraph-dropped-*")) and common.written() == since + 1
    common.drop_written(spark, since)
    assert not list(base.glob("loomgraph-kept-*"))
