import random

import numpy as np
import pytest

from tests.llm import brute, tables
from tripleweave.llm import tokens
from tripleweave.llm.elias_fano import EliasFano, encode
from tripleweave.llm.queries import word_tokenizer


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 7, 900], list(range(3000)), [2**40]])
def test_elias_fano_round_trip(values):
    e = EliasFano(encode(np.array(values, np.int64)))
    assert e.all().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    r = random.Random(1)
    v = np.cumsum([r.randrange(2000) for _ in range(20_000)])
    data = encode(v)
    assert EliasFano(data).all().tolist() == v.tolist()
    assert 8 * len(data) / len(v) < 2.5 + np.log2(v[-1] / len(v)) + 0.5


def test_encoder_equals_the_library(monkeypatch):
    from tokenizers import Tokenizer

    texts = [t for _, t in tables.rows()][:-4] + ["It's <|endoftext|>. don't! naïve... ÀÉ.. x²! ª. µ, º) İstanbul ﬁ 12,34. 'tis. e\u0301. \x1c y\x85z Ω, ½. ³.", "CAN'T. can't.' word.) »."]
    plain = Tokenizer.from_file(word_tokenizer())
    for memory in (600_000, 50):
        monkeypatch.setattr(tokens, "MEMORY", memory)
        e = tokens.Encoder(word_tokenizer())
        for _ in range(2):
            ids, n = e.encode([t.encode() if t is not None else None for t in texts])
            at = 0
            for t, k in zip(texts, n.tolist()):
                assert ids[at : at + k].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2]
                at += k
            assert at == len(ids)


def test_table_matches_brute_force(spark):
    given = tables.rows()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.tokenized(tables.frame(spark), word_tokenizer(), shard_ids=300).collect()}
    assert got == brute.tokens(given, word_tokenizer())


def _same_as_library(path, texts):
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(path), tokens.Encoder(path)
    ids, n = e.encode([t.encode() if t is not None else None for t in texts])
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    return e


def test_other_tokenizers_get_the_librarys_ids(spark, tmp_path):
    import json

    from tokenizers import Tokenizer, models, pre_tokenizers

    texts = [None, "", "Hello World. hello world.", "  two  spaces\nand lines ", "É ñ 漢字 It's"]
    cased = Tokenizer(models.WordLevel({"[UNK]": 0, "Hello": 3, "hello": 4, "World": 5, "world": 6, ".": 7}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.Whitespace()
    cased.save(f"{tmp_path}/cased.json")
    assert not _same_as_library(f"{tmp_path}/cased.json", texts).by_word
    byte_level = word_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    assert not _same_as_library(byte_level, texts).by_word
    said = json.load(open(word_tokenizer()))
    said["normalizer"]["normalizers"].pop()  # cased, but else the same
    json.dump(said, open(f"{tmp_path}/other.json", "w"))
    assert not _same_as_library(f"{tmp_path}/other.json", texts).by_word
    assert _same_as_library(word_tokenizer(), texts).by_word
    given = tables.rows()[:12]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.tokenized(tables.frame(spark, given), byte_level, shard_ids=300).collect()}
    assert got == brute.tokens(given, byte_level)


def test_files_and_select(spark, tmp_path):
    docs = tables.frame(spark, [(3, "b c"), (None, "x"), (3, "a"), (-5, None)])
    path = f"{tmp_path}/table"
    tokens.write_shards(docs, word_tokenizer(), path, shard_ids=4)
    n = tokens.save_files(spark, path, str(tmp_path))
    shards = [tokens.Shard((tmp_path / f"shard-{i:06d}.tks").read_bytes()) for i in range(n)]
    assert [d for s in shards for d in s.doc_ids] == [None, -5, 3, 3]
    for s in shards:
        assert sum(len(s.document(i)) for i in range(s.n_docs)) == s.n_ids
        assert all(s.document(i)[-1] == 2 for i in range(s.n_docs))
    assert tokens.tokenized(docs.limit(0), word_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        tokens.Shard(b"x" * 64)


def test_the_encoders_memory_is_bounded_by_its_pieces():
    """What it takes besides the words it remembers, with 8 MB of text in a batch."""
    import tracemalloc

    import pyarrow as pa

    from tripleweave.llm.textmap import pieces

    r = random.Random(2)
    texts = [tables.words(r, 2000, 3000) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["d", "t"])
    e = tokens.Encoder(word_tokenizer())
    e.encode([x.encode() for x in texts[:100]])
    tracemalloc.start()
    try:
        n = sum(len(ids) for _, part in pieces(batch, 1, tokens.PIECE_BYTES) for ids, _ in [e.encode(part)])
        assert n > 1_600_000 and tracemalloc.get_traced_memory()[1] < 50 << 20, tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
