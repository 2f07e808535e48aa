import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm import token_files
from lakeloom.llm.token_files import decode_chunk, encode_chunk, read_token_files, write_token_files
from lakeloom.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1 << 15, (1 << 15) + 1, 100_001])
def test_chunk_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    sizes, payload = encode_chunk(ids, kind)
    assert (decode_chunk(sizes, payload, n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_round_trip(spark, docs, kind):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 101, f"text {i} and more! " * (i % 9)) for i in range(101)]
    rows += [(200, None), (201, ""), (202, "long " * 30_000), (-5, "below zero")]
    path = new_path(spark, "test")
    table = docs(*rows).withColumns({c: F.lit(1) for c in ("shard", "start", "chunk")})
    write_token_files(table, path, PATH, kind=kind, shards=4)
    got = read_token_files(spark, path, keep_ids=True).orderBy("start").collect()
    start = 0
    for r, (i, text) in zip(got, sorted(rows), strict=True):
        raw = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(raw) // 4)
        assert bytes(r["ids"]) == raw and r["ids_crc32"] == zlib.crc32(raw)
        start += len(raw) // 4


def test_repeats_null_ids_and_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 16)
    path = new_path(spark, "test")
    write_token_files(docs((None, "a"), (1, "b c"), (1, "b c"), (1, "d")), path, PATH)
    got = read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1] and [r["start"] for r in got][:2] == [0, 2]
    path = new_path(spark, "test")
    write_token_files(docs((1, "x")).limit(0), path, PATH)
    assert read_token_files(spark, path).collect() == []
