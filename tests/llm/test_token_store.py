import io
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.token_store import EliasFano, Shard, TextEncoder, read_tokens, shard_count, token_store, write_bounds, write_tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,top", [(0, 0), (1, 0), (1, 5), (700, 3), (5000, 10**6), (3000, 10**12)])
def test_elias_fano_select_and_ranges(n, top):
    rng = np.random.default_rng(n + top)
    values = np.sort(rng.integers(0, top + 1, n))
    coded = EliasFano.encode([values[: n // 3], values[n // 3 :]], n, top + 1)
    assert coded.values(0, n).tolist() == values.tolist()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert coded.values(a, b).tolist() == values[a:b].tolist()
    for i in list(range(0, n, 97)) + ([n - 1] if n else []):
        assert coded.select(i) == values[i]
    if n >= 3000 and top < 10**9:
        assert len(coded.low) + len(coded.high) < n * 8 / 4


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(7)
    plain = Tokenizer.from_file(FILE)
    own = TextEncoder(FILE, 4, remember=50)
    parts = ["a", "it's", "Été", "\n", "\t", " ", "  ", "1234", "<|endoftext|>", "東京", "\xa0", "　", " ", "!!", ".\n", "x_y", "\U0001f600", "'ll", "\r\n", "\x1c", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_shard_random_access():
    out = io.BytesIO()
    docs = [np.arange(k % 7 + 1, dtype="<u2") + k for k in range(1000)]
    for d in docs:
        out.write(d.tobytes())
    write_bounds(out, array("q", range(-5, 2995, 3)), array("I", [len(d) for d in docs]), 2, block=300)
    shard = Shard(io.BytesIO(out.getvalue()))
    for i in (0, 1, 500, 999):
        assert shard.document(i).tolist() == docs[i].tolist() and shard.doc_ids(i, i + 1).tolist() == [3 * i - 5]
    with pytest.raises(ValueError):
        Shard(io.BytesIO(out.getvalue()[:-9]))


def test_any_doc_ids():
    for ids in ([], [7], [-(2**63), 2**63 - 1], [-(2**63), -5, -5, 0, 2**63 - 1], [3] * 9):
        out = io.BytesIO(np.zeros(len(ids), "<u2").tobytes())
        out.seek(0, 2)
        write_bounds(out, array("q", ids), array("I", [1] * len(ids)), 2, block=2)
        shard = Shard(io.BytesIO(out.getvalue()))
        assert shard.doc_ids(0, len(ids)).tolist() == ids and shard.bounds.values(0, len(ids)).tolist() == list(range(1, len(ids) + 1))


def test_round_trip_of_a_table(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rng.choice(["one", "Two,", "été", "4\n5"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rng.shuffle(rows)
    rows += [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "w" * 60_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, path string")
    plain = Tokenizer.from_file(FILE)
    want, at = [], 0
    for doc, text in sorted(rows):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_store(docs, FILE, 2).collect()) == want
    assert token_store(docs.limit(0), FILE, 2).count() == 0
    twice = spark.createDataFrame([(5, "a b"), (5, "a b"), (5, "c"), (None, "d")], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens) for r in token_store(twice, FILE, 2).collect())
    sizes = [n for _, n in got]
    assert sorted(sizes) == [2, 3, 3] and [s for s, _ in got] == [0, sizes[0], sizes[0] + sizes[1]]


def test_shards_are_bounded_whatever_the_partitions(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) for _, t in rows)
    assert shard_count(docs) == 8 and shard_count(docs.limit(0)) == 8
    n = shard_count(docs, 1000)
    assert n == -(-size // 1000) > 20
    manifest = write_tokens(docs, f"file://{tmp_path}/shards", FILE, 2, shards=n).collect()
    assert len(manifest) > 20 and sum(r.n_docs for r in manifest) == 300
    plain, start, want = Tokenizer.from_file(FILE), 0, []
    for i, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in read_tokens(spark, manifest).collect()) == want
