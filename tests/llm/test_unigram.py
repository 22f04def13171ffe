import random

import public_tokenizers
import pytest

from tessera.llm.unigram import MARK, Encoder, build, decode, encode, load, round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return Encoder(load(MODEL))


def brute(vocabulary, text):
    """Best total by trying all segmentations into pieces (no unknown characters)."""
    scores = {p: s for p, s, kind in vocabulary if kind == "normal"}
    best = {0: 0.0}
    for end in range(1, len(text) + 1):
        best[end] = max((best[i] + scores[text[i:end]] for i in range(end) if i in best and text[i:end] in scores), default=float("-inf"))
    return best[len(text)]


def test_viterbi_against_all_segmentations():
    rng = random.Random(1)
    pieces = sorted({"".join(rng.choice("abc" + MARK) if not k else rng.choice("abc") for k in range(rng.randrange(1, 6))) for _ in range(120)} | set("abc" + MARK))
    vocabulary = [(p, -rng.random() * 9, "normal") for p in pieces]
    own = Encoder(build(vocabulary))
    for _ in range(200):
        text = MARK + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        ids = own.segment(text)
        assert "".join(vocabulary[i][0] for i in ids) == text
        assert abs(sum(vocabulary[i][1] for i in ids) - brute(vocabulary, text)) < 1e-9


def test_same_ids_as_the_public_unigram_encoder(coder):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    import sentencepiece

    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    public = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    import numpy as np

    for text in ["hello world", " two  spaces ", "Être naïve, 東京 \U0001f600!", "a\nb\tc", "x" * 40, "tokens = 12345", "é", "  ", "Thheation thatesha ndble"]:
        assert np.frombuffer(coder.encode(text), "<i4").tolist() == public.encode(text), text


def test_words_are_the_same_as_whole_texts(coder):
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab é\n. 東\U0001f600") for _ in range(rng.randrange(1, 60)))
        import numpy as np

        whole = coder.segment(MARK + text.replace(" ", MARK))
        assert np.frombuffer(coder.encode(text), "<i4").tolist() == whole
        assert coder.decode(coder.encode(text)) == text


def test_memory_is_bounded():
    small = Encoder(load(MODEL), remember=10)
    full = Encoder(load(MODEL))
    for i in range(100):
        text = f"word{i} other{i * 7} again"
        assert small.encode(text) == full.encode(text)
        assert len(small.known) < 20


def test_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, 4), (None, "", 5), (1, "a b", 3), (4, "y" * 50_000, 1), (5, f"a{MARK}b", 1)], "doc_id long, text string, ids int")
    found = encode(docs).collect()
    assert [r.n_tokens for r in found][:4] == [found[0].n_tokens, 0, 0, found[0].n_tokens]
    assert sorted(r.text for r in decode(encode(docs)).collect()) == sorted(["a b", "", "", "a b", "y" * 50_000, "a b"])
    assert [r.lossless for r in round_trip(docs).collect()] == [True] * 5 + [False]
    assert encode(docs.limit(0)).count() == 0 and round_trip(docs.limit(0)).count() == 0


def test_odd_ids_are_shown_as_unknown_pieces(spark, coder):
    n = len(coder.p.shown)
    ids = [encode(spark.createDataFrame([(1, "word")], "doc_id long, text string")).first().ids]
    rows = [(1, ids[0]), (2, [*ids[0], None]), (3, [-5, *ids[0]]), (4, [n]), (5, [2**31 - 1]), (6, None), (7, [])]
    out = {r.doc_id: r.text for r in decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert out == {1: "word", 2: "word ⁇ ", 3: "⁇  word", 4: "⁇ ", 5: "⁇ ", 6: "", 7: ""}


def test_a_file_is_loaded_once(spark):
    import time

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    encode(docs)
    began = time.time()
    encode(docs)
    assert time.time() - began < 1
