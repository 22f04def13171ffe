import random
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tessera.llm.quality import DIAGONAL, POOL, _discriminant, statistics
from tessera.llm.secrets import fit, redact, scan
from tessera.llm.unigram import Encoder, load
from tests.llm.test_decontaminate import brute


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["tra", "len", "mo", "ti", "sen", "da", "ri"]) for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    docs, labels = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randrange(40, 160))]
        good = i % 4 != 0
        text = " ".join(words) + "." if good else " | ".join(w.upper() for w in words)
        if i % 9 == 1:
            text += " " + items[i % 6][1]
        if i % 7 == 2:
            text += f' token = "{rng.getrandbits(160):040x}" end'
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good)))
    docs += [(500 + i, docs[i][1], "en", "src0", docs[i][4]) for i in (1, 5, 6, 7)]
    docs += [(600 + i, docs[i][1][:-1] + " !", "en", "src0", docs[i][4] + 1) for i in (9, 13)]
    docs += [(700, "", "en", "src0", 0), (701, None, None, None, None), (702, "é" * 30_000, "fr", "src1", 30_000)]
    return docs, labels, items


def plain(docs, labels, items):
    known = {d: q for d, q in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    x = {d: np.array(statistics((t or "").encode())) for d, t, *_ in docs}
    own = [np.array([x[d] for d in known if known[d] == k]) for k in (0, 1)]
    model = _discriminant(np.array([float(len(o)) for o in own]), np.array([o.sum(0) for o in own]), np.array([o.T @ o for o in own]), POOL, DIAGONAL)
    left = {d: (t, s) for d, t, _, s, _ in docs if model.score(x[d][None])[0] >= 0.5}
    words = {d: (t or "").encode().lower().split() for d, (t, _) in left.items()}
    runs = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    label = {d: d for d in left}
    while True:
        new = {d: min(label[o] for o in left if len(runs[d] & runs[o]) >= 0.8 * len(runs[d] | runs[o])) for d in left}
        if new == label:
            break
        label = new
    left = {d: v for d, v in left.items() if label[d] == d}
    clean = {d for d, _, _, _, bad in brute([(d, t) for d, (t, _) in left.items()], items, 10) if not bad}
    forest, coder = fit(), Encoder(load(public_tokenizers.path("piece_bpe_32k.model")))
    return {d: np.frombuffer(coder.encode(redact(t, scan(forest, t, s or "")) if t else ""), "<i4").tolist() for d, (t, s) in left.items() if d in clean}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    docs, labels, items = fixture()
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain(docs, labels, items)
    assert got == want and 60 < len(want) < len(docs) - 20


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, items = fixture()
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.createDataFrame(docs[:40], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes)
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
