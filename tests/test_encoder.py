import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekframe import serve
from seekframe.functions.encoder import INSTRUCTION, WIDTH, TextEncoder, weights_in, width_in
from seekframe.functions.wordpiece import WordPieces
from seekframe.options import EngineOptions
from seekframe.plans.search import Engine

pytest.importorskip("onnxruntime")

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "fox", "owl", "##s", "tea", "风", *dict.fromkeys(INSTRUCTION)]
TABLE = np.random.default_rng(1).normal(size=(len(VOCAB), 6)).astype(np.float32)


def field(number, value):
    """A field of the wire format of model files: a varint, or bytes with their length."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def lookup_model() -> bytes:
    """A model whose hidden states are rows of TABLE."""
    shape = lambda *dims: b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    value = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape(*dims))))
    node = field(1, "table") + field(1, "input_ids") + field(2, "hidden") + field(4, "Gather")
    held = field(1, TABLE.shape[0]) + field(1, TABLE.shape[1]) + field(2, 1) + field(8, "table") + field(9, TABLE.tobytes())
    graph = field(1, node) + field(2, "g") + field(5, held) + field(11, value("input_ids", 7, "b", "s")) + field(11, value("attention_mask", 7, "b", "s")) + field(12, value("hidden", 1, "b", "s", TABLE.shape[1]))
    return field(1, 8) + field(8, field(2, 13)) + field(7, graph)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("model")
    (path / "deep" / "er").mkdir(parents=True)
    for file in ("deep/er/m.onnx", "deep/er/longer.onnx"):
        (path / file).write_bytes(lookup_model())
    (path / "vocab.txt").write_text("\n".join(VOCAB), encoding="utf-8")
    (path / "config.json").write_text('{"hidden_size": 6}')
    return path


def wanted(text, first_token, most=512):
    rows = TABLE[WordPieces(VOCAB).encode(text, most)[0]]
    v = rows[0] if first_token else rows.mean(axis=0)
    return v / np.linalg.norm(v)


def test_weights_and_width(folder, tmp_path):
    assert weights_in(folder).name == "m.onnx" and width_in(folder) == 6 and width_in(tmp_path) == WIDTH
    with pytest.raises(FileNotFoundError):
        weights_in(tmp_path)
    (tmp_path / "onnx").mkdir()
    for name in ("onnx/model_quantized.onnx", "a.onnx"):
        (tmp_path / name).write_bytes(b"")
    assert weights_in(tmp_path).name == "model_quantized.onnx"


@pytest.mark.parametrize("first_token", [True, False])
def test_texts_are_encoded_one_like_many(spark, folder, first_token):
    texts = ["fox", "owls", "fox tea fox", "风 tea owl", "zzz", "fox " * 700, "", None] + ["tea owl"] * 70
    encoder = TextEncoder(spark, str(folder), first_token)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = rows.select("i", encoder(F.col("t")).alias("v"), encoder.query(F.col("t")).alias("q")).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.i] or ""
        assert np.allclose(r.v, wanted(text, first_token) if text else np.zeros(6), atol=1e-5)
        assert np.allclose(r.q, wanted(INSTRUCTION + text, first_token), atol=1e-5)


def test_engine_with_an_encoder(spark, folder, tmp_path):
    rows = [("a", "", "", "fox fox", ""), ("b", "", "", "owls", ""), ("c", "", "", "tea", "")]
    docs = spark.createDataFrame(rows, "ext_id string, url string, title string, body string, tags string")
    encoder = TextEncoder(spark, str(folder), first_token=False, instruct=False)
    engine = Engine.build(docs, EngineOptions(mining=False), encoder=encoder)
    found = engine.search("owls", "vector").hits.collect()
    assert found[0].id == "b" and len(found) == 3 and engine.stats()["encoder"] == "given"
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": r[0], "body": r[3]}) + "\n" for r in rows))
    out = io.StringIO()
    assert serve.main(["search", "tea", "--mode", "vector", "--corpus", str(tmp_path), "--model", str(folder), "--mean-pooling", "--no-instruction", "--no-mining"], spark, out) == 0
    assert json.loads(out.getvalue().splitlines()[0])["id"] == "c"
