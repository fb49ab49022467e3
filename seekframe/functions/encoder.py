"""A neural text encoder from a folder of weights, as Column functions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .wordpiece import WordPieces

#: Fixed value: what the usual Chinese retrieval models expect before a query.
INSTRUCTION = "为这个句子生成表示以用于检索文章："
#: Width of the vectors if neither the model nor its config.json tells.
WIDTH = 512


def weights_in(folder: str | Path) -> Path:
    """onnx/model_quantized.onnx of a folder, else its .onnx file of the shortest path, up to three levels down."""
    folder = Path(folder)
    usual = folder / "onnx" / "model_quantized.onnx"
    found = [usual] if usual.is_file() else [p for n in range(3) for p in folder.glob("*/" * n + "*") if p.is_file() and p.suffix.lower() == ".onnx"]
    if not found:
        raise FileNotFoundError(f"{folder} has no .onnx file")
    return min(found, key=lambda p: (len(str(p)), str(p)))


def width_in(folder: str | Path) -> int:
    try:
        return int(json.loads((Path(folder) / "config.json").read_text(encoding="utf-8"))["hidden_size"])
    except (OSError, ValueError, KeyError, TypeError):
        return WIDTH


class TextEncoder:
    """encoder(text) for documents and encoder.query(text) for queries: unit vectors; null or empty texts have zeros.

    The weights are one file of a fixed size: they are broadcast, so only the driver reads the folder. A task makes one
    session for one core and runs texts of equal length together, which needs no padding.
    """

    def __init__(self, spark: SparkSession, folder: str, first_token: bool = True, most: int = 512, instruct: bool = True, batch: int = 32) -> None:
        self.weights = spark.sparkContext.broadcast(weights_in(folder).read_bytes())
        self.pieces = WordPieces((Path(folder) / "vocab.txt").read_text(encoding="utf-8").splitlines())
        self.width, self.first_token, self.most, self.batch = width_in(folder), first_token, max(16, most), batch
        self.instruction = INSTRUCTION if instruct else ""

    def query(self, text: Column) -> Column:
        return self(F.concat(F.lit(self.instruction), F.coalesce(text, F.lit(""))))

    def __call__(self, text: Column) -> Column:
        weights, pieces, width, first_token, most, size = self.weights, self.pieces, self.width, self.first_token, self.most, self.batch

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            session = onnxruntime.InferenceSession(weights.value, options, providers=["CPUExecutionProvider"])
            taken, told = {i.name for i in session.get_inputs()}, session.get_outputs()[0].shape[-1]
            zeros = np.zeros(told if isinstance(told, int) else width, np.float32)
            for texts in batches:
                out, ids = [zeros] * len(texts), [pieces.encode(t, most)[0] if t else [] for t in texts]
                order = sorted((i for i in range(len(ids)) if ids[i]), key=lambda i: len(ids[i]))
                while order:
                    n = len(ids[order[0]])
                    now = [i for i in order[:size] if len(ids[i]) == n]
                    order = order[len(now) :]
                    rows = np.array([ids[i] for i in now], np.int64)
                    given = {"input_ids": rows, "attention_mask": np.ones_like(rows), "token_type_ids": np.zeros_like(rows)}
                    hidden = session.run(None, {k: v for k, v in given.items() if k in taken})[0]
                    found = hidden[:, 0] if first_token else hidden.mean(axis=1)
                    norms = np.linalg.norm(found, axis=1, keepdims=True)
                    for i, v in zip(now, np.divide(found, norms, out=np.zeros_like(found), where=norms > 0)):
                        out[i] = v
                yield pd.Series(out)

        return encode(text)
