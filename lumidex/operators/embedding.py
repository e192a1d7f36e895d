"""Texts to vectors in tasks: a hashing embedder without a model, and an ONNX one where a model is there."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.config import DIMENSIONS
from lumidex.functions.text import fts_tokens_of


class HashingEmbedder:
    """Signed feature hashing of tokens, of unit length; the same text gives the same vector in any batch. A text without tokens
    gives zeros."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, text in enumerate(texts):
            for token in fts_tokens_of(text or ""):
                h = xxhash.xxh64_intdigest(token)
                out[i, h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OnnxEmbedder:
    """Masked mean of a model's token states, of unit length. The folder holds tokenizer.json and onnx/model.onnx; texts are cut
    and padded to 512 tokens. Sessions are made once a process with one thread."""

    _sessions: dict[str, tuple] = {}

    def __init__(self, folder: str, dimensions: int = DIMENSIONS):
        self.folder, self.dimensions = os.path.expanduser(folder), dimensions

    @staticmethod
    def available(folder: str) -> bool:
        return os.path.exists(os.path.join(os.path.expanduser(folder), "onnx", "model.onnx"))

    def _session(self) -> tuple:
        if self.folder not in self._sessions:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
            tokenizer.enable_padding(length=512)
            tokenizer.enable_truncation(max_length=512)
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            self._sessions[self.folder] = (tokenizer, onnxruntime.InferenceSession(os.path.join(self.folder, "onnx", "model.onnx"), options))
        return self._sessions[self.folder]

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dimensions), np.float32)
        tokenizer, session = self._session()
        encoded = tokenizer.encode_batch([t or "" for t in texts])
        ids = np.array([e.ids for e in encoded], np.int64)
        mask = np.array([e.attention_mask for e in encoded], np.int64)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
        mean = (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def chosen_embedder(*folders: str, dimensions: int = DIMENSIONS):
    """The model in the first of the folders that holds one (the user's, then the one that comes with the program), else the hashing embedder."""
    return next((OnnxEmbedder(f, dimensions) for f in folders if f and OnnxEmbedder.available(f)), None) or HashingEmbedder(dimensions)


def embed_column(rows: DataFrame, text_col: str, embedder=None, out: str = "embedding") -> DataFrame:
    """rows plus the embedding of a text column, in Arrow batches."""
    embedder = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed(texts.tolist())), index=texts.index, dtype=object)

    return rows.withColumn(out, run(text_col))
