"""Byte-level BPE of Arrow text columns by tiktoken, into numpy ids."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import SLICE_BYTES, slices, text_buffer

TOKENIZERS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: The fixed pre-tokenization pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A free id of both vocabularies.
END_OF_TEXT = 50_256


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class BpeEncoder:
    def __init__(self, path: str):
        self.bpe = encoding(path)

    def one(self, text: str | None) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; a null has 0."""
        return np.array([len(self.one(t)) for t in texts], np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint16; a null has none."""
        return [self.one(t).astype(np.uint16) for t in texts]


def text_slices(batch: pa.RecordBatch, at: int, limit: int = SLICE_BYTES):
    """The batch in row ranges of about `limit` bytes of its column `at`."""
    _, offs, _ = text_buffer(batch.column(at))
    for lo, hi in slices(offs, limit):
        yield batch.slice(lo, hi - lo)
