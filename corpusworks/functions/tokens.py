"""Token counts by a given tokenizer file."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How byte-pair vocabularies of this family cut a text before merging, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Number of tokens per text, by the library that a file's ending asks for: .json, .tiktoken or .model."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        made = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(made.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in made.encode(texts, num_threads=1)]
    raise ValueError(f"no tokenizer library for {path}")


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text by the tokenizer at ``path``, a file that every executor can open; a null text has none."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        lengths, counted = texts.fillna("").tolist(), encoder(path)
        out: list[int] = []
        for at in range(0, len(lengths), 256):
            out += counted(lengths[at : at + 256])
        return pd.Series(out, dtype="int64")

    return count(text)
