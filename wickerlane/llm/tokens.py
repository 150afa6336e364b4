"""Text sizes in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that splits text before the merges of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a ``.tiktoken``, ``.json`` or ``.model`` file, as a function from texts to lists of ids."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [e.encode_ordinary(t) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: p.encode(texts, num_threads=1)


def token_count(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty. The file must lie at the same path on every executor."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary)
        for s in batches:
            n = pd.Series(0, index=s.index, dtype="int64")
            there = s[s.notna() & (s != "")]
            n[there.index] = [len(x) for x in encode(there.tolist())] if len(there) else []
            yield n

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # Declared non-deterministic, so that a filter on the count doesn't make the optimizer count twice.
    return F.pandas_udf(count, "bigint").asNondeterministic()(F.col(text) if isinstance(text, str) else text)
