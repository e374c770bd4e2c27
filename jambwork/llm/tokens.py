"""Token ids of public vocabularies. Their files' paths are parameters; workers load each once."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def byte_pairs(path: str):
    """A function from texts to lists of ids, without special tokens, of the byte-level vocabulary in the JSON file.

    Where a file of the same name's ranks lies beside it, these encode, to the same
    ids but faster; texts that spell a special token go to the JSON's tokenizer.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = [x.content for x in own.get_added_tokens_decoder().values()]
    ranks = Path(path).with_suffix(".tiktoken")
    plain = lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    if not ranks.exists():
        return plain
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding(ranks.name, pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [plain([x])[0] if any(s in x for s in special) else fast.encode_ordinary(x) for x in texts]

    return encode


@lru_cache(2)
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the offsets of each list."""
    off = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    out = np.empty(off[-1], np.int64)
    for x, a, b in zip(lists, off[:-1].tolist(), off[1:].tolist(), strict=True):
        out[a:b] = x
    return out, off
