"""Token ids of a public byte-level BPE vocabulary, for batches inside tasks.

The ids are those of the ``tokenizers`` library for the same vocabulary (tests compare them);
the rank file is read with tiktoken, which needs a fifth of the CPU time.
"""

from __future__ import annotations

import base64
import functools
import re

import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k"
END_OF_TEXT = {"<|endoftext|>": 50256}
#: A superset of the white space that the pattern's \s stands for.
_SPACE_RUN = re.compile(r"\s\s")
_LOOK_AHEAD = r"\s+(?!\S)|"


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """text -> list of ids; one per worker process."""
    path = public_tokenizers.path(f"{vocabulary}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = public_tokenizers.PATTERN
    if _LOOK_AHEAD not in pattern:
        raise ValueError("the vocabulary's pattern is not the expected one")
    # look-ahead only matters after two white spaces in a row and is slow to run
    exact = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens=END_OF_TEXT)
    quick = tiktoken.Encoding(
        f"{vocabulary}-quick",
        pat_str=pattern.replace(_LOOK_AHEAD, ""),
        mergeable_ranks=ranks,
        special_tokens=END_OF_TEXT,
    )

    def encode(text: str) -> list[int]:
        chosen = exact if _SPACE_RUN.search(text) else quick
        return chosen.encode(text, allowed_special="all")

    return encode
