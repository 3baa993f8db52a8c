"""Token counts by a public tokenizer whose files lie in a folder given as a parameter."""

from __future__ import annotations

import base64
import importlib.util
import re
from functools import lru_cache
from pathlib import Path

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: White space as the tokenizer's pattern has it, 1,000 characters or more.
_GAP = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    lines = (Path(folder) / name).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, folder: str = TOKENIZERS, name: str = VOCABULARY) -> list[int]:
    """The tokenizer's ids of the whole text; none of an empty or null one.

    Very long white space, which its pattern can't match in one go, is cut out where the pattern ends a match anyway: such a run
    but for its last character before a word is a match of its own.
    """
    if not text:
        return []
    enc = encoder(folder, name)
    out, at = [], 0
    for run in _GAP.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])
