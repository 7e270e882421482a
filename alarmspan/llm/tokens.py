"""Byte-level BPE through the faster of two libraries that give the same ids."""
from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE files write a byte as a printable letter: itself if printable, else the next letter from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def one_thread_tokenizer(path: str):
    """A tokenizers object that stays in the task's own thread: cores are Spark's to share out, and threads that come and
    go in a long-lived worker leave memory behind with each task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to a uint32 array of ids, as ``tokenizers`` gives them without added special tokens.

    Plain byte-level files (ids in order of merging, the standard pattern, no normaliser) are loaded into tiktoken, which
    gives the same ids about five times as fast; the tests compare the two.  Any other file runs in tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("byte_fallback")
             and not model.get("ignore_merges") and not model.get("dropout")
             and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")))
    if plain:
        import public_tokenizers
        import tiktoken
        letters = _byte_of_letter()
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in special}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items()}
        coding = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: coding.encode_to_numpy(text, allowed_special="all")
    tokenizer = one_thread_tokenizer(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
