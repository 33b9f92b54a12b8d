"""Plug-in points for models: splitter, embedder, scorers, tokenizers, transcriber. Defaults are deterministic and offline.

A scorer or embedder gets pandas Series in batches (iterator style), so a model is loaded once in a worker.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, f: Callable) -> Callable:
    """Make a plug-in known; kinds: splitter, embedder, scorer, tokenizer, transcriber, rewriter, similarity."""
    _REGISTRY[kind, name] = f
    return f


def get(kind: str, name: str) -> Callable:
    try:
        return _REGISTRY[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} named {name!r}; known: {sorted(n for k, n in _REGISTRY if k == kind)}") from None


def split_sentences(text: str) -> list[tuple[str, int, int]]:
    """Sentences of one paragraph with their spans: an end mark and white space, or a full-width end mark, ends one."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s)|[。！？]+", text):
        if text[start : m.end()].strip():
            out.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    trimmed = []
    for a, b in out:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        trimmed.append((piece.strip(), a, a + len(piece.strip())))
    return trimmed


register("splitter", "regex", split_sentences)
register("splitter", "line", lambda text: [(text.strip(), len(text) - len(text.lstrip()), len(text.rstrip()))] if text.strip() else [])


def hashed_ngrams(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors from signed hashes of character trigrams: near texts are near, and nothing is downloaded."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        padded = f" {t.lower()} "
        for k in range(max(1, len(padded) - 2)):
            h = int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
        out[i] /= np.linalg.norm(out[i]) + 1e-5
    return out


register("embedder", "hashed_ngrams", hashed_ngrams)
register("rewriter", "concat", lambda a, b: f"{a} {b}")
register("similarity", "accept", lambda a, b: 1.0)
register("tokenizer", "whitespace", lambda s: s.split())


def spelled(contents: list[bytes], languages: list[str]) -> list[tuple[str, list[tuple[str, float, float]]]]:
    """A stand-in for a transcriber: the bytes are the text, and each word takes half a second."""
    texts = [bytes(b).decode() for b in contents]
    return [(t, [(w, i / 2, i / 2 + 0.5) for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", t))]) for t in texts]


register("transcriber", "spelled", spelled)


def overlap_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """A stand-in for a neural score of (src, mt, ref): F1 of the words of mt and ref (or src)."""
    for columns in batches:
        mt, ref = columns[1], columns[-1] if len(columns) > 2 else columns[0]
        yield pd.Series([_f1(set(str(a).split()), set(str(b).split())) for a, b in zip(mt, ref)])


def _f1(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


register("scorer", "overlap", overlap_score)


def retry(f: Callable, attempts: int = 3, wait: float = 0.0) -> Callable:
    """Call again after an error; after the last attempt the result is None."""

    def run(*args, **kw):
        for i in range(attempts):
            try:
                return f(*args, **kw)
            except Exception:
                if i + 1 < attempts and wait:
                    time.sleep(wait)
        return None

    return run
