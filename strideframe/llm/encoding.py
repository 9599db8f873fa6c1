"""Exact token ids of whole texts, word by word with a bounded memory of words already encoded.

The vocabulary's pre-tokenizer never joins characters across ASCII white space and its normaliser
(composition, white space to one space, lower case) doesn't look across it either. A text's ids are
therefore the ids of its white-space-separated words, end to end, and each distinct word needs the
tokenizers library once. The tests hold this against encoding whole texts. A vocabulary whose normaliser or
pre-tokenizer isn't of this kind is recognised on loading, and its texts are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import chain, islice

import numpy as np

from . import common


class _Index(dict):
    def __init__(self, *items):
        super().__init__(*items)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at


def splits_at_white_space(config: dict) -> bool:
    """Whether the pre-tokenizer drops all white space and no normaliser looks across it."""
    parts = lambda x, name: [] if not x else x[name] if x["type"] == "Sequence" else [x]
    first, *rest = parts(config.get("pre_tokenizer"), "pretokenizers") or [{"type": None}]
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in parts(config.get("normalizer"), "normalizers"))
    # the pieces that are kept: none of them may hold white space
    kept = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and " " not in first["pattern"]["Regex"] and r"\s+" not in first["pattern"]["Regex"]
    return plain and kept and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in rest) and not config.get("post_processor")


class WordEncoder:
    """``encode(texts)`` gives all ids end to end (uint32) and each text's count.

    most: distinct words remembered; when there are more, only the first third, where frequent words
    are, is kept (memory, never results).
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.by_words = splits_at_white_space(json.loads(self.library.to_str()))
        self.mark = "\x01"
        alone = self.library.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = alone[0] if len(alone) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _shrink(self) -> None:
        keep = self.most // 3
        self.index = _Index(zip(islice(self.index, keep), range(keep)))
        self.used = int(self.starts[keep - 1] + self.lengths[keep - 1])

    def _learn(self) -> None:
        words, self.index.fresh = self.index.fresh, []
        first = len(self.index) - len(words)
        for at in range(0, len(words), 20_480):
            flat, n = self._library_ids([w.decode("utf-8", "replace") for w in words[at : at + 20_480]])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while first + len(n) > len(self.starts):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            self.pool[self.used : self.used + len(flat)] = flat
            self.starts[first : first + len(n)] = self.used + np.cumsum(n) - n
            self.lengths[first : first + len(n)] = n
            self.used += len(flat)
            first += len(n)

    def _library_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words from the library. Lines of 64 words with a control character between cost less than single calls."""
        odd = any(self.mark in w or "<|" in w for w in words) or self.mark_id is None
        lines = words if odd else [f" {self.mark} ".join([*words[i : i + 64], ""]) for i in range(0, len(words), 64)]
        got = [e.ids for e in self.library.encode_batch_fast(lines, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum()))
        if odd:
            return flat, n
        marks = np.flatnonzero(flat == self.mark_id)
        return np.delete(flat, marks), np.diff(marks, prepend=-1) - 1

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            got = [e.ids for e in self.library.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n
        if len(self.index) > self.most:
            self._shrink()
        # only a literal marker of the vocabulary could read otherwise in lower case
        parts = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        words = np.fromiter(map(len, parts), np.int64, len(parts))
        get = self.index.__getitem__
        at = np.fromiter(map(get, chain.from_iterable(parts)), np.int64, int(words.sum()))
        if self.index.fresh:
            self._learn()
        n = self.lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])]
        return ids, np.diff(edges)


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept from task to task."""
    return common.kept(f"encoder {path}", lambda: WordEncoder(path))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each text's ids; and where each text starts, and the end of all."""
    edges = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(edges[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[edges[1:] - 1] = False
    out[keep] = ids
    return out, edges
