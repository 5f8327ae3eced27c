"""Token ids of texts by a public tokenizer file, word by word with a memory of words already seen.

The vocabulary's normaliser folds white space and lower-cases character by character, and its splitter never lets a
piece cross white space, so the ids of a text are the ids of its words in a row. Words are looked up in a dictionary of
the worker; unseen ones go to the `tokenizers` library. ASCII capitals are folded before the lookup, and a full stop or
comma behind an ASCII letter or digit, always a piece of its own, is looked up apart. Texts with `<|`, which may begin a
special token, go to the library unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

END = 1  #: id appended to every document
VOCABULARY = "word_bpe_49k.json"
_READY: dict[str, TextEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """ids of texts as little-endian unsigned 16-bit bytes; forgets its words when `room` of them are held."""

    def __init__(self, path: str, room: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        assert self.tokenizer.get_vocab_size() <= 1 << 16
        self.room, self.known = room, {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        if len(known) + len(words) > self.room:
            known.clear()
        cut, plain = [], set()
        for w in words:
            if w[-1:] in (b".", b",") and len(w) > 1 and (w[-2:-1].isalnum()):
                cut.append(w)
                plain.add(w[:-1])
                plain.add(w[-1:])
            else:
                plain.add(w)
        new = [w for w in plain if w not in known]
        for k in range(0, len(new), 1024):
            part = new[k : k + 1024]
            known.update(zip(part, self._library([w.decode() for w in part]), strict=True))
        for w in cut:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text, uint16; null: none."""
        out: list[np.ndarray | None] = [None] * len(texts)
        split, odd = [], []
        for k, t in enumerate(texts):
            if t and "<|" in t:
                odd.append(k)
            else:
                split.append((k, t.encode().lower().split() if t else []))
        known = self.known
        missing = set()
        for _, words in split:
            missing.update(words)
        self._learn({w for w in missing if w not in known})
        for k, words in split:
            try:
                b = b"".join([known[w] for w in words])
            except KeyError:  # forgotten while learning
                self._learn({w for w in words if w not in known})
                b = b"".join([known[w] for w in words])
            out[k] = np.frombuffer(b, dtype="<u2")
        for k, b in zip(odd, self._library([texts[k] for k in odd]), strict=True):
            out[k] = np.frombuffer(b, dtype="<u2")
        return out


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    if path not in _READY:
        _READY[path] = TextEncoder(path)
    return _READY[path]


def in_portions(column, chars: int = 1 << 20):
    """Portions (from, to) of an Arrow text column of about `chars` bytes each, at least a row."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32 if column.type == "string" else np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else []
    a, held = 0, 0
    for k, s in enumerate(sizes):
        held += s
        if held >= chars:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(column):
        yield a, len(column)


Portion = Callable[[list], list]
