"""Public tokenizers applied word by word, with a bounded memo per Python worker.

White space never joins two tokens in these vocabularies, so a text's ids are the ids of its
white-space words one after another; the frequent words of a corpus are encoded once per worker.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Words that one generation of a memo holds; two generations are kept.
MEMO_WORDS = 250_000

_loaded: dict[str, object] = {}


def vocab_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """word -> encode(word). When a generation is full it becomes the old one, and the words that are
    still in use move over as they are asked for."""

    def __init__(self, encode: Callable):
        self.encode, self.old = encode, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self._turn()
        self[word] = found
        return found

    def _turn(self) -> None:
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()


class BatchMemo(Memo):
    """A memo whose encode takes a list of words at once; `of` gives the values of a text's words."""

    def of(self, words: list[bytes]) -> list:
        self._turn()
        new = []
        for w in set(words):
            if w not in self:
                if w in self.old:
                    self[w] = self.old[w]
                else:
                    new.append(w)
        if new:
            self.update(zip(new, self.encode(new), strict=True))
        return list(map(self.__getitem__, words))


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


#: Words of these characters need no normalising beyond lower case, and their splits are known.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž]+")
_SPLITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")


def _word_ids(path: str) -> Callable[[bytes], bytes]:
    """For the lower-casing vocabulary with word ends. Plain words go to the model piece by piece, which
    saves the general pipeline's overhead; all others take the whole pipeline."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    model, letters = t.model, _byte_letters()
    part = Memo(lambda p: array("I", [x.id for x in model.tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes())

    def encode(word: bytes) -> bytes:
        w = word.decode()
        if _PLAIN.fullmatch(w) and "<|" not in w:
            return b"".join([part[p] for p in _SPLITS.findall(w.lower())])
        return np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def _pieces(path: str) -> Callable[[list[bytes]], list[bytes]]:
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: [array("I", ids).tobytes() for ids in t.encode([w.decode() for w in words], num_threads=1)]


def _ranks(path: str) -> Callable[[bytes], int]:
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    # a word inside a text carries the blank before it
    return lambda word: len(t.encode_ordinary(" " + word.decode()))


def memo(path: str) -> Memo:
    """The worker's memo for one vocabulary file, from words as UTF-8: ids as little-endian unsigned
    32-bit bytes for .json (tokenizers) and .model (sentencepiece), the number of ids for .tiktoken."""
    if path not in _loaded:
        if path.endswith(".model"):
            _loaded[path] = BatchMemo(_pieces(path))
        else:
            _loaded[path] = Memo((_word_ids if path.endswith(".json") else _ranks)(path))
    return _loaded[path]


def byte_pieces(path: str) -> np.ndarray:
    """Of a sentencepiece vocabulary: for each id, whether it is a byte-fallback or unknown piece."""
    key = path + "#bytes"
    if key not in _loaded:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[key] = np.array([t.is_byte(i) or t.is_unknown(i) for i in range(t.vocab_size())])
    return _loaded[key]
