"""Whole-text token ids of a byte-level BPE vocabulary, with a bounded cache per worker."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

#: a space between two characters that are no white space: no token spans it
#: except as its own first character, and no merge looks across it
_JOINT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0          " \
               "      　"
CACHE_ENTRIES = 1_000_000


def split_at_joints(text: str) -> list[str]:
    """Parts between the joints; all but the first have lost the space before them."""
    if not text or text[0] == " " or text[-1] == " " or "  " in text:
        return _JOINT.split(text)
    for c in _OTHER_SPACE:
        if c in text and (c + " " in text or " " + c in text):
            return _JOINT.split(text)
    return text.split(" ")              # every space is a joint


class ByteBpe:
    """Ids as little-endian unsigned 32-bit bytes, equal to encoding the whole text at once.

    The pre-tokenizer splits before a single space that stands between two
    non-space characters, so the parts between such spaces can be encoded each
    on its own, or many joined by such spaces at once.  Each distinct part is
    encoded once while it stays in the cache; new ones are joined, encoded
    together, and told apart again by their lengths in bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        # a token is written with one character per byte
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.known: dict[str, bytes] = {}       # parts after a joint, without its space

    def _alone(self, text: str) -> bytes:
        if not text:
            return b""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that neither begin nor end in white space."""
        groups = [parts[i:i + 1000] for i in range(0, len(parts), 1000)]
        coded = self.tokenizer.encode_batch([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, coded, strict=True):
            ids = np.array(e.ids, "<u4")
            lengths = np.fromiter(map(len, map(str.encode, g)), np.int64, len(g)) + 1
            ends = 4 * np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(lengths)) + 4
            raw, ends = ids.tobytes(), ends.tolist()
            self.known.update(zip(g, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        get, docs, new = self.known.get, [], set()
        for t in texts:
            rest = split_at_joints(t)
            first = rest.pop(0)
            last = " " + rest.pop() if rest and rest[-1][-1].isspace() else ""
            found, missing = list(map(get, rest)), []
            if None in found:
                missing = [i for i, v in enumerate(found) if v is None]
                new.update([rest[i] for i in missing])
            docs.append((first, rest, found, missing, last))
        self._learn(list(new))
        out = []
        for first, rest, found, missing, last in docs:
            for i in missing:
                found[i] = self.known[rest[i]]
            out.append(b"".join((self._alone(first), *found, self._alone(last))))
        return out


@cache
def byte_bpe(path: str | None) -> ByteBpe:
    """The vocabulary at ``path``, or the named file of the installed public vocabularies."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None or os.sep not in path:
        import public_tokenizers
        path = public_tokenizers.path(path or "byte_bpe_50k.json")
    return ByteBpe(path)
