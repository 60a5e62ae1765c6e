"""Encoders over the public vocabulary files; the paths are parameters, nothing is copied or trained."""

from __future__ import annotations

import functools
import gc
import json

import numpy as np

from .common import worker_cache

#: The byte-level splitting pattern that belongs to the vocabulary file, in a form without back-tracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies write them: printable Latin-1 stays, the rest moves up from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in keep}
    moved = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(moved)})
    return table


def easy_collection() -> None:
    """Workers that hold large tables of small objects look for cycles less often."""
    gc.set_threshold(200_000, 50, 100)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@worker_cache("byte-bpe")
def byte_bpe_encoder(path: str):
    """The byte-level BPE file as a rank encoder, its added tokens as specials; gives the ids that the tokenizers library gives."""
    import tiktoken

    file = read_vocabulary(path)
    back = {c: b for b, c in byte_alphabet().items()}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(back[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class ByteBpe:
    """Whole texts to ids.

    A cut before a single space is always a cut of the splitting pattern, so a text is encoded as the
    chunks between its spaces, each distinct chunk once (the cache is bounded).  Texts with runs of
    spaces, an end in a space or a special string take the plain way.
    """

    def __init__(self, path: str, keep: int = 350_000):
        import array

        easy_collection()
        self._array = array.array
        self.encoder = byte_bpe_encoder(path)
        self.specials = list(self.encoder._special_tokens)
        self.leads = np.zeros(self.encoder.n_vocab, bool)
        self.leads[[i for t, i in self.encoder._mergeable_ranks.items() if t[:1] == b" "]] = True
        self.cache: dict[str, bytes] = {}
        self.keep = keep

    def _plain(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self._array("I", self.encoder.encode(text, allowed_special="all")).tobytes()
        return self._array("I", self.encoder._core_bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.keep:
            self.cache.clear()
        get, out = self.cache.get, []
        waiting: list[tuple[int, list[str], list]] = []
        missing: set[str] = set()
        for text in texts:
            if not text or "  " in text or text[-1] == " " or any(s in text for s in self.specials):
                out.append(self._plain(text) if text else b"")
                continue
            chunks = text.split(" ")
            found = list(map(get, chunks))
            found[0] = self._plain(chunks[0])
            if None in found:
                waiting.append((len(out), chunks, found))
                missing.update([c for c, f in zip(chunks, found, strict=True) if f is None])
                out.append(b"")
            else:
                out.append(b"".join(found))
        if missing:
            self._learn(list(missing))
            for at, chunks, found in waiting:
                for i, f in enumerate(found):
                    if f is None:
                        found[i] = get(chunks[i])
                out[at] = b"".join(found)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks in one call; an id that begins with a space begins a chunk."""
        ids = np.array(self.encoder._core_bpe.encode_ordinary(" " + " ".join(chunks)), "<u4")
        at = [*(4 * np.flatnonzero(self.leads[ids])).tolist(), 4 * len(ids)]
        packed = ids.tobytes()
        self.cache.update(zip(chunks, [packed[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))


@worker_cache("byte-bpe")
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
