"""Words of many texts at once, as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, the same as a run of characters
outside [\\x20\\x09-\\x0D]. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are worked on at once (one text may be longer).
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES * 2)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _POWERS[base] = have = np.cumprod(table, dtype=np.uint64)
        if n > 8 * CHUNK_BYTES:  # an unusually long text's table isn't kept
            del _POWERS[base]
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) for runs of about limit bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def minimisers(seeds: np.ndarray, width: int) -> np.ndarray:
    """The (first) place of the least of the next width seeds, from each place on (shorter by width - 1)."""
    at, have = np.arange(len(seeds)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(seeds[b] < seeds[a], b, a)
        have += step
    return at


class Words:
    """The words of some texts: hash, first byte and end in buf of each, and bounds of texts.

    words of text i are [bounds[i], bounds[i + 1]); its bytes are [at[i], at[i] + size[i]).
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.buf = buf = np.frombuffer(joined, np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.space = space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        self.starts, self.ends = edges[0::2], edges[1::2]
        total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(buf))[: len(buf)], dtype=np.uint64)
        before = np.where(self.starts > 0, total[self.starts - 1], np.uint64(0))
        self.hashes = mix((total[self.ends - 1] - before) * _powers(_INVERSE, len(buf))[self.starts])
        self.bounds = np.concatenate([np.searchsorted(self.starts, self.at), [len(self.starts)]])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), np.diff(self.bounds))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The number of flagged bytes of each text."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.at + self.size] - total[self.at]

    def spans(self, k: int) -> np.ndarray:
        """Hashes of the k words from each word on, over all texts (shorter by k - 1)."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(_BASE, n)[:n], dtype=np.uint64)])
        return mix((total[k:] - total[: n - k + 1]) * _powers(_INVERSE, n)[: n - k + 1])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and the words that have k in their text."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            part = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                part = part * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j : n - k + 1 + j]
            out[: n - k + 1] = mix(part)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return out, np.arange(n) + k <= ends


def repeated_words(words: Words, k: int = 3) -> np.ndarray:
    """For each text, its words that lie in a window of k words found twice or more in it."""
    hashes, whole = words.windows(k)
    docs = words.doc_of_word()
    at = np.flatnonzero(whole)
    out = np.zeros(len(words.size), np.int64)
    if not len(at):
        return out
    keys = mix(hashes[at] ^ mix(docs[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    covered = np.cumsum(cover)[:-1] > 0
    np.add.at(out, docs[covered], 1)
    return out


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))
