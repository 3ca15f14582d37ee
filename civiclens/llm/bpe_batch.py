"""Byte-level BPE of many texts at once.

Texts are cut into the pieces that the tokenizers file's own splitting makes (runs of
letters, of digits, of other characters, with one space before them; contractions;
white space), equal pieces are found by hash and compared byte by byte, and the
distinct ones of one length are merged together: in each round every piece that is
not done merges its leftmost pair of the least rank.  The classes of characters are
asked of the library; pieces over ``LONG_PIECE`` bytes are encoded by it.
"""

from __future__ import annotations

import numpy as np

from civiclens.llm.jaccard_join import EXACT, _power, mixed

LONG_PIECE = 32
LETTER, DIGIT, OTHER, SPACE, UNKNOWN = range(5)
NO_RANK = np.int32(2**31 - 1)
_U = np.uint64
#: holds each rule of the splitting; what the library makes of it decides whether this module may be used
PROBE = "It's  we'll they'd'ves I'm\n\nx 12a½\t é'é ñandú　漢字   --'s '' don''t 's\r\n \U0001f600\U0001f600 a_b ſ'S  "


def byte_letters() -> list[str]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (chr(256 + i) for i in range(256 - len(shown)))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class BatchEncoder:
    """Encodes like ``tokenizer``, whose file's content is ``spec``."""

    def __init__(self, tokenizer, spec: dict):
        self.tokenizer = tokenizer
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        model = spec["model"]
        vocab, self.size = model["vocab"], 1 + max(model["vocab"].values())
        self.bytes = np.asarray([vocab[c] for c in byte_letters()], dtype=np.int32)
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[a] * self.size + vocab[b]] = (rank, vocab[a + b])
        self.pairs = np.asarray(sorted(ranks), dtype=np.int64)
        self.ranks = np.asarray([ranks[k][0] for k in self.pairs.tolist()], dtype=np.int32)
        self.merged = np.zeros(len(model["merges"]), dtype=np.int32)
        for rank, made in ranks.values():
            self.merged[rank] = made
        self.of_bytes = self._rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)

    @classmethod
    def of(cls, tokenizer, spec: dict) -> BatchEncoder | None:
        """None where the file's rules are not those of this module."""
        model = spec["model"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or not model["merges"] or any(model.get(k) for k in odd) or any(c not in model["vocab"] for c in byte_letters()):
            return None
        own = cls(tokenizer, spec)
        expected = np.asarray(tokenizer.encode(PROBE, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return own if own.encoded([PROBE, "", PROBE[:-1]])[0] == expected else None

    def takes(self, text: str) -> bool:
        """Added tokens are found before the text is cut: texts with one are not for this."""
        return not any(t in text for t in self.added)

    def _class(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        new = out == UNKNOWN
        if new.any():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[new]).tolist():
                c = chr(p)
                self.classes[p] = next((k for k, x in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(cut(x + c + x)) == 1), SPACE)
            out = self.classes[points]
        return out

    def _starts(self, points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        c = self._class(points)
        white = c == SPACE
        text_end = np.concatenate([text_start[1:], [True]])
        start = text_start.copy()
        start[1:] |= c[1:] != c[:-1]
        last = white & ~text_end
        last[:-1] &= ~white[1:]
        start |= last  # white space before a word: its last character is apart
        spaced = (points[:-1] == 32) & ~white[1:] & ~text_start[1:]
        start[1:][spaced] = False  # a space belongs to the word after it
        at = np.flatnonzero((points == 39) & start & ~text_end)
        at = at[c[at + 1] == LETTER]
        one = np.isin(points[at + 1], [ord(x) for x in "stmd"])
        far = np.minimum(at + 2, len(points) - 1)
        inside = (at + 2 < len(points)) & ~text_start[far]
        two = np.zeros(len(at), dtype=bool)
        for x, y in ("re", "ve", "ll"):
            two |= inside & (points[at + 1] == ord(x)) & (points[far] == ord(y))
        start[at[one | two] + 1] = False
        end = np.concatenate([at[one] + 2, at[two] + 3])
        start[end[end < len(points)]] = True
        return np.flatnonzero(start)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_RANK)

    def _merge(self, raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(rows, ids)`` of pieces of equal length, a row each."""
        done, row, ids = [], np.arange(len(raw)), self.bytes[raw]
        rank = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        while ids.shape[1] > 1 and len(row):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(row)), at]
            go = least != NO_RANK
            if not go.all():
                done.append((row[~go], ids[~go]))
                row, ids, rank, at, least = row[go], ids[go], rank[go], at[go], least[go]
            n, width = ids.shape
            if not n:
                break
            line = np.arange(n)
            ids[line, at] = self.merged[least]
            keep = np.ones((n, width), dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), dtype=bool)
            keep[line, at] = False
            rank = rank[keep].reshape(n, width - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])
        if len(row):
            done.append((row, ids))
        return done

    def _distinct(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces one after the other, and the number of each."""
        found = []
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            if n <= LONG_PIECE:
                found += [(which[row], ids) for row, ids in self._merge(raw[begin[which][:, None] + np.arange(n)])]
            else:
                texts = [raw[b : b + n].tobytes().decode("utf-8") for b in begin[which].tolist()]
                encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
                found += [(which[i : i + 1], np.asarray([e.ids], dtype=np.int32)) for i, e in enumerate(encoded)]
        count = np.zeros(len(begin), dtype=np.int64)
        for row, ids in found:
            count[row] = ids.shape[1]
        offset, flat = np.cumsum(count) - count, np.zeros(int(count.sum()), dtype="<u4")
        for row, ids in found:
            flat[offset[row][:, None] + np.arange(ids.shape[1])] = ids
        return flat, count

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The texts' ids as packed unsigned 32-bit integers."""
        chars = np.asarray([len(t) for t in texts], dtype=np.int64)
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        at = np.cumsum(chars) - chars
        text_start = np.zeros(len(points), dtype=bool)
        text_start[at[chars > 0]] = True
        begin = self._starts(points, text_start)
        first = np.append(np.searchsorted(begin, at), len(begin))  # each text's first piece
        raw = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        if len(raw) > len(points):
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            begin = (np.cumsum(width) - width)[begin]
        size = np.diff(np.append(begin, len(raw)))
        up, down = _power(len(raw) + 1)
        sums = np.concatenate([[_U(0)], np.cumsum(EXACT[raw] * up[: len(raw)])])
        key = mixed((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64), 5)
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        same = np.repeat(begin[one][which] - begin, size) + np.arange(len(raw))
        if (size[one][which] != size).any() or (raw[np.minimum(same, len(raw) - 1)] != raw).any():  # two pieces with one hash
            one = which = np.arange(len(begin))
        flat, count = self._distinct(raw, begin[one], size[one])
        of, offset = count[which], (np.cumsum(count) - count)[which]
        to = np.cumsum(of)
        ids = flat[np.repeat(offset - (to - of), of) + np.arange(int(to[-1]))].tobytes()
        edge = (4 * np.append(0, to)[first]).tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]
