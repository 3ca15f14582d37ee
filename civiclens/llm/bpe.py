"""BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is cut into halves, again and again; the leaves are
encoded on their own, and neighbouring results are joined by encoding a window of
text around the cut.  A join is accepted when the window's tokens agree with the
left result on its left and with the right result on its right; else the window
grows.  A shared token (same id, same place) on either side makes the joined
sequence valid at every adjacent pair of tokens, and a BPE sequence that is valid
pairwise is the encoding of its text, so the result is exact.

Texts over ``PART_CHARS`` are cut into rows that executors encode in parallel and
that meet again per document; shorter ones run the same tree in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.functions.frames import map_frames
from civiclens.llm.bpe_batch import BatchEncoder
from civiclens.llm.common import id_and_text, shuffle_width

LEAF_CHARS = 8192
PART_CHARS = 32768
WINDOW_CHARS = 48
CACHED_CHUNK = 64
CACHE_ENTRIES = 800_000
MANY_CHUNKS = 64

_SPACED_SPACE = re.compile(r"\s ")
_SPACE_AT_END = re.compile(r"\s(?: |\Z)")
_SPLIT_AT_SPACE = re.compile(r"(?<=\S) ")
#: white space of str.split() that is none for the tokenizers' patterns
_EXTRA_SPACE = re.compile("[\x1c-\x1f]")
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")


class _Chunks(dict):
    """chunk -> its ids as packed unsigned 32-bit integers; at most CACHE_ENTRIES
    chunks of at most CACHED_CHUNK characters are kept between texts."""

    def __init__(self, packed: Callable[[list[str]], list[bytes]], lead: str = ""):
        super().__init__()
        self.packed, self.lead = packed, lead

    def learn(self, chunks: set[str]) -> None:
        """Keep the ids of all these chunks, the new ones encoded in one call."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = [c for c in chunks.difference(self) if len(c) <= CACHED_CHUNK]
        if new:
            self.update(zip(new, self.packed([self.lead + c for c in new])))

    def joined(self, chunks: list[str]) -> bytes:
        try:
            return b"".join(map(self.__getitem__, chunks))
        except KeyError:
            pass
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = [c for c in set(chunks) if c not in self]
        if new:
            self.update(zip(new, self.packed([self.lead + c for c in new])))
        out = b"".join(map(self.__getitem__, chunks))
        for c in new:
            if len(c) > CACHED_CHUNK:
                del self[c]
        return out


class Encoder:
    """A tokenizers file with truncation and padding off.

    Where the file's own splitting can't join characters over white space, the
    text is cut there and the chunks' ids are kept, since words repeat.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        drops = any(
            p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") and "[^\\s\\p{L}\\p{N}]" in p["pattern"].get("Regex", "")
            for p in pre.get("pretokenizers", [])
        )
        byte = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
        self.kind = "drops space" if drops and plain else "leading space" if byte and plain else "whole"
        #: an added token that a window's edge cuts through misleads the tokens this near to the edge
        self.margin = 4 + max((len(t["content"]) for t in spec.get("added_tokens", [])), default=0)
        self.first, self.rest = _Chunks(self._packed), _Chunks(self._packed, " ")
        self.spaced = self.batch = None
        if self.kind == "leading space":
            self.batch = BatchEncoder.of(self.tokenizer, spec)
            self.spaced = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
            self.spaced[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if "\u0120" in t]] = True
        # no decoder: the library joins the tokens' strings by a space
        self.strings = None
        if spec.get("decoder") is None:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.strings = {i: t for t, i in vocab.items()}

    def _packed(self, texts: list[str]) -> list[bytes]:
        if self.spaced is not None and len(texts) > MANY_CHUNKS:  # white space at the end of a few keeps no others from the one call
            odd = [t[-1:].isspace() for t in texts]
            ends, others = iter(self._encoded([t for t, o in zip(texts, odd) if o])), iter(self._encoded([t for t, o in zip(texts, odd) if not o]))
            return [next(ends if o else others) for o in odd]
        return self._encoded(texts)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts) if self.spaced is not None and len(texts) > 1 else ""
        if joined and joined.count(" ") == len(texts) and all([t[:1] == " " for t in texts]) and not _SPACE_AT_END.search(joined):
            # one call for all: each chunk's first token, and no other, begins with the space
            ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(texts) and starts[0] == 0:
                at, packed = (4 * starts).tolist() + [4 * len(ids)], ids.tobytes()
                return [packed[a:b] for a, b in zip(at, at[1:])]
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, text: str) -> list[str]:
        """A text cut where no token joins what is before and after."""
        if self.kind == "drops space":
            return _WHITE.split(text) if _EXTRA_SPACE.search(text) else text.split()
        return _SPLIT_AT_SPACE.split(text) if _SPACED_SPACE.search(text) else text.split(" ")

    def learn(self, texts: Iterable[str]) -> None:
        """Encode the words of several texts that are new, all in one call: a call for
        each text's few new words costs more than the words."""
        if self.kind == "whole":
            return
        first, rest = set(), set()
        for t in texts:
            chunks = self._chunks(t)
            if self.kind == "leading space":
                first.update(chunks[:1])
                rest.update(chunks[1:])
            else:
                first.update(chunks)
        self.first.learn(first)
        self.rest.learn(rest)

    def leaf(self, text: str) -> bytes:
        """Ids of a text, packed; no tree."""
        if self.kind == "whole":
            return self._packed([text])[0]
        chunks = self._chunks(text)
        if self.kind == "drops space":
            return self.first.joined(chunks)
        return self.first.joined(chunks[:1]) + self.rest.joined(chunks[1:])

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of short texts, packed: all at once where the file's rules allow it."""
        if self.batch is None:
            self.learn(texts)
            return [tree_encode(self, t) for t in texts]
        own = [i for i, t in enumerate(texts) if self.batch.takes(t)]
        found = dict(zip(own, self.batch.encoded([texts[i] for i in own])))
        return [found[i] if i in found else tree_encode(self, t) for i, t in enumerate(texts)]

    def placed(self, text: str) -> list[tuple[int, int, int]]:
        """``(id, start, end)`` of a short text's tokens, by code points."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return [(i, s, t) for i, (s, t) in zip(e.ids, e.offsets)]

    def decode(self, ids: np.ndarray) -> str:
        if self.strings is not None:
            return " ".join(s for s in map(self.strings.get, ids.tolist()) if s is not None)
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _clean(tokens: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], int]:
    """token -> index, of tokens that share no character with a neighbour."""
    last = len(tokens) - 1
    return {
        t: i
        for i, t in enumerate(tokens)
        if t[1] < t[2] and (i == 0 or tokens[i - 1][2] <= t[1]) and (i == last or t[2] <= tokens[i + 1][1])
    }


def join(enc: Encoder, ltext: str, left: bytes, rtext: str, right: bytes, window: int = WINDOW_CHARS) -> bytes:
    """Ids of ``ltext + rtext`` from the ids of both."""
    if not ltext or not rtext:
        return left + right
    window = max(window, 2 * enc.margin)
    while True:
        w_left, w_right = ltext[-window:], rtext[:window]
        whole_left, whole_right = len(w_left) == len(ltext), len(w_right) == len(rtext)
        over = enc.placed(w_left + w_right)
        shared, cut = _clean(over), len(w_left)
        lo, keep_left = (0, 0) if whole_left else (None, 0)
        hi, skip_right = (len(over), len(right) // 4) if whole_right else (None, 0)
        if lo is None:
            alone = enc.placed(w_left)
            tail = np.frombuffer(left[-4 * len(alone) :], dtype="<u4").tolist() if alone else []
            same = 0  # tokens at the end of the lone window that are the left result's own
            while same < min(len(alone), len(tail)) and alone[-1 - same][0] == tail[-1 - same]:
                same += 1
            clean = _clean(alone)
            for t in alone[len(alone) - same :]:
                if t[1] >= enc.margin and t in shared and t in clean:
                    lo, keep_left = shared[t], len(left) // 4 - (len(alone) - clean[t])
                    break
        if hi is None:
            alone = enc.placed(w_right)
            head = np.frombuffer(right[: 4 * len(alone)], dtype="<u4").tolist()
            same = 0
            while same < min(len(alone), len(head)) and alone[same][0] == head[same]:
                same += 1
            clean = _clean(alone)
            for t in reversed(alone[:same]):
                moved = (t[0], t[1] + cut, t[2] + cut)
                if t[2] <= len(w_right) - enc.margin and moved in shared and t in clean:
                    hi, skip_right = shared[moved], clean[t]
                    break
        if lo is not None and hi is not None and lo <= hi:
            mid = np.asarray([t[0] for t in over[lo:hi]], dtype="<u4").tobytes()
            return left[: 4 * keep_left] + mid + right[4 * skip_right :]
        window *= 2


def tree_encode(enc: Encoder, text: str, leaf_chars: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> bytes:
    """Packed ids of a text: halves are encoded on their own and joined."""
    if len(text) <= max(1, leaf_chars):
        return enc.leaf(text)
    mid = len(text) // 2
    ltext, rtext = text[:mid], text[mid:]
    left = tree_encode(enc, ltext, leaf_chars, window)
    return join(enc, ltext, left, rtext, tree_encode(enc, rtext, leaf_chars, window), window)


def tree_join(enc: Encoder, texts: list[str], ids: list[bytes], window: int = WINDOW_CHARS) -> bytes:
    """Ids of the concatenated texts, joined pairwise level by level."""
    while len(texts) > 1:
        ids = [
            join(enc, texts[i], ids[i], texts[i + 1], ids[i + 1], window) if i + 1 < len(ids) else ids[i]
            for i in range(0, len(ids), 2)
        ]
        texts = ["".join(texts[i : i + 2]) for i in range(0, len(texts), 2)]
    return ids[0] if ids else b""


def _summary(enc: Encoder, doc_ids, packed: list[bytes], with_ids: bool) -> pd.DataFrame:
    ids = [np.frombuffer(p, dtype="<u4") for p in packed]
    decoded = [enc.decode(x) for x in ids]
    out = pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64")})
    if with_ids:
        out["ids"] = [x.astype(np.int32) for x in ids]
        out["decoded"] = decoded
    else:
        out["n_tokens"] = [len(x) for x in ids]
        out["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
        out["decoded_sha256"] = [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]
    return out


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
    part_chars: int = PART_CHARS,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """Ids and decoded text of every whole text, one row per input row.

    Returns ``doc_id, ids array<int>, decoded string``; with ``digests`` the
    smaller ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (ids as unsigned
    little-endian 32-bit integers).  NULL text counts as empty: no ids, empty
    decoded text.  Repeated ids and rows each give their own row.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, " + (
        "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    )

    def encode_whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for f in frames:
            for at in range(0, len(f), 256):  # ids and decoded texts of few documents at once
                g = f.iloc[at : at + 256]
                yield _summary(enc, g["doc_id"], [tree_encode(enc, t, leaf_chars) for t in g["text"]], not digests)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row, doc_id, text in zip(f["row"], f["doc_id"], f["text"]):
                starts = range(0, len(text), part_chars)
                yield pd.DataFrame(
                    {
                        "row": row,
                        "doc_id": pd.array([doc_id] * len(starts), dtype="Int64"),
                        "part": range(len(starts)),
                        "text": [text[s : s + part_chars] for s in starts],
                    }
                )

    def encode_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for f in frames:
            yield f.assign(packed=[tree_encode(enc, t, leaf_chars) for t in f["text"]])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(tokenizer_path)
        f = f.sort_values("part")
        return _summary(enc, f["doc_id"].iloc[:1], [tree_join(enc, list(f["text"]), list(f["packed"]))], not digests)

    short = map_frames(rows.where(F.length("text") <= part_chars), encode_whole, schema)
    part_schema = "row long, doc_id long, part int, text string"
    parts = map_frames(rows.where(F.length("text") > part_chars).withColumn("row", F.monotonically_increasing_id()), cut, part_schema)
    encoded = map_frames(parts.repartition(shuffle_width(docs.sparkSession)), encode_parts, part_schema + ", packed binary")
    long = encoded.groupBy("row").applyInPandas(meet, schema)  # one document's rows: its id or NULL in all
    return short.unionByName(long)
