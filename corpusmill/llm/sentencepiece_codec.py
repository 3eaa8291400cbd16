"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A marked text ("▁" for each space, and one before the text) is cut into words that no piece can span. The distinct
words of a run of documents are sorted, which is a depth-first walk of their trie: from one word to the next only the
letters after the common prefix are new, and the forward states of the shared prefix are used again.

The model given is of the BPE kind, so the best path isn't that of the largest sum of scores: pieces that merge first
win. A path is the BPE result if and only if BPE leaves each two neighbouring pieces of it as they are, and every
prefix has just one such path. The forward state of a prefix is therefore the last piece of its path, and a step is
allowed if the pair of pieces is stable. Ids are those of the sentencepiece library. Letters without a piece are
spelled in byte pieces.
"""

from __future__ import annotations

import heapq
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
GROUP = 512  #: documents whose words are sorted together
CACHE = 150_000  #: words in each of the two generations that a task keeps
PAIRS = 400_000  #: pairs of pieces kept in a task, as numbers
LETTERS = 1 << 20  #: where the numbers of letters without a piece begin; vocabularies are smaller
_UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def load_model(path: str = MODEL) -> dict:
    """Pieces and scores of a model file, to be broadcast: its size is that of the vocabulary, whatever the documents are."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.vocab_size()
    special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)}
    pieces = [p.id_to_piece(i) for i in range(n)]
    if n >= LETTERS:
        raise ValueError(f"vocabularies of more than {LETTERS} pieces aren't supported")
    if any(MARK in x.lstrip(MARK) or ("\n" in x and len(x) > 1) for i, x in enumerate(pieces) if i not in special):
        raise ValueError("pieces that span words aren't supported")
    spelled = [b"" if p.is_control(i) or p.is_unknown(i) else bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.encode() for i, x in enumerate(pieces)]
    return {
        "key": uuid.uuid4().hex,
        "ids": {x: i for i, x in enumerate(pieces) if i not in special},
        "scores": {x: p.get_score(i) for i, x in enumerate(pieces) if i not in special},
        "bytes": [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "spelled": spelled,
    }


def merged(word: str, scores: dict[str, float]) -> list[str]:
    """BPE: of all neighbours whose join is a piece, the best (then the leftmost) merge, until none are left."""
    parts: list[str] = list(word)
    get = scores.get
    if len(parts) <= 16:  # too few for a heap to pay
        while True:
            best = at = None
            for i in range(len(parts) - 1):
                s = get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    after = [*range(1, len(parts)), -1]
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []
    for i in range(len(parts) - 1):
        if (s := scores.get(x := parts[i] + parts[i + 1])) is not None:
            heap.append((-s, i, x))
    heapq.heapify(heap)
    while heap:
        _, i, x = heapq.heappop(heap)
        j = after[i] if parts[i] else -1
        if j < 0 or parts[i] + parts[j] != x:
            continue
        parts[i], parts[j] = x, ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (s := scores.get(y := x + parts[k])) is not None:
                heapq.heappush(heap, (-s, i, y))
        if (h := before[i]) >= 0 and (s := scores.get(y := parts[h] + x)) is not None:
            heapq.heappush(heap, (-s, h, y))
    return [p for p in parts if p]


class Encoder:
    """Encodes words, and keeps what it learns about up to `PAIRS` pairs and two generations of `CACHE` words: when the younger is full it
    becomes the older, and words that are still met move on."""

    def __init__(self, model: dict):
        self.scores, self.bytes = model["scores"], model["bytes"]
        self.ids: dict[str, int] = model["ids"]
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.older: dict[str, bytes] = {}
        self.feed = self._spell("\n")
        self.stable: dict[int, bool] = {}
        self.reach: dict[str, int] = {}  # length of the longest piece that ends in these two letters
        for x in self.ids:
            if len(x) > self.reach.get(x[-2:], 1):
                self.reach[x[-2:]] = len(x)

    def _spell(self, pieces: Iterable[str]) -> tuple[int, ...]:
        get, out = self.ids.get, []
        for p in pieces:
            if (i := get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in p.encode())
        return tuple(out)

    def _pair(self, key: int, a: str, b: str) -> bool:
        """Whether BPE leaves `a` then `b` as they are; for a = "" whether it makes b one piece."""
        if len(self.stable) >= PAIRS:
            self.stable.clear()
        # neighbours that make a piece always merge
        ok = self.stable[key] = not (a and a + b in self.ids) and merged(a + b, self.scores) == ([a, b] if a else [b])
        return ok

    def learn(self, words: Iterable[str], into: dict[str, tuple[int, ...]]) -> None:
        """Walks the trie of the words depth-first. `last[i]` is the forward state of the current word's first i letters: the number of the last piece of
        their path, 1 up, and 0 for no letters; `size[i]` is that piece's length. Letters without a piece are numbered after the pieces."""
        get, reach, stable, pair, none = self.ids.get, self.reach.get, self.stable.get, self._pair, LETTERS
        last: list[int] = [0]
        size: list[int] = [0]
        before = ""
        for word in sorted(words):
            if word.startswith(MARK * 2):  # runs of blanks: ties between pieces of one score
                into[word] = self._spell(merged(word, self.scores))
                continue
            n = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                n += 1
            del last[n + 1 :], size[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                least = max(0, i - reach(word[max(0, i - 2) : i], 1))
                for at in range(i - 1, least - 1, -1):
                    a = last[at]
                    if a < 0:
                        continue
                    p = word[at:i]
                    b = get(p, -1)
                    if b < 0:
                        if at < i - 1:
                            continue
                        b = none + ord(p)
                    key = (a << 22) | b
                    ok = stable(key)
                    if ok is None:
                        ok = pair(key, word[at - size[at] : at], p)
                    if ok:
                        last.append(b + 1)
                        size.append(i - at)
                        break
                else:
                    last.append(-1)  # no path: not with models made by merging; then `merged` decides
                    size.append(0)
            path, i, whole = [], len(word), True
            while i and last[i] > 0:
                path.append(last[i] - 1)
                whole = whole and last[i] <= none
                i -= size[i]
            if i:
                into[word] = self._spell(merged(word, self.scores))
            elif whole:
                into[word] = tuple(path[::-1])
            else:
                into[word] = tuple(chain.from_iterable((x,) if x < none else [self.bytes[c] for c in chr(x - none).encode()] for x in reversed(path)))
            before = word

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Texts are cut at spaces and before line feeds, and what is between is looked up. What begins with a line feed has no mark.
        The few texts with runs of spaces, or marks of their own, are cut by a regular expression."""
        odd: dict[int, list[str]] = {}
        chunks: list[list[str]] = []
        for k, t in enumerate(texts):
            if not t:
                chunks.append([])
                continue
            spaced = t.replace("\n", " \n")
            if MARK in t or "  " in spaced or t[0] == " " or t[-1] == " ":
                odd[k] = _UNITS.findall(MARK + t.replace(" ", MARK))
                chunks.append([])
            else:
                chunks.append(spaced.split(" "))
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set(chain.from_iterable(chunks)).difference(known)
        again = new.intersection(older)
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        new -= again
        found: dict[str, tuple[int, ...]] = {}
        heads = {c: c[1:] for c in new if c.startswith("\n")}
        self.learn({*heads.values(), *(MARK + c for c in new.difference(heads)), *chain.from_iterable(odd.values())}, found)
        for c in new:
            known[c] = array("i", self.feed + found[heads[c]] if c in heads else found[MARK + c]).tobytes()
        ids, of = known.__getitem__, found.__getitem__
        return [None if t is None else np.fromiter(chain.from_iterable(map(of, odd[k])), np.int32) if k in odd else np.frombuffer(b"".join(map(ids, chunks[k])), np.int32) for k, t in enumerate(texts)]


def decode(ids: Iterable[int] | None, spelled: list[bytes]) -> str | None:
    """The text of the ids; the blank before the text is taken off. Bytes that aren't UTF-8 become U+FFFD."""
    if ids is None:
        return None
    text = b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def _encoder(model: Broadcast) -> Encoder:
    """One encoder a Python worker, so that a task starts with what earlier tasks learnt."""
    key = model.value["key"]
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model.value)
    return _encoders[key]


def broadcast_model(spark: SparkSession, path: str = MODEL) -> Broadcast:
    return spark.sparkContext.broadcast(load_model(path))


def encoded(docs: DataFrame, model: Broadcast, *, text: str = "text", ids: str | None = "input_ids", check: bool = False) -> DataFrame:
    """`docs` with the piece ids (array<int>, in the column `ids` unless that is None) and n_tokens of each text.

    With `check`, ids_xxh64 (XXH64 of the ids as little-endian 32-bit integers) and round_trip (whether they decode to the text) are added. Columns of
    these names are replaced. A null text gives null ids and no tokens, an empty one no ids; U+2581 in a text counts as a
    space. Rows are encoded in runs of GROUP, so that a task holds no more than that, whatever the batch.
    """
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []
    added += [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("ids_xxh64", T.LongType()), T.StructField("round_trip", T.BooleanType())] if check else []
    names = {f.name for f in added}
    kept = docs.select(*[c for c in docs.columns if c not in names and c != text], F.col(text)) if text not in names else docs
    at = len(kept.columns) - 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spelled = _encoder(model), model.value["spelled"]
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                rows = batch.slice(start, GROUP)
                texts = rows.column(at).to_pylist()
                found = encoder.encode(texts)
                out = [pa.array(found, pa.list_(pa.int32()))] if ids else []
                out.append(pa.array([0 if x is None else len(x) for x in found], pa.int64()))
                if check:
                    same = [(None if t is None else t.replace(MARK, " ")) == decode(None if x is None else x.tolist(), spelled) for t, x in zip(texts, found, strict=True)]
                    out.append(pa.array([None if x is None else np.uint64(xxhash.xxh64_intdigest(x.tobytes())).astype(np.int64) for x in found], pa.int64()))
                    out.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *out], names=[*rows.schema.names, *[f.name for f in added]])
        tidied()

    return kept.mapInArrow(encode, T.StructType([*kept.schema.fields, *added]))


def decoded(ids: Column, model: Broadcast) -> Column:
    """The text of each array of ids; null gives null."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spelled = model.value["spelled"]
        for s in batches:
            yield pd.Series([decode(None if x is None else x.tolist() if hasattr(x, "tolist") else x, spelled) for x in s], dtype=object)

    return F.pandas_udf(texts, T.StringType())(ids)
