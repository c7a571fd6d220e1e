"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Distinct words of equal length advance together, character by character: hashes of the substrings that end
there probe the sorted hashes of the pieces, and the best candidate of each word is stored as a backpointer.
In a unigram model the best candidate has the largest sum of scores. The public model is a byte-pair model,
whose encoding is not the largest sum; there a candidate counts only if byte-pair merging would keep the
boundary between it and the piece before it. Exactly one candidate does, so the same recursion gives the
ids of byte-pair merging.

Null and empty texts have no ids. Characters outside the vocabulary become byte pieces. Very long words
and texts are encoded whole. Repeated rows are encoded alike, null ids stay null, an empty table has no rows; other
columns, whatever their names, are ignored. Of unigram candidates with equal sums the longer last piece counts.
A text that holds U+2581 itself decodes to a blank there.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import id_and_text

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
NEVER = np.iinfo(np.int64).max
SLOTS = 20  # bits of the table of verdicts
ENTRY = 180  # bytes that a word in the cache takes besides its letters and ids


def spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of hashes, so that sums of small code points do not meet."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Table:
    """Sorted hashes, probed through the places where their leading bits begin."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange(2**bits + 1, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1."""
        lead = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        out = np.full(len(hashes), -1, np.int64)
        live = np.flatnonzero(at < end)
        at, end, sought = at[live], end[live], hashes[live]
        while len(live):
            hit = self.keys[at] == sought
            out[live[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            live, at, end, sought = live[on], at[on] + 1, end[on], sought[on]
        return out


class Model:
    """Pieces of a model in sorted tables. `kind` is "bpe" or "unigram"."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.size = kind, own.vocab_size()
        ids = range(self.size)
        self.text = [own.id_to_piece(i) for i in ids]
        special = [own.is_byte(i) or own.is_control(i) or own.is_unknown(i) for i in ids]
        self.byte = {int(self.text[i][1:-1], 16): i for i in ids if own.is_byte(i)}
        self.id_of = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.score = np.array([own.get_score(i) for i in ids])
        self.known = {t for t in self.id_of if len(t) == 1}
        back = {v: bytes([k]) for k, v in self.byte.items()}
        self.bytes = [back.get(i, b"" if special[i] else self.text[i].replace(BLANK, " ").encode()) for i in ids]
        whole = {t: i for t, i in self.id_of.items() if t.strip(BLANK) or len(t) == 1}  # runs of blanks: see `blanks`
        hashes = {}  # of all beginnings of pieces; -1 where a beginning is no piece
        grown = {"": np.zeros(1, np.uint64)}
        for t, i in whole.items():
            for k in range(1, len(t) + 1):
                if t[:k] not in grown:
                    grown[t[:k]] = h = spread(grown[t[: k - 1]] * BASE + np.uint64(ord(t[k - 1]) + 1))
                    hashes[int(h[0])] = -1
            hashes[int(grown[t][0])] = i
        order = sorted(hashes)
        self.beginnings = Table(np.array(order, np.uint64))
        self.ids = np.array([hashes[h] for h in order], np.int64)
        if kind == "bpe":
            self.link(whole)

    def link(self, whole: dict[str, int]) -> None:
        """Ranks, the last merge of each piece, and all pairs of pieces that make a piece."""
        self.rank = np.full(self.size, NEVER)
        by_score = sorted(whole.values(), key=lambda i: (-self.score[i], i))
        for r, i in enumerate(by_score):
            self.rank[i] = -1 if len(self.text[i]) == 1 else r
        pairs = {}
        for t, i in whole.items():
            for cut in range(1, len(t)):
                a, b = whole.get(t[:cut]), whole.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.verdicts = np.full(2**SLOTS, np.iinfo(np.int64).min)
        keys = spread(np.array(list(pairs), np.uint64))  # spread is one to one
        order = np.argsort(keys)
        self.pairs = Table(keys[order])
        self.pair_ids = np.array(list(pairs.values()), np.int64)[order]
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.own = np.zeros(self.size, bool)
        for i in sorted(whole.values(), key=lambda i: len(self.text[i])):
            t = self.text[i]
            if len(t) == 1:
                self.own[i] = True
                continue
            parts = self.merge(list(t), pairs)
            self.own[i] = len(parts) == 1

    def merge(self, text: list[str], pairs: dict[int, int]) -> list[int]:
        """Byte-pair merging of one piece's characters; notes the last merge of each piece made."""
        now = [self.id_of[c] for c in text if c in self.id_of]
        while len(now) > 1:
            found = [(self.rank[c], k, c) for k in range(len(now) - 1) if (c := pairs.get(now[k] * self.size + now[k + 1])) is not None]
            if not found:
                break
            _, k, c = min(found)
            self.left[c], self.right[c] = now[k], now[k + 1]
            now[k : k + 2] = [c]
        return now

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b make, or NEVER."""
        at = self.pairs.find(spread((a * self.size + b).astype(np.uint64)))
        out = np.full(len(a), NEVER)
        hit = np.flatnonzero(at >= 0)
        out[hit] = self.rank[self.pair_ids[at[hit]]]
        return out

    def parted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`judged` of each pair; the same pairs come again and again, so a table of fixed size holds verdicts."""
        key = a * self.size + b
        slot = (spread(key.astype(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        cell = self.verdicts[slot]
        out = cell & 1 == 1
        miss = np.flatnonzero(cell >> 1 != key)
        if len(miss):
            out[miss] = found = self.judged(a[miss], b[miss])
            self.verdicts[slot[miss]] = key[miss] * 2 + found
        return out

    def judged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between pieces a and b.

        Going back in time from both whole pieces, the younger one is taken apart at the boundary; a merge across
        it would have happened if it ranks before the merges that made the pieces around (the left one wins ties).
        """
        out = np.ones(len(a), bool)
        todo = np.arange(len(a))
        a, b = a.copy(), b.copy()
        next_a, next_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(todo):
            across = self.pair(a, b)
            bad = (across != NEVER) & (across < next_a) & (across <= next_b)
            out[todo[bad]] = False
            split_a = self.rank[a] > self.rank[b]
            more = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            next_a = np.where(split_a, self.rank[a], next_a)
            next_b = np.where(split_a, next_b, self.rank[b])
            a, b = np.where(split_a, self.right[a], a), np.where(split_a, b, self.left[b])
            todo, a, b, next_a, next_b = todo[more], a[more], b[more], next_a[more], next_b[more]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids, as bytes of unsigned 32-bit numbers, of words of equal length made of known characters."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        last, length = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int32)
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0
        # words whose substring from some start on still begins a piece, with its hash, extended in each round
        running: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for j in range(1, size + 1):
            running[j - 1] = np.arange(n), np.zeros(n, np.uint64)
            for start, (rows, h) in list(running.items()):
                h = spread(h * BASE + codes[j - 1][rows])
                at = self.beginnings.find(h)
                on = np.flatnonzero(at >= 0)
                if not len(on):
                    del running[start]
                    continue
                rows, piece = rows[on], self.ids[at[on]]
                running[start] = rows, h[on]
                whole = piece >= 0
                rows, p = rows[whole], piece[whole]
                if self.kind == "bpe":
                    fits = self.own[p]
                    rows, p = rows[fits], p[fits]
                    if start:
                        fits = self.parted(last[rows, start], p)
                        rows, p = rows[fits], p[fits]
                value = (total[rows, start] if self.kind == "unigram" else 0) + self.score[p]
                better = value > total[rows, j]
                rows, p = rows[better], p[better]
                total[rows, j], last[rows, j], length[rows, j] = value[better], p, j - start
        out, at = np.zeros((n, size), "<u4"), np.full(n, size)
        left = np.full(n, size)
        live = np.arange(n)
        while len(live):
            left[live] -= 1
            out[live, left[live]] = last[live, at[live]]
            at[live] -= length[live, at[live]]
            live = live[at[live] > 0]
        flat = out.tobytes()
        return [flat[4 * (i * size + k) : 4 * (i + 1) * size] for i, k in enumerate(left.tolist())]

    @lru_cache(maxsize=4096)  # noqa: B019
    def blanks(self, n: int) -> bytes:
        """Ids of n blanks in a row: the largest runs first."""
        out, runs = [], sorted((len(t) for t in self.id_of if not t.strip(BLANK)), reverse=True)
        for size in runs:
            out += [self.id_of[BLANK * size]] * (n // size)
            n %= size
        return np.array(out, "<u4").tobytes()


class Encoder:
    """Words to ids with a cache, which is dropped when it takes about `most` bytes, and by `forget`."""

    def __init__(self, model: Model, most: int = 48_000_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def units(self, text: str) -> list[str]:
        """Blanks and the word behind them; a text starts with one blank more."""
        return UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def learn(self, units: set[str]) -> None:
        model, parts, by_size, plain = self.model, {}, {}, {}
        for u in units:
            word = u.lstrip(BLANK)
            runs = len(u) - len(word)
            if word and runs == 1 and model.known.issuperset(u):
                plain.setdefault(len(u), []).append(u)
                continue
            if not word:
                self.known[u] = model.blanks(runs)
                continue
            text = BLANK + word if runs else word
            cut = [text]
            if not model.known.issuperset(text):
                cut, at = [], 0
                for i, c in enumerate(text):
                    if c not in model.known:
                        cut += [text[at:i], c]
                        at = i + 1
                cut = [x for x in [*cut, text[at:]] if x]
            parts[u] = (max(0, runs - 1), cut)
            for x in cut:
                if len(x) > 1 or x in model.known:
                    by_size.setdefault(len(x), {})[x] = None
        ids: dict[str, bytes] = {}
        for found, groups in ((self.known, plain), (ids, by_size)):
            for size, words in groups.items():
                words = list(words)
                step = max(1, 4_000_000 // (size + 1))
                for i in range(0, len(words), step):
                    found.update(zip(words[i : i + step], model.viterbi(words[i : i + step]), strict=True))
        first = np.array([model.id_of.get(BLANK, 0)], "<u4").tobytes()
        for u, (runs, cut) in parts.items():
            found = [ids[x] if x in ids else np.array([model.byte[b] for b in x.encode()], "<u4").tobytes() for x in cut]
            if runs:  # a blank that stayed alone joins the blanks before it
                alone = found[0][:4] == first
                found[0] = model.blanks(runs + alone) + found[0][4 * alone :]
            self.known[u] = b"".join(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            end, size, held = at, 0, []
            while end < len(texts) and size < 4_000_000:
                held.append(self.units(texts[end]))
                size += len(texts[end])
                end += 1
            fresh = set().union(*held).difference(self.known)
            self.learn(fresh)
            self.held += sum(ENTRY + len(u) + len(self.known[u]) for u in fresh)
            for units in held:
                out.append(np.frombuffer(b"".join(map(self.known.__getitem__, units)), "<u4"))
            if self.held > self.most:
                self.forget()
            at = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding put first is taken away."""
        text = b"".join(map(self.model.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str = MODEL, kind: str = "bpe") -> Encoder:
    """One for each Python worker; `name` is a path or a public file's name."""
    if (name, kind) not in _encoders:
        import public_tokenizers

        _encoders[name, kind] = Encoder(Model(name if "/" in name else public_tokenizers.path(name), kind))
    return _encoders[name, kind]


def encode(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids) of every row."""

    def apply(batches):
        for batch in batches:
            ids = encoder(model, kind).encode(batch.column("text").to_pylist())
            sizes = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], ["doc_id", "ids"])
        encoder(model, kind).forget()

    return id_and_text(docs).mapInArrow(apply, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text."""

    def apply(batches):
        for batch in batches:
            own = encoder(model, kind)
            texts = [own.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(apply, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, same): a digest of every row's ids, and whether decoding them gives the text."""

    def apply(batches):
        for batch in batches:
            own, texts = encoder(model, kind), batch.column("text").to_pylist()
            ids = own.encode(texts)
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "same"])
        encoder(model, kind).forget()

    return id_and_text(docs).mapInArrow(apply, "doc_id long, n_ids long, ids_crc32 long, same boolean")
