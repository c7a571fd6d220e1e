"""Packing of token pieces into sequences: shortest-pack-first over the length histogram.

Texts are tokenised by their distinct words (the tokenizer never joins across blanks), each word once per
task as long as the cache of a few MB holds it. A document's ids, with an end id, are cut into pieces of at most
the sequence length. The histogram of piece lengths, at most that many numbers, goes to the driver, which
places lengths longest first into the emptiest open packing pattern, updating pattern counts. A piece finds
its sequence by its rank among pieces of its length, without any shuffle of texts or ids.

Null and empty texts are one piece that holds the end id; a text of any length is cut into as many pieces as it takes.
Null ids stay null, repeated rows are packed each. Pieces of equal length are interchangeable: which of them goes where
follows tasks and rows. Other columns, whatever their names, are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import heapq
import os
from array import array
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, materialize, stretches

LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes that a word in the cache takes besides its letters and ids.
ENTRY = 180


class WordIds:
    """Ids of texts by their distinct words, with a cache of ids as bytes of unsigned 32-bit numbers.

    The cache is dropped when it takes about `most` bytes, and by `forget`.

    A word made of Latin letters and closing marks is looked up as its lower-case letters and its marks. New letter
    runs are encoded many at a time by the same model without the steps that leave such runs as they are,
    and parted again behind the pieces that end a word. All other words go through the whole tokenizer.
    """

    MARKS = ".,;:!?"
    LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"

    def __init__(self, path: str, most: int = 24_000_000, longest: int = 64, together: int = 100):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        whole = Tokenizer.from_file(path)
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        self.encode_runs = lambda texts: [e.ids for e in bare.encode_batch_fast(texts, add_special_tokens=False)]
        self.ends = np.zeros(whole.get_vocab_size(), bool)
        for piece, i in whole.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.most, self.longest, self.together = most, longest, together
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def learn(self, keys: list[str]) -> None:
        """Add the ids of new words; letter runs are those in lower case."""
        letters = pc.match_substring_regex(pa.array(keys, pa.string()), self.LETTERS).to_pylist()
        runs = [k for k, plain in zip(keys, letters, strict=True) if plain and k.islower()]
        odd = [k for k, plain in zip(keys, letters, strict=True) if not (plain and k.islower())]
        self.known.update((k, array("I", ids).tobytes()) for k, ids in zip(odd, self.encode(odd), strict=True))
        lines = [" ".join(runs[i : i + self.together]) for i in range(0, len(runs), self.together)]
        ids = array("I")
        for line in self.encode_runs(lines):
            ids.extend(line)
        flat = np.frombuffer(ids, "<u4") if len(ids) else np.zeros(0, "<u4")
        raw, at = flat.tobytes(), 0
        stops = (4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()
        for run, stop in zip(runs, stops, strict=True):
            self.known[run] = raw[at:stop]
            at = stop

    def parts(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words in a row, and how many each word has."""
        if self.held > self.most:
            self.forget()
        known = self.known
        fresh = [k for k in keys if k not in known]
        self.learn(fresh)
        found = [known[k] for k in keys]
        for k in fresh:
            if len(k) > self.longest:
                known.pop(k, None)
            else:
                self.held += ENTRY + len(k) + len(known[k])
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n+1 places where texts begin and end."""
        words = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        bounds = words.offsets.to_numpy()
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds, distinct = bounds - bounds[0], coded.dictionary
        core = pc.utf8_rtrim(distinct, characters=self.MARKS)
        plain = pc.match_substring_regex(core, self.LETTERS)
        keys = pc.if_else(plain, pc.utf8_lower(core), distinct).dictionary_encode()
        cut = pc.and_(plain, pc.not_equal(pc.binary_length(core), pc.binary_length(distinct)))
        marked = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        marks = pa.array([w[len(w.rstrip(self.MARKS)) :] for w in distinct.filter(cut).to_pylist()], pa.string()).dictionary_encode()
        low, low_sizes = self.parts(keys.dictionary.to_pylist())
        end, end_sizes = self.parts(marks.dictionary.to_pylist())
        # The parts of each distinct word: its key, then its marks.
        last = len(low_sizes) + len(end_sizes)
        pair = np.full((len(distinct), 2), last, np.int64)
        pair[:, 0] = keys.indices.to_numpy()
        pair[marked, 1] = len(low_sizes) + marks.indices.to_numpy()
        sizes = np.concatenate([low_sizes, end_sizes, [0]])
        flat = gathered(np.concatenate([low, end]), sizes, pair.reshape(-1))
        sizes, order = sizes[pair].sum(axis=1), coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        return gathered(flat, sizes, order), ends[bounds]


def gathered(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Runs of `flat`, whose sizes are given, in another order."""
    starts, n = np.cumsum(sizes) - sizes, sizes[order]
    shift = np.repeat(starts[order] - (np.cumsum(n) - n), n)
    shift += np.arange(len(shift))
    return flat[shift]


#: One tokenizer for each Python worker; its cache lasts for a task.
_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document; `nth` counts pieces of the same length within a task, `part` names the task."""

    def split(batches):
        words, part, seen = word_ids(tokenizer_path(tokenizer)), TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            rows, docs_ids, texts = [], batch.column("doc_id").to_pylist(), batch.column("text")
            for at, n in stretches(texts):
                flat, bounds = words.ids(texts.slice(at, n))
                for doc_id, low, high in zip(docs_ids[at : at + n], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.append(flat[low:high], np.array([end_id], "<u4"))
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        rows.append((doc_id, start, len(piece), crc32(piece), len(ids), part, seen[len(piece)]))
                        seen[len(piece)] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])
        words.forget()

    return id_and_text(docs).mapInArrow(split, PIECES)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used.

    Lengths are placed from the longest on, each into the open pattern with the most room, as often as both
    last; what does not fit opens a new pattern.
    """
    open_: list[tuple[int, int, tuple[int, ...], int]] = []  # (-room, order, pattern, count)
    done, order = [], 0
    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        left = histogram[size]
        while left:
            if open_ and -open_[0][0] >= size:
                room, _, pattern, count = heapq.heappop(open_)
                room = -room
                used = min(left, count)
                if used < count:
                    heapq.heappush(open_, (-room, (order := order + 1), pattern, count - used))
            else:
                room, pattern, used = length, (), max(1, left // max(1, length // size))
            left -= used
            if room - size:
                heapq.heappush(open_, (size - room, (order := order + 1), (*pattern, size), used))
            else:
                done.append(((*pattern, size), used))
    return done + [(pattern, count) for _, _, pattern, count in sorted(open_, key=lambda x: x[1])]


def slots(patterns: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Where pieces go: for each length, ranges of ranks with their first sequence, pieces a sequence and offset."""
    out, base, rank = [], 0, [0] * (length + 1)
    for pattern, count in patterns:
        offset = 0
        for size, same in groupby(pattern):
            n = len(list(same))
            out.append((size, rank[size], base, n, offset))
            rank[size] += n * count
            offset += n * size
        base += count
    out.sort()
    names = ("length", "low", "base", "each", "offset")
    return {k: np.array([x[i] for x in out], np.int64) for i, k in enumerate(names)}


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    found = materialize(pieces(docs, tokenizer, length, end_id), "packing")
    by_part = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = by_part.withColumn("first", before)
    histogram = {r["length"]: r["n"] for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = slots(shortest_pack_first(histogram, length), length)
    far = 1 << 44  # ranks stay below this
    keys = at["length"] * far + at["low"]

    def place(batches):
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            s = np.searchsorted(keys, size * far + rank, side="right") - 1
            turn, within = np.divmod(rank - at["low"][s], at["each"][s])
            out = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            out += [pa.array(at["base"][s] + turn), pa.array(at["offset"][s] + within * size)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = found.join(firsts.select("length", "part", "first"), ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, columns)
