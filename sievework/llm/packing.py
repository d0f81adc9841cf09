"""Best-fit packing of tokenised documents with a swap-based local search.

Documents become pieces of at most one sequence, pieces are dealt at random into groups of bounded size, and each group
is packed on its own: best fit in decreasing order, then a local search that increases the sum of squared fills.  The
lightest sequences give their pieces away by moves, one-for-one and two-for-one exchanges with fuller ones, until they
are empty or no exchange helps.  A group ends with at most about one sequence that is not nearly full, so the loss
against packing everything together is about one sequence in ``group_size`` pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from sievework.llm.common import written

CAPACITY = 2048
# A space or line end is a cut between tokens when no blank follows it; the last marks are ones some tables count as blanks.
_CUT = re.compile("[ \n](?![\\s\u180e\u200b\ufeff]|\\Z)")
_ODD = re.compile("[ \n](?:[\\s\u180e\u200b\ufeff]|\\Z)")


def _bytes_in(*ranges: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[ord(first) : ord(last) + 1] = True
    return table


# Bytes of a word that the byte-level split leaves whole (with the letters from U+00C0 on, which are two bytes each), and of the marks at its end.
_ASCII_LETTERS = _bytes_in("AZ", "az")
_MARKS = _bytes_in("!/", ":@", "[`", "{~")


def _byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a text as little-endian 32-bit numbers.

    The tokenizer splits before every single space or line end that a visible character follows, so what stands between such places
    is encoded on its own, each different part of a call once; ids are gathered by the parts' numbers.  It also splits between a word
    and the marks at its end and behind a line end, so words and marks go straight to the merges of a byte-level model, many in one call.
    Texts that name one of the tokenizer's added tokens are encoded whole, as those tokens are cut out before anything else.

    Of the other parts at most twice ``remembered`` are kept: those met since the last change of generation, and the generation before.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        told = json.loads(self.tokenizer.to_str())
        model, split = told["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        altered = ("byte_fallback", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
        plain = told["normalizer"] is None and model["type"] == "BPE" and not any(model.get(k) for k in altered)
        letters = _byte_letters()
        self.letters = None
        if plain and split.items() <= (told["pre_tokenizer"] or {}).items() and model["vocab"].keys() >= set(letters.values()):
            self.letters = letters | {0: "\0"}  # no text in parts has a zero of its own
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = CharDelimiterSplit("\0")
            self.sizes = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # bytes of each token
            self.sizes[list(model["vocab"].values())] = [len(t) for t in model["vocab"]]

    @staticmethod
    def cut(text: str) -> str:
        """The text with a zero at every place before which it ends for the tokenizer."""
        if not _ODD.search(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n")
        return _CUT.sub("\0\\g<0>", text)

    def _whole(self, parts: Sequence[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _worded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which parts are a word and marks behind it, if any, and where the word ends; the first mark is no apostrophe."""
        wide = np.concatenate(([False], data[:-1] == 0xC3)) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)  # not the signs for times and division
        letter = _ASCII_LETTERS[data] | (data == 0xC3) | wide
        first = starts + ((data[starts] == 32) | (data[starts] == 10))
        other, unmarked = np.flatnonzero(~letter), np.flatnonzero(~_MARKS[data])
        stop = other[np.searchsorted(other, first)]
        upto = unmarked[np.searchsorted(unmarked, stop)]
        return (stop > first) & (upto == ends) & (data[stop] != ord("'")), stop

    def _merged(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with their marks, and how many each has; tokens are as long as their bytes, so these tell where a word's end."""
        sizes = ends - starts
        base = np.cumsum(sizes) - sizes
        text = data[np.repeat(starts - base, sizes) + np.arange(int(sizes.sum()))]
        lines, marked = data[starts] == 10, stops < ends
        between = np.concatenate((base[1:], (base + 1)[lines], (base + stops - starts)[marked]))
        spelt = np.insert(text, np.sort(between), 0).tobytes().decode("latin-1").translate(self.letters)
        (got,) = self.merges.encode_batch_fast([spelt], add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), base + sizes) + 1
        return ids, np.diff(upto, prepend=0)

    def _others(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known = self.known
        known.update({p: ids for p in parts if p not in known and (ids := self.older.get(p)) is not None})
        new = [p for p in parts if p not in known]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            known.update(zip(some, self._whole([p.decode() for p in some])))
        out = [known[p] for p in parts]
        for part in new:
            if len(part) > 64:
                del known[part]
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        named = {i: t for i, t in enumerate(texts) if "\0" in t or any(a in t for a in self.added)}
        found = self._gathered([self.cut(t) for i, t in enumerate(texts) if i not in named])
        whole = iter(self._whole(list(named.values())))
        return [next(whole if i in named else found) for i in range(len(texts))]

    def _gathered(self, cuts: list[str]) -> Iterator[bytes]:
        if not cuts:
            return
        data = "\0".join([*cuts, ""]).encode()
        edges = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 0) + 1))
        parts = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        codes, (_, offsets, content) = parts.indices.to_numpy(), parts.dictionary.buffers()
        different = np.frombuffer(content, np.uint8)
        edges = np.frombuffer(offsets, np.int64)[: len(parts.dictionary) + 1]
        starts, ends = edges[:-1], edges[1:] - 1  # without the zero
        words, stops = self._worded(different, starts, ends) if self.letters else (np.zeros(len(starts), bool), starts)
        sizes = np.zeros(len(starts), np.int64)
        ids, sizes[words] = self._merged(different, starts[words], stops[words], ends[words]) if words.any() else (np.zeros(0, np.uint32), 0)
        other = self._others([different[a:b].tobytes() for a, b in zip(starts[~words].tolist(), ends[~words].tolist())])
        sizes[~words] = [len(p) // 4 for p in other]
        pool = np.concatenate((ids, np.frombuffer(b"".join(other), np.uint32)))
        at = np.empty(len(starts), np.int64)
        order = np.concatenate((np.flatnonzero(words), np.flatnonzero(~words)))
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        counts = sizes[codes]
        upto = np.cumsum(counts)
        got = pool[np.repeat(at[codes] - (upto - counts), counts) + np.arange(int(upto[-1]))]
        last = upto[np.cumsum([cut.count("\0") + 1 for cut in cuts]) - 1].tolist()
        yield from (got[a:b].tobytes() for a, b in zip([0, *last], last))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def _texts(column: pa.Array, chars: int = 8_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about that many characters, with the place of the first; a longer text stands alone."""
    run, size, start = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if run and size + len(text) > chars:
            yield start, run
            run, size, start = [], 0, i
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def tokenise(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ids: bool = True, narrow: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids``.

    A document is its token ids and an id 0.  Longer ones are cut into full pieces; the first takes what is left over.
    ``narrow`` ids are bytes for the way to ``widened``: two a token where the ids of a piece allow it, else four.
    ``tokenizer`` is a file that every executor has.
    """
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                owner, rows, blobs = [], [], []
                for i, raw in enumerate(encode(texts), first):
                    raw += b"\0\0\0\0"
                    n = len(raw) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = raw[4 * a : 4 * b]
                        owner.append(i)
                        rows.append((k, a, b - a, zlib.crc32(part)))
                        if narrow:
                            blobs.append(_narrowed(part))
                        elif ids:
                            blobs.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
                columns += [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(fields)]
                if ids:
                    columns.append(pa.array(blobs, pa.binary() if narrow else pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f.name for f in fields], *(["ids"] if ids else [])])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (f", ids {'binary' if narrow else 'array<int>'}" if ids else "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _narrowed(part: bytes) -> bytes:
    """Little-endian 32-bit ids as 16-bit ones if none is larger."""
    found = np.frombuffer(part, "<u4")
    return found.astype("<u2").tobytes() if found.max() < 1 << 16 else part


def widened(pieces: DataFrame, size: int = 1_000) -> DataFrame:
    """Pieces whose ``ids`` are narrow bytes, with them as an array; a piece has an id at least, so its ``length`` tells how wide they are."""
    at, length = pieces.columns.index("ids"), pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, size):
                batch = whole.slice(first, size)
                sizes = batch.column(length).to_numpy()
                some = [np.frombuffer(b.as_py(), "<u2" if len(b.as_py()) == 2 * n else "<u4").astype(np.int32) for b, n in zip(batch.column(at), sizes)]
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some)))
                columns = [ids if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = pieces.withColumn("ids", F.lit(None).cast("array<int>")).schema
    return pieces.mapInArrow(run, schema)


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Best fit in decreasing order; bins as lists of item numbers.  Bins are found by a bit mask of free spaces."""
    spaces: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    mask = 0
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fitting = mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            own = spaces[space].pop()
            if not spaces[space]:
                mask ^= 1 << space
        else:
            space, own = capacity, len(bins)
            bins.append([])
        bins[own].append(item)
        left = space - size
        if left:
            if not spaces.setdefault(left, []):
                mask |= 1 << left
            spaces[left].append(own)
    return bins


class Search:
    """Local search over the underfull bins of a group: exchanges that make a fuller bin fuller, until bins are empty.

    Every exchange raises the sum of squared fills, so the search ends by itself.  What a bin could take in place of a piece, or of two,
    depends on lengths alone, so all partners of a giver are judged at once, by a table over lengths.
    """

    def __init__(self, lengths: Sequence[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = np.asarray(lengths, np.int64), capacity
        self.bins = [set(b) for b in bins]
        self.where = np.zeros(len(self.lengths), np.int64)
        for number, members in enumerate(bins):
            self.where[members] = number
        self.fill = np.bincount(self.where, self.lengths, len(bins)).astype(np.int64)
        self.used = len(bins)
        self.exchanges = 0
        self._judged, self._tables = -1, {}

    def _takers(self, giver: int) -> np.ndarray:
        fits = (self.fill >= self.fill[giver]) & (self.fill < self.capacity)
        fits[giver] = False
        return fits

    def _exchange(self, giver: int, taker: int, out: Sequence[int], back: Sequence[int]) -> None:
        """Pieces ``out`` go from giver to taker, pieces ``back`` the other way; the taker gets fuller."""
        for pieces, source, goal in ((out, giver, taker), (back, taker, giver)):
            self.bins[source].difference_update(pieces)
            self.bins[goal].update(pieces)
            self.where[list(pieces)] = goal
        gain = int(self.lengths[list(out)].sum() - self.lengths[list(back)].sum())
        self.fill[giver] -= gain
        self.fill[taker] += gain
        self.used -= not self.bins[giver]
        self.exchanges += 1

    def _least(self, given: np.ndarray, room: np.ndarray) -> np.ndarray:
        """For each length up to the capacity: the shortest thing that can be given back for it."""
        table = np.full(self.capacity + 2, self.capacity + 1, np.int64)
        np.minimum.at(table, np.minimum(given + room, self.capacity), given)
        return np.minimum.accumulate(table[::-1])[::-1]

    def _some(self, own: np.ndarray) -> np.ndarray:
        """Of each length two pieces, as two of one length may go together."""
        _, first = np.unique(self.lengths[own], return_index=True)
        rest = np.delete(own, first)
        _, second = np.unique(self.lengths[rest], return_index=True)
        return np.concatenate((own[first], rest[second]))

    def _items(self, takers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the bins, bin by bin, their lengths and the room of their bins."""
        items = np.flatnonzero(takers[self.where])
        items = items[np.argsort(self.where[items], kind="stable")]
        return items, self.lengths[items], self.capacity - self.fill[self.where[items]]

    def _pairs(self, items: np.ndarray, given: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the two pieces of every pair inside a bin that is shorter than ``below``."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(1, len(items)):
            same = np.flatnonzero(self.where[items[apart:]] == self.where[items[:-apart]])
            if not len(same):
                break
            same = same[given[same] + given[same + apart] < below]
            left.append(same)
            right.append(same + apart)
        return np.concatenate(left), np.concatenate(right)

    def _hopeless(self, total: np.ndarray, two: bool) -> bool:
        """Whether no open bin at all could take any of these lengths for a shorter thing; kept until the next exchange."""
        if self._judged != self.exchanges:
            self._judged, self._tables = self.exchanges, {}
        if two not in self._tables:
            items, given, room = self._items((self.fill < self.capacity) & (self.fill > 0))
            if two:
                left, right = self._pairs(items, given, self.capacity)
                given, room = given[left] + given[right], room[left]
            self._tables[two] = self._least(given, room)
        return bool((total <= self._tables[two][total]).all())

    def step(self, giver: int) -> bool:
        """The exchange that takes most out of the giver; False if none takes anything."""
        own = np.fromiter(self.bins[giver], np.int64, len(self.bins[giver]))
        own = own[np.argsort(-self.lengths[own], kind="stable")]
        takers = self._takers(giver)
        bins = np.flatnonzero(takers)
        if not len(bins):
            return False
        room = self.capacity - self.fill[bins]
        by_room = np.argsort(room, kind="stable")
        at = np.searchsorted(room[by_room], self.lengths[own])  # moves, the longest piece that fits anywhere
        fitting = np.flatnonzero(at < len(bins))
        if len(fitting):
            self._exchange(giver, int(bins[by_room[at[fitting[0]]]]), [int(own[fitting[0]])], [])
            return True
        some = self._some(own)
        size = self.lengths[some]
        a, b = np.triu_indices(len(some), 1)
        total = np.concatenate((size, size[a] + size[b]))
        fits = np.flatnonzero(total <= self.capacity)
        if not self._hopeless(total[fits], False):
            items, given, space = self._items(takers)
            gain = total[fits] - self._least(given, space)[total[fits]]
            if gain.max() > 0:  # one for one, and two of the giver for one
                at = int(fits[gain.argmax()])
                out = [at] if at < len(some) else [a[at - len(some)], b[at - len(some)]]
                partner = np.flatnonzero((given == total[at] - gain.max()) & (given + space >= total[at]))[0]
                self._exchange(giver, int(self.where[items[partner]]), [int(some[i]) for i in out], [int(items[partner])])
                return True
        if not self._hopeless(size, True):
            items, given, space = self._items(takers)
            left, right = self._pairs(items, given, int(size.max()))
            both, space = given[left] + given[right], space[left]
            gain = size - self._least(both, space)[size]
            if gain.max() > 0:  # one of the giver for two
                at = int(gain.argmax())
                pair = np.flatnonzero((both == size[at] - gain.max()) & (both + space >= size[at]))[0]
                back = [int(items[left[pair]]), int(items[right[pair]])]
                self._exchange(giver, int(self.where[back[0]]), [int(some[at])], back)
                return True
        return False

    def run(self) -> list[list[int]]:
        """Lightest bins first, again and again, as long as fewer bins are possible at all and something changes."""
        needed = -(-int(self.fill.sum()) // self.capacity)
        changed = True
        while changed:
            changed = False
            for giver in np.argsort(self.fill, kind="stable"):
                while self.bins[giver] and self.used > needed and self.fill[giver] < self.capacity and self.step(int(giver)):
                    changed = True
        return [sorted(b) for b in self.bins if b]


def pack_lengths(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: best fit, then the search until no exchange helps."""
    return Search(lengths, best_fit(lengths, capacity), capacity).run()


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = 10_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with a ``length`` of 1 to ``capacity``.

    Repeated rows are packed each.  An empty table gives no rows.
    """
    added = ("sequence_id", "offset")
    kept = [c for c in pieces.columns if c not in added]
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.select(*kept).withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for number, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (int(key[0]) << 32) + number, at
                at += lengths[i]
        return rows.drop(columns="_group").assign(sequence_id=sequence, offset=offset)

    schema = dealt.drop("_group").withColumns({n: F.lit(0).cast("long") for n in added}).schema
    return dealt.groupBy("_group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    With ``ids`` each piece carries its token ids (see ``sequences``).  Null and empty texts are documents of the id 0 alone; null ids are kept; repeated rows are documents of their own; an
    empty table gives no rows; of the input only the id and the text are used, so other columns cannot clash.
    """
    pieces = written(tokenise(docs, tokenizer, doc_id, text, capacity, ids, narrow=ids), "pieces")
    if not ids:
        return pack(pieces, capacity)
    # Ids stay out of the search; a piece finds its own again by the file and row it was written to.  They are exchanged as narrow bytes.
    at = pieces.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return widened(pack(at.drop("ids"), capacity).join(at.select("_file", "_row", "ids"), ["_file", "_row"]).drop("_file", "_row"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its token ``ids``, from packed pieces that carry their ids; a sequence is at most one capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
