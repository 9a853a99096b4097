"""The two dedup operators over the steps of ``anchors``: words with suffix trees, bytes with suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .anchors import anchor_runs, pack, unpack
from .linear_grouping import suffix_order
from .tokens import buffer_of, runs_hash, slices, span_hashes, word_bounds

_LAST = np.iinfo(np.int64).max


def _ids(table) -> np.ndarray:
    ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False)


def ordered(table):
    """The rows by doc_id (null last), equal ids by text: the order in which occurrences are earlier or later."""
    key = _ids(table)
    order = np.argsort(key, kind="stable")
    if len(key) > 1 and (np.diff(key[order]) == 0).any():
        texts = table["text"].to_pylist()
        order = np.array(sorted(range(len(key)), key=lambda i: (key[i], texts[i] or "")))
    return table.take(pa.array(order))


def _unfolded(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of consecutive numbers: the run each number is of, and all the numbers."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]


def _folded(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of consecutive numbers with one owner begin, and how long they are."""
    new = np.ones(len(number), bool)
    new[1:] = (np.diff(number) != 1) | (np.diff(owner) != 0)
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(number)))


def _runs(row: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of windows as they are sent: row of the chunk, first unit in it, number of windows."""
    return np.stack([row, start, count], axis=1).astype(np.int32)


class Fragments:
    """Stretches of text around anchors, in order of occurrence, one for each run of windows with one anchor.

    ``data`` holds text; ``begin`` and ``end`` are the bytes of a fragment in it, ``anchor`` the byte at which its anchor
    begins, ``count`` how many windows start in it, ``first`` the unit it begins with.
    """

    __slots__ = ("data", "begin", "end", "anchor", "count", "first")

    def __init__(self, data, begin, end, anchor, count, first):
        self.data, self.begin, self.end, self.anchor = data, begin, end, anchor
        self.count, self.first = count, first

    def pick(self, at: np.ndarray) -> Fragments:
        return Fragments(self.data, *(getattr(self, n)[at] for n in self.__slots__[1:]))

    def twins(self) -> tuple[np.ndarray, np.ndarray]:
        """The fragments whose text comes first here, and for each fragment if an earlier one has its text and anchor."""
        seen: set = set()
        again = np.zeros(len(self.count), bool)
        for f, (b, e, a) in enumerate(zip(self.begin.tolist(), self.end.tolist(), self.anchor.tolist())):
            key = (self.data[b:e], a - b)
            if key in seen:
                again[f] = True
            else:
                seen.add(key)
        return np.flatnonzero(~again), again


class Method:
    """What both operators share: L units to a window, anchors of k units."""

    length: int
    k: int

    def prepare(self, table):
        """Prepared text (``data``, ``offsets`` of documents, ``starts`` and ``ends`` of units, ``first`` unit of each document) of ordered rows."""
        raise NotImplementedError

    def grams(self, text: Text, a: int, b: int) -> np.ndarray:
        """Hashes of the k-grams that begin at units a to b."""
        raise NotImplementedError

    def repeats(self, found: Fragments) -> np.ndarray:
        """Per window of the fragments, in order: does an equal one come earlier?"""
        raise NotImplementedError

    def late(self, found: Fragments) -> np.ndarray:
        """``repeats``, for which a text that comes again as a whole is looked at once."""
        fresh, again = found.twins()
        out = np.repeat(again, found.count)
        out[~out] = self.repeats(found.pick(fresh))
        return out

    def anchors(self, table) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for part in slices(table, "text", 1 << 20):
            text = self.prepare(part)
            out.append(np.unique(anchor_runs(lambda a, b: self.grams(text, a, b), text.first, self.length, self.k)[3]))
        return np.unique(np.concatenate(out))

    def fragments(self, table, shared: np.ndarray):
        """What repeats inside a chunk (packed), and of its other windows those with shared anchors as fragments to send."""
        table = ordered(table)
        text = self.prepare(table)
        low, count, at, gram = anchor_runs(lambda a, b: self.grams(text, a, b), text.first, self.length, self.k)
        if not len(low):
            return None, np.zeros(0, np.uint64), None
        # Anchors that the chunk has at two places or more are settled here.
        place = np.concatenate([[0], np.cumsum(np.diff(at) != 0)])
        _, kind = np.unique(gram, return_inverse=True)
        often = (np.bincount(kind[np.flatnonzero(np.diff(place, prepend=-1))])[kind] > 1)
        mine = np.flatnonzero(often)
        owner, unit = _unfolded(low[mine], count[mine])
        late = self.late(self._cut(text, low[mine], count[mine], at[mine]))
        row = lambda u: np.searchsorted(text.first, u, "right") - 1
        head, n = _folded(row(unit[late]), unit[late])
        start = unit[late][head]
        own = _runs(row(start), start - text.first[row(start)], n).tobytes() or None
        # Windows that come first in the chunk, of runs whose anchor another chunk has too.
        head, n = _folded(owner[~late], unit[~late])
        whole = np.flatnonzero(~often)
        left = mine[owner[~late][head]]
        run = np.concatenate([whole, left])
        low, count = np.concatenate([low[whole], unit[~late][head]]), np.concatenate([count[whole], n])
        near = np.searchsorted(shared, gram[run])
        known = shared[np.minimum(near, len(shared) - 1)] == gram[run] if len(shared) else np.zeros(len(run), bool)
        run, low, count = run[known], low[known], count[known]
        found = self._cut(text, low, count, at[run])
        rows = row(low)
        ids = np.ascontiguousarray(_ids(table)[rows]).view(np.int32).reshape(-1, 2)
        numbers = np.stack([found.end - found.begin, found.anchor - found.begin, count, rows, low - text.first[rows], ids[:, 0], ids[:, 1]]).astype(np.int32)
        begin, end = found.begin, found.end

        def blob(w: np.ndarray) -> bytes:
            return pack(numbers[:, w], b"".join([found.data[x:y] for x, y in zip(begin[w].tolist(), end[w].tolist())]))

        return own, gram[run], blob

    def _cut(self, text: Text, low, count, at) -> Fragments:
        return Fragments(text.data, text.starts[low], text.upto(low + count + self.length - 2), text.starts[at], count, low)

    def answer(self, blobs: list[bytes]):
        """Per blob, the windows of its fragments that are not first anywhere: row, start, and number of consecutive ones."""
        numbers, data = zip(*map(unpack, blobs))
        source = np.repeat(np.arange(len(blobs)), [x.shape[1] for x in numbers])
        numbers = np.concatenate(numbers, axis=1)
        size, anchor, count, row, start = numbers[:5].astype(np.int64)
        doc = np.ascontiguousarray(numbers[5:].T).view(np.int64).ravel()
        end = np.cumsum(size)
        begin = end - size
        order = np.lexsort((start, row, doc))
        found = Fragments(b"".join(data), begin[order], end[order], (begin + anchor)[order], count[order], None)
        found.first = self.units_before(found)
        late = self.late(found)
        owner, unit = _unfolded(start[order], found.count)
        head, n = _folded(owner[late], unit[late])
        f = order[owner[late][head]]
        back = np.argsort(source[f], kind="stable")
        runs = _runs(row[f], unit[late][head], n)[back]
        cuts = np.searchsorted(source[f][back], np.arange(len(blobs) + 1)).tolist()
        for low, high in zip(cuts, cuts[1:]):
            yield runs[low:high].tobytes() if high > low else None

    def units_before(self, found: Fragments) -> np.ndarray:
        """The unit of the whole data that each fragment begins with."""
        raise NotImplementedError

    def covered(self, text: Text, answers: list[bytes]) -> np.ndarray:
        """Per unit whether a repeated window covers it."""
        change = np.zeros(int(text.first[-1]) + 1, np.int32)
        row, start, count = np.frombuffer(b"".join(answers), np.int32).reshape(-1, 3).T
        low = text.first[row] + start
        np.add.at(change, low, 1)
        np.add.at(change, low + count - 1 + self.length, -1)
        return np.cumsum(change, dtype=np.int32)[:-1] > 0

    def finish(self, table, answers: list[bytes]) -> pa.Table:
        raise NotImplementedError


class Text:
    """Documents as one byte string; see ``Method.prepare``."""

    __slots__ = ("data", "flat", "offsets", "starts", "ends", "first")

    def __init__(self, data: bytes, flat, offsets, starts, ends, first):
        self.data, self.flat, self.offsets, self.starts, self.ends, self.first = data, flat, offsets, starts, ends, first

    def upto(self, unit: np.ndarray) -> np.ndarray:
        """The byte behind a unit and the space that ends it, if units are words."""
        return self.ends[unit]


def _spans(gone: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs: begin and end, counted in their document, and the first of each document (and the end)."""
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    begins = first[:-1][first[:-1] < first[1:]]
    edge[begins] = gone[begins]
    low = np.flatnonzero(edge)
    stop = gone.copy()
    stop[:-1] &= ~gone[1:]
    ends = first[1:][first[:-1] < first[1:]] - 1
    stop[ends] = gone[ends]
    high = np.flatnonzero(stop) + 1
    doc = np.searchsorted(first, low, "right") - 1
    return low - first[doc], high - first[doc], np.searchsorted(doc, np.arange(len(first)))


def _listed(low: np.ndarray, high: np.ndarray, cuts: np.ndarray) -> pa.Array:
    pairs = pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)


class Subtree:
    """A suffix tree of some leaves: their order, and how deep each meets the one before it.

    A leaf is a suffix of the words ``ids``, given by where it begins; leaves come in order of occurrence. Suffixes are
    followed to ``depth`` words. An inner node is a run of ordered leaves that meet at its depth and no deeper.
    """

    def __init__(self, ids: np.ndarray, leaves: np.ndarray, depth: int):
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        each = max(1, 63 // bits)
        keys = []
        for a in range(0, depth, each):
            key = np.zeros(len(leaves), np.int64)
            for j in range(a, min(depth, a + each)):
                key = (key << bits) | ids[leaves + j]
            keys.append(key)
        # Stable: leaves of equal suffixes stay in order of occurrence.
        self.order = np.lexsort(keys[::-1])
        x, y = leaves[self.order[:-1]], leaves[self.order[1:]]
        self.meets = np.zeros(len(leaves), np.int64)
        alive = np.ones(len(x), bool)
        for j in range(depth):
            alive &= ids[x + j] == ids[y + j]
            self.meets[1:] += alive

    def deep_nodes(self, least: int) -> list[tuple[int, int]]:
        """The inner nodes at ``least`` words or deeper that lie under no other such node: (first, last) of their ordered leaves."""
        deep = np.concatenate([[False], self.meets[1:] >= least, [False]])
        return list(zip((np.flatnonzero(~deep[:-1] & deep[1:])).tolist(), (np.flatnonzero(deep[:-1] & ~deep[1:])).tolist()))


class WordTrees(Method):
    """Windows of words; variable-length prefixes deal suffixes to subtrees, whose deep inner nodes are the repeats."""

    def __init__(self, length: int = 20, k: int = 8, capacity: int = 65_536):
        self.length, self.k, self.capacity = length, k, capacity

    def prepare(self, table):
        flat, offsets = buffer_of(table["text"])
        data = flat.tobytes()
        # Every word ends with one space.
        texts = [b" ".join(x) + b" " if (x := data[offsets[i] : offsets[i + 1]].split()) else b"" for i in range(len(offsets) - 1)]
        data = b"".join(texts)
        flat = np.frombuffer(data, np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        s, e, first = word_bounds(flat, offsets)
        return Text(data, flat, offsets, s, e + 1, first)

    def grams(self, text, a, b):
        low, high = text.starts[a], text.ends[b + self.k - 2]
        return runs_hash(span_hashes(text.flat[low:high], text.starts[a : b + self.k - 1] - low, text.ends[a : b + self.k - 1] - low), self.k)

    def units_before(self, found):
        return np.searchsorted(self._words(found.data), found.begin)

    def _words(self, data: bytes) -> np.ndarray:
        """Where each word begins; every word ends with one space."""
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        return np.concatenate([[0], gaps + 1])[: len(gaps)]

    def repeats(self, found):
        """Suffixes of the text, one for each window, are leaves; a deep node's leaves but the first are repeats."""
        leaves = _unfolded(found.first, found.count)[1]
        late = np.zeros(len(leaves), bool)
        if not len(leaves):
            return late
        begin = np.append(self._words(found.data), len(found.data))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(found.data)])
        ids = words.dictionary_encode().indices.to_numpy()
        for group in self.prefix_groups(ids, leaves):
            tree = Subtree(ids, leaves[group], self.length)
            for first, last in tree.deep_nodes(self.length):
                late[group[tree.order[first + 1 : last + 1]]] = True
        return late

    def prefix_groups(self, ids: np.ndarray, leaves: np.ndarray):
        """Leaves in groups of bounded size, none of which divides a prefix: a prefix of more leaves than fit is lengthened by a word."""
        work = [(np.arange(len(leaves)), 0)]
        while work:
            own, depth = work.pop()
            # At window depth all leaves are equal, and a group is a single node.
            if len(own) <= self.capacity or depth == self.length:
                yield own
                continue
            word = ids[leaves[own] + depth]
            order = np.argsort(word, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(word[order])) + 1, len(own)).tolist()
            a = begin = 0
            for b in cuts:
                if b - begin > self.capacity:
                    if begin > a:
                        yield np.sort(own[order[a:begin]])
                    work.append((own[order[begin:b]], depth + 1))
                    a = b
                elif b - a > self.capacity:
                    yield np.sort(own[order[a:begin]])
                    a = begin
                begin = b
            if begin > a:
                yield np.sort(own[order[a:begin]])

    def finish(self, table, answers):
        table = ordered(table)
        text = self.prepare(table)
        gone = self.covered(text, answers)
        n = np.diff(text.first)
        low, high, cuts = _spans(gone, text.first)
        upto = np.concatenate([[0], np.cumsum(gone)])
        removed = upto[text.first[1:]] - upto[text.first[:-1]]
        kept = []
        for i in range(len(n)):
            own = text.data[text.offsets[i] : max(text.offsets[i], text.offsets[i + 1] - 1)]
            if removed[i]:
                own = b" ".join([w for w, g in zip(own.split(b" "), gone[text.first[i] : text.first[i + 1]].tolist()) if not g])
            kept.append(own)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "removed": _listed(low, high, cuts)})


class SuffixArray:
    """Texts of up to ``most`` bytes in byte order, by linear grouping, and how far each agrees with the one before it.

    A text is written as blocks of bytes, each a number, and ends with a symbol that is less than any block and tells
    how many bytes its last block has; the suffixes of all texts, one after the other, are sorted, and those that begin
    a text are the order. Agreement is read off neighbours' symbols. ``heads`` are symbols before the first block: texts
    with different ones are kept apart.
    """

    BLOCK = 12

    def __init__(self, texts: list[bytes], heads: list[int]):
        # A block's number leaves room below for ends, and heads come above all blocks.
        above = (1 << 8 * self.BLOCK) + self.BLOCK + 2
        string: list[int] = []
        begins: dict[int, int] = {}
        for i, (x, h) in enumerate(zip(texts, heads)):
            begins[len(string)] = i
            string.append(above + h)
            for c in range(0, len(x), self.BLOCK):
                string.append(int.from_bytes(x[c : c + self.BLOCK].ljust(self.BLOCK, b"\0"), "big") + self.BLOCK + 2)
            string.append(1 + (len(x) - 1) % self.BLOCK + 1 if x else 1)
        string.append(0)
        places = [p for p in suffix_order(string) if p in begins]
        self.order = [begins[p] for p in places]
        self.agrees = [-1] * len(texts)
        for slot in range(1, len(places)):
            p, q = places[slot - 1], places[slot]
            if string[p] != string[q]:
                continue
            same = 1
            while string[p + same] == string[q + same]:
                same += 1
            bytes_ = self.BLOCK * (same - 1)
            x, y = string[p + same], string[q + same]
            if min(x, y) > self.BLOCK + 1:
                bytes_ += self.BLOCK - -(-((x - self.BLOCK - 2) ^ (y - self.BLOCK - 2)).bit_length() // 8)
            self.agrees[slot] = min(bytes_, len(texts[self.order[slot - 1]]), len(texts[self.order[slot]]))


class ByteArrays(Method):
    """Windows of bytes; what follows sampled anchors and, reversed, what precedes them is sorted by linear grouping."""

    #: Texts that are sorted as one string, about.
    GROUP = 4_000

    def __init__(self, length: int = 100, k: int = 52):
        self.length, self.k = length, k

    def prepare(self, table):
        flat, offsets = buffer_of(table["text"])
        units = np.arange(len(flat) + 1)
        return Text(flat.tobytes(), flat, offsets, units[:-1], units[1:], offsets)

    def grams(self, text, a, b):
        return runs_hash(text.flat[a : b + self.k - 1], self.k)

    def units_before(self, found):
        return found.begin

    def repeats(self, found):
        """Two windows at one offset before their anchors are equal if what follows the anchors agrees far enough in its
        suffix array, and what precedes them in the array of reversed texts."""
        n = len(found.count)
        late = np.zeros(int(found.count.sum()), bool)
        # By anchor gram: its texts that follow the gram, and those that precede it.
        kinds: dict[bytes, int] = {}
        rights: dict[tuple[int, bytes], int] = {}
        lefts: dict[tuple[int, bytes], int] = {}
        r_of, l_of = np.empty(n, np.int64), np.empty(n, np.int64)
        of = np.empty(n, np.int64)
        data, k = found.data, self.k
        for f, (b, a, e) in enumerate(zip(found.begin.tolist(), found.anchor.tolist(), found.end.tolist())):
            of[f] = kind = kinds.setdefault(data[a : a + k], len(kinds))
            r_of[f] = rights.setdefault((kind, data[a + k : e]), len(rights))
            l_of[f] = lefts.setdefault((kind, data[b:a][::-1]), len(lefts))
        # A gram that comes once has nothing to agree with.
        many = np.bincount(of, minlength=len(kinds)) > 1
        r_place, r_agrees = self._arranged(list(rights), many)
        l_place, l_agrees = self._arranged(list(lefts), many)
        some = np.flatnonzero(many[of])
        r_of, l_of = r_place[r_of], l_place[l_of]
        base = np.cumsum(found.count) - found.count
        before = found.anchor - found.begin
        for o in range(self.length - k + 1):
            # The window that starts o bytes before the anchor, where a fragment has it.
            j = before[some] - o
            has = some[(j >= 0) & (j < found.count[some])]
            if len(has) < 2:
                continue
            key = (np.cumsum(l_agrees < o)[l_of[has]] << 32) | np.cumsum(r_agrees < self.length - k - o)[r_of[has]]
            order = np.argsort(key, kind="stable")
            again = has[order[1:][key[order[1:]] == key[order[:-1]]]]
            late[base[again] + before[again] - o] = True
        return late

    def _arranged(self, texts: list[tuple[int, bytes]], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's place among all, texts of one gram next to each other in byte order, and by place the agreement
        with the text before (-1 at another gram's first). Grams are sorted in groups of some thousand texts."""
        place, agrees = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
        by: dict[int, list[int]] = {}
        for i, (kind, _) in enumerate(texts):
            if many[kind]:
                by.setdefault(kind, []).append(i)
        at = 0
        for one in (own[0] for own in by.values() if len(own) == 1):
            place[one] = at
            at += 1
        group: list[int] = []
        rest = [own for own in by.values() if len(own) > 1]
        for nth, own in enumerate(rest):
            group += own
            if len(group) >= self.GROUP or nth == len(rest) - 1:
                array = SuffixArray([texts[i][1] for i in group], [texts[i][0] for i in group])
                place[[group[x] for x in array.order]] = np.arange(at, at + len(group))
                agrees[at : at + len(group)] = array.agrees
                at += len(group)
                group = []
        return place, agrees

    def finish(self, table, answers):
        table = ordered(table)
        text = self.prepare(table)
        gone = self.covered(text, answers)
        n = np.diff(text.offsets)
        low, high, cuts = _spans(gone, text.offsets)
        removed = np.bincount(np.repeat(np.arange(len(n)), np.diff(cuts)), high - low, len(n)).astype(np.int64)
        kept = []
        for i in range(len(n)):
            own = text.flat[text.offsets[i] : text.offsets[i + 1]]
            kept.append((own[~gone[text.offsets[i] : text.offsets[i + 1]]] if removed[i] else own).tobytes())
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.binary()), "removed": _listed(low, high, cuts)})
