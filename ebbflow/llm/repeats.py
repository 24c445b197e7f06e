"""Periodic runs of words, by suffix trees, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same) that no neighbouring word extends with that period, at least
MIN_WORDS long and MIN_TURNS times its period.

Two suffix trees (Ukkonen), of the words and of the words in reverse, answer
in constant time how far two places agree to the right and to the left: the
string depth of the lowest common ancestor of two leaves is the minimum of the
depths on the Euler tour between them.  Every run has a Lyndon root, which is
the longest Lyndon word at its place in one of the two orders of the words
(Bannai et al.); the place where it ends is the next smaller, or next larger,
suffix.  So the 2n candidates (place, length of the Lyndon word), extended in
both directions, are all runs.

Words that can be in no run never reach the trees: each word of a run stands
in it four times or more (MIN_TURNS), each three consecutive words three times,
so a stretch of words is kept only while all its words and triples are that
frequent within the stretch.  Kept stretches are joined by marks that stand
once, which no run crosses.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS, MIN_TURNS = 6, 4
#: Words of short texts that are worked on together (one text is never cut).
PORTION = 60_000
#: Words that share a tree (one stretch is never cut): small trees stay in the processor's cache.
TREE = 1_000
Run = tuple[int, int, int]
Edit = Callable[[int | None, list[bytes]], list[bytes]]


class _Minimum:
    """Least value of any range of an array in constant time: prefix and suffix
    minima within blocks of WIDTH, a sparse table over the blocks."""

    WIDTH = 32

    def __init__(self, values: np.ndarray):
        w = self.WIDTH
        rest = -len(values) % w
        blocks = np.concatenate([values, np.full(rest, values.max(initial=0), values.dtype)]).reshape(-1, w)
        self.flat = blocks.ravel()
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= len(blocks):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minima of ``left`` to ``right``, both included, left <= right."""
        a, b = left // self.WIDTH, right // self.WIDTH
        out = np.minimum(self.tail[left], self.head[right])
        one = np.flatnonzero(a == b)
        for s in range(0, len(one), 1 << 15):
            k = one[s:s + (1 << 15)]
            at = np.minimum(left[k][:, None] + np.arange(self.WIDTH), right[k][:, None])
            out[k] = self.flat[at].min(axis=1)
        far = np.flatnonzero(b - a > 1)
        if len(far):
            lo, hi = a[far] + 1, b[far]                 # whole blocks between
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            for k in np.unique(level):
                m = level == k
                t = self.levels[k]
                out[far[m]] = np.minimum(out[far[m]], np.minimum(t[lo[m]], t[hi[m] - (1 << int(k))]))
        return out


def _tour(kid: np.ndarray, parent: np.ndarray, span: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the leaves on the Euler tour and the string depth at each of
    its places.  ``kid``, ``parent``: edges by parent, then first number;
    ``span``: length of the edge into a node.

    Step v goes down into node v, step nodes + v back up; each has one next
    step, and its distance from the end is found by doubling."""
    nodes = len(span)
    steps = np.arange(2 * nodes)
    follow = steps.copy()
    follow[kid] = nodes + kid                           # down into a leaf, then up
    follow[nodes + kid] = nodes + parent                # up from the last child: on up
    more = parent[1:] == parent[:-1]
    follow[nodes + kid[:-1][more]] = kid[1:][more]      # the next child
    first = np.concatenate([[True], ~more])
    follow[parent[first]] = kid[first]
    end = nodes                                         # up from the root
    follow[end] = end
    left = (steps != end).astype(np.int64)
    while True:
        further = follow[follow]
        if np.array_equal(further, follow):
            break
        left += left[follow]
        follow = further
    when = left[0] - left                               # 0: down into the root
    change = np.empty(2 * nodes, np.int64)
    change[when[:nodes]] = span
    change[when[nodes:]] = -span
    return when[leaf], np.cumsum(change)


class SuffixTree:
    """Ukkonen's tree of a list of numbers >= 1; a mark 0 ends it."""

    def __init__(self, word: list[int]):
        s = [*word, 0]
        n, sigma = len(s), max(s) + 1
        begin, stop, link = [0] * (2 * n), [0] + [n] * (2 * n), [0] * (2 * n)       # of the edge into a node; the node's suffix link
        leaf = [0] * n                                  # of each suffix
        child: dict[int, int] = {}                      # parent * sigma + first number of the edge
        find = child.get
        node = edge = length = 0                        # the longest suffix that stands further left as well
        nodes, done, i = 1, 0, 0                        # done: suffixes that have a leaf
        while i < n:
            c = s[i]
            last = 0
            while done <= i:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                v = find(key)
                if v is None:
                    child[key] = leaf[done] = nodes
                    begin[nodes] = i
                    nodes += 1
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at, end = begin[v], stop[v]
                    if length >= end - at:              # the place lies below v
                        edge += end - at
                        length -= end - at
                        node = v
                        continue
                    at += length
                    if s[at] == c:
                        if last:
                            link[last] = node
                        at += 1
                        length += 1
                        while at < end and i + 1 < n and s[at] == s[i + 1]:     # on along the edge
                            at += 1
                            length += 1
                            i += 1
                        break
                    middle = child[key] = nodes
                    begin[middle], stop[middle] = begin[v], at
                    begin[middle + 1] = i
                    begin[v] = at
                    key = middle * sigma
                    child[key + c] = leaf[done] = middle + 1
                    child[key + s[at]] = v
                    nodes += 2
                    if last:
                        link[last] = middle
                    last = middle
                done += 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = done
            i += 1
        span = np.array(stop[:nodes]) - begin[:nodes]
        keys = np.fromiter(child, np.int64, nodes - 1)
        order = np.argsort(keys)
        kid, parent = np.fromiter(child.values(), np.int64, nodes - 1)[order], keys[order] // sigma
        self.place, depth = _tour(kid, parent, span, np.array(leaf))
        self._least = _Minimum(depth)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b`` (a <> b)."""
        p, q = self.place[a], self.place[b]
        return self._least(np.minimum(p, q), np.maximum(p, q))


def _lyndon(place: list[int]) -> tuple[list[int], list[int]]:
    """Next smaller and next larger suffix of every suffix (ends of the longest
    Lyndon words in the two orders); the number of suffixes where none is."""
    n = len(place)
    smaller, larger = [n] * n, [n] * n
    for out, sign in ((smaller, 1), (larger, -1)):
        stack: list[int] = []
        values = place if sign == 1 else [-x for x in place]
        for i, x in enumerate(values):
            while stack and values[stack[-1]] > x:
                out[stack.pop()] = i
            stack.append(i)
    return smaller, larger


def runs_of(word: list[int]) -> np.ndarray:
    """(start, length, period) of all runs of a list of numbers >= 1, sorted."""
    n = len(word)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(word), SuffixTree(word[::-1])
    w = np.array(word)
    ends = np.array(_lyndon(ahead.place[:n].tolist()))
    at, end = np.tile(np.arange(n), 2), ends.ravel()
    keep = end < n
    at, end = at[keep], end[keep]
    keep = w[at] == w[end]                              # a run of two turns or more goes on after its first root
    at, end = at[keep], end[keep]
    period = end - at
    right = ahead.common(at, end)
    left = np.zeros(len(at), np.int64)
    inner = at > 0
    left[inner] = back.common(n - at[inner], n - end[inner])
    length = left + period + right
    keep = length >= np.maximum(MIN_WORDS, MIN_TURNS * period)
    return np.unique(np.stack([at - left, length, period], axis=1)[keep], axis=0)


def _stretches(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of ``word`` that may be in runs, stretch after stretch, and the
    number of each place's stretch (two rows).  Hashes may collide: that keeps
    more words, never fewer."""
    place, part, known = np.arange(len(word)), group, -1
    bits = max(12, int(len(word)).bit_length() + 2)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

    def bucket(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * odd[0] >> np.uint64(64 - bits)).astype(np.int64)

    while len(place) != known and len(place) >= MIN_WORDS:
        known = len(place)
        w, p = word[place].astype(np.uint64), part.astype(np.uint64)
        h = bucket(w * odd[1] + p * odd[3])
        words = np.bincount(h, minlength=1 << bits)[h] >= MIN_TURNS
        h = bucket(((w[:-2] * odd[0] + w[1:-1]) * odd[1] + w[2:]) * odd[2] + p[2:] * odd[3])
        same = (part[:-2] == part[2:]) & words[:-2] & words[1:-1] & words[2:]
        often = same & (np.bincount(h[same], minlength=1 << bits)[h] >= MIN_TURNS - 1)
        joined = often[1:] & often[:-1] & (part[1:-2] == part[:-3])
        first = np.flatnonzero(often & np.concatenate([[True], ~joined]))
        last = np.flatnonzero(often & np.concatenate([~joined, [True]]))
        long = last - first + 3 >= MIN_WORDS
        first, size = first[long], (last - first + 3)[long]
        if not len(first):
            return np.zeros((2, 0), np.int64)
        ends = np.cumsum(size)
        part = np.repeat(np.arange(len(size)), size)
        place = place[np.arange(ends[-1]) - np.repeat(ends - size - first, size)]
    if len(place) < MIN_WORDS:
        return np.zeros((2, 0), np.int64)
    return np.stack([place, part])


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """Runs of each list of words, by start, then period."""
    number: dict[bytes, int] = {}
    put = number.setdefault
    word = np.array([put(w, len(number)) for t in texts for w in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    place, part = _stretches(np.repeat(np.arange(len(texts)), sizes), word)
    if not len(place):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    first = 0
    while first < len(cut) - 1:                         # trees of whole stretches, of about TREE words
        last = max(first + 1, int(np.searchsorted(cut, cut[first] + TREE, "right")) - 1)
        here = place[cut[first]:cut[last]]
        used, short = np.unique(word[here], return_inverse=True)
        border = cut[first + 1:last] - cut[first]
        joined = np.insert(short + 1, border, len(used) + 1 + np.arange(len(border)))
        source = np.insert(here, border, -1)
        for start, length, period in runs_of(joined.tolist()).tolist():
            at = int(source[start])
            d = int(np.searchsorted(starts, at, "right")) - 1
            out[d].append((at - int(starts[d]), length, period))
        first = last
    return [sorted(set(r), key=lambda x: (x[0], x[2])) for r in out]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that stand after the first turn of a run."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def _read(docs: DataFrame, schema: dict[str, str], make: Callable, edit: Edit | None) -> DataFrame:
    """doc_id and the columns of ``schema``, which ``make`` gives for the words
    and runs of a portion of rows; words are split at ASCII white space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            row = 0
            while row < batch.num_rows:
                begin, words, n = row, [], 0
                while row < batch.num_rows and (n < PORTION or row == begin):
                    w = (texts[row].as_py() or b"").split()
                    if edit:
                        w = edit(ids[row].as_py(), w)
                    words.append(w)
                    n += len(w)
                    row += 1
                part = ids.slice(begin, row - begin)
                columns = make(zip(words, runs_of_texts(words)))
                yield pa.RecordBatch.from_arrays([part, *columns], ["doc_id", *schema])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} {t}" for c, t in schema.items())]))


def find(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period; by start, then
    period), ``collapsed`` (the words that stand in no run after its first
    turn, joined by one space) of every row.  ``edit`` changes a row's words
    first.  Null and empty texts have no runs and an empty ``collapsed``;
    null ids stay null; repeated rows repeat; an empty table gives an empty
    result; texts of any length are read whole (time and memory grow with
    their length); other columns are not read, whatever their names."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make(rows):
        rows = list(rows)
        return [pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for _, r in rows], kind),
                pa.array([b" ".join(kept_words(w, r)) for w, r in rows]).cast(pa.string())]

    return _read(docs, {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}, make, edit)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a row with a tail that repeats, where the id's checksum
    ends in 0: what the query op12 is asked for.  Null ids change nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a:a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[:n - a]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, of equals the first, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


REPORT = dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "bigint") | dict.fromkeys(
    ("runs_sha256", "collapsed_sha256"), "string")


def report(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """Per row: doc_id, number of runs, the strongest run (nulls without one)
    and digests of all runs and of the collapsed text.  Rows as in ``find``."""
    def make(rows):
        out = []
        for words, runs in rows:
            best = strongest(runs)
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            out.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()))
        return [pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(zip(*out))]

    return _read(docs, REPORT, make, edit)
