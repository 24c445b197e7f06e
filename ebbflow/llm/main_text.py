"""Main text of HTML pages: a recurrent labeller over leaf blocks.

Every leaf block of a page becomes a vector: hashed words of the elements on its
path (near ones count more), of its own element, hashed words of its text, and
a few numbers.  A bidirectional LSTM in numpy reads the blocks of a page in
order, so that every block is judged with the whole page in view; blocks that
are likelier to belong to the article than not are its main text.

The labeller is trained by back-propagation on the labelled pages of
``sample_pages`` (their number is a parameter, their seed fixed) and is the same
in every run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Leaf, leaves
from .sample_pages import KEEP, Pages
from .tokens import LETTERS, U, portions, word_hashes

#: Buckets of path words, own-element words and text words; further numbers; units of each direction.
PATH, OWN, WORDS, NUMBERS, HIDDEN = 256, 128, 64, 6, 16
#: Weight of an element a step further out.
FADE = 0.8
SAMPLE_PAGES, EPOCHS, BATCH, SEED = 2_400, 8, 50, 11
#: Blocks of a batch at most, padding included (one page is never cut).
CELLS = 16_384


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % n


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed words of the elements around a block and of its own element."""
    out = np.zeros(PATH + OWN, np.float32)
    weight = 1.0
    for k, words in enumerate(reversed(path)):
        tag, *names = words.split(" ")
        for w in (f"<{tag}>", *names):
            out[_bucket(w, PATH)] += weight
        if not k:
            for w in (f"<{tag}>", *names):
                out[PATH + _bucket(w, OWN)] += 1
        weight = max(weight * FADE, 0.05)
    np.minimum(out, 2, out=out)
    return out


def text_vectors(page: Sequence[Sequence[Leaf]]) -> np.ndarray:
    """Word shares and numbers of all blocks of some pages."""
    flat = [b for p in page for b in p]
    out = np.zeros((len(flat), WORDS + NUMBERS), np.float32)
    if not flat:
        return out
    row, count = 0, np.zeros(len(flat), np.float32)
    for first, end, data, offsets in portions(pa.array([b.text for b in flat], pa.large_string())):
        h, _, block = word_hashes(data, offsets, LETTERS)
        n = end - first
        cells = np.bincount(block * WORDS + (h % U(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        count[first:end] = cells.sum(axis=1)
        out[first:end, :WORDS] = cells
    out[:, :WORDS] /= np.sqrt((out[:, :WORDS] ** 2).sum(axis=1, keepdims=True)).clip(1)
    length = np.array([len(b.text) for b in flat], np.float32)
    out[:, WORDS] = np.log1p(length) / 8
    out[:, WORDS + 1] = np.array([b.linked for b in flat], np.float32) / length
    out[:, WORDS + 2] = np.log1p(count) / 6
    out[:, WORDS + 3] = [b.text[-1] in ".!?…\"'" for b in flat]
    for p in page:
        for k, b in enumerate(p):
            out[row, WORDS + 4] = k / len(p)
            out[row, WORDS + 5] = k > 0 and p[k - 1].path[:-1] == b.path[:-1]
            row += 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(z: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Outputs of an LSTM for the gate inputs z (step, page, 4 x unit); steps
    outside a page leave its state empty."""
    steps, pages, _ = z.shape
    n = u.shape[0]
    h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    out = np.empty((steps, pages, n), np.float32)
    for t in range(steps):
        g = z[t] + h @ u
        gates, new = _sigmoid(g[:, :3 * n]), np.tanh(g[:, 3 * n:])
        before, c = c, (gates[:, n:2 * n] * c + gates[:, :n] * new) * mask[t]
        top = np.tanh(c)
        if keep is not None:
            keep.append((h, before, gates, new, top))
        h = gates[:, 2 * n:] * top * mask[t]
        out[t] = h
    return out


def _backward(d: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u`` for gradients d of the outputs."""
    steps, pages, n = d.shape
    dz, du = np.empty((steps, pages, 4 * n), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, before, gates, new, top = kept[t]
        i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
        dh = (dh + d[t]) * mask[t]
        dc = (dc + dh * o * (1 - top ** 2)) * mask[t]
        g = dz[t]
        g[:, :n], g[:, n:2 * n], g[:, 2 * n:3 * n] = dc * new * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o)
        g[:, 3 * n:] = dc * i * (1 - new ** 2)
        du += h.T @ g
        dh, dc = g @ u.T, dc * f
    return dz, du


@dataclass(frozen=True)
class Labeller:
    """Weights: inputs to gates of both directions, their bias, states to gates (each direction), outputs, bias."""

    w: np.ndarray
    b: np.ndarray
    forth: np.ndarray
    back: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def scores(self, pages: Sequence[Sequence[Leaf]]) -> list[np.ndarray]:
        """For each page the probability of each block to be main text."""
        number: dict[tuple[str, ...], int] = {}
        which = np.array([number.setdefault(b.path, len(number)) for p in pages for b in p], np.int64)
        if not len(which):
            return [np.zeros(0, np.float32) for _ in pages]
        paths = np.concatenate([np.stack([path_vector(p) for p in part]) @ self.w[:PATH + OWN]
                                for part in _parts(list(number), 4096)])
        z = text_vectors(pages) @ self.w[PATH + OWN:] + self.b
        z += paths[which]
        sizes = np.array([len(p) for p in pages])
        starts = np.cumsum(sizes) - sizes
        score = np.empty(len(which), np.float32)
        order, at = np.argsort(sizes, kind="stable"), int((sizes == 0).sum())
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * sizes[order[end]] <= CELLS:
                end += 1
            some = order[at:end]
            steps = np.arange(sizes[some[-1]])
            mask = (steps[:, None] < sizes[some])
            place = np.where(mask, starts[some] + steps[:, None], 0)
            score[place[mask]] = self._run(z[place] * mask[..., None].astype(np.float32), mask[..., None].astype(np.float32))[mask]
            at = end
        return [score[s:s + n] for s, n in zip(starts, sizes)]

    def _run(self, z: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n = 4 * HIDDEN
        a = _forward(z[..., :n], mask, self.forth)
        b = _forward(z[::-1, :, n:], mask[::-1], self.back)[::-1]
        return _sigmoid(np.concatenate([a, b], axis=2) @ self.out + self.bias)


def _parts(items: list, n: int):
    return (items[s:s + n] for s in range(0, len(items), n))


def labelled(count: int, seed: int) -> list[tuple[list[Leaf], np.ndarray]]:
    """Blocks and labels of made pages."""
    made, out = Pages(seed), []
    for _ in range(count):
        blocks = leaves(made.page())
        label = np.array([KEEP in b.text for b in blocks], np.float32)
        for b in blocks:
            size = len(b.text)
            b.text = " ".join(b.text.replace(KEEP, "").split())
            b.linked = min(b.linked, len(b.text)) if len(b.text) == size else max(0, min(b.linked - 1, len(b.text)))
        if len(blocks):
            out.append((blocks, label))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = SAMPLE_PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller, trained on ``pages`` made pages (Adam; about twenty seconds)."""
    rng = np.random.default_rng(SEED)
    data = sorted((d for d in labelled(pages, SEED)), key=lambda d: len(d[0]))
    size, n = PATH + OWN + WORDS + NUMBERS, 4 * HIDDEN
    start = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
    p = {"w": start(size, 2 * n, by=0.15), "b": np.zeros(2 * n, np.float32), "forth": start(HIDDEN, n, by=0.2),
         "back": start(HIDDEN, n, by=0.2), "out": start(2 * HIDDEN, by=0.3), "bias": np.zeros(1, np.float32)}
    for k in (HIDDEN, n + HIDDEN):
        p["b"][k:k + HIDDEN] = 1                        # remember at first
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    batches = [data[s:s + BATCH] for s in range(0, len(data), BATCH)]
    packed = []
    for part in batches:
        steps = max(len(b) for b, _ in part)
        x, y = np.zeros((steps, len(part), size), np.float32), np.zeros((steps, len(part)), np.float32)
        mask = np.zeros((steps, len(part), 1), np.float32)
        text = text_vectors([b for b, _ in part])
        row = 0
        for k, (blocks, label) in enumerate(part):
            m = len(blocks)
            x[:m, k, :PATH + OWN] = [path_vector(b.path) for b in blocks]
            x[:m, k, PATH + OWN:] = text[row:row + m]
            y[:m, k], mask[:m, k] = label, 1
            row += m
        packed.append((x, y, mask))
    step = 0
    for epoch in range(epochs):
        for at in rng.permutation(len(packed)):
            x, y, mask = packed[at]
            x = x.copy()
            x[..., :PATH] *= rng.random((1, x.shape[1], PATH)) > 0.15     # some names are unknown: look around
            x[..., PATH + OWN:PATH + OWN + WORDS] *= rng.random((1, x.shape[1], 1)) > 0.3     # and so may the words be
            z = x @ p["w"] + p["b"]
            forth, back = [], []
            a = _forward(z[..., :n], mask, p["forth"], forth)
            b = _forward(z[::-1, :, n:], mask[::-1], p["back"], back)[::-1]
            h = np.concatenate([a, b], axis=2)
            d = (_sigmoid(h @ p["out"] + p["bias"]) - y) * mask[..., 0] / mask.sum()
            g = {"out": np.tensordot(d, h, axes=([0, 1], [0, 1])), "bias": d.sum(keepdims=True)[0]}
            dh = d[..., None] * p["out"]
            dz_a, g["forth"] = _backward(dh[..., :HIDDEN], mask, p["forth"], forth)
            dz_b, g["back"] = _backward(dh[::-1, :, HIDDEN:], mask[::-1], p["back"], back)
            dz = np.concatenate([dz_a, dz_b[::-1]], axis=2) * mask
            g["w"] = np.tensordot(x, dz, axes=([0, 1], [0, 1])) + 1e-5 * p["w"]
            g["b"] = dz.sum(axis=(0, 1))
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k].reshape(v.shape) - m)
                s += 0.01 * (g[k].reshape(v.shape) ** 2 - s)
                v -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return Labeller(**p)


def joined(blocks: Sequence[Leaf], scores: np.ndarray) -> str:
    return "\n\n".join(b.text for b, s in zip(blocks, scores.tolist()) if s >= 0.5)


def _pages(batch: pa.RecordBatch, model: Labeller, rows: int = 512):
    """(row, blocks, scores) of a batch's pages, a portion at a time."""
    texts = batch.column("html")
    for first in range(0, batch.num_rows, rows):
        blocks = [leaves(t) for t in texts.slice(first, rows).to_pylist()]
        yield from zip(range(first, batch.num_rows), blocks, model.scores(blocks))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) per row.

    The text is the article's blocks in page order, joined by two line ends;
    empty for null and empty pages and for pages without an article.  Rows that
    repeat give the same text each; an empty table gives an empty result; pages
    of any length are read whole; other columns are not read, whatever their
    names; null ids and urls stay null."""
    model = trained()

    def run(batches):
        for batch in batches:
            texts = [joined(blocks, scores) for _, blocks, scores in _pages(batch, model)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t.encode("utf-8", "replace") for t in texts]).cast(pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")


def blocks(pages: DataFrame) -> DataFrame:
    """``page_id`` and ``blocks`` per row: text, path (elements from the outermost, joined by ``>``),
    score and whether the block is main text.  Rows as in ``extract``."""
    model = trained()
    kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("score", pa.float32()), ("main", pa.bool_())]))

    def run(batches):
        for batch in batches:
            found = [[{"text": b.text.encode("utf-8", "replace").decode(), "path": ">".join(re.sub(" ", ".", e) for e in b.path),
                       "score": s, "main": s >= 0.5} for b, s in zip(leafs, scores.tolist())] for _, leafs, scores in _pages(batch, model)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, kind)], ["page_id", "blocks"])

    return pages.select("page_id", "html").mapInArrow(
        run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, blocks array<struct<text:string,path:string,score:float,main:boolean>>")
