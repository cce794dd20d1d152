"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling over the whole text."""

from __future__ import annotations

import io
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows of the embedding table, its columns, filters of each width (in words), and the parts of a word that are hashed.
BUCKETS, DIM, FILTERS = 1 << 18, 8, 6
WIDTHS = (1, 2, 3)
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4, 5)
#: Words whose convolutions are held at a time.
STRETCH = 1 << 15
#: Squared gradients that every weight starts with; small, so that the few gradients of a rare word count.
START = 1e-5
MARKS = ".,;:!?\"'()[]{}<>*_-…“”„«»¿¡"
_PARTS = 1 + len(PREFIXES) + len(SUFFIXES)


def word_parts(word: str) -> list[int]:
    """Buckets of the word without marks around it and of its beginnings and ends."""
    bare = word.strip(MARKS) or word
    parts = [f"={bare}", *(f"^{bare[:k]}" for k in PREFIXES if len(bare) >= k), *(f"{bare[-k:]}$" for k in SUFFIXES if len(bare) >= k)]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


def parts_of(words: Iterable[str]) -> np.ndarray:
    """One row of buckets per word; ``BUCKETS`` fills it up and stands for an empty row of the table."""
    found = [word_parts(w) for w in words]
    out = np.full((len(found), _PARTS), BUCKETS, np.int32)
    for row, p in zip(out, found, strict=True):
        row[: len(p)] = p
    return out


@dataclass
class Words:
    """Texts as numbers of distinct words: the words of text k are ``ids[starts[k]:starts[k + 1]]``."""

    distinct: list[str]
    ids: np.ndarray
    starts: np.ndarray


def cut(texts: pa.Array) -> Words:
    """Lower-cased words between white space, of whole texts; null texts have none."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    starts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets - offsets[0]].astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts)


@dataclass
class Model:
    """Weights: the table (last row empty), per width a filter bank (width, DIM, FILTERS), biases, and the output layer."""

    table: np.ndarray
    banks: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def vectors(self, parts: np.ndarray) -> np.ndarray:
        """Mean of the table's rows of each word's parts."""
        out = np.zeros((len(parts), DIM), np.float32)
        for column in parts.T:
            out += self.table[column]
        return out / np.maximum((parts < BUCKETS).sum(axis=1, keepdims=True), 1).astype(np.float32)

    def pool(self, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Greatest response of each filter over the windows that start at a text's words, and with ``places`` where it is.

        Behind a text's end lie empty words. Texts are walked in stretches of ``STRETCH`` words, so a text of any length takes bounded memory.
        A text without words responds with 0.
        """
        n_texts, n = len(starts) - 1, len(ids)
        wide = max(WIDTHS)
        blank = len(vectors)
        vectors = np.concatenate([vectors, np.zeros((1, DIM), np.float32)])
        # Column block w of the response at offset k: vectors through slice k of bank w.
        by_offset = [
            np.concatenate([vectors @ bank[k] for w, bank in zip(WIDTHS, self.banks, strict=True) if k < w], axis=1) for k in range(wide)
        ]
        text_of = np.repeat(np.arange(n_texts), np.diff(starts))
        ends = starts[1:]
        best = np.full((n_texts, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64) if places else None
        for a in range(0, n, STRETCH):
            at = np.arange(a, min(a + STRETCH, n))
            mine = text_of[at]
            response = by_offset[0][ids[at]]
            for k in range(1, wide):
                after = at + k
                word = np.where(after < ends[mine], ids[np.minimum(after, n - 1)], blank)
                response[:, -by_offset[k].shape[1] :] += by_offset[k][word]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            top, here = np.maximum.reduceat(response, first, axis=0), mine[first]
            if places:
                row, column = np.nonzero(response == np.repeat(top, np.diff(np.append(first, len(at))), axis=0))
                found = np.zeros(top.shape, np.int64)
                of = np.searchsorted(first, row, side="right") - 1
                found[of[::-1], column[::-1]] = at[row[::-1]]
                better = top > best[here]
                where[here] = np.where(better, found, where[here])
            best[here] = np.maximum(best[here], top)
        pooled = best + self.bias
        pooled[np.diff(starts) == 0] = 0
        return pooled, where


def logits(models: list[Model], texts: Words) -> list[np.ndarray]:
    """One score per text and model, before the logistic function."""
    parts = parts_of(texts.distinct)
    out = []
    for m in models:
        pooled, _ = m.pool(texts.ids, texts.starts, m.vectors(parts))
        out.append(np.maximum(pooled, 0) @ m.out + m.out_bias[0])
    return out


def to_bytes(model: Model) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, model.table, model.bias, model.out, model.out_bias, *model.banks)
    return sink.getvalue()


def from_bytes(stored: bytes) -> Model:
    table, bias, out, out_bias, *banks = np.load(io.BytesIO(stored)).values()
    return Model(table, banks, bias, out, out_bias)


def fresh(seed: int) -> Model:
    r = np.random.default_rng(seed)
    table = r.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    table[-1] = 0
    banks = [r.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    width = len(WIDTHS) * FILTERS
    return Model(table, banks, np.zeros(width, np.float32), r.normal(0, 0.1, width).astype(np.float32), np.full(1, -1.0, np.float32))


def gradients(model: Model, ids: np.ndarray, starts: np.ndarray, parts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list]:
    """Weighted log loss of some texts and its gradient: (rows, values) of the table, then the other arrays in order.

    Only the window that a filter chose passes its gradient on.
    """
    vectors = model.vectors(parts)
    pooled, where = model.pool(ids, starts, vectors, places=True)
    active = np.maximum(pooled, 0)
    logit = active @ model.out + model.out_bias[0]
    p = 1 / (1 + np.exp(-logit))
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / total)
    d = (weight * (p - y) / total).astype(np.float32)
    d_pooled = np.outer(d, model.out) * (pooled > 0)
    text, filt = np.nonzero(d_pooled)
    g = d_pooled[text, filt]
    at, bank_of, f = where[text, filt], filt // FILTERS, filt % FILTERS
    ends = starts[1:][text]
    d_banks, into, values = [], [], []
    for b, (w, bank) in enumerate(zip(WIDTHS, model.banks, strict=True)):
        d_bank = np.zeros_like(bank)
        for k in range(w):
            mine = np.flatnonzero((bank_of == b) & (at + k < ends))
            word = ids[at[mine] + k]
            gk = g[mine]
            through = np.zeros((len(mine), FILTERS), np.float32)
            through[np.arange(len(mine)), f[mine]] = gk
            d_bank[k] = vectors[word].T @ through
            into.append(word)
            values.append(gk[:, None] * bank[k][:, f[mine]].T)
        d_banks.append(d_bank)
    word, value = np.concatenate(into), np.concatenate(values)
    used, back = np.unique(word, return_inverse=True)
    by_word = np.stack([np.bincount(back, weights=value[:, c], minlength=len(used)) for c in range(DIM)], axis=1)
    own = parts[used]
    by_word /= np.maximum((own < BUCKETS).sum(axis=1, keepdims=True), 1)
    rows, back = np.unique(own, return_inverse=True)
    spread = np.repeat(by_word, own.shape[1], axis=0)
    by_row = np.stack([np.bincount(back.ravel(), weights=spread[:, c], minlength=len(rows)) for c in range(DIM)], axis=1)
    real = rows < BUCKETS
    return loss, [
        (rows[real], by_row[real].astype(np.float32)), *d_banks, d_pooled.sum(axis=0), active.T @ d, np.array([d.sum()], np.float32)
    ]


def train(texts: Words, y: np.ndarray, weight: np.ndarray, seed: int, steps: int = 700, batch: int = 32, rate: float = 0.05) -> Model:
    """Adaptive gradient steps, each over a batch of the texts in shuffled rounds; the same input and seed give the same model."""
    model = fresh(seed)
    r = np.random.default_rng(seed)
    every = parts_of(texts.distinct)
    flat = [*model.banks, model.bias, model.out, model.out_bias]
    sums = [np.full(a.shape, START, np.float32) for a in flat]
    table_sums = np.full(model.table.shape, START, np.float32)
    # A batch's loss is a mean; times its texts, a gradient no longer depends on the size of the batch.
    order = np.zeros(0, np.int64)
    for _ in range(steps):
        if not len(order):
            order = r.permutation(len(y))
        chosen, order = order[:batch], order[batch:]
        lengths = texts.starts[chosen + 1] - texts.starts[chosen]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.concatenate([texts.ids[texts.starts[c] : texts.starts[c + 1]] for c in chosen])
        distinct, ids = np.unique(ids, return_inverse=True)
        _, (sparse, *dense) = gradients(model, ids, starts, every[distinct], y[chosen], weight[chosen])
        rows, g = sparse
        g = g * len(chosen)
        table_sums[rows] += g * g
        model.table[rows] -= rate * g / np.sqrt(table_sums[rows])
        for a, total, g in zip(flat, sums, dense, strict=True):
            g = g * len(chosen)
            total += g * g
            a -= (rate * g / np.sqrt(total)).astype(np.float32)
    return model
