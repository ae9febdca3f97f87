"""Language identification word by word with a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.folds import held_out, per_label
from gridloom.llm.rows import ROW, named, opened, row_schema, with_row
from gridloom.llm.text import Rolling, byte_codes, flat_ranges, joined, pieces, utf8, word_spans

UNDETERMINED = "und"
PIECE_BYTES = 2 << 20
FEATURES = 1 << 17
SAMPLE_DOCUMENTS = 800  # of each language
SAMPLE_CHARS = 1_500  # of each of them, from a place chosen by a hash
SEQUENCE = 48
EPOCHS = 3
SEED = 11

_LETTERS = np.zeros(256, bool)
_LETTERS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTERS[0x80:] = True


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, and the n+1 offsets of the words in them.

    Of the lower-cased word between two marks: all stretches of 2 to 4 bytes, the first and the last
    2 to 4 bytes as affixes, and the whole word, the lexicon feature.
    """
    data, offsets = joined([f"^{w.lower()}$".encode() for w in words])
    sizes = np.diff(offsets)
    rolling = Rolling(byte_codes(5)[data])
    numbers, owners = [], []
    word = np.arange(len(words))

    def add(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, kind: int) -> None:
        numbers.append((rolling.stretches(starts, ends) + np.uint64(kind * 0x9E3779B9)) % np.uint64(FEATURES))
        owners.append(owner)

    add(offsets[:-1], offsets[1:], word, 1)
    for n in (2, 3, 4):
        counts = np.maximum(sizes - n + 1, 0)
        at = flat_ranges(offsets[:-1], counts)
        add(at, at + n, np.repeat(word, counts), 1 + n)
        long = sizes > n
        add(offsets[:-1][long], offsets[:-1][long] + n, word[long], 10 + n)
        add(offsets[1:][long] - n, offsets[1:][long], word[long], 20 + n)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(numbers)[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words) + 1))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features by labels
    steps: np.ndarray  # log weights of label to next label

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log weights of the labels of each word; zero for a word without a letter."""
        if not words:
            return np.zeros((0, len(self.labels)))
        numbers, offsets = word_features(words)
        sums = np.add.reduceat(self.weights[numbers], offsets[:-1], axis=0).astype(np.float64)
        sums[[not any(map(str.isalpha, w)) for w in words]] = 0
        return sums

    def mean_marginals(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Forward-backward over each text; the mean over its words of each label's probability.

        Texts run side by side, the longest first, so step t holds only those with a word t.
        """
        n = np.diff(offsets)
        order = np.argsort(-n, kind="stable")
        lengths = n[order]
        total = np.zeros((len(n), len(self.labels)))
        longest = int(lengths[0]) if len(lengths) else 0
        if not longest:
            return total
        active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with a word t
        at = np.concatenate(([0], np.cumsum(active)))
        place = np.concatenate([offsets[:-1][order[: active[t]]] + t for t in range(longest)])
        weight = np.exp(scores - scores.max(axis=1, keepdims=True))[place]
        step = np.exp(self.steps - self.steps.max())
        ahead = np.empty_like(weight)
        state = weight[: at[1]]
        state = state / state.sum(axis=1, keepdims=True)
        ahead[: at[1]] = state
        for t in range(1, longest):
            state = (state[: active[t]] @ step) * weight[at[t] : at[t + 1]]
            state /= state.sum(axis=1, keepdims=True)
            ahead[at[t] : at[t + 1]] = state
        back = np.ones((len(n), len(self.labels)))
        for t in range(longest - 1, -1, -1):
            k = active[t]
            both = ahead[at[t] : at[t + 1]] * back[:k]
            both /= both.sum(axis=1, keepdims=True)
            total[:k] += both
            carried = (weight[at[t] : at[t + 1]] * back[:k]) @ step.T
            back[:k] = carried / carried.sum(axis=1, keepdims=True)
        out = np.empty_like(total)
        out[order] = total / np.maximum(lengths, 1)[:, None]
        return out


def fit(texts: list[tuple[str, str]]) -> Model:
    """A model of (language, text) pairs, by gradient steps on the likelihood of word labels.

    Every word of a text has the language of the text. So that transitions between languages are
    learned, a third of the sequences join pieces of two texts, as code-switched text does.
    """
    labels = sorted({language for language, _ in texts})
    place = {w: i for i, w in enumerate(labels)}
    rng = np.random.default_rng(SEED)
    model = Model(labels, np.zeros((FEATURES, len(labels)), np.float32), np.zeros((len(labels), len(labels))))
    data, offsets = joined([t.encode() for _, t in texts])
    starts, ends, cuts = word_spans(data, offsets, _LETTERS)
    if not len(starts):
        return model
    raw = data.tobytes()
    words, inverse = np.unique(np.array([raw[a:b].decode().lower() for a, b in zip(starts.tolist(), ends.tolist())], object), return_inverse=True)
    numbers, at = word_features(words.tolist())
    runs = []
    for (language, _), a, b in zip(texts, cuts.tolist(), cuts[1:].tolist()):
        runs += [(place[language], inverse[i : min(i + SEQUENCE, b)]) for i in range(a, b, SEQUENCE)]
    grown = np.full(model.weights.shape, 1e-8, np.float32)
    grown_steps = np.full(model.steps.shape, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for begin in range(0, len(order), 128):
            batch = [runs[i] for i in order[begin : begin + 128]]
            seq = np.full((len(batch), SEQUENCE), -1)
            gold = np.zeros((len(batch), SEQUENCE), int)
            for k, (label, ids) in enumerate(batch):
                other, ids_other = batch[k - 1]
                half = len(ids) // 2
                if k % 3 == 0 and half:
                    mixed = np.concatenate((ids[:half], ids_other[: SEQUENCE - half]))
                    gold[k, :half], gold[k, half:] = label, other
                else:
                    mixed = ids
                    gold[k] = label
                seq[k, : len(mixed)] = mixed
            _climb(model, seq, gold, numbers, at, grown, grown_steps)
    return model


def _climb(model: Model, seq: np.ndarray, gold: np.ndarray, numbers: np.ndarray, at: np.ndarray, grown: np.ndarray, grown_steps: np.ndarray) -> None:
    """One adaptive gradient step on a batch of sequences (-1 marks the end of a shorter one)."""
    valid = seq >= 0
    used, inverse = np.unique(seq[valid], return_inverse=True)
    flat = numbers[flat_ranges(at[used], at[used + 1] - at[used])]
    begins = np.concatenate(([0], np.cumsum(at[used + 1] - at[used])))
    emission = np.add.reduceat(model.weights[flat], begins[:-1], axis=0).astype(np.float64)
    n, length, size = *seq.shape, len(model.labels)
    psi = np.ones((n, length, size))
    score = emission[inverse]
    psi[valid] = np.exp(score - score.max(axis=1, keepdims=True))
    step = np.exp(model.steps)
    ahead, back = np.empty_like(psi), np.empty_like(psi)
    ahead[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        x = np.where(valid[:, t, None], (ahead[:, t - 1] @ step) * psi[:, t], ahead[:, t - 1])
        ahead[:, t] = x / x.sum(1, keepdims=True)
    back[:, -1] = 1
    for t in range(length - 1, 0, -1):
        x = np.where(valid[:, t, None], (psi[:, t] * back[:, t]) @ step.T, 1.0)
        back[:, t - 1] = x / x.sum(1, keepdims=True)
    both = ahead * back
    both /= both.sum(2, keepdims=True)
    slope = np.eye(size)[gold] - both
    by_word = np.zeros((len(used), size))
    np.add.at(by_word, inverse, slope[valid])
    by_feature = np.repeat(by_word, np.diff(begins), axis=0)
    touched, where = np.unique(flat, return_inverse=True)
    gradient = np.stack([np.bincount(where, by_feature[:, k], len(touched)) for k in range(size)], axis=1)
    grown[touched] += gradient**2
    model.weights[touched] += 0.2 * gradient / np.sqrt(grown[touched])
    pair = ahead[:, :-1, :, None] * step[None, None] * (psi[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    linked = valid[:, 1:]
    seen = np.zeros((size, size))
    np.add.at(seen, (gold[:, :-1][linked], gold[:, 1:][linked]), 1)
    rise = seen - pair[linked].sum(0)
    grown_steps += rise**2
    model.steps += 0.2 * rise / np.sqrt(grown_steps)


def learn(documents: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on a bounded sample: ``SAMPLE_DOCUMENTS`` of each language outside the held-out part, and of
    each of them ``SAMPLE_CHARS`` characters from a place chosen by a hash of its id."""
    known = documents.select(named(doc_id).alias("id"), named(lang).alias("lang"), named(text).alias("text"), (~held_out(doc_id)).alias("learn"))
    known = known.filter("learn and lang is not null and id is not null and length(text) > 0")
    sample = per_label(known, "lang", "id", SAMPLE_DOCUMENTS)
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), room).cast("int") + 1
    rows = sample.select("id", "lang", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    return fit([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["id"], r["lang"], r["text"]))])


def predict(documents: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``.

    Words are runs of ASCII letters and characters beyond ASCII. Forward-backward labels each word of
    the whole text; ``score`` is the mean probability over the words of the language that has the
    most, which is ``lang_pred``. A text that is null or has no letter is ``und`` with score 0, and so
    is every text if the model knows no language. Ties go to the first language by name; repeated
    rows are scored alike; an empty table gives an empty result. No shuffle is needed.
    """
    source = with_row(documents, keep, _text=named(text))
    lookup = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lookup.value
        for batch in pieces(batches, "_text", PIECE_BYTES):
            data, offsets = utf8(batch.column("_text"))
            starts, ends, cuts = word_spans(data, offsets, _LETTERS)
            if not len(starts) or not known.labels:
                found, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                raw = data.tobytes()
                content = Rolling(byte_codes(6)[data]).stretches(starts, ends)
                _, first, inverse = np.unique(content, return_index=True, return_inverse=True)
                words = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                letters = np.array([any(map(str.isalpha, w)) for w in words])
                seen = np.concatenate(([0], np.cumsum(letters[inverse])))
                some = seen[cuts[1:]] > seen[cuts[:-1]]
                mean = known.mean_marginals(known.emissions(words)[inverse], cuts)
                best = mean.argmax(axis=1)
                score = np.where(some, mean[np.arange(len(best)), best], 0.0)
                found = [known.labels[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array(found, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64())],
                names=[ROW, "lang_pred", "score"],
            )

    return opened(source.mapInArrow(run, row_schema(source, "lang_pred string, score double")))
