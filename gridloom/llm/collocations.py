"""Phrase collocations by the SON scheme: shards are mined alone, what they find is counted everywhere.

A phrase that stands ``support`` times in the corpus stands at least ``support / shards`` times in one
of the shards. So each shard is mined completely at that lowered support, the phrases frequent in any
shard are united, and these candidates are counted over the whole corpus.

Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash, and blocks to a fixed number of
shards, so that the lowered support stays above one at any size of corpus. A block sends each of its
distinct phrases once, as a 32-bit print with its number of occurrences, to the bucket of its hash.
There each shard is mined by itself; the answer to a block lists those of its prints that are
candidates, without those whose prints fall short of the support even all together. A print shared by
two phrases can only add a candidate. The block then counts its candidates on the words themselves and
sends them, packed, to the bucket of the phrase, where counts are added up exactly.

Skew. A phrase, however frequent, is one entry of a block; blocks hold a bounded amount of text
whatever its language or source, and buckets grow in number with the corpus. The scores come from
joins on phrases, which AQE splits where one word heads many phrases.
"""

from __future__ import annotations

from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.llm.repeats import read_documents, ship_documents
from gridloom.llm.rows import named
from gridloom.llm.text import Rolling, byte_codes, give_back, joined, mix, utf8, word_spans
from gridloom.session import settle

UNDETERMINED = "und"
COUNTED = ["lang", "phrase", "size", "f"]
SHARDS = 4
BLOCK_BYTES = 10 << 20
BUCKET_BYTES = 12 << 20
SLICE_BYTES = 1 << 20
PARTS_OF_LANGUAGE = 8

# The bytes that end a piece, and those that only end a word.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"

_ENDS_PIECE = np.isin(np.arange(256), list(PIECE_ENDS))
_IS_WORD = ~np.isin(np.arange(256), list(PIECE_ENDS + WORD_ENDS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPLITTABLE = bytes(0x20 if _ENDS_PIECE[b] else int(_LOWER[b]) for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """A number for each distinct word of each language; words of one language share a dictionary."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.words)
        self.words.append(word)
        return place


class Block:
    """The words of some documents as numbers, and in which piece each stands."""

    def __init__(self, texts: pa.Array, langs: list[str], most_words: int):
        self.most = most_words
        self.words: list[bytes] = []
        self.labels = sorted(set(langs))
        numbers = {lang: _Numbers(self.words) for lang in self.labels}
        own, pieces, lang_of, before = [], [], [], 0
        lengths = np.diff(utf8(texts)[1])
        group = np.cumsum(lengths) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(langs)] if langs else []
        for a, b in zip(cuts, cuts[1:]):
            data, offsets = utf8(texts.slice(a, b - a))
            starts, _, rows = word_spans(data, offsets, _IS_WORD)
            row = np.searchsorted(rows, np.arange(len(starts)), "right") - 1
            ends = np.concatenate(([0], np.cumsum(_ENDS_PIECE[data])))
            pieces.append((ends[starts] + row + before).astype(np.int64))
            before += int(ends[-1]) + b - a
            raw = data.tobytes().translate(_SPLITTABLE)
            for k, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                found = raw[i:j].replace(b"\t", b" ").split(b" ") if j > i else []
                number = numbers[langs[a + k]].__getitem__
                own.append(np.fromiter(map(number, filter(None, found)), np.int32))
                lang_of.append(len(own[-1]))
        self.ids = np.concatenate([np.zeros(0, np.int32), *own])
        self.piece = np.concatenate([np.zeros(0, np.int64), *pieces])
        places = {lang: k for k, lang in enumerate(self.labels)}
        self.lang = np.repeat(np.array([places[x] for x in langs], np.int32), lang_of)

    def starts(self, size: int) -> np.ndarray:
        """Places where ``size`` words of one piece begin."""
        n = len(self.ids) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self):
        """For each size: the places where its phrases begin, and their hashes."""
        data, offsets = joined(self.words)
        print_ = np.zeros(len(self.words), np.uint64)
        if len(data):
            print_ = Rolling(byte_codes(0)[data]).stretches(offsets[:-1], offsets[1:])
        each = print_[self.ids]
        salts = np.array([hash_of_text(x) for x in self.labels] or [0], np.uint64)
        grown = mix(each ^ salts[self.lang]) if len(each) else each
        for size in range(1, self.most + 1):
            at = self.starts(size)
            if size > 1 and len(at):
                grown = mix(grown[: len(each) - size + 1] * _STEP + each[size - 1 :])
            yield size, at, grown[at]

    def phrases(self, size: int, at: np.ndarray):
        """Language, words and number of the distinct phrases that begin at some places."""
        stack = np.stack([self.ids[at + k] for k in range(size)])
        wide = max(len(self.words), 1)
        if wide**size < 1 << 63:
            key = stack[0].astype(np.int64)
            for k in range(1, size):
                key = key * wide + stack[k]
            key, counts = np.unique(key, return_counts=True)
            parts = []
            for _ in range(size):
                parts.append(key % wide)
                key = key // wide
            first = parts[-1]
            columns = parts[::-1]
        else:
            distinct, counts = np.unique(stack, axis=1, return_counts=True)
            columns = list(distinct)
            first = columns[0]
        word = self.words.__getitem__
        texts = [b" ".join(x) for x in zip(*(map(word, c.tolist()) for c in columns))]
        lang = np.zeros(len(self.words), np.int32)
        lang[self.ids] = self.lang
        return lang[first], texts, counts


def hash_of_text(text: str) -> int:
    data, offsets = joined([text.encode()])
    return int(mix(Rolling(byte_codes(1)[data]).stretches(offsets[:-1], offsets[1:]))[0])


def _packed(prints: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending 32-bit prints as differences, and counts of a byte each where they fit."""
    parts = [np.array([len(prints), 0 if counts is None else (1 if counts.max(initial=0) < 256 else 4)], np.int64).tobytes()]
    parts.append(np.diff(prints, prepend=np.uint32(0)).tobytes())
    if counts is not None:
        parts.append(counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width = np.frombuffer(raw, np.int64, 2).tolist()
    prints = np.cumsum(np.frombuffer(raw, np.uint32, n, 16), dtype=np.uint32)
    kind = {0: np.uint8, 1: np.uint8, 4: np.uint32}[width]
    return prints, np.frombuffer(raw, kind, n if width else 0, 16 + 4 * n).astype(np.int64)


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, print in the lower 32 bits."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    return bucket << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _block_of(blobs: list[bytes], most_words: int) -> Block:
    tables = [read_documents(b) for b in blobs]
    if not tables:
        return Block(pa.array([], pa.string()), [], most_words)
    table = pa.concat_tables(tables).combine_chunks()
    return Block(table.column("_text").combine_chunks(), table.column("_lang").to_pylist(), most_words)


def _send_prints(buckets: int, most_words: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = _block_of(table.column("blob").to_pylist(), most_words)
        keys = [_keys(h, buckets) for _, _, h in block.hashes()]
        keys = np.sort(np.concatenate(keys))
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        out = [
            (int(b), _packed(keys[i:k].astype(np.uint32), counts[i:k]))
            for b, (i, k) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()))
            if k > i
        ]
        rows = list(zip(*out)) or [[], []]
        give_back()
        return pa.table(
            [pa.array(rows[0], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(rows[1], pa.binary())],
            names=["bucket", "block", "blob"],
        )

    return run


def _frequent(sent: list[tuple[np.ndarray, np.ndarray]], least: int) -> np.ndarray:
    """Prints whose counts add up to ``least`` or more."""
    if not sent:
        return np.zeros(0, np.uint32)
    prints, counts = (np.concatenate(x) for x in zip(*sent))
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    return prints[new][np.add.reduceat(counts, new) >= least]


def _mine_shards(shards: int, support: int):
    """Of one bucket: each shard's frequent prints, united; each block hears which of its own are among them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        sent = [_unpacked(b) for b in table.column("blob").to_pylist()]
        candidates = np.zeros(0, np.uint32)
        for shard in range(shards):
            mine = [sent[i] for i in np.flatnonzero(blocks % shards == shard).tolist()]
            candidates = np.union1d(candidates, _frequent(mine, ceil(support / shards)))
        candidates = np.intersect1d(candidates, _frequent(sent, support), assume_unique=True)
        answers = []
        for block, (prints, _) in zip(blocks.tolist(), sent):
            hit = prints[np.isin(prints, candidates, assume_unique=True)]
            if len(hit):
                answers.append((block, _packed(hit)))
        rows = list(zip(*answers)) or [[], []]
        give_back()
        return pa.table(
            [pa.array(rows[0], pa.int32()), pa.array([key[0].as_py()] * len(answers), pa.int32()), pa.array(rows[1], pa.binary())],
            names=["block", "bucket", "blob"],
        )

    return run


def _count_candidates(buckets: int, most_words: int):
    def run(key: tuple, documents: pa.Table, answers: pa.Table) -> pa.Table:
        block = _block_of(documents.column("blob").to_pylist(), most_words)
        told = sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
        known = [np.uint64(b) << np.uint64(32) | _unpacked(blob)[0].astype(np.uint64) for b, blob in told]
        known = np.concatenate([np.zeros(0, np.uint64), *known])
        langs, texts, counts = [], [], []
        for lang, n in zip(*np.unique(block.lang, return_counts=True)):  # all words of a language, as the empty phrase
            langs.append(np.array([lang], np.int32)), texts.append([b""]), counts.append(np.array([n]))
        for size, at, hashes in block.hashes():
            keys = _keys(hashes, buckets)
            if not len(known) or not len(keys):
                continue
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            at = at[known[place] == keys]
            if len(at):
                lang, phrases, n = block.phrases(size, at)
                langs.append(lang), texts.append(phrases), counts.append(n)
        lang = np.concatenate([np.zeros(0, np.int32), *langs])
        phrases = [t for each in texts for t in each]
        bucket = np.fromiter(map(crc32, phrases), np.int64, len(phrases)) % buckets
        made = pa.table(
            [
                pa.array(bucket),
                pa.array(lang),
                pa.array(phrases, pa.binary()),
                pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)),
            ],
            names=["bucket", "lang", "phrase", "f"],
        ).sort_by([("bucket", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
        bucket, lang, f = (made.column(c).to_numpy() for c in ("bucket", "lang", "f"))
        cuts = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0)).tolist()
        out = [
            (int(bucket[i]), block.labels[lang[i]], _listed(made.column("phrase").slice(i, k - i).to_pylist(), f[i:k]))
            for i, k in zip(cuts, [*cuts[1:], len(f)])
        ]
        rows = list(zip(*out)) or [[], [], []]
        give_back()
        return pa.table(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary())], names=["bucket", "lang", "blob"]
        )

    return run


def _listed(phrases: list[bytes], counts: np.ndarray) -> bytes:
    """Phrases and their counts; no phrase holds a line feed."""
    width = 1 if counts.max(initial=0) < 256 else 8
    parts = [np.array([len(phrases), width], np.int64).tobytes(), counts.astype(f"<u{width}").tobytes(), b"\n".join(phrases)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _told(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width = np.frombuffer(raw, np.int64, 2).tolist()
    return raw[16 + n * width :].split(b"\n"), np.frombuffer(raw, f"<u{width}", n, 16).astype(np.int64)


def _add_up(support: int):
    """Of one bucket: the exact count of every phrase sent to it, where it reaches the support."""

    def run(table: pa.Table) -> pa.Table:
        labels = table.column("lang").to_pylist()
        made = []
        for label in sorted(set(labels)):
            sent = [_told(b) for x, b in zip(labels, table.column("blob").to_pylist()) if x == label]
            phrases = pa.array([p for own, _ in sent for p in own], pa.binary())
            whole = pa.table([phrases, pa.array(np.concatenate([n for _, n in sent]))], names=["phrase", "f"])
            whole = whole.group_by("phrase").aggregate([("f", "sum")])
            phrase, f = whole.column("phrase").combine_chunks().cast(pa.string()), whole.column("f_sum").combine_chunks()
            size = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
            kept = pc.or_(pc.equal(size, 0), pc.greater_equal(f, support))
            columns = [pa.array([label] * len(phrase), pa.string()), phrase, size, f]
            made.append(pa.table(columns, names=COUNTED).filter(kept))
        give_back()
        return pa.concat_tables(made)

    return run


def count_phrases(
    documents: DataFrame,
    *,
    support: int = 10,
    most_words: int = 3,
    shards: int = SHARDS,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
) -> DataFrame:
    """(lang, phrase, size, f): every phrase of 1 to ``most_words`` words that stands ``support`` times or more.

    A row of size 0 and an empty phrase holds the number of all words of each language that has any.
    Texts have A-Z lower-cased and are cut into pieces at ``PIECE_ENDS`` and into words at spaces and tabs;
    phrases lie within a piece and may overlap. A null language is ``und``, a null or empty text has
    no words. Null ids are allowed, repeated rows count each, other columns are ignored, and an empty
    table gives no rows.
    """
    label = F.coalesce(named(lang).cast("string"), F.lit(UNDETERMINED))
    source = documents.select(named(doc_id).cast("string").alias("_id"), label.alias("_lang"), named(text).alias("_text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = ceil(size / BLOCK_BYTES) or 1
    buckets = ceil(size / BUCKET_BYTES) or 1
    dealt = source.select("_lang", "_text", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int").alias("_block"))
    shipped = dealt.filter("_text <> ''").mapInArrow(ship_documents(blocks), "block int, blob binary")
    sent = shipped.groupBy("block").applyInArrow(_send_prints(buckets, most_words), "bucket int, block int, blob binary")
    mined = sent.groupBy("bucket").applyInArrow(_mine_shards(shards, support), "block int, bucket int, blob binary")
    counted = shipped.groupBy("block").cogroup(mined.groupBy("block")).applyInArrow(
        _count_candidates(buckets, most_words), "bucket int, lang string, blob binary"
    )
    return counted.groupBy("bucket").applyInArrow(_add_up(support), "lang string, phrase string, size int, f long")


def _part(start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def score_phrases(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the ``phrases`` of two words and more, all of them among the counts.

    Each cut after k words gives ``floor(1000000 * a * a / (l * r))``; the least of them counts, of equal
    ones that of the smallest k. The arithmetic is in decimals of 38 digits, exact for counts of up
    to 15 digits.
    """
    words = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    known = counts.filter("size >= 1")
    cuts = words.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "size", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    whole = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("phrase", F.concat_ws(" ", "left", "right"))
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * (_a * _a)) div (_l * _r)")
    scored = whole.withColumns({"_a": wide("a"), "_l": wide("l"), "_r": wide("r")}).withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def drop_contained(phrases: DataFrame, *, share: tuple[int, int] = (50, 100)) -> DataFrame:
    """Phrases go whose words stand in a longer one that is at least ``share[0] / share[1]`` as frequent, dropped or not."""
    least, whole = share
    inner = phrases.filter("size > 2").select(
        "lang", "f", F.split("phrase", " ").alias("words"), F.col("size").alias("outer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n")
    )
    inner = inner.select("lang", "f", "words", "n", F.explode(F.sequence(F.lit(1), F.col("outer") - F.col("n") + 1)).alias("i"))
    longest = inner.groupBy("lang", _part(F.col("i"), F.col("n")).alias("phrase")).agg(F.max("f").alias("longer"))
    held = F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(20,0)") * F.lit(whole) >= F.col("f").cast("decimal(20,0)") * F.lit(least)
    return phrases.join(longest, ["lang", "phrase"], "left").filter(~held).drop("longer")


def collocations(documents: DataFrame, *, support: int = 10, most_words: int = 3, top: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language by score.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of the parts of its weakest cut, ``n`` the number
    of words of the language. Order: score and frequency descending, then the phrase by its bytes.
    ``count_phrases`` names the cases of null, empty and repeated rows.
    """
    counts = settle(count_phrases(documents, support=support, most_words=most_words, **options))
    scored = score_phrases(counts, drop_contained(counts.filter("size >= 2")))
    first = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS_OF_LANGUAGE))  # so that a language's last task sees a bounded number
    near = scored.withColumn("_near", F.row_number().over(Window.partitionBy("lang", part).orderBy(*first))).filter(F.col("_near") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first))).filter(F.col("rank") <= top)
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def brute_force(documents: list[tuple[str | None, str | None]], support: int = 10, most_words: int = 3, top: int = 2000) -> list[tuple]:
    """The rows of ``collocations`` for (lang, text) pairs, with every phrase in one dictionary."""
    seen: dict[str, dict[tuple, int]] = {}
    for lang, text in documents:
        own = seen.setdefault(UNDETERMINED if lang is None else lang, {})
        for piece in (text or "").encode().translate(bytes(0x0A if _ENDS_PIECE[b] else int(_LOWER[b]) for b in range(256))).split(b"\n"):
            words = [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
            for size in range(1, most_words + 1):
                for i in range(len(words) - size + 1):
                    phrase = tuple(words[i : i + size])
                    own[phrase] = own.get(phrase, 0) + 1
    out = []
    for lang, f in seen.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        able = {p: v for p, v in f.items() if len(p) > 1 and v >= support}
        rows = []
        for p, a in able.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in able.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out
