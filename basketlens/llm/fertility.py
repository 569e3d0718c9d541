"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each document: characters per
token, share of byte-fallback tokens and entropy of the token distribution.
A document is kept when all three lie in the band of its language (or of its
script where the language has no band).  Text that no ordinary writing
produces (symbol noise, repeated words, broken encodings) leaves the bands.

Bands are narrowed by the distribution over all documents: characters per
token and entropy depend on the length, so each language or script has a band
per length class (octave of tokens), some spreads around the class's median.
Measuring is row-local; the distribution is a histogram with a bounded number
of bins, of which the driver reads four quantiles per class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from basketlens.llm.common import Words, held, mix64, ragged, stage, steps, text_bytes

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
#: A document may lie so many spreads below or above the median of its length class.
SPREADS_BELOW, SPREADS_ABOVE = 3.0, 5.0
#: Distinct measurements that a class needs; a smaller one takes the lower ends of the next shorter class that has them.
MIN_CLASS = 30
#: Width of the histogram bins, and the least spread.
BINS = {"chars_per_token": (0.002, 0.01), "token_entropy": (0.01, 0.02)}
#: Distinct words of which a worker remembers the tokens; beyond it a word is simply tokenised again.
MEMO_WORDS = 150_000


@dataclass(frozen=True)
class Band:
    """Accepted ranges.  ``min_entropy`` (bits) holds from ``entropy_from`` tokens on."""
    min_chars_per_token: float = 1.0
    max_chars_per_token: float = 8.0
    max_byte_share: float = 0.2
    min_entropy: float = 3.0
    entropy_from: int = 60


#: Bands by language code, then by script; "*" is for the rest.
BANDS = {
    "en": Band(1.3), "de": Band(1.2), "fr": Band(1.2), "es": Band(1.2),
    "latin": Band(1.15), "cyrillic": Band(0.9), "cjk": Band(0.25, 3.0, 0.9), "*": Band(0.25, 8.0, 0.9),
}

SCRIPTS = {"latin": r"[A-Za-z\x{C0}-\x{24F}]", "cyrillic": r"[\x{400}-\x{52F}]", "cjk": r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class _Pieces:
    """Token ids of words, remembered up to MEMO_WORDS."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.memo: dict[str, np.ndarray] = {}

    def encode(self, words: list[str]) -> list[np.ndarray]:
        out = list(map(self.memo.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(missing, self.sp.encode([words[i] for i in missing], num_threads=1) if missing else ()):
            out[i] = np.array(ids, np.int32)
            if len(self.memo) < MEMO_WORDS and len(words[i]) <= 64:
                self.memo[words[i]] = out[i]
        return out


def _pieces(path: str) -> _Pieces:
    return held(("pieces", path), lambda: _Pieces(path))


def _repeat_words(words: Words) -> np.ndarray:
    """Per row: words inside 8-word windows that the row holds twice or more."""
    n, codes, rows = len(words.codes), words.codes.astype(np.uint64), words.rows()
    first = ragged(words.starts[:-1], np.maximum(words.counts - WINDOW + 1, 0))
    if not len(first):
        return np.zeros(len(words.counts), np.int64)
    with np.errstate(over="ignore"):
        h = rows[first].astype(np.uint64)
        for k in range(WINDOW):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[first + k])
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    a, b = first[order[same]], first[order[same + 1]]
    ok = rows[a] == rows[b]
    for k in range(WINDOW):
        ok &= codes[a + k] == codes[b + k]
    cover = np.zeros(n + 1, np.int64)
    at = np.unique(np.concatenate([a[ok], b[ok]]))
    cover[at] += 1
    cover[at + WINDOW] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    return np.bincount(rows[hit], minlength=len(words.counts))


def _dup_lines(text: pa.Array) -> np.ndarray:
    """Per row: lines that have a word and equal an earlier line of the row."""
    parts = pc.split_pattern(text.cast(pa.large_string()), "\n")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    enc = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    has_word = pc.match_substring_regex(enc.dictionary, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(text)), np.diff(offsets))
    ok = has_word[codes] if len(codes) else np.zeros(0, bool)
    key = np.sort(rows[ok] * (len(enc.dictionary) + 1) + codes[ok])
    dup = key[1:][key[1:] == key[:-1]] // (len(enc.dictionary) + 1)
    return np.bincount(dup, minlength=len(text))


def _entropy(rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Shannon entropy (bits) of each row's token distribution."""
    key = np.sort(rows.astype(np.int64) << 32 | ids)
    if not len(key):
        return np.zeros(n)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(edge, len(key))).astype(float)
    row = key[edge] >> 32
    total = np.bincount(row, count, n)
    part = np.bincount(row, count * np.log2(count), n)
    safe = np.maximum(total, 1)
    return np.where(total > 0, np.log2(safe) - part / safe, 0.0)


def _script(text: pa.Array) -> list[str]:
    n = np.stack([pc.count_substring_regex(text, p).to_numpy(zero_copy_only=False) for p in SCRIPTS.values()])
    names = [*SCRIPTS, "*"]
    return [names[k] if m else "*" for k, m in zip(n.argmax(0), n.max(0) > 0)]


COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, "
           "token_entropy double, band string")


def _measure(batch: pa.RecordBatch, pieces: _Pieces, bands: dict[str, Band]) -> list[pa.Array]:
    text = pc.fill_null(batch.column("__text").cast(pa.string()), "")
    words = Words(text)
    n, rows = batch.num_rows, words.rows()
    distinct = words.distinct.to_pylist()
    chars = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False)
    word_chars = np.bincount(rows, chars[words.codes], n).astype(np.int64)
    encoded = pieces.encode(distinct)
    lens = np.fromiter(map(len, encoded), np.int64, len(encoded))
    flat = np.concatenate(encoded) if encoded else np.zeros(0, np.int32)
    at = np.cumsum(lens) - lens
    ids = flat[ragged(at[words.codes], lens[words.codes])]
    token_rows = np.repeat(rows, lens[words.codes])
    n_tokens = np.bincount(token_rows, minlength=n)
    safe = np.maximum(n_tokens, 1)
    per_token = np.where(n_tokens > 0, word_chars / safe, 0.0)
    byte_share = np.bincount(token_rows, pieces.is_byte[ids], n) / safe
    entropy = _entropy(token_rows, ids, n)
    repeat = _repeat_words(words)
    base_failed = (words.counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * words.counts)
    lang = batch.column("__lang").to_pylist()
    script = _script(text)
    name = [x if x in bands else s if s in bands else "*" for x, s in zip(lang, script)]
    band = [bands[x] for x in name]
    col = lambda f: np.array([getattr(b, f) for b in band], float)
    good = ((per_token >= col("min_chars_per_token")) & (per_token <= col("max_chars_per_token"))
            & (byte_share <= col("max_byte_share"))
            & ((n_tokens < col("entropy_from")) | (entropy >= col("min_entropy"))))
    return [pa.array(x) for x in (
        words.counts.astype(np.int64), word_chars,
        pc.count_substring_regex(text, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        _dup_lines(text), repeat.astype(np.int64), base_failed, ~base_failed & good, n_tokens.astype(np.int64),
        per_token, byte_share, entropy)] + [pa.array(name, pa.string())]


def _octave():
    return F.floor(F.log2("n_tokens")).cast("int")


def _class_bands(measured: DataFrame) -> list[tuple]:
    """(band, octave, least and greatest characters per token, least and greatest entropy) of the rows that are kept so far.

    Equal measurements count once: copies of one text do not set the band.  The
    spread is that of the middle half or of the upper half, whichever is wider,
    so junk below the median widens neither end.
    """
    each = F.explode(F.array(*(
        F.struct(F.lit(m).alias("m"), (F.round(F.col(m) / w) * w).alias("v")) for m, (w, _) in BINS.items())))
    bins = (measured.where("kept").select("band", "n_tokens", *BINS).distinct()
            .select("band", _octave().alias("octave"), each.alias("x")).groupBy("band", "octave", "x.m", "x.v").count())
    found = {}
    for r in bins.groupBy("band", "octave", "m").agg(
            F.sum("count").alias("n"), F.percentile("v", [0.25, 0.5, 0.75, 0.95], F.col("count")).alias("q")).collect():
        if r["n"] >= MIN_CLASS:
            q = r["q"]
            spread = max((q[2] - q[0]) / 1.349, (q[3] - q[1]) / 1.645, BINS[r["m"]][1])
            found[r["band"], r["m"], r["octave"]] = (q[1] - SPREADS_BELOW * spread, q[1] + SPREADS_ABOVE * spread)
    out = []
    for band in sorted({b for b, *_ in found}):
        low = {m: None for m in BINS}
        for octave in range(64):
            ends = []
            for m in BINS:
                own = found.get((band, m, octave))
                low[m] = own[0] if own else low[m]
                ends += [low[m], own[1] if own else None]
            out.append((band, octave, *ends))
    return out


def _narrowed(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept`` narrowed to the bands of the length classes."""
    ends = measured.sparkSession.createDataFrame(
        _class_bands(measured), "band string, __octave int, __c0 double, __c1 double, __e0 double, __e1 double")
    inside = F.lit(True)
    for m, k in zip(BINS, "ce"):
        inside &= F.coalesce(F.col(m) >= F.col(f"__{k}0"), F.lit(True)) & F.coalesce(F.col(m) <= F.col(f"__{k}1"), F.lit(True))
    # One row per band and octave: bounded by the number of bands.
    joined = measured.withColumn("__octave", _octave()).join(F.broadcast(ends), ["band", "__octave"], "left")
    return joined.withColumn("kept", F.col("kept") & inside).select(*measured.columns)


def fertility_quality(docs: DataFrame, vocabulary: str | None = None, bands: dict[str, Band] | None = None,
                      id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the base counts, the fertility measures, ``kept``.

    Null or blank text has no words: base_failed, not kept.  Null or unknown
    languages take the band of the script.  Ids may be null or repeated.  A
    missing language column counts as null.  ``kept`` follows ``bands`` and,
    inside them, the distribution over all rows of ``docs``.
    """
    path, bands = vocabulary or default_vocabulary(), bands or BANDS
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else None
    src = docs.select(docs[id_col].alias("__id"), text_bytes(text_col).alias("__text"),
                      (lang if lang is not None else F.lit(None).cast("string")).alias("__lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for b in steps(batches, "__text"):
            yield pa.RecordBatch.from_arrays([b.column("__id"), *_measure(b, pieces, bands)], names=names)

    kind = dict(src.dtypes)["__id"]
    names = ["__id", *(c.split()[0] for c in COLUMNS.split(", "))]
    measured = stage(src.mapInArrow(run, f"__id {kind}, {COLUMNS}"), "fertility")
    return _narrowed(measured).withColumnRenamed("__id", id_col)


def keep_fertile(docs: DataFrame, vocabulary: str | None = None, bands: dict[str, Band] | None = None,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass base rules and bands, columns unchanged.

    Texts are measured once: the rows inside ``bands`` are staged with their
    measures, and the bands of the length classes are applied to those.
    """
    path, bands = vocabulary or default_vocabulary(), bands or BANDS
    names = docs.columns
    tagged = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    tagged = tagged.withColumn("__text", text_bytes(at[text_col])).withColumn(
        "__lang", F.col(at[lang_col]).cast("string") if lang_col in at else F.lit(None).cast("string"))
    keep = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for b in steps(batches, "__text"):
            m = dict(zip(measures, _measure(b, pieces, bands)))
            cols = [*b.columns[:keep], *(m[c] for c in used)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:keep], *used]).filter(m["kept"])

    measures = [c.split()[0] for c in COLUMNS.split(", ")]
    used = ["n_tokens", "chars_per_token", "token_entropy", "band", "kept"]
    kinds = dict(c.split() for c in COLUMNS.split(", "))
    schema = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)])
    for c in used:
        schema = schema.add(c, kinds[c])
    return _narrowed(stage(tagged.mapInArrow(run, schema), "fertility")).where("kept").select(*(f"c{i}" for i in range(keep))).toDF(*names)
