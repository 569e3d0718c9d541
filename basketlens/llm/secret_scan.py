"""Secret scans: fixed patterns plus a randomness test battery.

Patterns find assignments, access keys and hex strings.  The battery looks at
every other long token.  The alphabet of its characters is the inferred
encoding (hex, base32, base36, letters, base62, base64); symbols are numbered by
their frequency in text (letters in the order of English, then capitals, digits
and signs), so that text crowds into the first numbers and random draws do not.
Three tests ask whether the numbers could be independent uniform draws:
chi-squared uniformity, runs about the median, lag-1 serial correlation.

What is tested is the hypothesis "this token is text": its p-value is the share
of text tokens, of that encoding and at most that length, that look as random
as it does.  Text tokens are words of a public vocabulary joined as identifiers
and paths are, drawn with a fixed seed.  Within a document the hypotheses are
tested together: Benjamini-Hochberg with weights in proportion to length (a
long token can be told from text, a short one hardly) bounds the share of
ordinary tokens among those reported.  Row-local: no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from basketlens.llm.common import hold_nothing, steps, text_bytes

#: Pattern, group whose length counts, least length.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # a run of 16 or more is the same as a whole run that is then measured
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
#: Letters by their frequency in English text, a public order.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
_LOWER, _UPPER, _DIGITS = BY_FREQUENCY, BY_FREQUENCY.upper(), "0123456789"
#: Encodings in order of inference: pattern, symbols by their frequency in text.
ENCODINGS = {
    "random_hex": (re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    "random_letters": (re.compile(r"[a-z]+|[A-Z]+"), _LOWER),
    "random_base32": (re.compile(r"(?:[A-Z2-7]+|[a-z2-7]+)=*"), _LOWER + "234567"),
    "random_base36": (re.compile(r"[a-z0-9]+|[A-Z0-9]+"), _LOWER + _DIGITS),
    "random_base62": (re.compile(r"[A-Za-z0-9]+"), _LOWER + _UPPER + _DIGITS),
    "random_base64": (re.compile(r"[A-Za-z0-9+/_-]+=*"), _LOWER + _UPPER + _DIGITS + "+/"),
}
KIND_ORDER = {k: i for i, k in enumerate((*PATTERNS, *ENCODINGS))}
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Least information (bits) a reported token carries if random; level of the false-discovery control.
MIN_BITS, FDR = 64, 0.05
#: Text tokens drawn for each encoding and length; lengths (a token takes the greatest one up to its own); seed.
DRAWS, LENGTHS, SEED = 3000, (16, 20, 24, 28, 32, 40, 48, 64, 96, 128), 20


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(v) for v in x.ravel()]).reshape(x.shape)


def _sf_chi2(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tail of chi-squared by the Wilson-Hilferty normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * _erfc(z / math.sqrt(2))


def randomness(symbols: np.ndarray, size: int) -> np.ndarray:
    """P-values (rows: tokens of one length; columns: chi-squared uniformity, runs, serial correlation) for draws from
    0 .. size - 1.

    Short tokens use fewer, equally wide bins, so that five draws are expected in each.
    """
    many, n = symbols.shape
    bins = int(max(2, min(size, n // 5)))
    at = symbols * bins // size + np.arange(many)[:, None] * bins
    counts = np.bincount(at.ravel(), minlength=many * bins).reshape(many, bins)
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    p_chi = _sf_chi2((((counts - n * share) ** 2) / (n * share)).sum(axis=1), bins - 1)
    high = symbols >= size // 2
    a = high.sum(axis=1).astype(float)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    both = 2 * a * b
    var = both * (both - n) / (n * n * (n - 1.0))
    z = (runs - 1 - both / n) / np.sqrt(np.where(var > 0, var, 1.0))
    p_runs = np.where((a == 0) | (b == 0), 2.0 ** (1 - n), np.where(var > 0, _erfc(np.abs(z) / math.sqrt(2)), 1.0))
    x = symbols - symbols.mean(axis=1, keepdims=True)
    ss = (x * x).sum(axis=1)
    r = np.where(ss > 0, (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.where(ss > 0, ss, 1.0), 1.0)
    p_serial = _erfc(np.abs((r + 1 / (n - 1)) * math.sqrt(n)) / math.sqrt(2))
    return np.stack([p_chi, p_runs, p_serial], axis=1)


def looks_random(symbols: np.ndarray, size: int) -> np.ndarray:
    """The battery in one number a token: the least p-value, corrected for three tests."""
    return np.minimum(1.0, 3 * randomness(symbols, size).min(axis=1))


def _numbers(alphabet: str) -> np.ndarray:
    """Symbol number of each ASCII character; a single-case alphabet reads both cases alike."""
    table = np.zeros(128, np.int64)
    one_case = alphabet.lower() == alphabet
    for i, c in enumerate(alphabet):
        table[ord(c)] = i
        if one_case:
            table[ord(c.upper())] = i
    table[ord("-")], table[ord("_")] = table[ord("+")], table[ord("/")]
    return table


_TABLES = {kind: _numbers(alphabet) for kind, (_, alphabet) in ENCODINGS.items()}


def infer(token: str) -> tuple[str, np.ndarray, int] | None:
    """Encoding, symbol numbers and alphabet size of a token: the first encoding that holds all its characters."""
    for kind, (pattern, alphabet) in ENCODINGS.items():
        if pattern.fullmatch(token):
            return kind, _TABLES[kind][np.frombuffer(token.rstrip("=").encode(), np.uint8)], len(alphabet)
    return None


def _words(vocabulary: str) -> list[str]:
    """The vocabulary's words of three ASCII letters or more (those that end a word)."""
    with open(vocabulary, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w in entries if w.endswith("</w>"))
    return sorted(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha())


def text_tokens(kind: str, n: int, many: int, words: list[str], rng: np.random.Generator) -> np.ndarray:
    """``many`` tokens of ``n`` characters (rows of ASCII) as text makes them: words and numbers joined in the ways that
    fit an encoding, from the start of a word on."""
    if kind == "random_hex":            # numbers, dates and hours one after the other; words of a to f are rare
        return rng.integers(48, 58, (many, n)).astype(np.uint8)
    out = []
    styles = {"random_letters": ["lower"], "random_base32": ["lower"], "random_base36": ["lower"],
              "random_base62": ["Camel", "Camel9"], "random_base64": ["snake_", "kebab-", "path/", "Snake_9"]}[kind]
    for style in styles:
        parts, size = [], 0
        share = -(-many // len(styles))
        for i in rng.integers(0, len(words), 2000 + n).tolist():
            w = words[i].capitalize() if style[0].isupper() else words[i]
            parts.append(w + ("" if style[-1].isalpha() or style[-1] == "9" and style[0] == "C" else "_" if style[-1] == "9" else style[-1]))
            if style[-1] == "9" and size % 5 == 0:
                parts.append(str(rng.integers(0, 10_000)))
            size += 1
        at = np.cumsum([0, *map(len, parts)])
        text = np.frombuffer("".join(parts).encode(), np.uint8)
        starts = at[:-1][at[:-1] <= len(text) - n]
        out.append(text[rng.choice(starts, share)[:, None] + np.arange(n)])
    got = np.concatenate(out)[:many].copy()
    if kind in ("random_base32", "random_base36"):          # one to four digits at the end, or at the beginning
        digits = rng.integers(50, 56, (many, 4)) if kind == "random_base32" else rng.integers(48, 58, (many, 4))
        for k in range(1, 5):
            mine = np.flatnonzero(np.arange(many) % 4 == k - 1)
            front, back = mine[: len(mine) // 4], mine[len(mine) // 4:]
            got[front[:, None], np.arange(k)] = digits[front, :k]
            got[back[:, None], np.arange(n - k, n)] = digits[back, :k]
    return got


class TextNull:
    """How random text tokens look, by encoding and length: the distribution that p-values are read from."""

    def __init__(self, vocabulary: str):
        words, rng = _words(vocabulary), np.random.default_rng(SEED)
        self.found: dict[tuple[str, int], np.ndarray] = {}
        for kind, (_, alphabet) in ENCODINGS.items():
            for n in LENGTHS:
                symbols = _TABLES[kind][text_tokens(kind, n, DRAWS, words, rng)]
                self.found[kind, n] = np.sort(looks_random(symbols, len(alphabet)))

    def p_value(self, kind: str, n: int, looks: float) -> float:
        """Share of text tokens that look as random (one more counted, so it is never 0)."""
        null = self.found[kind, max(x for x in LENGTHS if x <= n)]
        return float((len(null) - np.searchsorted(null, looks, "left") + 1) / (len(null) + 1))


def rejected(p: np.ndarray, length: np.ndarray, level: float = FDR) -> np.ndarray:
    """True where length-weighted Benjamini-Hochberg rejects the hypothesis, here that a token is text."""
    m = len(p)
    q = p * length.mean() / length
    order = np.argsort(q, kind="stable")
    below = np.flatnonzero(q[order] <= level * np.arange(1, m + 1) / m)
    out = np.zeros(m, bool)
    if len(below):
        out[order[: below[-1] + 1]] = True
    return out


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_NULLS: dict[str, TextNull] = {}


def text_null(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The null distribution, drawn once by the driver and sent to the workers: encodings x lengths x draws, about 1.4 MB."""
    if vocabulary not in _NULLS:
        _NULLS[vocabulary] = TextNull(vocabulary)
    return spark.sparkContext.broadcast(_NULLS[vocabulary])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, (pattern, group, least) in PATTERNS.items():
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], KIND_ORDER[s[2]]))


def random_spans(text: str, base: list[tuple[int, int, str]], null: TextNull) -> list[tuple[int, int, str]]:
    """Tokens outside the base spans that the battery takes for random.

    Equal tokens are one hypothesis: a name that a document repeats is not many.
    """
    found: dict[str, list] = {}
    for m in _TOKEN.finditer(text):
        if any(s <= m.start() and m.end() <= e for s, e, _ in base):
            continue
        if m[0] in found:
            found[m[0]][-1].append(m.start())
            continue
        kind, symbols, size = infer(m[0])
        if len(symbols) * math.log2(size) >= MIN_BITS:
            p = null.p_value(kind, len(symbols), float(looks_random(symbols[None], size)[0]))
            found[m[0]] = [kind, p, len(symbols), [m.start()]]
    if not found:
        return []
    take = rejected(np.array([f[1] for f in found.values()]), np.array([float(f[2]) for f in found.values()]))
    return [(at, at + len(token), f[0]) for (token, f), t in zip(found.items(), take) if t for at in f[3]]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(text: str, null: TextNull) -> tuple[int, int, int, str, str, list[tuple[int, int, str]]]:
    base = base_spans(text)
    spans = sorted(base + random_spans(text, base, null), key=lambda s: (s[0], KIND_ORDER[s[2]]))
    n = [sum(k == kind for *_, k in base) for kind in PATTERNS]
    return *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), spans


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield (x.as_py() or b"").decode("utf-8", "replace")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, counts per pattern, digest of the base spans, all spans.

    Null and empty text have no spans (the digest is that of the empty string).
    Ids may be null or repeated.  Spans count code points, end exclusive.
    """
    shared = text_null(docs.sparkSession, vocabulary or default_vocabulary())
    src = docs.select(docs[id_col].alias("__id"), text_bytes(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        null = shared.value
        for b in steps(batches, "__text"):
            rows = [scan(t, null)[:5] for t in _texts(b.column("__text"))]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([b.column("__id"), *cols], names=names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)['__id']}, n_assign long, n_access long, n_hex long, "
                               "base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars",
           vocabulary: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and ``length_col`` brought up to date.

    Rows without a span are unchanged; null text stays null.  Ids are not
    read: they may be null or repeated.  An empty table stays empty.
    """
    shared = text_null(docs.sparkSession, vocabulary or default_vocabulary())
    names, types = docs.columns, [f.dataType for f in docs.schema.fields]
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None
    tagged = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def clean(text: str | None, null: TextNull) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for s, e, _ in scan(text, null)[5]:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join(out) + text[done:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        null = shared.value
        for b in steps(batches, f"c{at}"):
            old = b.column(at).to_pylist()
            new = [clean(t, null) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if length_at is not None:
                had = b.column(length_at).to_pylist()
                cols[length_at] = pa.array([len(n) if n is not o and n != o else h for n, o, h in zip(new, old, had)],
                                           cols[length_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    schema = StructType([StructField(f"c{i}", t, True) for i, t in enumerate(types)])
    return tagged.mapInArrow(run, schema).toDF(*names)
