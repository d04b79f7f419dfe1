"""Language of documents and of their sentences, by compression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import folded, masked, plain, spans, squeezed
from strandline.llm.encoding import spread

# The languages told apart, with their codes and names.
LANGUAGES = {
    "en": ["en", "eng", "english"], "es": ["es", "spa", "spanish", "espanol", "español", "castilian"], "fr": ["fr", "fra", "fre", "french", "francais", "français"],
    "pt": ["pt", "por", "portuguese", "portugues", "português"], "de": ["de", "deu", "ger", "german", "deutsch"], "it": ["it", "ita", "italian", "italiano"],
    "id": ["id", "in", "ind", "indonesian", "bahasa indonesia"], "ru": ["ru", "rus", "russian", "русский"],
}
#: Labelled rows per language the dictionaries are drawn from, bytes of a dictionary, rounds of sorting out.
ROWS, DICTIONARY, ROUNDS = 400, 96 * 1024, 3
#: Level of compression, and sentences a worker remembers.
LEVEL, REMEMBERED = 2, 50_000
#: A language is rejected unless the next one is larger by this share, and these bytes.
MARGIN, MARGIN_BYTES = 0.08, 3
#: Characters of the texts the dictionaries are drawn from; all texts are classified, of any length.
TRAINING_CHARS = (200, 20_000)
#: Words of letters below which a sentence is short: it needs closing punctuation, which names and headings lack, and a larger margin. Words up to
#: which a quotation within a sentence is a slogan of its own, whatever its language.
SHORT_WORDS, SHORT_MARGIN, SLOGAN = 5, 0.2, 5

_WORD = re.compile(r"[^\W\d_]{2,}")
_CLOSED = re.compile(r"[.!?…][\"'”’»)]*$")
_QUOTES = "\"“„«"
_QUOTED = re.compile(r"[\"“„«]([^\"“”„«»\n]{1,60})[\"”“»]")


def label_key(c: Column) -> Column:
    """The two-letter code a label stands for in any notation; NULL for void and unknown labels."""
    low = F.trim(F.lower(c))
    base = F.regexp_extract(low, r"^([^-_]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        out = F.when(low.isin(names) | base.isin(names), F.lit(code)).otherwise(out)
    return out


def segments(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, words to judge, whether it is short) of the sentences of a text, by positions in the text as it is.

    Slogans quoted within a sentence are cut out of what is judged, unless nothing else would be left. Pieces without a word are none, and
    short ones only with closing punctuation.
    """
    out, bare = [], masked(text)
    for a, b in spans(bare):
        rest = s = squeezed(bare[a:b])
        if any(q in s for q in _QUOTES):
            rest = _QUOTED.sub(lambda m: " " if len(m.group(1).split()) <= SLOGAN else m.group(), s)
            if not _WORD.search(rest):
                rest = s
        n = sum(1 for _ in islice(_WORD.finditer(rest), SHORT_WORDS))
        if n >= SHORT_WORDS or (n and _CLOSED.search(bare[a : b + 1].rstrip())):
            out.append((a, b, rest.strip(), n < SHORT_WORDS))
    return out


@dataclass
class Classifier:
    """A raw-content zstandard dictionary per language."""

    dictionaries: dict[str, bytes]
    _ready: dict = field(default_factory=dict, repr=False)
    _seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_ready": {}, "_seen": {}}

    def sizes(self, raw: bytes) -> dict[str, int]:
        if not self._ready:
            import zstandard as z

            for k, content in self.dictionaries.items():
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                p = z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
                self._ready[k] = p.compress
        return {k: len(f(raw)) for k, f in self._ready.items()}

    def of(self, text: str, least: float = MARGIN) -> tuple[str | None, float]:
        """(language or None, margin): the smallest size wins, unless the next is nearly as small."""
        if (known := self._seen.get(text)) is None:
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            known = self._seen[text] = self._judge(folded(text).encode())
        lang, margin = known
        return (lang if margin >= least else None), margin

    def _judge(self, raw: bytes) -> tuple[str | None, float]:
        s = sorted((n, k) for k, n in self.sizes(raw).items())
        if len(s) < 2:
            return (s[0][1], 1.0) if s else (None, 0.0)
        margin = (s[1][0] - s[0][0]) / s[1][0]
        return (s[0][1] if margin >= MARGIN and s[1][0] - s[0][0] >= MARGIN_BYTES else None), margin


def _words(segment: str) -> set[str]:
    return set(_WORD.findall(folded(segment)))


def _sorted_out(sample: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
    """Sentences by language, from (label, sentences) of texts some of which are mislabelled or mixed.

    Each sentence goes to the label its words are most typical of, whatever its own text's label; the
    words' counts are then taken anew from the sentences so placed.
    """
    placed = [(lab, s) for lab, segs in sample for s in segs]
    words = {s: _words(s) for _, s in placed}
    codes = sorted({lab for lab, _ in placed})
    for _ in range(ROUNDS):
        n = {c: Counter() for c in codes}
        for c, s in placed:
            n[c].update(words[s])
        total = {c: sum(n[c].values()) + 1 for c in codes}
        odds = lambda c, w: math.log((n[c][w] + 0.1) / total[c])  # noqa: B023, E731
        placed = [(max(codes, key=lambda c: sum(odds(c, w) for w in words[s])), s) for _, s in placed]  # noqa: B023
    out: dict[str, list[str]] = {c: [] for c in codes}
    for c, s in placed:
        out[c].append(s)
    return out


def _content(segs: list[str]) -> bytes:
    """A dictionary's content: sentences that say something new last, where they are cheapest to refer to.

    A sentence is new if a third of its pairs of words, or more, has not occurred; all such sentences come in before
    variants of known ones fill the rest.
    """
    new, more, seen = [], [], set()
    for s in dict.fromkeys(folded(x) for x in segs):
        w = s.split()
        pairs = set(zip(w, w[1:], strict=False))
        (new if len(pairs - seen) * 3 >= len(pairs) else more).append(s)
        seen |= pairs
    core = "\n".join(new).encode()[:DICTIONARY]
    return "\n".join(more).encode()[: max(0, DICTIONARY - len(core) - 1)] + b"\n" + core


def _build(by_language: dict[str, list[str]]) -> Classifier:
    return Classifier({k: _content(v) for k, v in by_language.items() if v})


def fit(docs: DataFrame, key: str, text: str, label: str, rows: int = ROWS, chars: tuple[int, int] = TRAINING_CHARS) -> Classifier:
    """A classifier from a bounded sample: at most ``rows`` labelled texts per language, of ``chars`` characters, by hash of the key.

    The languages' labels are counted first; the texts are then read once and only some ``rows`` of each drawn.

    Labels are noisy and texts mixed, so the sample's sentences are first sorted by their words; the
    dictionaries hold the sentences of each language, in the order of the sample.
    """
    length = F.coalesce(F.length(text), F.lit(0))
    labelled = docs.withColumn("__l", label_key(F.col(label))).where(F.col("__l").isNotNull() & length.between(*chars))
    n = {r["__l"]: r["count"] for r in labelled.groupBy("__l").count().collect()}  # a row per language
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    some = F.coalesce(*(F.when(F.col("__l") == k, F.lit(min(1.0, (rows + 4 * math.sqrt(rows)) / c))) for k, c in sorted(n.items()))) if n else F.lit(0.0)
    sample = labelled.where(draw < some).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("__l").alias("l"), draw.alias("draw")).toPandas()
    sample = sample.sort_values(["draw", "k"]).groupby("l").head(rows).sort_values("k")
    return _build(_sorted_out([(lab, [x[2] for x in segments(t) if not x[3]]) for lab, t in zip(sample.l, sample.t, strict=True)]))


def _runs(found: list[tuple[int, int, str | None, float]]) -> list[tuple]:
    """(start, end, lang, confidence, sentences, size): neighbouring sentences of one language as one."""
    out: list[list] = []
    for a, b, lang, margin in found:
        if out and out[-1][2] == lang:
            x = out[-1]
            x[1], x[3], x[4], x[5] = b, x[3] + margin, x[4] + 1, x[5] + b - a
        else:
            out.append([a, b, lang, margin, 1, b - a])
    return [(a, b, lang, total / n, n, size) for a, b, lang, total, n, size in out]


def classify(docs: DataFrame, key: str, text: str, model: Classifier) -> DataFrame:
    """(key, segment, start, end, lang, confidence, n_sentences, size): a row per run of sentences of one language.

    Each sentence goes to the language whose dictionary compresses it best; where the next one is nearly as good
    the language is NULL. Neighbouring sentences of one language, or of none, make one segment: characters ``start`` up to, not
    including, ``end`` of the text, counted from 0; ``size`` is without the gaps between them. A text none of whose
    sentences is clear is judged as a whole (segment 0). Texts without words, NULL and empty ones give no rows. ``confidence``
    is the mean margin to the next language. All sentences of the whole text count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DICTIONARY bytes per language

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in parts:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                found = [(a, b, *m.of(s, SHORT_MARGIN if short else MARGIN)) for a, b, s, short in segments(t)] if t else []
                rows += [(k, i + 1, *x) for i, x in enumerate(_runs(found))]
                if t and not any(f[2] for f in found) and len(_WORD.findall(whole := plain(t))) >= SHORT_WORDS:
                    rows.append((k, 0, 0, len(t), *m.of(whole), len(found), len(t)))
            yield pd.DataFrame(rows, columns=[key, "segment", "start", "end", "lang", "confidence", "n_sentences", "size"])

    kind = dict(docs.dtypes)[key]
    shape = f"`{key}` {kind}, segment int, start int, end int, lang string, confidence double, n_sentences int, size int"
    return spread(docs.select(key, text).where(F.col(text).isNotNull()), key).mapInPandas(run, shape)


def per_language(segs: DataFrame, key: str) -> DataFrame:
    """(key, lang, confidence, n_segments, n_sentences, share, n_langs): a row per language of each text."""
    n = F.sum("n_sentences")
    by = segs.where("lang is not null").groupBy(key, "lang").agg(
        F.count("*").alias("n_segments"), n.alias("n_sentences"), (F.sum(F.col("confidence") * F.greatest("n_sentences", F.lit(1))) / F.greatest(n, F.lit(1))).alias("confidence"), F.sum("size").alias("size")
    )
    text = Window.partitionBy(key)  # a row per language, eight at most
    return by.select(key, "lang", "confidence", "n_segments", "n_sentences", (F.col("size") / F.sum("size").over(text)).alias("share"), F.count("*").over(text).cast("int").alias("n_langs"))
