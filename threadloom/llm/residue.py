"""Problem 10: template residue, filler, error pages and script notices.

Character n-gram models are fitted on a small labelled table; log-likelihood ratios over sliding windows localise residue, and the share
of a text that residue covers decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import residue_seeds as seeds

ORDERS = (2, 3, 4, 5)
_BITS = 16
#: Every model is scaled to this many n-grams, so an n-gram that no seed has favours no model.
_TOTAL = 20000.0
_ALPHA = 0.35
_MULT = np.uint64(0x9E3779B97F4A7C15)

#: Forms of unfilled blanks, localised exactly; the models of unfilled and of reported blanks decide on each. ``[EMAIL]`` and the like,
#: single bracketed words in capitals, are none.
_FIELD = r"[^\W\d_][^\W_]*(?:[ _.\-][^\W_]+)*"
#: Words that name a field of a letter, in the languages of the seeds.
_NAMED = r"(?:[Nn]ame|[Vv]orname|[Nn]achname|[Nn]ombre|[Aa]pellidos?|[Nn]om|[Pp]r[ée]nom|[Dd]ate|[Dd]atum|[Ff]echa|[Aa]ddress|[Aa]dresse|[Aa]mount|[Bb]etrag|[Ii]mporte|[Mm]ontant|[Tt]itle|[Tt]itel|[Cc]ompany|[Ff]irma|[Ee]mpresa|[Ll]ink|[Nn]umber|[Nn]ummer|[Cc]ity|[Ss]tadt|[Ss]ignature)"
BLANK = re.compile(
    rf"""\{{\{{\{{?\s*\#?/?{_FIELD}(?:\s*\|[^{{}}\n]*)?\s*\}}?\}}\}} | \{{%-?\s*{_FIELD}\s*-?%\}} | <%[=\-]?\s*{_FIELD}\s*-?%> | \*\|\s*{_FIELD}\s*\|\* | <<\s*{_FIELD}\s*>> | \[\[\s*{_FIELD}\s*\]\]
      | \$\{{\s*{_FIELD}\s*\}} | \#\{{\s*{_FIELD}\s*\}} | \#(?!\d+\#){_FIELD}\# | %%{_FIELD}%% | @@{_FIELD}@@ | (?<![\w_])__{_FIELD}__(?![\w_]) | %\({_FIELD}\)[sd] | %\d+\$[sd] | (?<![\w%])%[sd](?!\w)
      | (?<![\w%])%(?-i:[A-Z][A-Z_]+)%(?!\w) | (?<![\w$])\$(?-i:[A-Z][A-Z_]{{2,}})\b
      | \{{\d+\}} | \{{\s*{_FIELD}\s*\}} | (?<!\w)XX_\w+_XX(?!\w) | _{{4,}}\s*\((?:{_FIELD})\) | (?<!\w)_{{5,}}(?!\w)
      | \[(?:insert|enter|your|add|fill\ in|type|put|hier|bitte|ihr|inserte|su|votre)\s[^\[\]\n]+\] | \[[^\[\]\n]+\s(?:here|einfügen|eintragen|aquí|ici)\] | (?-i:\[(?:(?:[A-Z]?[a-z]+)[ _])?{_NAMED}\])
      | (?<!\w)TODO:?\s*(?:fill|insert|add|enter|write|complete|replace)\b[^.\n]*
      | <(?!/)(?:{_FIELD})>""",
    re.X | re.I,
)
#: Every form of a blank starts with one of these.
_MARKS = re.compile(r"[{%<*$#@_]|\[(?=\[|[^\W\d_])|[Xx](?=[Xx]_)|[Tt](?=[Oo][Dd][Oo])")
#: Names of markup elements. Angle brackets around one are markup, unless the element makes no sense without attributes or should be
#: closed and is not.
TAGS = frozenset("a abbr article aside audio b big blockquote body br button center cite code col dd del details div dl dt em embed figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label legend li link main map mark menu meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split())
BARE = frozenset("link source track param meta input img embed area col iframe object".split())
OPEN = frozenset("p br hr wbr li dt dd td tr th option html body head tbody thead tfoot noscript".split())


def _is_markup(tag: str, text: str) -> bool:
    name = tag[1:-1].strip().lower().split(" ")[0]
    if name not in TAGS or name in BARE:
        return False
    return name in OPEN or f"</{name}" in text.lower()


def _plain(text: str) -> str:
    """Lower case, runs of white space as one blank, a blank at either end."""
    return " " + " ".join(text.lower().split()) + " "


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all plain texts end to end, digits as 0, and where each text starts, the end last."""
    plain = [_plain(t) for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes, np.concatenate(([0], np.cumsum([len(t) for t in plain]))).astype(np.int64)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hashed n-grams that end at each place from the n-th on; one running hash serves all orders."""
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, ORDERS[-1] + 1):
            h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(1)) * _MULT if len(codes) >= n else h[:0]
            h ^= h >> np.uint64(29)
            if n in ORDERS:
                out.append(((h * _MULT) >> np.uint64(64 - _BITS)).astype(np.int32))
    return out


class NgramModel:
    """Log probabilities of hashed character n-grams of a few orders, from labelled texts."""

    def __init__(self, texts: Sequence[str]):
        self.tables = []
        found = [_grams(_codes([text])[0]) for text in texts]
        for k in range(len(ORDERS)):
            counts = np.zeros(1 << _BITS)
            for grams in found:
                np.add.at(counts, grams[k], 1.0)
            counts *= _TOTAL / max(1.0, counts.sum())
            self.tables.append(np.log(counts + _ALPHA).astype(np.float32))


class Ratios:
    """Mean log-likelihood ratios of pairs of models, per character; one row of a table holds the ratios of all pairs."""

    def __init__(self, *pairs: tuple[NgramModel, NgramModel]):
        self.pairs = len(pairs)
        self.tables = [np.stack([(own.tables[k] - other.tables[k]) / len(ORDERS) for own, other in pairs], axis=1) for k in range(len(ORDERS))]

    def per_char(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row per character, one column per pair; no n-gram reaches over the start of a text."""
        out = np.zeros((len(codes), self.pairs), dtype=np.float32)
        place = np.arange(len(codes), dtype=np.int64) - np.repeat(starts[:-1], np.diff(starts))
        for n, table, grams in zip(ORDERS, self.tables, _grams(codes), strict=True):
            got = table[grams]
            got[place[n - 1 :] < n - 1] = 0.0
            out[n - 1 :] += got
        return out


def _windowed(total: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Mean over the window around each place, shorter at the ends of a text; ``total`` are the running sums from 0."""
    at = np.arange(len(total) - 1)
    sizes = np.diff(starts)
    lo = np.maximum(np.repeat(starts[:-1], sizes), at - width // 2)
    hi = np.minimum(np.repeat(starts[1:], sizes), at + width // 2 + 1)
    return (total[hi] - total[lo]) / (hi - lo)


class ResidueModel:
    """Decides for a batch of texts at a time; the default parameters are the production ones, set on the held-out texts of the tests.

    ``window`` characters make a likelihood-ratio window. A filler passage is a run of windows for filler of at least
    ``filler_run`` characters whose mean ratio is at least ``filler_ratio``, or filler over ``page_cover`` of a short text. A page or
    notice covers ``page_cover`` of its text with windows for notice, at a mean ratio of at least ``page_ratio``. A blank stands in words
    that the model of unfilled blanks likes better than that of reported ones by at least ``blank_ratio``.
    """

    def __init__(self, window: int = 24, filler_run: int = 30, filler_ratio: float = 0.6, page_cover: float = 0.56, page_ratio: float = 0.1, blank_ratio: float = -0.25):
        filler, notice, prose = NgramModel(seeds.FILLER), NgramModel(seeds.NOTICE), NgramModel(seeds.PROSE + seeds.REPORTS)
        self.ratios = Ratios((filler, prose), (notice, prose))
        self.unfilled = Ratios((NgramModel(seeds.UNFILLED), NgramModel(seeds.QUOTED)))
        self.window, self.filler_run, self.filler_ratio, self.page_cover, self.page_ratio, self.blank_ratio = window, filler_run, filler_ratio, page_cover, page_ratio, blank_ratio

    def kinds(self, text: str) -> tuple[bool, bool, bool]:
        """Whether one text has an unfilled blank, a filler passage, and is a page or notice."""
        blank, filler, page = self.batch([text])
        return bool(blank[0]), bool(filler[0]), bool(page[0])

    def batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for each of many texts, worked out in one pass over the characters of all."""
        codes, starts = _codes(texts)
        sizes = np.diff(starts)
        scores = self.ratios.per_char(codes, starts)
        total = np.concatenate((np.zeros((1, 2)), np.cumsum(scores, axis=0, dtype=np.float64)))
        blank = np.fromiter((self.blank(t) for t in texts), dtype=bool, count=len(texts))
        some = sizes > 2
        return blank & some, self._filler(total[:, 0], starts) & some, self._page(total[:, 1], starts) & some

    def _filler(self, total: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(starts)
        on = _windowed(total, starts, self.window) > 0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begins = on.copy()
        begins[1:] &= ~on[:-1] | (owner[1:] != owner[:-1])
        ends = on.copy()
        ends[:-1] &= ~on[1:] | (owner[1:] != owner[:-1])
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        of = owner[a]
        long = (b - a >= self.filler_run) | (b - a >= self.page_cover * sizes[of])
        hit = long & (total[b] - total[a] >= self.filler_ratio * (b - a))
        out = np.zeros(len(sizes), dtype=bool)
        out[of[hit]] = True
        return out

    def _page(self, total: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.maximum(np.diff(starts), 1)
        covered = np.concatenate(([0], np.cumsum(_windowed(total, starts, self.window) > 0)))
        return ((covered[starts[1:]] - covered[starts[:-1]]) >= self.page_cover * sizes) & ((total[starts[1:]] - total[starts[:-1]]) >= self.page_ratio * sizes)

    def blank(self, text: str) -> bool:
        end = 0
        for mark in _MARKS.finditer(text):
            m = BLANK.match(text, mark.start()) if mark.start() >= end else None
            if m is None:
                continue
            s, end = m.group(), m.end()
            if s[0] == "<" and s[1] not in "<%" and _is_markup(s, text):
                continue
            if self.around(text, m.start(), m.end()) >= self.blank_ratio:
                return True
        return False

    def around(self, text: str, first: int, last: int) -> float:
        """The ratio of the nearest words of the sentence around a blank, by the models of unfilled and of reported blanks."""
        left = max(text.rfind(ch, 0, first) for ch in ".!?\n")
        ends = [x for x in (text.find(ch, last) for ch in ".!?\n") if x >= 0]
        right = min(ends, default=len(text))
        before, after = BLANK.sub("~", text[left + 1 : first])[-30:], BLANK.sub("~", text[last : right + 1])[:18]
        codes, starts = _codes([f"{before}~{after}"])
        return float(self.unfilled.per_char(codes, starts).mean())


def residue(documents: DataFrame, doc: Column, text: Column) -> DataFrame:
    """``doc_id, has_blank, has_filler, is_page`` of every document with any of them.

    Null and empty texts hold no residue; texts are read whole; repeated documents repeat their rows. The models are refitted from the
    seeds in each Python worker, in well under a second, so nothing is broadcast. One pass, no shuffle.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ResidueModel()
        for batch in batches:
            texts, parts, at = batch["_text"].tolist(), [], 0
            while at < len(texts):
                # About a million characters at a time, one longer text alone.
                size, to = len(texts[at]), at + 1
                while to < len(texts) and size + len(texts[to]) <= 1_000_000:
                    size, to = size + len(texts[to]), to + 1
                parts.append(model.batch(texts[at:to]))
                at = to
            if not parts:
                continue
            blank, filler, page = (np.concatenate(x) for x in zip(*parts, strict=True))
            out = pd.DataFrame({"doc_id": batch["doc_id"], "has_blank": blank, "has_filler": filler, "is_page": page})
            yield out[blank | filler | page]

    rows = documents.select(doc.alias("doc_id"), text.alias("_text")).where("_text is not null")
    return rows.mapInPandas(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, has_blank boolean, has_filler boolean, is_page boolean")


def without_residue(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """The documents that hold no residue, whole rows."""
    return documents.join(residue(documents, F.col(doc), F.col(text)).select(F.col("doc_id").alias(doc)).distinct(), doc, "left_anti")
