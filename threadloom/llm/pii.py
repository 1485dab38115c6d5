"""Problem 5: personal data inside free text.

A linear-chain conditional random field over word-shape features, trained from a small labelled table, is decoded by Viterbi in numpy
batches. What it finds passes an exact check of its kind and is replaced by a typed placeholder.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import pii_seeds as seeds

KINDS = seeds.KINDS
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
_BITS = 15
_TOKEN = re.compile(r"[^\S\n]*(?:[^\W\d_]+|\d+|\n|[^\w\s]|_)")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[NAME]"}

_GIVEN = {x.lower() for x in seeds.GIVEN}
_STREET = set(
    "street road lane close drive avenue terrace way hill court row place square crescent grove gardens boulevard blvd avda st rd ave ln dr straße strasse str gasse weg allee platz rue impasse quai chemin allée avenida calle plaza paseo camino ronda travesía rua travessa praça largo via viale piazza straat gracht gatan ulica box postfach apartado bp".split()
)
_STREET_END = ("straße", "strasse", "str", "gasse", "weg", "allee", "platz", "straat", "gracht", "gatan", "vej", "laan")
_PHONE_WORDS = set("tel call mobile phone text ring number sms whatsapp cell fax handy telefon teléfono nummer landline reach numéro ext".split())
_ID_WORDS = set("ssn social security nino national insurance tax steuer id passport reisepass pasaporte passeport ausweis ausweisnummer personalausweis license licence driving driver führerschein permis carnet dni nie curp identity steuernummer tin".split())
_REF_WORDS = set("ticket case order serial ref invoice err error code version tracking transaction model barcode build".split())


def _features(token: str) -> list[str]:
    """Of one token with the white space before it; digits count by their number only."""
    word = token.lstrip()
    low, spaced = word.lower(), token != word
    if word.isdigit():
        kind = [f"d{min(len(word), 13)}", "digit", "zero" if word[0] == "0" else "nonzero"]
    elif word[:1].isalpha():
        shape = "X" if word.isupper() and len(word) > 1 else "Xx" if word[0].isupper() else "x"
        kind = [f"w={low}", shape, f"{shape}{min(len(word), 6)}", f"s3={low[-3:]}", f"s4={low[-4:]}", f"p3={low[:3]}", "alpha"]
        for name, group in (("given", _GIVEN), ("street", _STREET), ("phoneword", _PHONE_WORDS), ("idword", _ID_WORDS), ("refword", _REF_WORDS)):
            if low in group:
                kind += [name, name + shape]
        if low.endswith(_STREET_END) and len(low) > 5:
            kind.append("streetend")
        if len(low) == 1:
            kind.append("single")
    else:
        kind = [f"c={word}", "mark"]
    return ["bias", *kind, "spaced" if spaced else "tight", kind[0] + ("_" if spaced else "")]


def _rows(token: str) -> np.ndarray:
    return np.array([zlib.crc32(f.encode()) & ((1 << _BITS) - 1) for f in _features(token)], dtype=np.int64)


def tokens_of(text: str) -> list[str]:
    """Words, digit runs, marks and line breaks, each with the blanks before it."""
    return _TOKEN.findall(text)


def _key(token: str) -> str:
    return token[: len(token) - len(token.lstrip())][:1] + ("0" * min(len(token.strip()), 13) if token.strip().isdigit() and token.strip()[0] != "0" else token.lstrip())


class Crf:
    """Weights of every feature at every offset, and of every pair of labels."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(OFFSETS), 1 << _BITS, LABELS), dtype=np.float32)
        self.steps = np.zeros((LABELS, LABELS), dtype=np.float32)
        self.ids: dict[str, int] = {}
        self.most = 400_000
        self.scores = np.zeros((1024, len(OFFSETS), LABELS), dtype=np.float32)

    # -- emissions ---------------------------------------------------------------------------------------------------------------

    def _id(self, token: str) -> int:
        i = self.ids.get(token)
        if i is None:
            i = len(self.ids) + 1
            self.ids[token] = i
            if i >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[i] = self.weights[:, _rows(token)].sum(axis=1)
        return i

    def emissions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens of all texts, laid end to end, and where each text starts. Id 0, the padding, scores nothing."""
        if len(self.ids) >= self.most:  # a bound on memory, between batches only: rows in use must not be given to other tokens
            self.ids.clear()
        pad = max(OFFSETS)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        starts = pad + np.concatenate(([0], np.cumsum(lengths + pad)))[:-1]
        ids = np.zeros(int((lengths + pad).sum()) + pad, dtype=np.int64)
        get = self.ids.get
        for s, t in zip(starts.tolist(), texts, strict=True):
            if t:
                ids[s : s + len(t)] = [get(x) or self._id(x) for x in t]
        out = np.zeros((len(ids), LABELS), dtype=np.float32)
        n = len(ids)
        for k, o in enumerate(OFFSETS):
            a, b = max(0, -o), min(n, n - o)
            out[a:b] += self.scores[ids[a + o : b + o], k]
        return out, starts

    # -- decoding ----------------------------------------------------------------------------------------------------------------

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best labels of every text, by Viterbi over blocks of texts of similar length."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(texts)
        scores, starts = self.emissions(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            block = [order[at]]
            while at + len(block) < len(order) and len(block) < 4096:
                n = len(texts[order[at + len(block)]])
                if n > longest * 1.2 + 2:
                    break
                block.append(order[at + len(block)])
            at += len(block)
            lengths = np.array([len(texts[i]) for i in block])
            width = int(lengths.max())
            index = starts[block][:, None] + np.minimum(np.arange(width)[None, :], lengths[:, None] - 1)
            labels = self._viterbi(scores, index)
            for row, i in enumerate(block):
                out[i] = labels[row, : lengths[row]]
        return out

    def _viterbi(self, scores: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Texts shorter than the block repeat their last token; only labels within the text are used, and repeating it adds equal
        scores to every continuation that keeps its label."""
        rows, width = index.shape
        back = np.zeros((width, rows, LABELS), dtype=np.int8)
        best = scores[index[:, 0]] + _START
        grid = np.ascontiguousarray(self.steps.T + _RULES.T)
        finals = np.empty((width, rows), dtype=np.int8)
        finals[0] = best.argmax(axis=1)
        for t in range(1, width):
            ways = best[:, None, :] + grid[None, :, :]
            back[t] = ways.argmax(axis=2)
            best = ways.max(axis=2) + scores[index[:, t]]
            finals[t] = best.argmax(axis=1)
        labels = np.zeros((rows, width), dtype=np.int8)
        # Every text starts its way back at its own last token.
        last = np.concatenate((index[:, 1:] == index[:, :-1], np.ones((rows, 1), dtype=bool)), axis=1).argmax(axis=1)
        now = finals[last, np.arange(rows)]
        labels[np.arange(rows), last] = now
        for t in range(int(last.max()), 0, -1):
            live = t <= last
            now = np.where(t == last, finals[t], now)
            previous = back[t, np.arange(rows), now]
            now = np.where(live, previous, now)
            labels[:, t - 1] = np.where(live, now, labels[:, t - 1])
        return labels

    # -- training ----------------------------------------------------------------------------------------------------------------

    def fit(self, data: list[tuple[list[str], np.ndarray]], epochs: int = 12, batch: int = 96, rate: float = 0.08, decay: float = 1e-5, seed: int = 3) -> Crf:
        """Maximises the conditional log-likelihood by AdaGrad over batches of texts of similar length."""
        rng = np.random.default_rng(seed)
        vocabulary: dict[str, int] = {}
        coded = [(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in t]), y) for t, y in data if t]
        rows = [_rows(t) for t in vocabulary]
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        starts = np.concatenate(([0], np.cumsum([len(x) for x in rows])))[:-1]
        squares, step_squares = np.full_like(self.weights, 1e-2), np.full_like(self.steps, 1e-1)
        coded.sort(key=lambda x: len(x[0]))
        batches = [coded[i : i + batch] for i in range(0, len(coded), batch)]
        pad = max(OFFSETS)
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                part = batches[b]
                width = max(len(x) for x, _ in part)
                ids = np.full((len(part), width + 2 * pad), -1, dtype=np.int64)
                gold = np.zeros((len(part), width), dtype=np.int64)
                mask = np.zeros((len(part), width), dtype=bool)
                for i, (x, y) in enumerate(part):
                    ids[i, pad : pad + len(x)], gold[i, : len(x)], mask[i, : len(x)] = x, y, True
                used = np.unique(ids[ids >= 0])
                place = np.zeros(len(rows) + 1, dtype=np.int64)
                place[used] = np.arange(len(used))
                spans = np.concatenate([np.arange(starts[u], starts[u] + len(rows[u])) for u in used])
                feats, local = flat[spans], place[owner[spans]]
                firsts = np.concatenate(([0], np.flatnonzero(np.diff(local)) + 1))
                emit = np.zeros((len(part), width, LABELS), dtype=np.float32)
                views = []
                for k, o in enumerate(OFFSETS):
                    view = ids[:, pad + o : pad + o + width]
                    ok = (view >= 0) & mask
                    table = np.add.reduceat(self.weights[k][feats], firsts, axis=0)
                    emit[ok] += table[place[view[ok]]]
                    views.append((ok, place[view[ok]]))
                node, edge = self._expected(emit, mask)
                node[np.arange(len(part))[:, None], np.arange(width)[None, :], gold] -= 1.0
                node[~mask] = 0
                both = mask[:, 1:]
                np.add.at(edge, (gold[:, :-1][both], gold[:, 1:][both]), -1.0)
                scale = 1.0 / len(part)
                for k, (ok, where) in enumerate(views):
                    per = np.zeros((len(used), LABELS), dtype=np.float32)
                    np.add.at(per, where, node[ok])
                    touched, inverse = np.unique(feats, return_inverse=True)
                    grad = np.zeros((len(touched), LABELS), dtype=np.float32)
                    np.add.at(grad, inverse, per[local])
                    grad = grad * scale + decay * self.weights[k][touched]
                    squares[k][touched] += grad * grad
                    self.weights[k][touched] -= rate * grad / np.sqrt(squares[k][touched])
                edge *= scale
                step_squares += edge * edge
                self.steps -= rate * edge / np.sqrt(step_squares)
        self.ids, self.scores = {}, np.zeros((1024, len(OFFSETS), LABELS), dtype=np.float32)
        return self

    def _expected(self, emit: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels of every token and expected pairs of labels, by the forward-backward algorithm with scaling."""
        rows, width, _ = emit.shape
        step = np.exp(self.steps + _RULES)
        e = np.exp(emit - emit.max(axis=2, keepdims=True))
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[:, 0] = e[:, 0] * np.exp(_START)
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, width):
            a = (alpha[:, t - 1] @ step) * e[:, t]
            a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            b = (beta[:, t + 1] * e[:, t + 1]) @ step.T
            b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-30)
            beta[:, t] = np.where(mask[:, t + 1, None], b, 1.0)
        node = alpha * beta
        node /= np.maximum(node.sum(axis=2, keepdims=True), 1e-30)
        edge = np.zeros((LABELS, LABELS), dtype=np.float64)
        for t in range(1, width):
            pair = alpha[:, t - 1, :, None] * step[None] * (beta[:, t] * e[:, t])[:, None, :]
            pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-30)
            edge += pair[mask[:, t]].sum(axis=0)
        return node.astype(np.float32), edge.astype(np.float32)


def _grammar() -> tuple[np.ndarray, np.ndarray]:
    """An inside label follows only the begin or inside of its kind."""
    rules, start = np.zeros((LABELS, LABELS), dtype=np.float32), np.zeros(LABELS, dtype=np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        rules[:, inside] = -60.0
        rules[[inside - 1, inside], inside] = 0.0
        start[inside] = -60.0
    return rules, start


_RULES, _START = _grammar()


def training_data(sentences: int) -> list[tuple[list[str], np.ndarray]]:
    """Tokens and labels of the labelled table."""
    out = []
    for pieces in seeds.labelled(sentences):
        text = "".join(p for p, _ in pieces)
        kinds = np.zeros(len(text) + 1, dtype=np.int8)
        begins, at = set(), 0
        for piece, kind in pieces:
            if kind:
                kinds[at : at + len(piece)] = 1 + KINDS.index(kind)
                begins.add(at)
            at += len(piece)
        tokens, labels, before = [], [], 0
        for m in _TOKEN.finditer(text):
            first = m.end() - len(m.group().lstrip(" \t\r\f\v  "))
            k = int(kinds[first])
            fresh = k and (k != before or first in begins)
            tokens.append(_key(m.group()))
            labels.append(0 if not k else 2 * k - 1 if fresh else 2 * k)
            before = k
        out.append((tokens, np.array(labels, dtype=np.int64)))
    return out


@functools.lru_cache(maxsize=2)
def trained(sentences: int = 6000, epochs: int = 10) -> Crf:
    """The model of the labelled table; the same on every call, since nothing in it is left to chance."""
    return Crf().fit(training_data(sentences), epochs=epochs)


_CHECKS = {
    "email": re.compile(r"\S.*?(?:@|\bat\b|\(at\)|\[at\]|_at_|\barroba\b).*?(?:\.|dot|punto|punkt)\s*\S", re.I | re.S),
    "phone": re.compile(r"(?:\D*\d){7,18}\D*\Z"),
    "id_number": re.compile(r"(?:\D*\d){5,16}\D*\Z"),
    "address": re.compile(r"\d"),
    "person_name": re.compile(r"[^\W\d_]{2,}"),
}


def _numbered(text: str, first: int, last: int) -> bool:
    """Whether a number stands right before or after a stretch."""
    return bool(re.search(r"\d\W{0,2}\Z", text[max(0, first - 4) : first]) or re.match(r"\W{0,2}\d", text[last : last + 3]))


def spans(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the labelled stretches that pass the exact check of their kind."""
    found: list[list] = []
    for m, label in zip(_TOKEN.finditer(text), labels.tolist(), strict=True):
        if not label:
            continue
        kind, first = KINDS[(label - 1) // 2], m.start() + len(m.group()) - len(m.group().lstrip())
        if label % 2 == 0 and found and found[-1][2] == kind:
            found[-1][1] = m.end()
        else:
            found.append([first, m.end(), kind])
    out = []
    for a, b, kind in found:
        value = text[a:b]
        if kind == "person_name" and _numbered(text, a, b) and any(w in _STREET for w in re.findall(r"[^\W\d_]+", value.lower()) if len(w) > 2):
            continue  # a street with its number, or a title made like one
        if _CHECKS[kind].search(value):
            out.append((a, b, kind))
    return out


def find(model: Crf, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Spans of personal data of each text, read without its invisible characters."""
    plain = [_INVISIBLE.sub("", t) if t else "" for t in texts]
    found = model.decode([[_key(x) for x in tokens_of(t)] for t in plain])
    return [spans(t, y) if y.any() else [] for t, y in zip(plain, found, strict=True)]


def redact(text: str, marks: list[tuple[int, int, str]]) -> str:
    """The text without invisible characters, with placeholders for its spans."""
    plain = _INVISIBLE.sub("", text)
    for a, b, kind in reversed(marks):
        plain = plain[:a] + PLACEHOLDER[kind] + plain[b:]
    return plain


def personal_data(rows: DataFrame, text: Column, sentences: int = 6000) -> DataFrame:
    """The columns of ``rows`` and ``kind``: one row per row and kind of personal data in its text. A column called ``kind`` gives way.

    Null and empty texts have none; texts are read whole; equal texts give equal kinds. The model is trained on the driver from the
    labelled table and travels with the plan, a few megabytes whatever the data. One pass, no shuffle.
    """
    model = trained(sentences)
    weights, steps = model.weights.astype(np.float16), model.steps
    rows = rows.drop("kind")
    names = rows.columns
    put = next(n for n in ("_text", "__text", "___text") if n not in names)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Crf()
        own.weights, own.steps = weights.astype(np.float32), steps
        for batch in batches:
            marks = find(own, batch[put].tolist())
            at, kinds = [], []
            for i, m in enumerate(marks):
                for kind in dict.fromkeys(k for _, _, k in m):
                    at.append(i)
                    kinds.append(kind)
            if at:  # Arrow takes no column of text without a chunk
                yield batch[names].iloc[at].assign(kind=kinds)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.withColumn(put, text).where(F.col(put).isNotNull()).mapInPandas(scan, f"{schema}, kind string")


def redacted(rows: DataFrame, *columns: str, sentences: int = 6000) -> DataFrame:
    """``rows`` with typed placeholders in the named columns, texts or arrays of texts; null stays null, arrays keep their places."""
    model = trained(sentences)
    weights, steps = model.weights.astype(np.float16), model.steps

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Crf()
        own.weights, own.steps = weights.astype(np.float32), steps

        def clean(texts: list[str | None]) -> list[str | None]:
            return [t if not m else redact(t, m) for t, m in zip(texts, find(own, texts), strict=True)]

        for batch in batches:
            for c in columns:
                values = batch[c].tolist()
                if any(v is not None and not isinstance(v, str) for v in values):
                    flat = iter(clean([t for v in values if v is not None for t in v]))
                    values = [None if v is None else [next(flat) for _ in v] for v in values]
                else:
                    values = clean(values)
                batch[c] = pd.Series(values, index=batch.index, dtype="object")
            yield batch

    return rows.mapInPandas(scan, rows.schema)
