"""Problem 8: evaluation passages inside training text.

Items and documents are reduced to words, words to templates: numbers, units and names become typed slots. A unit is whatever is counted: the
word right after a number. Windows of template words are joined by hash, then the slots are compared: all equal is a verbatim passage, a
consistent substitution a re-parameterised one. A slot of a name takes any name of an item, any word that no item has and any word with
a capital in the document, but no number or unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Set

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.workspace import Workspace

_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});", re.S)
_WORD = re.compile(r"[^\W_]+")

#: Number words below a hundred and their parts, lower case.
NUMBERS = frozenset(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze vingt trente quarante cinquante".split()
)
_NUM, _UNIT, _NAME = "\x00n", "\x00u", "\x00p"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(text: str | None) -> list[str]:
    """Runs of letters or digits in lower case; markup tags and entities only separate."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


def _number(word: str) -> bool:
    return word.isdigit() or word in NUMBERS


def _template(word: str, names: set[str]) -> str:
    if _number(word):
        return _NUM
    return _NAME if word in names else word


def _counted(ids: np.ndarray, number: np.uint64, unit: np.uint64) -> np.ndarray:
    """``ids`` of one text with the unit in place of every word that follows a number and is none."""
    out, is_number = ids.copy(), ids == number
    out[1:][is_number[:-1] & ~is_number[1:]] = unit
    return out


def _cases(texts: Iterable[str | None]) -> tuple[set[str], set[str]]:
    """Words with a capital inside a sentence, and words without, in lower case."""
    upper, lower = set(), set()
    for text in texts:
        for m in _WORD.finditer(text or ""):
            w, before = m.group(), text[: m.start()].rstrip()[-1:]
            inside = before.isalnum() or before in (",", ";")
            if inside and w[0].isupper() and not w.isupper():
                upper.add(w.lower())
            elif w[0].islower():
                lower.add(w.lower())
    return upper, lower


def item_names(texts: Iterable[str | None]) -> set[str]:
    """Words that items write with a capital inside a sentence and never without: taken as names, whatever their case elsewhere."""
    upper, lower = _cases(texts)
    return upper - lower


def _capitals(text: str, tokens: list[str]) -> list[bool]:
    """Which of the words of a document are written with a capital, but not in capitals throughout."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    written = _WORD.findall(text)
    if len(written) == len(tokens):
        return [w[0].isupper() and not w.isupper() for w in written]
    # Lower case of a few letters takes more than one character: go by the word instead of its place.
    some = {w.lower() for w in written if w[0].isupper() and not w.isupper()}
    return [w in some for w in tokens]


def _rolled(plain: np.ndarray, ids: np.ndarray, span: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``span`` ids. The first word of a window is taken plain: what stands before it is not in the window."""
    out = np.zeros(max(0, len(ids) - span + 1), dtype=np.uint64)
    if not len(out):
        return out
    with np.errstate(over="ignore"):
        for k in range(span):
            out = out * _BASE + (plain if k == 0 else ids)[k : len(ids) - span + 1 + k]
    return out


def _word_ids(tokens: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w, 0) for w in tokens), dtype=np.uint64, count=len(tokens))


class Index:
    """Template windows of one block of items, small enough to ship to every task."""

    def __init__(self, items: pd.DataFrame, names: set[str], span: int, ordinary: Set[str] = frozenset()):
        self.span, self.ordinary, self.vocabulary, rows = span, ordinary, {}, []
        codes: dict[str, int] = {_NUM: 1, _UNIT: 2, _NAME: 3}
        # Odd multipliers spread small codes over 64 bits; 0 stands for words that no item has.
        spread = lambda code: np.uint64((code * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        self.number, self.unit, self.name = spread(1), spread(2), spread(3)
        places: list[tuple[int, ...]] = []
        for w in NUMBERS:
            self.vocabulary[w] = int(self.number)
        for item, text in zip(items["item"], items["text"], strict=True):
            tokens = words(text)
            for w in tokens:
                self.vocabulary[w] = int(spread(codes.setdefault(_template(w, names), len(codes) + 1)))
            plain = _word_ids(tokens, self.vocabulary)
            ids = _counted(plain, self.number, self.unit)
            named, first = ids == self.name, plain == self.name
            for at, h in enumerate(_rolled(plain, ids, span).tolist()):
                rows.append((item, h, " ".join(tokens[at : at + span])))
                places.append(tuple(([0] if first[at] else []) + (np.flatnonzero(named[at + 1 : at + span]) + 1).tolist()))
        self.windows = pd.DataFrame(rows, columns=["item_id", "_hash", "_item_words"])
        self.windows["_hash"] = self.windows["_hash"].astype("uint64").to_numpy().view("int64")
        #: Hashes by the places of names in their windows: what stands there in a document is free.
        self.hashes: dict[tuple[int, ...], np.ndarray] = {}
        for p, group in self.windows["_hash"].groupby(pd.Series(places, index=self.windows.index, dtype="object")):
            self.hashes[p] = np.unique(group.to_numpy())
        powers = [1]
        for _ in range(span - 1):
            powers.append(powers[-1] * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
        self.powers = np.array(powers[::-1], dtype=np.uint64)

    def _matches(self, plain: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, tuple[int, ...]]]:
        """Start, hash and free places of every window that some item has; ``starts`` are the places where a window may start."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        missing = unknown[starts + self.span] - unknown[starts + 1] + (plain[starts] == 0)
        most = max(map(len, self.hashes))
        starts, missing = starts[missing <= most], missing[missing <= most]
        whole = _rolled(plain, ids, self.span)[starts]
        out = []
        with np.errstate(over="ignore"):
            for free, hashes in self.hashes.items():
                h, left = whole.copy(), missing.copy()
                for k in free:
                    there = (plain if k == 0 else ids)[starts + k]
                    h += (self.name - there) * self.powers[k]
                    left -= there == 0
                at = np.flatnonzero(left == 0)
                h = h[at].view(np.int64)
                pos = np.searchsorted(hashes, h)
                pos[pos == len(hashes)] = 0
                hit = np.flatnonzero(hashes[pos] == h)
                out += [(i, v, free) for i, v in zip(starts[at[hit]].tolist(), h[hit].tolist(), strict=True)]
        return out

    def scan(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows of documents whose template hash some item has."""
        for batch in batches:
            keys, hashes, found = [], [], []
            group, size = [], 0

            def flush() -> None:
                plain, ids = np.concatenate([g[2] for g in group]), np.concatenate([g[4] for g in group])
                ends = np.cumsum([len(g[2]) for g in group])
                firsts = ends - [len(g[2]) for g in group]
                starts = np.concatenate([np.arange(a, b - self.span + 1) for a, b in zip(firsts, ends, strict=True)])
                capitals: dict[int, list[bool]] = {}
                for at, h, free in self._matches(plain, ids, starts):
                    n = int(np.searchsorted(ends, at, side="right"))
                    key, text, _, tokens, _ = group[n]
                    first = at - int(firsts[n])
                    window = tokens[first : first + self.span]
                    # A word that any item, of this block or not, uses as no name is one where the document writes it with a capital.
                    for k in free:
                        if _number(window[k]) or (k and ids[at + k] == self.unit):
                            break
                        if window[k] in self.ordinary:
                            if n not in capitals:
                                capitals[n] = _capitals(text, tokens)
                            if not capitals[n][first + k]:
                                break
                    else:
                        keys.append(key)
                        hashes.append(h)
                        found.append(" ".join(window))

            for key, text in zip(batch["_key"], batch["_text"], strict=True):
                tokens = words(text)
                if len(tokens) < self.span:
                    continue
                ids = _word_ids(tokens, self.vocabulary)
                for i in np.flatnonzero(ids == 0).tolist():
                    if tokens[i].isdigit():
                        ids[i] = self.number
                group.append((key, text, ids, tokens, _counted(ids, self.number, self.unit)))
                size += len(tokens)
                if size > 100_000:
                    flush()
                    group, size = [], 0
            if group:
                flush()
            yield pd.DataFrame({"_key": pd.Series(keys, dtype=batch["_key"].dtype if batch["_key"].dtype.kind == "i" else "object"), "_hash": pd.Series(hashes, dtype="int64"), "_doc_words": pd.Series(found, dtype="object")})


def leaked_windows(documents: DataFrame, doc: Column, text: Column, items: DataFrame, item: Column, item_text: Column, span: int = 10, block: int = 200_000) -> DataFrame:
    """``doc_id, item_id, verbatim, pairs``: one row per document, item and matching template window of ``span`` words.

    ``verbatim`` tells that all words agree; otherwise ``pairs`` lists the slots that differ as item word, document word. Null and
    short texts match nothing; repeated documents repeat their rows; texts are read whole. Items are indexed in blocks of about
    ``block`` words, so what travels to the tasks is bounded by words, a few dozen megabytes, or one item if that is longer; documents are
    scanned once per block (a benchmark of 300 items is one). What matches does not depend on the blocks. Filtering documents by the
    hashes of the few items where they lie moves nothing but hits; a shuffle of all windows of the corpus would move ten times its size.
    """
    spark = documents.sparkSession
    docs = documents.select(doc.alias("_key"), text.alias("_text")).where("_text is not null")
    stated = items.select(item.alias("item"), item_text.alias("text")).where("text is not null").orderBy("item")
    # Over all items, so that what is a name does not depend on the blocks; kept are words, not texts.
    upper, lower, ordinary = set(), set(), set()
    for row in stated.toLocalIterator():
        for total, part in zip((upper, lower), _cases([row["text"]]), strict=True):
            total |= part
        ordinary.update(words(row["text"]))
    names = upper - lower
    ordinary -= names
    out = None
    pending: list = []
    held = 0

    def add(rows: list) -> None:
        nonlocal out
        frame = pd.DataFrame([(r["item"], r["text"]) for r in rows], columns=["item", "text"])
        index = Index(frame, names, span, ordinary)
        if index.windows.empty:
            return
        windows = spark.createDataFrame(index.windows, "item_id long, _hash long, _item_words string")
        hits = docs.mapInPandas(index.scan, f"_key {dict(docs.dtypes)['_key']}, _hash long, _doc_words string")
        # One row per window text: copies within a document meet on the map side.
        found = hits.distinct().join(F.broadcast(windows), "_hash")
        out = found if out is None else out.unionByName(found)

    for row in stated.toLocalIterator():
        size = len(words(row["text"]))
        if pending and held + size > block:
            add(pending)
            pending, held = [], 0
        pending.append(row)
        held += size
    if pending:
        add(pending)
    if out is None:
        out = docs.select("_key", F.lit(0).cast("long").alias("item_id"), F.lit("").alias("_doc_words"), F.lit("").alias("_item_words")).limit(0)
    zipped = F.arrays_zip(F.split("_item_words", " ").alias("a"), F.split("_doc_words", " ").alias("b"))
    return out.select(F.col("_key").alias("doc_id"), "item_id", (F.col("_doc_words") == F.col("_item_words")).alias("verbatim"), F.filter(zipped, lambda p: p["a"] != p["b"]).alias("pairs"))


def leak_report(windows: DataFrame) -> DataFrame:
    """``doc_id, item_id, verbatim_windows, changed_windows, consistent`` per document and item.

    ``consistent``: every changed slot value of the item has one value in the document throughout, as when a question was re-parameterised.
    """
    counts = windows.groupBy("doc_id", "item_id").agg(F.count_if("verbatim").alias("verbatim_windows"), F.count_if(~F.col("verbatim")).alias("changed_windows"))
    slots = windows.where("not verbatim").select("doc_id", "item_id", F.explode("pairs").alias("p")).select("doc_id", "item_id", "p.a", "p.b").distinct()
    clashes = slots.groupBy("doc_id", "item_id", "a").count().where("count > 1").select("doc_id", "item_id").distinct().withColumn("_clash", F.lit(True))
    return counts.join(clashes, ["doc_id", "item_id"], "left").select("doc_id", "item_id", "verbatim_windows", "changed_windows", F.col("_clash").isNull().alias("consistent"))
