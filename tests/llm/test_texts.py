"""Leakage, residue, personal data and mixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import held_out as held_out_texts
from threadloom.llm import pii, pii_seeds
from threadloom.llm.leakage import Index, item_names, leak_report, leaked_windows, words
from threadloom.llm.mixture import mix, mixed_shares, position, source_name
from threadloom.llm.queries_text import TOKENIZER
from threadloom.llm.residue import ResidueModel, residue, without_residue

ITEM = "The patient baker from Leeds waits forty minutes before she paints seven bicycles at dawn and tells nobody"


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_key", F.lit(1)).withColumn("item_id", F.lit("clash"))
    rows = spark.createDataFrame(items, "item_id long, text string")
    return leaked_windows(docs, F.col("doc_id"), F.col("text"), rows, F.col("item_id"), F.col("text"))


def test_words():
    assert words("<p>It&nbsp;isn't 5 &lt; 6 <br/>über-GUT</p> a < b") == ["it", "isn", "t", "5", "6", "über", "gut", "a", "b"]
    assert words(None) == [] and words("") == []


def test_verbatim_and_changed(spark):
    w = ITEM.split()
    texts = [
        "xx " + ITEM.upper() + " yy", " ".join(w[:10]), " ".join(w[:9]) + " stop", "<b>" + "</b> <i>".join(w[3:14]) + "</i>", None, "", "x " * 30000 + " ".join(w[2:12]),
        ITEM.replace("forty", "90").replace("seven", "12"), ITEM.replace("waits", "boats").replace("dawn", "dusk"), "99 " + " ".join(w[5:15]),
    ]
    got = leaks(spark, texts, [(1, ITEM), (2, "too short an item"), (3, None), (4, ITEM)])
    assert {(x.doc_id, x.item_id) for x in got.where("verbatim").collect()} == {(d, i) for d in (0, 1, 3, 6, 9) for i in (1, 4)}
    report = {(x.doc_id, x.item_id): x for x in leak_report(got).collect()}
    assert report[(7, 1)].verbatim_windows == 0 and report[(7, 1)].changed_windows > 0 and report[(7, 1)].consistent
    assert (8, 1) not in report


def test_blocks_and_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM) for i in range(5)], "item_id long, text string")
    args = (docs, F.col("doc_id"), F.col("text"))
    assert leaked_windows(*args, items, F.col("item_id"), F.col("text"), block=40).select("item_id").distinct().count() == 5
    assert leaked_windows(*args, items.limit(0), F.col("item_id"), F.col("text")).count() == 0
    assert leaked_windows(docs.limit(0), F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text")).count() == 0


def test_names_are_slots():
    import pandas as pd

    assert item_names(["we met Anna in town", "then Anna left", "Once upon"]) == {"anna"}
    index = Index(pd.DataFrame({"item": [1], "text": [ITEM]}), {"leeds"}, 10)
    assert index.vocabulary["forty"] == index.vocabulary["seven"] and index.vocabulary["leeds"] != index.vocabulary["baker"]


def test_forgotten_tokens_change_no_scores():
    free, bound = pii.Crf(), pii.Crf()
    free.weights[:] = bound.weights[:] = np.random.default_rng(1).random(free.weights.shape[1:], dtype=np.float32)
    bound.most = 5
    for k in range(3):
        texts = [[f" w{k}{i}{j}" for j in range(4)] for i in range(6)]
        assert np.array_equal(free.emissions(texts)[0], bound.emissions(texts)[0])
    assert len(bound.ids) == 24


def test_names_that_no_item_has(spark):
    # The first place is a name of the items, the others are not; "rose" is a word of the items, numbers and units are no names.
    others = ["Leeds", "Bristol", "bristol", "Rose", "rose", "ninety", "42", "minutes"]
    texts = [ITEM.replace("Leeds", w) for w in others] + [ITEM.replace("Leeds", "Bristol").replace("forty", "90")]
    for block in (1, 200_000):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        items = spark.createDataFrame([(1, ITEM), (2, "the rose grows"), (3, "we met in LEEDS, then left Leeds")], "item_id long, text string")
        got = leaked_windows(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"), block=block)
        # Windows without the place of the name agree word by word; those with it are the first five.
        whole = {x.doc_id: (x.verbatim_windows, x.changed_windows, x.consistent) for x in leak_report(got).collect()}
        n = len(ITEM.split()) - 9
        assert whole[0] == (n, 0, True)
        with_name = whole[1][1]
        assert with_name == 5 and whole[1] == (n - 5, 5, True) and whole[2] == whole[1]
        assert all(whole[d][1] == 0 and whole[d][0] == n - 5 for d in (5, 6, 7))
        assert whole[3] == whole[1] and whole[4] == (n - 5, 0, True)
        assert whole[8][1] > 5 and whole[8][2]


def test_changed_number_name_and_unit_match_in_every_window(spark):
    changes = {"forty": "3", "seven": "eighty", "Leeds": "Oslo", "minutes": "fortnights", "bicycles": "kayaks"}
    texts = [ITEM.replace(a, b) for a, b in changes.items()]
    everything = ITEM
    for a, b in changes.items():
        everything = everything.replace(a, b)
    docs = spark.createDataFrame(list(enumerate([*texts, everything])), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "we met in LEEDS, then left Leeds")], "item_id long, text string")
    got = {x.doc_id: (x.verbatim_windows + x.changed_windows, x.consistent) for x in leak_report(leaked_windows(docs, F.col("doc_id"), F.col("text"), items, F.col("item_id"), F.col("text"))).collect()}
    # The window that starts with the unit does not hold its number, so there the unit is a plain word.
    n = len(ITEM.split()) - 9
    assert got == {i: (n - (i in (3, 5)), True) for i in range(6)}


REAL = [
    "Your mail greeted me as {{first_name}}, please fix the greeting. The queue is fine now.", "Contact on file: [EMAIL], [PHONE]; a refund was sent to [CUSTOMER].", "Someone wrote lorem ipsum into the playlist title, funny.",
    "I get a 404 on the voucher link from your mail, what now?", "The web player told me to enable JavaScript, which I had, and the queue still shows an empty page.", "<p>The radio works.</p> 3 < 5 and #1 of 20 at 50% [sic: shortened]", "",
    "C> We restarted it twice.\nA> Thank you, the case is closed.",
]
BLANKS = ["Hello {{first_name}}, your plan ends soon.", "It renews on *|DATE|*", "Dear [INSERT NAME], thanks.", "Total: ${amount}.", "Regards, <%= agent %>", "See %(link)s", "Ask XX_NAME_XX about it", "Hi <customer>, we refunded it.", "Your reference is _______ (number)"]
FILLERS = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "The plan was moved.\n\nLorem ipsum velit magnos sinto labor cupid animi noster tempora modus sitar ulma fugit.", "Your text goes here. Your text goes here.", "blah blah blah blah blah blah", "xxxx xxxx xxxx xxxx xxxx xxxx"]
PAGES = ["404 Not Found\nThe page could not be located.", "Please enable JavaScript to continue.", "Home | Help | Sign in\nService unavailable. Please come back later.\nPrivacy  Terms  Imprint", "Seite nicht gefunden. Der Link ist veraltet (404).", "JavaScript is turned off in your browser.", "Es necesario activar los scripts del navegador."]


def test_residue_kinds():
    m = ResidueModel()
    assert [t for t in REAL if any(m.kinds(t))] == []
    assert [t for t in BLANKS if not m.kinds(t)[0]] == []
    assert [t for t in FILLERS if not m.kinds(t)[1]] == []
    assert [t for t in PAGES if not m.kinds(t)[2]] == []


def test_residue_on_held_out_texts():
    m = ResidueModel()
    for texts, k in ((held_out_texts.PAGES + held_out_texts.LATER_PAGES, 2), (held_out_texts.BLANKS, 0), (held_out_texts.FILLER, 1)):
        missed = [t for t in texts if not m.kinds(t)[k]]
        assert len(missed) <= 0.1 * len(texts), missed
    real = held_out_texts.REAL + held_out_texts.LATER_REAL + held_out_texts.QUOTED
    marked = [t for t in real if any(m.kinds(t))]
    assert len(marked) <= 0.05 * len(real), marked


def test_a_batch_decides_as_single_texts_do():
    m = ResidueModel()
    texts = REAL + BLANKS + FILLERS + PAGES + ["", " ", "x"] + held_out_texts.PAGES
    for got, k in zip(m.batch(texts), range(3), strict=True):
        assert got.tolist() == [m.kinds(t)[k] for t in texts]


def test_residue_tables(spark):
    rows = list(enumerate(REAL + [None, " ", "a" * 300000] + BLANKS + FILLERS + PAGES))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("has_blank", F.lit("clash")).withColumn("_text", F.lit(3))
    found = {x.doc_id for x in residue(df, F.col("doc_id"), F.col("text")).collect()}
    first = len(REAL) + 3
    assert found - {len(REAL) + 2} == set(range(first, len(rows)))
    kept = without_residue(df, "doc_id", "text")
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - found and kept.columns == df.columns
    assert residue(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def held_out(n):
    out = []
    for pieces in pii_seeds.labelled(n, seed=99):
        out.append(("".join(p for p, _ in pieces), {k for _, k in pieces if k}))
    return out


def test_personal_data_held_out_accuracy():
    model = pii.trained()
    data = held_out(600)
    found = [{k for _, _, k in m} for m in pii.find(model, [t for t, _ in data])]
    for kind in pii.KINDS:
        hit = sum(kind in f and kind in t for f, (_, t) in zip(found, data, strict=True))
        recall = hit / sum(kind in t for _, t in data)
        precision = hit / max(1, sum(kind in f for f in found))
        assert recall > 0.93 and precision > 0.93, (kind, recall, precision)


def test_personal_data_of_other_people():
    data = held_out_texts.PERSONAL
    found = [{k for _, _, k in m} for m in pii.find(pii.trained(), [t for t, _ in data])]
    for kind in pii.KINDS:
        hit = sum(kind in f and kind in t for f, (_, t) in zip(found, data, strict=True))
        assert hit >= 0.85 * sum(kind in t for _, t in data) and hit >= 0.9 * sum(kind in f for f in found), kind


def test_personal_data_in_texts_written_later():
    data = held_out_texts.LATER_PERSONAL
    found = [{k for _, _, k in m} for m in pii.find(pii.trained(), [t for t, _ in data])]
    hit = sum(len(f & t) for f, (_, t) in zip(found, data, strict=True))
    assert hit >= 0.8 * sum(len(t) for _, t in data) and hit >= 0.9 * sum(len(f) for f in found)


def test_a_name_like_a_street_is_kept_without_a_number():
    labels = lambda text, words: np.array([0] * (len(pii.tokens_of(text)) - words) + [9] + [10] * (words - 1))
    assert pii.KINDS[4] == "person_name"
    assert pii.spans("ask for Rosa Hill", labels("ask for Rosa Hill", 2)) == [(8, 17, "person_name")]
    assert pii.spans("track 42 Rosa Hill", labels("track 42 Rosa Hill", 2)) == []


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    model = pii.Crf()
    r = np.random.default_rng(1)
    model.weights = r.normal(size=model.weights.shape).astype("float32")
    model.steps = r.normal(size=model.steps.shape).astype("float32")
    texts = [["call", " me"], [" on", "0000", "-"], ["x"], []]
    got = model.decode(texts)
    scores, starts = model.emissions(texts)
    for t, s, y in zip(texts, starts, got, strict=True):
        if not t:
            assert len(y) == 0
            continue
        e = scores[s : s + len(t)]
        best = max(itertools.product(range(pii.LABELS), repeat=len(t)), key=lambda p: e[0][p[0]] + pii._START[p[0]] + sum(e[i][p[i]] + model.steps[p[i - 1], p[i]] + pii._RULES[p[i - 1], p[i]] for i in range(1, len(t))))
        assert tuple(y) == best


def test_personal_data_rows(spark):
    texts = ["my name is Anna Brown, call me on 212-555-0147", None, "", "Case 8356-2293 says solved, it isn't", "write to a.b@mail.example please\n" + "no change. " * 20000, "It's the album 42 Juniper Road by Low Tide Choir"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("_text", F.lit("clash"))
    got = {(x.id, x.kind) for x in pii.personal_data(df, F.col("text")).collect()}
    assert got == {(0, "person_name"), (0, "phone"), (4, "email")}
    clean = {x.id: x.text for x in pii.redacted(df, "text").collect()}
    assert clean[0] == "my name is [NAME], call me on [PHONE]" and clean[1] is None and clean[3] == texts[3] and clean[4].startswith("write to [EMAIL] please\n")
    lists = spark.createDataFrame([(1, ["mail a.b@mail.example", None, "ok"]), (2, None), (3, [])], "id int, texts array<string>")
    assert {x.id: x.texts for x in pii.redacted(lists, "texts").collect()} == {1: ["mail [EMAIL]", None, "ok"], 2: None, 3: []}
    assert pii.personal_data(df.limit(0), F.col("text")).count() == 0


def mixture(spark):
    import os

    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer file")
    r = random.Random(8)
    rows = [(i, r.choice(["Big_Source", "big source", "big-source"]), "word " * r.randint(20, 60)) for i in range(900)] + [(2000 + i, " small ", "word " * 30) for i in range(40)] + [(3000, None, "word"), (3001, "other", "word"), (3002, "small", None), (3003, "small", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash")).withColumn("use", F.lit(0))
    targets = spark.createDataFrame([("big_source", 0.8, 1), ("Small", 0.2, 4), ("absent", 0.5, 2)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mixture_meets_shares(spark):
    docs, targets = mixture(spark)
    got = {x.source: x for x in mixed_shares(docs, targets, TOKENIZER).collect()}
    assert abs(got["small"].actual_share - 0.2) < 0.01 and got["small"].most_uses == 4 and got["big_source"].most_uses == 1
    assert got["absent"].tokens == 0 and got["absent"].actual_share == 0
    rows = mix(docs, targets, TOKENIZER).collect()
    assert [x.position for x in rows] == sorted(x.position for x in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    assert len({(x.doc_id, x.use) for x in rows}) == len(rows)
    early, late = (sum(x.tokens for x in rows if x.source == "small" and lo <= x.position < hi) for lo, hi in ((0, 0.5), (0.5, 1.1)))
    assert late > early


def test_mixture_that_wants_too_much(spark):
    docs, targets = mixture(spark)
    got = {x.source: x for x in mixed_shares(docs, targets, TOKENIZER, total_tokens=10**9).collect()}
    assert got["small"].most_uses == 4 and got["small"].documents == 40 and got["big_source"].documents == 900
    assert mix(docs.limit(0), targets, TOKENIZER).count() == 0 and mix(docs, targets.limit(0), TOKENIZER).count() == 0


def test_a_stated_schedule_is_followed(spark):
    docs, targets = mixture(spark)
    rows = mix(docs, targets, TOKENIZER, slopes={"small": -1.0}).where("source = 'small'").collect()
    early, late = (sum(x.tokens for x in rows if lo <= x.position < hi) for lo, hi in ((0, 0.5), (0.5, 1.1)))
    assert abs(early / (early + late) - 0.75) < 0.03
    with pytest.raises(ValueError):
        mix(docs, targets, TOKENIZER, slopes={"small": 2.0})


def test_positions_invert_the_schedule(spark):
    for slope in (0.0, 0.5, -0.7):
        df = spark.createDataFrame([(float(d),) for d in range(0, 101, 10)], "d double").select("d", position(F.col("d"), F.lit(100.0), F.lit(slope)).alias("t"))
        for x in df.collect():
            assert abs(100 * (x.t + slope * (x.t**2 - x.t)) - x.d) < 1e-6
    assert [r[0] for r in spark.createDataFrame([("Support - Threads ",), (" ",)], "s string").select(source_name(F.col("s"))).collect()] == ["support_threads", None]
