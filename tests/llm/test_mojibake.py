import random
from itertools import product
from math import prod

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mojibake as M

LINES = {
    "fr": ["La boulangère a rêvé d’une crème brûlée…", "Très bien, l’élève protège le théâtre!", "Où est le gâteau caché derrière l’hôtel?", "« Ça va déjà » — il a reçu neuf pièces."],
    "ru": ["Высокий человек потерял чужой чемодан.", "Моя сестра услышала старую машину!", "Капитан закрыл окно перед рассветом…", "Никто здесь не забыл письмо."],
    "pl": ["Najwyższy sąsiad ukrył książkę w piwnicy.", "Strażnik naprawił górne okno…", "Cała wieś zgubiła niebieską latarnię.", "Piekarka przyniosła zły kufer."],
    "el": ["Ο φύλακας άκουσε τον χάρτη πριν την αυγή.", "Κανείς πούλησε το ποδήλατο!", "Ο φούρναρης έκαψε το εισιτήριο."],
}
CHAINS = {"fr": [("cp1252", "utf_8"), ("latin_1", "utf_8"), ("cp437", "utf_8"), ("mac_roman", "cp1252"), ("cp1252", "utf_8", "cp1252", "utf_8")], "ru": [("cp1251", "utf_8"), ("cp1252", "cp1251"), ("koi8_r", "cp1251")], "pl": [("cp1252", "cp1250"), ("cp1252", "utf_8")], "el": [("cp1252", "cp1253"), ("cp437", "utf_8")]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    rows, truth = [], {}
    for i in range(1200):
        lang = rng.choice(list(LINES))
        lines = [rng.choice(LINES[lang]) for _ in range(6)]
        clean = "\n".join(lines)
        if i % 25 == 3:
            chain = rng.choice(CHAINS[lang])
            some = range(6) if rng.random() < 0.5 else rng.sample(range(6), 2)
            bad = [M.garble(x, chain) if j in some else x for j, x in enumerate(lines)]
            if all(x is not None for x in bad):
                truth[i] = clean
                clean = "\n".join(bad)
        rows.append((i, clean))
    rows += [(5000, None), (5001, ""), (5002, "plain ASCII ♪ only?"), (5003, "Personne prot�ge"), (5004, "═══ ™ £30 √2 ★"), (5005, "mot à mot " * 50_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("chain", F.lit("clash")), truth


def test_chains_undo_what_garbles():
    for lang, lines in LINES.items():
        for chain in CHAINS[lang]:
            for line in lines:
                bad = M.garble(line, chain)
                if bad is not None:
                    assert M.apply_chain(bad, chain) == line
    assert M.apply_chain("日本", ("cp1252", "utf_8")) is None and M.garble("日本", ("cp1251", "koi8_r")) is None
    assert M.apply_chain("plain", ("cp1252", "cp1251")) == "plain"


def test_garbled_records_are_found_and_restored(corpus):
    df, truth = corpus
    got = {r.doc_id: r for r in M.find_garbled(df, "doc_id", "text").collect()}
    found = set(got) - {5003}
    assert 5003 in got and got[5003].chain == "lost" and not got[5003].whole
    assert len(found & set(truth)) >= 0.95 * len(truth) and len(found - set(truth)) <= 1
    right = sum(got[i].restored == truth[i] for i in found & set(truth))
    assert right >= 0.9 * len(found & set(truth))


def test_empty_table(corpus):
    df, _ = corpus
    assert M.find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_words_and_scripts():
    assert M.words_beyond_ascii("a\nb é c\tдом\r\nx") == [["é", "дом"]] and M.words_beyond_ascii("abc") == []
    codes, starts = M._codes(["да", "дa", "é"])
    assert list(M._mixed(codes, starts) > 0) == [False, True, False]


def _model(lines):
    codes, _ = M._codes(words := [w for line in lines for w in line.split(" ")])
    model = M.Model()
    _, bc, abc = M._grams(codes)
    real = codes[2:] != 2
    np.add.at(model.uni, codes, 1)
    np.add.at(model.bi, bc[real], 1)
    np.add.at(model.tri, abc[real], 1)
    return model, words


@pytest.mark.parametrize("chain", [("latin_1", "utf_8"), ("latin_1", "utf_8", "latin_1", "utf_8")])
def test_words_with_many_lost_letters_get_their_likeliest_original(chain):
    model, words = _model([x for lang in ("fr", "ru", "el") for x in LINES[lang]])
    scorer = M.Scorer(model)

    def left(text):
        return "".join(c for c in M.garble(text, chain) if not 0x80 <= ord(c) < 0xA0)

    known = {}
    for c in {c for w in words for c in w}:
        known.setdefault(left(c), set()).add(c)
    lost = checked = right = 0
    for word in dict.fromkeys(w for w in words if not w.isascii()):
        got, _ = M._restore_word(scorer, left(word), (*chain, "with losses"))
        options = [sorted(known[left(c)]) for c in word]
        right += got == word
        # never less likely than what was really written, however many letters were lost
        assert left(got) == left(word) and scorer.model.scores([got])[0] >= scorer.model.scores([word])[0] - 1e-3
        lost += sum(len(o) > 1 for o in options) > 2
        if prod(map(len, options)) <= 20_000:
            every = ["".join(x) for x in product(*options)]
            codes, starts = M._codes(every)
            best = (scorer.model.scores(every) - M._mixed(codes, starts)).max()
            codes, starts = M._codes([got])
            assert abs(scorer.model.scores([got])[0] - M._mixed(codes, starts)[0] - best) < 1e-3
            checked += 1
    assert lost >= 10 and checked >= 10 and right > lost


def test_frequent_garbling_and_rare_signs_are_told_apart(spark):
    """A garbled word that occurs often isn't clean for that, and a rare sign isn't garbled because a common one has its byte."""
    rng = random.Random(4)
    rows, truth = [], set()
    for i in range(3000):
        lang = rng.choice(["fr", "ru"])
        lines = [rng.choice(LINES[lang]) for _ in range(5)]
        if lang == "fr" and i % 3 == 0:
            lines.append("Prends « ½ » tasse « ici »" if i % 9 == 0 else "« Oui » « non »")
        if lang == "ru":
            lines.append("[колокол]")
        if i % 25 == 5:
            chain = ("cp1252", "cp1251") if lang == "ru" else ("cp1252", "utf_8")
            lines = [M.garble(x, chain) for x in lines]
            truth.add(i)
        elif i % 25 == 6 and lang == "fr":
            lines.append(M.garble("Une crème", ("cp1252", "utf_8")))
            truth.add(i)
        elif i % 40 == 7:
            lines[0] = "п»ї1"
            truth.add(i)
        elif i % 10 == 8:
            lines[0] = "\ufeff1"
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in M.find_garbled(df, "doc_id", "text", restore=False).collect()} == truth


def test_margin_has_the_fewest_errors():
    table = np.zeros((2, len(M._BINS) + 1))
    at = lambda x: int(np.searchsorted(M._BINS, x))
    table[0, at(-1.0)], table[0, at(4.1)] = 990, 10
    table[1, at(2.1)], table[1, at(30.0)] = 1, 99
    margin, clean, garbled = M._least_errors(table, 0.01)
    assert 4.1 <= margin < 30 and clean == pytest.approx(0) and garbled == pytest.approx(0.01)
    margin, clean, garbled = M._least_errors(table, 0.99)
    assert -1 <= margin < 2.1 and clean == pytest.approx(0.01) and garbled == 0
    assert M._least_errors(table * [[1], [0]], 0.5) == (M.Model.margin, 0.0, 0.0)


def test_prefilters_lose_nothing_that_counts():
    """Chains that ``gains`` doesn't try, tried one by one: none of them is the likeliest of a word that is likelier for it."""
    model, words = _model([x for lang in LINES for x in LINES[lang]])
    chains = [c for lang in CHAINS for c in CHAINS[lang]]
    some = {w for w in words if not w.isascii()}
    some |= {g for w in some for c in chains if (g := M.garble(w, c)) is not None and not g.isascii()}
    some = sorted(some)
    table = M.gains(model, some)
    codes, starts = M._codes(some)
    own = model.scores(some) - M._mixed(codes, starts)
    lost = 0
    for i, w in enumerate(some):
        made = [f for c in M.CHAINS[: len(M.SINGLES) + len(M.MULTIS)] if (f := M.apply_chain(w, c)) is not None and f != w]
        if made:
            codes, starts = M._codes(made)
            best = (model.scores(made) - M._mixed(codes, starts)).max() - own[i]
            lost += best > max(float(table[i].max()), 0.0) + 0.01
    assert lost <= 0.005 * len(some)
