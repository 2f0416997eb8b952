"""Toxicity: the automaton against plain edit distances, windows case by case, learning on small tables."""

import random

import numpy as np
import pytest

from cohortia.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxic int, y int, id long, word string, half int, hits string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, y, 1, 2, "w", 3, "h", 0.5) for i, t, y in rows], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distances():
    dice = random.Random(3)
    terms = ["idiot", "idle", "pathetic", "worthless", "scum", "trash", "trasher", "aaaaaaaa", "été", "disgusting"]
    lexicon = T.Lexicon(terms)
    words = ["", "q", *terms]
    for term in terms * 60:
        letters = list(term)
        for _ in range(dice.randint(0, 3)):
            at = dice.randint(0, len(letters))
            action = dice.random()
            if action < 0.4:
                letters.insert(at, dice.choice("aeiotshé9"))
            elif letters and action < 0.7:
                letters.pop(min(at, len(letters) - 1))
            elif letters:
                letters[min(at, len(letters) - 1)] = dice.choice("aeiotshé9")
        words.append("".join(letters))
    for word in words:
        near = sorted((distance(word, t), t) for t in terms if distance(word, t) <= T.allowed_edits(t))
        assert lexicon.match(word) == ((near[0][1], near[0][0]) if near else None), word


def test_stems_and_spellings():
    lexicon = T.Lexicon(["idiot", "stupid"], ["achlich", "dumm"])
    assert lexicon.look_up("Achlichkeit") == ("achlich", T.STEM) and lexicon.look_up("dumm") == ("dumm", T.STEM)
    assert lexicon.look_up("achlic") is None and lexicon.look_up("1d10t") == ("idiot", 0) and lexicon.look_up("$tup1d"[1:]) == ("stupid", 1)
    assert lexicon.look_up("stupyd") == ("stupid", 1) and lexicon.look_up("12345") is None


def test_forgetting_changes_nothing(monkeypatch):
    words = [f"tras{k}h" for k in range(40)] + ["trash", "idiott"] * 3
    kept = T.Lexicon(["trash", "idiot"])
    expected = [kept.look_up(w) for w in words]
    monkeypatch.setattr(T, "REMEMBERED", 5)
    assert [T.Lexicon(["trash", "idiot"]).look_up(w) for w in words] == expected


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("what a sad day with trash on it", T.PLAIN),
        ("you are trash and nothing else", T.DIRECTED),
        ("trash!! nothing else", T.DIRECTED),
        ("the word trash means rubbish", T.REPORTED),
        ("a sign with “trash” in red", T.QUOTED),
        ("the 'trash' can", T.QUOTED),
        ("don't leave trash it's bad", T.PLAIN),
    ],
)
def test_windows(text, kind):
    model = T.ToxicityModel(T.Lexicon(["trash"]))
    (hit,) = T.find_hits(text, model)
    assert hit[4] == kind and text[hit[0] : hit[1]] == "trash"


def test_quotation_scores_below_abuse():
    model = T.ToxicityModel(T.Lexicon(T.TERMS))
    scores = [float(T.score(T.features(t, model)[None], model)[0]) for t in ("you are an idiot and pathetic", "the “idiot” was called “pathetic” in the report", "a calm text", None, "")]
    assert scores[0] > 0.7 > scores[1] > scores[2] == scores[3] == scores[4]


def corpus():
    dice = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("la", "mo", "ri", "tu", "ne") for b in ("ral", "sem", "dok", "vin")]
    rows = []
    for k in range(400):
        words = list(dice.choice(plain, 60))
        toxic = k % 5 == 0
        if toxic:
            words[10:13] = ["moron", ["zorkfeld", "worthles"][k % 2], "zorkfeld"]
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_learns_terms_and_judges_unseen(spark):
    rows = corpus()
    model = T.learn_toxicity(table(spark, rows[:300]), "toxic")
    assert "zorkfeld" in model.lexicon.terms
    again = T.learn_toxicity(table(spark, rows[299::-1]), "toxic")
    assert again.lexicon.terms == model.lexicon.terms and np.allclose(again.weights, model.weights)
    held = rows[300:] + [(1000, "ral " * 50_000 + "moron zorkfeld stupid trash", 1), (1001, None, 0), (1002, "", 0), (1002, "", 0), (None, "you idiot, pathetic moron", 1)]
    found = T.score_toxicity(table(spark, held), model)
    assert found.columns == ["doc_id", "score", "hits"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(held) and all((by_id[i].score >= 0.7) == bool(y) for i, _, y in held)
    assert by_id[1001].score == by_id[1002].score and by_id[1001].hits == []
    last = by_id[1000].hits[-1]
    assert held[100][1][last.start : last.end] == "trash"


def test_one_text_is_half_of_all_rows_and_odd_labels(spark):
    rows = corpus()[:100]
    model = T.learn_toxicity(table(spark, rows + [(7, "moron moron", 1)] * 100 + [(8, "x", None), (None, "y", 1)]), "toxic")
    assert np.isfinite(model.weights).all()
    for odd in ([], [(1, "fine", 0)], [(1, None, 1), (2, "", 1)]):
        model = T.learn_toxicity(table(spark, odd), "toxic")
        assert np.allclose(model.weights, T.PRIOR)
    assert T.score_toxicity(table(spark, []), model).collect() == []
