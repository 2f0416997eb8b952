"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the words around each hit.

The lexicon is a trie of terms and of stems, which any ending may follow. A word is matched with all its terms at once by running the
intersection of the trie with the terms' Levenshtein automata: a state is a set of (node of the trie, edits spent), and states are
made deterministic when they are first reached. Most words leave the automaton after a few letters. How many edits a term allows
depends on its length; stems allow none.

Each hit is judged by its window: quotation marks around it and words of reporting speak for quotation, words of address, further
hits and exclamation marks for abuse. A document's hits, by edits and by kind of window, are the features of a logistic regression,
pulled towards stated priors where the labelled rows say nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shared import keep, small_batches

#: Labelled documents that lexicon and weights are learned from at most: those with the lowest hashes of their ids.
SAMPLE_ROWS = 10_000
#: Terms, and stems, learned from labelled documents at most.
LEARNED_TERMS = 200
#: Letters of a learned stem; a document must hold it twice to count.
STEM_LETTERS = (4, 5, 6, 7, 8)
#: Words before and after a hit that are its window.
WINDOW = 8
#: Deterministic states and seen words a worker remembers; beyond that it forgets them and starts again.
REMEMBERED = 400_000

# fixed values: insults that are looked for whatever the labelled rows hold
TERMS = (
    "asshole", "bastard", "bitch", "clown", "coward", "crap", "creep", "cretin", "cunt", "degenerate", "despicable", "dimwit",
    "dipshit", "disgusting", "douchebag", "dumbass", "dumbest", "filthy", "fuck", "fucker", "fucking", "garbage", "halfwit",
    "idiot", "idiotic", "imbecile", "jackass", "jerk", "loser", "lowlife", "lunatic", "maggot", "moron", "moronic", "motherfucker",
    "nitwit", "parasite", "pathetic", "pervert", "pig", "psycho", "repulsive", "retard", "scum", "scumbag", "shit", "shithead",
    "sicko", "simpleton", "slut", "stupid", "trash", "vermin", "vile", "whore", "wimp", "worthless",
)
# fixed values: words that report what others said, or speak of words
REPORTING = frozenset(
    "said says saying called calls calling wrote writes quoted quote quotes quoting cited term terms word words phrase insult insults "
    "slur slurs meaning means defined definition reported allegedly described dictionary synonym lyrics title titled".split()
)
# fixed values: words that address somebody
ADDRESS = frozenset("you your youre yours yourself u ur he she they hes shes theyre him her them his their everyone such".split())
_OPEN, _CLOSE = "\"'“”„«‘‹`", "\"'”“»’›`"
_LEET = str.maketrans("013457@$!", "oieastasi")

_TOKEN = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")

EXACT, NEAR, FAR, STEM = 0, 1, 2, 3
PLAIN, DIRECTED, REPORTED, QUOTED = 0, 1, 2, 3
#: Features: for edits and kinds of window, the logarithm of how many hits there are; exact hits per word; different exact terms;
#: of stems whether there are two or three hits, and the logarithm of their number.
FEATURES = 17
# fixed values: where weights are pulled to; an exact hit speaks for abuse, a quoted or reported one hardly
PRIOR = np.array([2.5, 2.8, 0.8, 0.2, 0.8, 1.2, 0.2, 0.0, 0.3, 0.6, 0.0, 0.0, 0.5, 1.0, 0.5, 1.5, 0.5])
PRIOR_BIAS = -3.0


def allowed_edits(term: str) -> int:
    """Edits within which a word is taken for a misspelt term."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """The trie over terms and its lazily determinised intersection with their Levenshtein automata."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = ()) -> None:
        self.terms, self.stems = sorted(set(terms)), sorted(set(stems))
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.room: list[int] = [0]  # most edits of any term below a node
        for term, is_stem in [(t, False) for t in self.terms] + [(t, True) for t in self.stems]:
            node, edits = 0, 0 if is_stem else allowed_edits(term)
            self.room[0] = max(self.room[0], edits)
            for letter in term:
                child = self.next[node].get(letter)
                if child is None:
                    child = len(self.next)
                    self.next[node][letter] = child
                    self.next.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.room.append(0)
                node = child
                self.room[node] = max(self.room[node], edits)
            (self.stem if is_stem else self.term)[node] = term
        self.alphabet = {letter for step in self.next for letter in step}
        self._forget()

    def __getstate__(self):
        return self.terms, self.stems

    def __setstate__(self, lists) -> None:
        self.__init__(*lists)

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.found: list[tuple[str, int] | None] = []
        self.begun: list[str | None] = []  # the stem that a state is at the end of
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.seen: dict[str, tuple[str, int] | None] = {}
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of the least edits per node, after letters of terms that the word leaves out; -1 is the dead state."""
        waiting = list(reached.items())
        while waiting:
            node, edits = waiting.pop()
            if reached[node] < edits:
                continue
            for child in self.next[node].values():
                if edits + 1 <= self.room[child] and reached.get(child, 99) > edits + 1:
                    reached[child] = edits + 1
                    waiting.append((child, edits + 1))
        if not reached:
            return -1
        key = frozenset(reached.items())
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(edits, self.term[node]) for node, edits in reached.items() if self.term[node] is not None and edits <= allowed_edits(self.term[node])]
            self.found.append((min(ends)[1], min(ends)[0]) if ends else None)
            stems = [self.stem[node] for node, edits in reached.items() if not edits and self.stem[node] is not None]
            self.begun.append(stems[0] if stems else None)
        return number

    def _move(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.sets[state]:
            if edits + 1 <= self.room[node]:  # a letter too many
                reached[node] = min(reached.get(node, 99), edits + 1)
            for own, child in self.next[node].items():
                cost = edits + (own != letter)
                if cost <= self.room[child] and cost < reached.get(child, 99):
                    reached[child] = cost
        return self._state(reached)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, the first of equally near ones; None where none is within its edits. A word that
        isn't a term but begins with a stem is (the longest stem, STEM)."""
        state, begun = self.start, None
        moves, alphabet = self.moves, self.alphabet
        for letter in word:
            if letter not in alphabet:
                letter = ""
            after = moves[state].get(letter)
            if after is None:
                after = moves[state][letter] = self._move(state, letter)
            if after < 0:
                return begun
            state = after
            if self.begun[state] is not None:
                begun = (self.begun[state], STEM)
        found = self.found[state]
        return begun if found is None or (found[1] and begun) else found

    def look_up(self, token: str) -> tuple[str, int] | None:
        """The match of a token as it is written in a text; digits and signs that stand for letters are read as these."""
        try:
            return self.seen[token]
        except KeyError:
            pass
        if len(self.seen) >= REMEMBERED or len(self.sets) >= REMEMBERED:
            self._forget()
        word = token.lower()
        found = self.match(word)
        if (found is None or found[1]) and not word.isalpha() and not word.isdigit():
            spelt = self.match(word.translate(_LEET))
            if spelt is not None and (found is None or spelt[1] < found[1]):
                found = spelt
        self.seen[token] = found
        return found


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    #: Words near a term that clean labelled documents use: words of their own, not misspellings.
    ordinary: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS


def _window_kind(text: str, tokens: Sequence[str], spans: Sequence[tuple[int, int]], at: int) -> int:
    start, end = spans[at]
    low, high = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
    left = text[spans[low][0] : start]
    right = text[end : spans[high - 1][1]]
    before = any(mark in left for mark in _OPEN if not mark == "'") or (left[-1:] == "'")
    after = any(mark in right for mark in _CLOSE if not mark == "'") or (right[:1] == "'")
    if before and after:
        return QUOTED
    near = {tokens[k].lower().replace("'", "") for k in range(low, high) if k != at}
    if near & REPORTING:
        return REPORTED
    return DIRECTED if near & ADDRESS or right[:2] == "!!" else PLAIN


def find_hits(text: str, model: ToxicityModel) -> list[tuple[int, int, str, int, int]]:
    """(start, end, term, edits, kind of window) of every hit of a whole text, in order."""
    look_up, ordinary = model.lexicon.look_up, model.ordinary
    hits = {t: found for t in set(_TOKEN.findall(text)) if (found := look_up(t)) is not None and not (found[1] in (NEAR, FAR) and t.lower() in ordinary)}
    if not hits:
        return []
    places = list(_TOKEN.finditer(text))
    tokens, spans = [m.group() for m in places], [m.span() for m in places]
    return [(*spans[k], *hits[t], _window_kind(text, tokens, spans, k)) for k, t in enumerate(tokens) if t in hits]


def features(text: str | None, model: ToxicityModel) -> np.ndarray:
    found = np.zeros(FEATURES)
    hits = find_hits(text, model) if text else []
    if hits:
        for _, _, _, edits, kind in hits:
            found[16 if edits == STEM else 4 * edits + kind] += 1
        exact = found[[PLAIN, DIRECTED]].sum()
        words = max(1, text.count(" ") + 1)
        found[:12] = np.log1p(found[:12])
        found[12] = min(1.0, 100 * exact / words)
        found[13] = np.log1p(len({h[2] for h in hits if not h[3] and h[4] < REPORTED}))
        found[14], found[15], found[16] = found[16] >= 2, found[16] >= 3, np.log1p(found[16])
    return found


def score(rows: np.ndarray, model: ToxicityModel) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ model.weights + model.bias, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, model: ToxicityModel, pull: float = 2.0, steps: int = 50) -> ToxicityModel:
    """Weights of the regression by Newton steps, pulled towards the prior. Without rows, or with one class, they are the prior."""
    if len(labels) == 0 or labels.min() == labels.max():
        return ToxicityModel(model.lexicon, model.ordinary)
    x = np.hstack([rows, np.ones((len(rows), 1))])
    centre = np.append(PRIOR, PRIOR_BIAS)
    w = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + pull * (w - centre)
        bend = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(bend, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(model.lexicon, model.ordinary, w[:-1], float(w[-1]))


def _sample(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str) -> DataFrame:
    """(id, text, y) of at most SAMPLE_ROWS different ids, those with the lowest hashes. The ids are chosen from the labels alone; they
    are few, so they are broadcast and no other text leaves its place. An id that repeats is one row, with its greatest label and the
    greatest of its texts."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    ids = known.groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return rows.groupBy("id", "y").agg(F.max("text").alias("text"))


def learn_toxicity(docs: DataFrame, label: str, labels: DataFrame | None = None, id_column: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learns terms and weights from rows with text and a 0/1 label, which ``labels`` gives by id where it isn't a column of ``docs``;
    rows without label or id are left out.

    Words, and stems that a document holds twice, which toxic documents of the sample have at least 20 times as often as clean ones
    join the fixed terms, LEARNED_TERMS of each at most. To the driver come these, the ordinary words near a term, and FEATURES numbers a
    document of the sample.
    """
    rows = small_batches(keep(_sample(docs, docs if labels is None else labels, label, id_column, text), "labelled"))
    single = rows.select("id", "y", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,24})"), F.lit(1)).alias("words"))
    bad, all_rows = single.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).collect()[0]

    def telling(found: DataFrame, column: str) -> list[tuple[str, int]]:
        counts = found.groupBy(column).agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
        odds = (F.col("toxic") / max(1, bad)) / ((F.col("clean") + 1) / max(1, all_rows - bad))
        counts = counts.filter((F.col("toxic") >= max(5, bad // 25)) & (odds >= 20)).orderBy(F.col("toxic").desc(), F.length(column).desc(), column)
        return [(r[0], r[1]) for r in counts.limit(10 * LEARNED_TERMS).collect()]

    learned = dict(telling(single.select("y", F.explode(F.array_distinct("words")).alias("word")), "word"))
    starts = F.filter(F.flatten(F.transform("words", lambda w: F.array(*[F.when(F.length(w) >= n, F.left(w, F.lit(n))) for n in STEM_LETTERS]))), lambda w: w.isNotNull())
    twice = single.select("id", "y", F.explode(starts).alias("stem")).groupBy("id", "y", "stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    stems: list[str] = []
    for stem, toxic in telling(twice, "stem"):
        # a stem that is the beginning of one word only is that word
        if any(w.startswith(stem) and (w in TERMS or learned[w] >= toxic) for w in [*TERMS, *learned]):
            continue
        if not any(stem.startswith(s) or s.startswith(stem) for s in stems) and len(stems) < LEARNED_TERMS:
            stems.append(stem)
    terms = [w for w in learned if not any(w.startswith(s) for s in stems)][:LEARNED_TERMS]
    model = ToxicityModel(Lexicon([*TERMS, *terms], stems))
    half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")

    def near_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for side, value in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = set(_TOKEN.findall(value))
                found.update((t.lower(), side) for t in tokens if (hit := model.lexicon.look_up(t)) is not None and hit[1] in (NEAR, FAR))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([h for _, h in pairs], pa.int32())], ["word", "half"])

    clean = rows.filter("y = 0").select("text", half.alias("half")).mapInArrow(near_words, "word string, half int").distinct()
    near = clean.orderBy(F.xxhash64("word"), "word", "half").limit(10 * SAMPLE_ROWS).collect()
    # a document of the fit must not be judged by ordinary words that it supplied itself: each half has those of the other
    sides = [ToxicityModel(model.lexicon, frozenset(r.word for r in near if r.half != side)) for side in (0, 1)]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t, sides[h]).tolist() for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(values, pa.list_(pa.float64()))], ["id", "y", "x"])

    kind = dict(rows.dtypes)["id"]
    measured = rows.select("id", "y", "text", half.alias("half")).mapInArrow(measure, f"id {kind}, y int, x array<double>")
    measured = measured.select("y", "x").toPandas()
    measured = sorted(zip(measured["y"], (tuple(x) for x in measured["x"]), strict=True))  # the order of tasks must not matter
    found = np.array([x for _, x in measured]).reshape(-1, FEATURES)
    model.ordinary = frozenset(r.word for r in near)
    return fit(found, np.array([y for y, _ in measured], float), model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, hits): the probability that a text is toxic, and its hits as (start, end, term, edits, window), over whole
    texts of any length. Places count code points, end exclusive; window is plain, directed, reported or quoted; a stem's term ends
    in an asterisk.

    NULL and empty texts have no hit and the score of such; repeated rows are scored alike. Only the id and the text are read, so
    other columns may have any names. An empty table gives an empty table. One pass, no shuffle.
    """
    rows = small_batches(docs).select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the terms and ordinary words above
    kinds = ("plain", "directed", "reported", "quoted")
    hit_type = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("window", pa.string())])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            measured, hits = [], []
            for value in batch.column("text"):
                value = value.as_py()
                found = find_hits(value, own)
                shown = [(*h[:2], h[2] + "*", 0, kinds[h[4]]) if h[3] == STEM else (*h[:4], kinds[h[4]]) for h in found]
                hits.append([dict(zip(("start", "end", "term", "edits", "window"), h, strict=True)) for h in shown])
                measured.append(features(value, own) if found else np.zeros(FEATURES))
            scores = score(np.array(measured).reshape(-1, FEATURES), own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array(hits, pa.list_(hit_type))], ["id", "score", "hits"])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, score double, hits array<struct<start: bigint, `end`: bigint, term: string, edits: int, `window`: string>>"
    return rows.mapInArrow(judge, schema).withColumnRenamed("id", id_column)
