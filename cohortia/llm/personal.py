"""Personal data: fixed rules, and a semi-Markov conditional random field that adds what the rules don't reach.

The field works on clusters: runs of digit groups, and names around an at sign in any spelling. A cluster is cut into units, and
every run of up to MOST_UNITS units may be an entity of a type. Features look at the candidate as a whole (digits, shape,
separators, check digits, neighbours). Dynamic programming over the units, with entities of bounded length, chooses
boundaries and types together; the same recursion in sums gives the likelihood it is trained by and each span's
probability. It learns from the spans of the rules on a bounded sample, and from the same values in other spellings.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
#: Units of an entity at most, and characters of a name beside an at sign.
MOST_UNITS, MOST_NAME = 8, 64
#: Sampled documents and clusters the field learns from, at most.
SAMPLE_DOCUMENTS, SAMPLE_CLUSTERS = 4000, 1500
#: An added span needs this probability.
SURE = 0.95

_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match starts inside a run of digits, as the run itself would have been the longer match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _bytes(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """What the rules find, by kind and place; per kind leftmost and without overlaps, dropped where the check fails."""
    found = list(_emails(text))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _bytes(m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


_CLUSTER = re.compile(r"[0-9]++(?:[ ().\-/:+]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@| at |\(at\)|\[at\]")
# a longer label is none, and is not cut
_WORD = re.compile(r"[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-])")
_DOT = re.compile(r" ?(?:\.|\(dot\)|\[dot\])|(?<=\S) dot ")
#: What every cluster and every span of the rules holds.
_TRIGGER = re.compile(r"[0-9@]| at |\(at\)|\[at\]")

#: A cluster: its type of units, and their places; candidates run from the start of a unit to the end of another.
Cluster = tuple[str, list[tuple[int, int]]]


def clusters(text: str) -> list[Cluster]:
    """All clusters with 7 digits or more, and all names before and after an at sign."""
    found: list[Cluster] = []
    for m in _CLUSTER.finditer(text):
        if sum(c.isdigit() for c in m[0]) >= 7:
            found.append(("digits", [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]))
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - MOST_NAME) and text[start - 1] in _NAME:
            start -= 1
        if start and text[start - 1] in _NAME:
            continue  # a longer name is none, and is not cut
        at = m.end()
        units = [(start, m.start())]
        while word := _WORD.match(text, at):
            units.append((at, word.end()))
            dot = _DOT.match(text, word.end())
            if not dot or len(units) > MOST_UNITS:
                break
            at = dot.end() + (text[dot.end() : dot.end() + 1] == " " and dot[0][-1] != " ")
        if start < m.start() and len(units) > 2:
            found.append(("name", units))
    return found


def _outer(text: str, start: int) -> int:
    """A phone number's plus sign or bracket belongs to it."""
    while start > 0 and text[start - 1] in "+(":
        start -= 1
    return start


def features(text: str, cluster: Cluster, i: int, j: int, kind: str) -> list[str] | None:
    """Features of the units i..j as one entity of a kind; None where it can't be one."""
    name, units = cluster
    start, end = units[i][0], units[j][1]
    if name == "name":
        if kind != "email" or i or j < 2:
            return None
        joint = text[units[0][1] : units[1][0]]
        dots = {text[a[1] : b[0]].strip() for a, b in zip(units[1:j], units[2 : j + 1], strict=True)}
        last = text[units[j][0] : end]
        found = [f"at={joint.strip()}", f"end={last.isalpha() and 2 <= len(last) <= 6}", f"whole={j == len(units) - 1}"]
        found += [f"dot={d}" for d in dots] + [f"spelt={joint.strip() == '@'}{dots == {'.'}}"]
        return [f"{kind}:{f}" for f in found] + [f"{kind}:"]
    if kind == "email":
        return None
    inside = text[start:end]
    digits = _digits(inside)
    if not 7 <= len(digits) <= 19:
        return None
    groups = [b - a for a, b in units[i : j + 1]]
    between = [text[a[1] : b[0]] for a, b in zip(units[i:j], units[i + 1 : j + 1], strict=True)]
    outer = _outer(text, start)
    before, after = text[outer - 1 : outer] if outer else "", text[end : end + 1]
    even = len(set(between)) <= 1
    found = [
        f"digits={len(digits)}",
        f"groups={'-'.join(map(str, groups))}",
        f"marks={''.join(sorted(set(''.join(between))))}",
        f"even={even}",
        f"plus={text[outer:start]}",
        f"edges={before.isalnum() or before in '_@'}{after.isalnum() or after in '_@'}" if before and after else "edges=end",
        f"whole={i == 0}{j == len(units) - 1}",
    ]
    if kind == "card":
        found.append(f"luhn={luhn(digits)}{len(digits) >= 16}{even}")
    elif kind == "ip":
        found.append(f"four={len(groups) == 4 and set(between) == {'.'} and _bytes(inside.split('.'))}")
    else:
        found.append(f"fit={8 <= len(digits) <= 15}{groups[-1] >= 4}{len(groups)}")
    return [f"{kind}:{f}" for f in found] + [f"{kind}:"]


def _lattice(text: str, cluster: Cluster) -> list[tuple[int, int, str, list[str]]]:
    n = len(cluster[1])
    found = []
    for i in range(n):
        for j in range(i, min(n, i + MOST_UNITS)):
            for kind in KINDS:
                own = features(text, cluster, i, j, kind)
                if own is not None:
                    found.append((i, j, kind, own))
    return found


def _add(x: float, y: float) -> float:
    low, high = (x, y) if x < y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def marginals(n: int, scored: list[tuple[int, int, float]]) -> tuple[list[float], float]:
    """(probability of each candidate, log of the sum over all segmentations); a unit outside of entities scores 0."""
    starts: dict[int, list[int]] = {}
    for k, (i, _, _) in enumerate(scored):
        starts.setdefault(i, []).append(k)
    ahead = [0.0] + [-math.inf] * n
    for p in range(n):
        ahead[p + 1] = _add(ahead[p + 1], ahead[p])
        for k in starts.get(p, ()):
            _, j, s = scored[k]
            ahead[j + 1] = _add(ahead[j + 1], ahead[p] + s)
    back = [-math.inf] * n + [0.0]
    for p in range(n - 1, -1, -1):
        back[p] = back[p + 1]
        for k in starts.get(p, ()):
            _, j, s = scored[k]
            back[p] = _add(back[p], back[j + 1] + s)
    total = ahead[n]
    return [math.exp(min(0.0, ahead[i] + s + back[j + 1] - total)) for i, j, s in scored], total


def best(n: int, scored: list[tuple[int, int, float]]) -> list[int]:
    """The candidates of the segmentation with the highest score."""
    ends: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(scored):
        ends.setdefault(j, []).append(k)
    top, chosen = [0.0] * (n + 1), [-1] * (n + 1)
    for p in range(1, n + 1):
        top[p] = top[p - 1]
        for k in ends.get(p - 1, ()):
            i, _, s = scored[k]
            if top[i] + s > top[p]:
                top[p], chosen[p] = top[i] + s, k
    found, p = [], n
    while p:
        if chosen[p] >= 0:
            found.append(chosen[p])
            p = scored[chosen[p]][0]
        else:
            p -= 1
    return found


Weights = dict[str, float]
Example = tuple[str, list[Span]]


def _variants(kind: str, value: str, draw: random.Random) -> str:
    """The same value as people also write it."""
    digits = _digits(value)
    if kind == "email":
        name, host = value.split("@", 1)
        at, dot = draw.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", ".")])
        return name.replace(".", draw.choice([".", "_"])) + at + host.replace(".", dot)
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"00{digits[:-10]} {a} {b} {c}"])
    if kind == "card":
        return draw.choice([".", "/"]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return value


def _decoys(draw: random.Random) -> str:
    """Numbers that are no personal data."""
    n = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    bad = n(16)
    while luhn(bad):
        bad = n(16)
    return draw.choice([f"20{n(2)}-0{draw.randint(1, 9)}-1{n(1)}", f"1{n(1)}/0{draw.randint(1, 9)}/20{n(2)} 10:{n(2)}:{n(2)}", bad, "-".join(bad[k : k + 4] for k in range(0, 16, 4)), n(7), n(9), n(12), n(20), f"{n(3)} {n(3)} {n(3)} {n(3)}", f"3{n(2)}.4{n(2)}.9{n(2)}.{n(2)}", f"{n(4)}.{n(4)}", f"id{n(9)}x", f"{n(2)}:{n(2)}:{n(2)}.{n(3)}"])


def fit(examples: list[Example], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Weights:
    """Maximum conditional likelihood of the marked spans, by stochastic gradient steps; runs over the bounded sample."""
    draw = random.Random(seed)
    examples = sorted(examples)
    values = sorted({(kind, text[a:b]) for text, spans in examples for kind, a, b in spans})
    made = []
    for k in range(600):
        lead, tail = draw.choice(["", "tel ", "x. ", "the "]), draw.choice([".", " and", "", ", or"])
        if values and k % 2:
            kind, value = draw.choice(values)
            value = _variants(kind, value, draw)
            made.append((f"{lead}{value}{tail}", [(kind, len(lead), len(lead) + len(value))]))
        else:
            made.append((f"{lead}{_decoys(draw)}{tail}", []))
    work = []
    for text, spans in examples + made:
        gold = set(spans)
        for cluster in clusters(text):
            lattice = _lattice(text, cluster)
            units = cluster[1]
            marked = [(kind, _outer(text, units[i][0]) if kind == "phone" else units[i][0], units[j][1]) in gold for i, j, kind, _ in lattice]
            if lattice:
                work.append((len(units), lattice, marked))
    weights: Weights = {}
    for epoch in range(epochs):
        draw.shuffle(work)
        step = rate / (1 + epoch)
        for n, lattice, marked in work:
            scored = [(i, j, sum(weights.get(f, 0.0) for f in own)) for i, j, _, own in lattice]
            for (_, _, _, own), p, y in zip(lattice, marginals(n, scored)[0], marked, strict=True):
                if abs(y - p) > 1e-3:
                    for f in own:
                        w = weights.get(f, 0.0)
                        weights[f] = w + step * ((y - p) - decay * w)
    return weights


def _free(cluster: Cluster, base: list[Span]) -> Iterator[Cluster]:
    """The runs of digit groups between the spans of the rules, each a cluster; names are left whole."""
    name, units = cluster
    if name == "name":
        yield cluster
        return
    run: list[tuple[int, int]] = []
    for unit in [*units, None]:
        if unit and not any(a < unit[1] and unit[0] < b for _, a, b in base):
            run.append(unit)
        elif run:
            yield name, run
            run = []


def added_spans(text: str, weights: Weights, base: list[Span], sure: float = SURE) -> list[Span]:
    """Spans of the best segmentation of each cluster that are probable enough and touch no span of the rules."""
    found = []
    for cluster in (piece for whole in clusters(text) for piece in _free(whole, base)):
        units = cluster[1]
        lattice = [x for x in _lattice(text, cluster) if not any(a < units[x[1]][1] and units[x[0]][0] < b for _, a, b in base)]
        scored = [(i, j, sum(weights.get(f, 0.0) for f in own)) for i, j, _, own in lattice]
        probable, _ = marginals(len(units), scored)
        for k in best(len(units), scored):
            i, j, kind, _ = lattice[k]
            start, end = _outer(text, units[i][0]) if kind == "phone" else units[i][0], units[j][1]
            if probable[k] >= sure and not any(a < end and start < b for _, a, b in [*base, *found]):
                found.append((kind, start, end))
    return found


def _joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def learn_field(docs: DataFrame, text: str = "text") -> Weights:
    """Fits the field to the rules' spans in a sample of about SAMPLE_DOCUMENTS documents with digits or at signs, those
    with the lowest hashes. At most SAMPLE_CLUSTERS clusters with a little text around them come to the driver."""
    rows = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, rows.count()))
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < int(share * (1 << 40)))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for whole in batch.column("text").to_pylist():
                base = base_spans(whole)
                for _, units in clusters(whole):
                    a, b = max(0, units[0][0] - 8), units[-1][1] + 8
                    if b - a <= 300:
                        spans = [(k, x - a, y - a) for k, x, y in base if a <= x and y <= b]
                        found.append((whole[a:b], _joined(spans)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["piece", "spans"])

    pieces = small_batches(sample).mapInArrow(cut, "piece string, spans string").orderBy(F.xxhash64("piece"), "piece", "spans").limit(SAMPLE_CLUSTERS).collect()
    parsed = lambda x: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in x.split(",") if s)]
    return fit([(r["piece"], parsed(r["spans"])) for r in pieces])


def find_personal_data(docs: DataFrame, weights: Weights, id_column: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per row of ``docs``.

    The counts and base_sha256 (SHA-256 of ``kind:start:end`` of the rules' spans by kind and start, comma-joined) are
    the rules' alone; spans lists those and the field's, in the same form. Places are code points, ends exclusive. NULL
    texts are empty; empty texts have no spans; repeated rows get equal results. Whole texts are searched, in time linear
    in their length, as entities have a bounded number of units. Only id and text are read. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the kinds of features
    kind = docs.schema[id_column].dataType.simpleString()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
        for batch in batches:
            rows = []
            for whole in batch.column("text").to_pylist():
                if not whole or not _TRIGGER.search(whole):
                    rows.append(nothing)
                    continue
                base = base_spans(whole)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                every = base + added_spans(whole, sent.value, base, sure)
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    rows = small_batches(docs).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(search, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_column)
