"""The operators on small tables: empty tables, NULLs, ties, repeated rows and columns with clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import copies, graph, languages, leaks, mixing, personal, quality, repeats, tokens, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, k1 long, id long, a string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 1, 2, "x") for i, t, s in rows], DOCS)


LONG = " ".join(f"w{k % 97}x{k % 89}" for k in range(40_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the dog for a long time today", "s1"),
    (2, "the cat sat on the mat and looked at the dog for a long time today", "s1"),
    (2, "the cat sat on the mat and looked at the dog for a long time today", "s1"),
    (3, None, None),
    (4, "", "s2"),
    (5, " \n\t ", "s2"),
    (6, LONG, "s1"),
    (None, "a row without an id", None),
    (7, "one", "s3"),
    (8, "ONE", "s3"),
]


@pytest.fixture(scope="module")
def mixed(spark):
    return docs(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def plain_components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (6, 6), (None, 1)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(chain).collect()} == {1}
    assert graph.components(edges.limit(0)).count() == 0


# near copies


def test_near_copies_small(mixed, empty):
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in copies.near_copies(mixed, size=2).collect()}
    n = len({tuple(x) for x in zip(LONG.split(), LONG.split()[1:])})
    assert found == {
        (1, 15, 1, True), (2, 15, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
        (6, n, 6, True), (None, 4, None, True), (7, 1, 7, True), (8, 1, 7, False),
    }
    assert copies.near_copies(mixed, size=2).count() == len(ROWS)
    assert copies.near_copies(empty).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies_brute_force(spark, size):
    random = np.random.default_rng(size)
    rows = []
    for group in range(40):
        base = [f"v{x}" for x in random.integers(0, 500, 60)]
        for _ in range(int(random.integers(1, 12))):
            own = list(base)
            for _ in range(int(random.integers(0, 5))):
                own[int(random.integers(0, len(own)))] = f"e{random.integers(0, 1000)}"
            rows.append((len(rows), " ".join(own), f"g{group}"))
    sets = {}
    for i, t, _ in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    expected = plain_components(sets, 80)
    found = {r.doc_id: r.component_id for r in copies.near_copies(docs(spark, rows), size=size).collect()}
    assert found == expected
    assert len(set(expected.values())) < len(rows)


def test_near_copies_of_a_hub(spark, monkeypatch):
    random = np.random.default_rng(7)
    base = [f"v{x}" for x in random.permutation(10_000)[:200]]
    rows = []
    for k in range(900):  # each edited on its own: 0.82 to the original, about 0.68 to each other
        own = list(base)
        for p in random.choice(np.arange(2, 198, 3), 10, replace=False):
            own[p] = f"e{k}x{p}"
        rows.append((k, " ".join(own), "s"))
    rows.append((5000, " ".join(base), "s"))
    pairs = {i: set(zip(w, w[1:])) for i, t, _ in rows for w in [t.split()]}
    assert all(100 * len(pairs[5000] & pairs[k]) >= 80 * len(pairs[5000] | pairs[k]) for k in range(900))
    assert all(100 * len(pairs[0] & pairs[k]) < 80 * len(pairs[0] | pairs[k]) for k in range(1, 900))
    assert {r.component_id for r in copies.near_copies(docs(spark, rows), size=2).collect()} == {0}
    monkeypatch.setattr(copies, "BLOCK", 100)
    monkeypatch.setattr(copies, "COLUMNS", 50)
    assert {r.component_id for r in copies.near_copies(docs(spark, rows), size=2).collect()} == {0}


# vectors


def test_near_vectors(spark):
    random = np.random.default_rng(1)
    rows = [(k, random.normal(size=64).tolist(), k % 3) for k in range(120)]
    for k in range(40):  # a group of near copies and two equal vectors
        rows.append((200 + k, (np.array(rows[0][1]) + random.normal(0, 0.08, 64)).tolist(), 0))
    rows += [(300, rows[5][1], 2), (301, rows[5][1], 2), (302, rows[5][1], None), (303, None, 1), (304, [0.0] * 64, 1), (305, [], 1)]
    rows += [(306, [float("nan")] * 64, 1), (307, [None] * 64, 1), (308, rows[5][1][:32], 2), (None, rows[5][1], 2)]
    frame = spark.createDataFrame([(*r, 7, "y") for r in rows], "vec_id long, embedding array<double>, label int, links int, id string")
    usable = {r[0]: (np.array(r[1]), r[2]) for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    links = {i: {j for j, (y, m) in usable.items() if j != i and m == l and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98} for i, (x, l) in usable.items()}
    found = vectors.near_vectors(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_links == len(links.get(r.vec_id, ()))
        reach, todo = {r.vec_id}, [r.vec_id]
        while todo:
            new = links.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert r.component_id == (min(reach) if r.vec_id is not None else None)
        assert r.kept == (r.component_id == r.vec_id)
    assert max(len(x) for x in links.values()) > 10
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_large_buckets_are_cut(spark, monkeypatch):
    random = np.random.default_rng(2)
    base = random.normal(size=16)
    rows = [(k, (base + random.normal(0, 0.1, 16)).tolist(), 1) for k in range(150)]
    monkeypatch.setattr(vectors, "BLOCK", 20)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98).sum(1) - 1
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(found[k] == near[k] for k in range(150)) > 147
    assert all(found[k] <= near[k] for k in range(150))


# repeats


def brute_repeats(texts, length):
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((k, p))
    masks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                masks[k][p : p + length] = True
    return masks


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    random = np.random.default_rng(group)
    letters = lambda n: "".join(random.choice(list("abcdeé \n"), n))
    passages = [letters(n) for n in (60, 95, 100, 130, 300)]
    rows = [(k, letters(int(random.integers(0, 200))) + str(random.choice(passages)) + letters(int(random.integers(0, 200))) + str(random.choice(passages))[: int(random.integers(40, 300))], "s") for k in range(60)]
    rows += [(100, "ab" * 300, "s"), (101, rows[0][1], "s"), (102, None, "s"), (103, "", "s"), (None, rows[1][1], "s"), (None, letters(150), "s"), (100, letters(300), "s")]
    texts = [(t or "").encode() for _, t, _ in rows]
    expected = []
    for (i, _, _), t, m in zip(rows, texts, brute_repeats(texts, 100)):
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        expected.append((i, len(t), int(m.sum()), int((np.diff(np.append(0, m.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    found = [tuple(r[:5]) + (bytes(r[5]),) for r in repeats.cut_repeats(docs(spark, rows), length=100).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_repeats_empty(empty):
    assert repeats.cut_repeats(empty).count() == 0


def test_intervals():
    order, found = repeats.intervals([b"banana", b"ban", b"band", b"x", b"bat"])
    texts = [b"ban", b"banana", b"band", b"bat", b"x"]
    assert [[b"banana", b"ban", b"band", b"x", b"bat"][k] for k in order] == texts
    assert sorted(found) == [(0, 0, 4), (2, 0, 3), (3, 0, 2)]


# personal data


def test_rules_are_the_regular_expressions():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fits(kind, x):
        d = re.sub("[^0-9]", "", x)
        return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in x.split(".")), "card": 16 <= len(d) <= 19 and personal.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    random = np.random.default_rng(0)
    texts = ["".join(random.choice(list("ab1@.+- (20)é9"), 60)) for _ in range(3000)]
    texts += ["a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "4539 5787 6362 1486", "+1 (212) 555-0198", "x@y", "@", "256.1.1.1", "0255.1.1.1"]
    for t in texts:
        assert personal.base_spans(t) == [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if fits(k, m[0])]


def test_personal_data(spark, mixed, empty):
    rows = [(k, f"call +1 (212) 555-{k:04d} or write to p{k}@mail.example.org, host 10.0.{k}.7, card 4539 5787 6362 1486 in 2021", "s") for k in range(50)]
    field = personal.learn_field(docs(spark, rows))
    new = [(1, "ring (212) 555-0143 now", "s"), (2, "on 2021-03-12 10:22:33 it rained", "s"), (3, "joe at mail dot example dot org", "s"), (4, "+1 (212) 555-0198", "s"), (5, None, None)]
    found = {r.doc_id: r for r in personal.find_personal_data(docs(spark, new), field).collect()}
    assert found[1].spans == "phone:5:19" and found[1].n_phone == 0 and found[2].spans == "" and found[3].spans.startswith("email:0:31")
    assert found[4].spans == "phone:0:17" and found[4].base_sha256 == hashlib.sha256(b"phone:0:17").hexdigest()
    assert found[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal.find_personal_data(mixed, field).count() == len(ROWS)
    assert personal.find_personal_data(empty, personal.learn_field(empty)).count() == 0


def test_every_start_of_a_cluster_is_searched():
    for text in ("write to john at example.org", "john(at)example.org", "john[at]example dot org", "john at example dot org", "call 415-555-9999"):
        assert personal.clusters(text) and personal._TRIGGER.search(text)


def test_numbers_beside_spans_of_the_rules():
    draw = np.random.default_rng(1)
    texts = [f"call +1 (212) 555-{k:04d} or host 10.0.{k}.7 {draw.integers(10)}" for k in range(60)]
    field = personal.fit([(t, personal.base_spans(t)) for t in texts])
    for text, number in [("+14155552671 / 415-555-9999", "415-555-9999"), ("+1 4155552671/(212) 555-0199", "(212) 555-0199"), ("10.0.0.1 415-555-9999", "415-555-9999"), ("+14155552671 / 415-555-9999 / 212-555-0143", "415-555-9999")]:
        base = personal.base_spans(text)
        added = personal.added_spans(text, field, base, 0.0)
        assert not any(a < end and start < b for _, start, end in added for _, a, b in base)
        assert any(number in text[a:b] or text[a:b] in number for _, a, b in added), (text, base, added)


def test_marginals_are_sums_over_segmentations():
    scored = [(0, 0, 0.5), (0, 1, 1.5), (1, 2, -0.3), (2, 2, 0.7)]
    ways = [(), (0,), (1,), (2,), (3,), (0, 2), (0, 3), (1, 3)]
    weight = {w: np.exp(sum(scored[k][2] for k in w)) for w in ways}
    total = sum(weight.values())
    found, log_total = personal.marginals(3, scored)
    assert np.isclose(log_total, np.log(total))
    assert np.allclose(found, [sum(v for w, v in weight.items() if k in w) / total for k in range(4)])
    assert sorted(personal.best(3, scored)) == list(max(weight, key=weight.get))


# languages and quality

WORDS = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "quick brown jumps over lazy".split()}


def test_languages(spark, mixed, empty):
    random = np.random.default_rng(0)
    rows = [(k, " ".join(random.choice(WORDS[lang], 30)), lang) for k in range(60) for lang in WORDS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("kept away"))
    known = languages.learn_languages(frame.filter("doc_id % 3 > 0"))
    found = languages.identify(frame.filter("doc_id % 3 = 0"), known, narrow=0.01).collect()
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 and not r.rejected for r in found)
    odd = languages.identify(mixed, known).collect()
    assert len(odd) == len(ROWS) and {r.lang_pred for r in odd if not (r.text or "").strip()} == {"und"}
    assert all(r.rejected for r in odd if r.lang_pred == "und")
    assert languages.identify(spark.createDataFrame([(1, "123 !? 45")], "doc_id long, text string"), known).first().lang_pred == "und"
    none = languages.learn_languages(empty)
    assert languages.identify(mixed, none).filter("lang_pred <> 'und'").count() == 0
    assert languages.identify(empty, known).count() == 0


def test_quality(spark, mixed, empty):
    random = np.random.default_rng(0)
    good = [" ".join(random.choice(WORDS["bb"], 40)) + "." for _ in range(150)]
    bad = [" ".join(x + "!!" for x in random.choice(WORDS["bb"], 40)).upper() for _ in range(60)]
    rows = [(k, t, y, len(t)) for k, (t, y) in enumerate([*((t, 1) for t in good), *((t, 0) for t in bad), ("unlabelled", None)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int, n_chars long")
    machine = quality.learn_quality(frame.filter("doc_id % 4 > 0"), "label", metadata=["n_chars"])
    scored = {r.doc_id: r.score for r in quality.score_quality(frame, machine, metadata=["n_chars"]).collect()}
    held = [(scored[k], y) for k, _, y, _ in rows if k % 4 == 0 and y is not None]
    assert all((s >= 0.7) == (y == 1) for s, y in held)
    odd = quality.score_quality(mixed, machine, metadata=["n_chars"]).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(empty, quality.learn_quality(empty, "n_chars")).count() == 0


def test_sum_of_squares():
    random = np.random.default_rng(0)
    machine = quality.Machine(0.3, random.normal(size=9), random.normal(size=(9, quality.FACTORS)))
    i, x = np.array([1, 4, 7, 8]), random.normal(size=4)
    plain = 0.3 + sum(machine.weights[i] * x) + sum(machine.factors[i[a]] @ machine.factors[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert np.isclose(machine.raw(np.array([0, 4]), i, x)[0], plain)


# leaks


def test_leaks(spark, mixed, empty):
    random = np.random.default_rng(0)
    word = lambda: "".join(random.choice(list("abcdefghij"), int(random.integers(3, 9))))
    items = [(k, " ".join(word() for _ in range(30 + 10 * k))) for k in range(5)]
    table = spark.createDataFrame([*items, (8, None), (9, "ab"), (None, "x" * 50)], "item_id long, text string").withColumn("leaks", F.lit(1))
    rows, want = [], set()
    for k in range(40):
        filler = [" ".join(word() for _ in range(80)) for _ in range(2)]
        item, text = items[k % 5]
        if k % 2 == 0:
            edited = list(text)
            for p in random.choice(len(text), len(text) // 25, replace=False):
                edited[p] = str(random.choice(["", "z", "zz"]))
            rows.append((k, filler[0] + "; " + "".join(edited).upper() + " " + filler[1], "s"))
            want.add((k, item))
        else:
            rows.append((k, " ".join(filler), "s"))
    rows.append((90, "Ä " + items[0][1].replace(" ", " ,\n"), "s"))
    want.add((90, 0))
    found = leaks.mark_leaks(docs(spark, rows), table).collect()
    assert {(r.doc_id, x.item) for r in found for x in r.leaks} == want
    exact = next(r for r in found if r.doc_id == 90)
    assert exact.text[exact.leaks[0].start : exact.leaks[0].end] == exact.text[2:] and exact.leaks[0].edits == 0
    assert all(r.leaks == [] for r in leaks.mark_leaks(mixed, table).collect())
    assert leaks.mark_leaks(empty, table).count() == 0
    assert all(r.leaks == [] for r in leaks.mark_leaks(mixed, table.limit(0)).collect())


def test_leaks_finds_passages_of_every_offset(spark):
    random = np.random.default_rng(5)
    word = lambda: "".join(random.choice(list("abcdefghij"), int(random.integers(3, 9))))
    item = " ".join(word() for _ in range(60))
    least = leaks.WINDOW + leaks.STRIDE - 1
    rows = []
    for k in range(len(item) - least + 1):
        passage = list(item[k : k + least])
        if k % 2:  # edits in no window more than it may have
            for p in (10, 40, 70):
                passage[p] = "z"
        rows.append((k, f"{word()} {word()} q{''.join(passage)}q {word()}", "s"))
    rows.append((10_000, " ".join(word() for _ in range(400)), "s"))
    found = leaks.mark_leaks(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found if r.leaks} == {r[0] for r in rows} - {10_000}


def test_leaks_in_passes(spark, monkeypatch):
    text = " ".join(f"word{k}" for k in range(60))
    table = spark.createDataFrame([(k, f"{text} {k}{k}{k}") for k in range(4)], "item_id long, text string")
    monkeypatch.setattr(leaks, "PASS_BYTES", 600)
    assert {x.item for x in leaks.mark_leaks(docs(spark, [(1, text, "s")]), table).first().leaks} == {0, 1, 2, 3}


def test_nearest():
    assert leaks.nearest([(b"kitten", np.frombuffer(b"xx sitting xx", np.uint8))]) == [(2, 9)]
    assert leaks.nearest([]) == []


@pytest.mark.parametrize("cells", [1 << 17, 30])
def test_nearest_by_hand(monkeypatch, cells):
    monkeypatch.setattr(leaks, "CELLS", cells)
    dice = np.random.default_rng(4)
    pairs = [(bytes(dice.integers(97, 100, dice.integers(1, 9)).tolist()), dice.integers(97, 100, dice.integers(0, 20)).astype(np.uint8)) for _ in range(200)]

    def plain(pattern, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (t != c), row[j] + 1, new[-1] + 1))
            row = new
        return min(row), row.index(min(row))

    assert leaks.nearest(pairs) == [plain(p, t.tolist()) for p, t in pairs]


# tokens


def test_token_files(spark, mixed, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    manifest = tokens.write_sequences(mixed, f"file://{tmp_path}/out", path, length=64)
    found = sorted(tokens.document_checks(manifest).collect(), key=lambda r: r.start)
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (i, text, _) in zip(found, ordered, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for f in manifest.collect():
        ids, mask = tokens.read_sequence(f.path, 0)
        assert len(ids) == len(mask) == 64 and mask.sum() == min(64, f.n_tokens)
        last_ids, last_mask = tokens.read_sequence(f.path, (f.n_tokens - 1) // 64)
        assert last_mask.sum() == (f.n_tokens - 1) % 64 + 1 and not last_ids[~last_mask].any()
    assert tokens.encode_documents(empty, path).count() == 0


def test_coder_splits_at_spaces(monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    tokenizer, coder = Tokenizer.from_file(path), tokens.Coder(path)
    texts = ["", " ", "a  b", " a", "  a", "a\n  b c", "a \n b", "x <|endoftext|> y<|endoftext|>", "it's  John's  ", "a\x1c b \x1cc", "　 a  b", "  \n\n  x   y", "ab" * 500]
    for most in (700_000, 0):
        monkeypatch.setattr(tokens, "REMEMBERED", most)
        for t, ids in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(ids, coder.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_coder_joins_few_pieces(monkeypatch):
    coder, texts = tokens.Coder(tokens.default_tokenizer()), []
    ids = coder._ids

    def noted(own):
        texts.extend(own)
        return ids(own)

    monkeypatch.setattr(coder, "_ids", noted)
    text = " ".join(f"word{k}" for k in range(1000))
    (found,) = coder.encode([text])
    assert 20 < len(texts) < 100 and max(t.count(" ") for t in texts) <= 64
    assert np.frombuffer(found, coder.kind).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


# URLs


def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    rows = [
        ("http://a.com/x", "a.com", "/x", "com/", "allow"),
        ("http://Example.COM/en/1?q=://", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/#t", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://x.net/EN/1", "x.net", "/EN/1", None, "allow"),
        ("http://casino-win.example.org?x", "casino-win.example.org", "", None, "block"),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    frame = spark.createDataFrame([(k, r[0], "old", 1.0) for k, r in enumerate([*rows, rows[0]])], "page_id long, url string, host string, features double")
    model = urls.fit_url_model(urls.labelled_urls(spark))
    found = {r.page_id: r for r in urls.judge_urls(frame, rules, model).collect()}
    assert len(found) == len(rows) + 1
    for k, (_, host, path, rule, verdict) in enumerate(rows):
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert verdict is None or found[k].verdict == verdict
    assert urls.judge_urls(frame.limit(0), rules, model).count() == 0
    assert urls.judge_urls(frame, [], model).filter("rule IS NOT NULL").count() == 0


def test_paths_decide_too(spark):
    unwanted = ["http://example.org/casino/free-bets", "http://gardening.example.net/poker/77", "http://townhall.org/porn/", "http://www.bakery.com/buy-viagra/9"]
    ordinary = ["http://example.org/news/12", "http://gardening.example.net/library/77", "http://townhall.org/contact", "http://www.bakery.com/recipes/9"]
    frame = spark.createDataFrame([(u,) for u in unwanted + ordinary], "url string")
    model = urls.fit_url_model(urls.labelled_urls(spark))
    found = {r.url: r.verdict for r in urls.judge_urls(frame, [], model).collect()}
    assert [found[u] for u in unwanted] == ["block"] * 4 and [found[u] for u in ordinary] == ["allow"] * 4


# mixing


def test_mixing_small(mixed, empty):
    found = mixing.mix_sources(mixed).collect()
    assert len(found) == len(ROWS)
    total = sum(r.size for r in found)
    assert sum(r.taken for r in found) == int(total * 1.5)
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_targets(spark):
    random = np.random.default_rng(0)
    sources = ["b", "B", "é", "z", None]
    rows = [(k, " ".join(["w"] * int(random.integers(0, 60))), sources[int(random.integers(0, 5)) if k % 3 else 0]) for k in range(900)]
    found = mixing.mix_sources(docs(spark, rows)).collect()
    again = mixing.mix_sources(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    sizes, taken, targets = {}, {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    order = ["B", "b", "z", "é", None]
    weights = dict(zip(order, [5, 2, 1, 5, 2]))
    target, open_ = {}, set(order)
    while True:  # the excess is shared again until nobody is above
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in above}
        open_ -= above
    for s in order:
        assert np.isclose(targets[s], target[s])
        assert abs(taken[s] - target[s]) <= 60
