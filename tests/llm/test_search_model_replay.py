"""Lexical search, the language model and the replay of conversations, against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts(seed, n=120):
    """Texts with copies, nulls, empty, short and long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéÖñ1", k=rng.randint(1, 6))) for _ in range(150)]
    made = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(150)], k=rng.choice([1, 3, 20, 80]))) for _ in range(n)]
    return [*made, made[3], made[3], made[5].upper(), None, "", " \n\t", "...!?", "x" * 50_000, "lorem ipsum " * 40_000]


# ------------------------------------------------------------------ ranked lexical search


def ranked(docs, items, k):
    found = [Counter(TERMS.findall(low(t))) for _, t in docs]
    total, length = sum(bool(c) for c in found), sum(sum(c.values()) for c in found)
    df = Counter(t for c in found for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERMS.findall(low(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for (doc, _), c in zip(docs, found, strict=True):
            m = 10 + (90 * sum(c.values()) * total) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, n + 1, None if none else doc, -s) for n, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, k, parts=3):
    from millrace.llm.lexical_search import build_index
    from millrace.llm.lexical_search import search as run

    left = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in docs], "doc_id long, text string, chunk int, ids string, terms binary").repartition(parts)
    right = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int").repartition(2)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in run(build_index(left), right, k).collect()), key=repr)


def test_search(spark):
    """Ties, null and repeated ids, repeated and null items, items of no term, and fewer documents than asked for."""
    all_texts = texts(2)
    docs = [(k * 7 % 500 - 100, t) for k, t in enumerate(all_texts)] + [(None, all_texts[3]), (4, all_texts[0]), (4, all_texts[0]), (-(2**63), all_texts[3]), (2**63 - 1, all_texts[3])]
    items = [(k, t) for k, t in enumerate(all_texts[:12])] + [(3, all_texts[20]), (50, None), (51, "..."), (None, all_texts[3]), (52, "nowhere"), (53, all_texts[-1])]
    for k in (1, 10):
        assert search(spark, docs, items, k) == ranked(docs, items, k)


def test_search_of_nothing(spark):
    assert search(spark, [], [(1, "a")], 10) == [] and search(spark, [(1, "a")], [], 10) == [] and search(spark, [(1, None)], [(1, "a")], 10) == []


def test_search_opens_few_ranges():
    """The tree gives the same as all scores, opening ranges of equal bounds for smaller ids."""
    from millrace.llm.lexical_search import Best, Tree, _Builder

    rng = random.Random(4)
    made = _Builder()
    rows = [(rng.randrange(10**6), " ".join(rng.choices(["a", "b", "c", "d", *map(str, range(200))], k=rng.randint(1, 30))).encode()) for _ in range(3000)]
    rows += [(k, b"a b c") for k in range(5000, 4000, -1)]
    for doc, text in rows[:4096]:
        made.add(doc, text)
    names = ["chunk", "ids", "sizes", "terms", "counts", "places", "tfs"]
    number = {t: k for k, t in enumerate([b"a", b"b", b"c", b"17"])}
    tree = Tree(dict(zip(names, made.row(0), strict=True)), number, np.array([900, 1100, 1300, 4000]), 4000, 60_000)
    for asked in ([0, 1, 2], [3], [0, 3]):
        best = Best(10)
        tree.search(np.array(asked), best, False)
        wanted = np.isin(tree.term, asked)
        scores = np.zeros(len(tree.ids), dtype=np.int64)
        np.add.at(scores, tree.place[wanted], tree.value[wanted])
        assert sorted((-s, d) for s, _, d in best.heap) == sorted((-s, d) for s, d in zip(scores.tolist(), tree.ids, strict=True) if s)[:10]


# ------------------------------------------------------------------ language model


def scored(spark, docs):
    from millrace.llm.pitman_yor import score

    table = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in docs], "doc_id long, text string, batch int, words string, key binary").repartition(3)
    return score(table).collect()


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def test_language_model(spark):
    """Counts and the base score exactly; held-out texts are likelier than by the base, and a model of pairs knows what it has read."""
    rows = list(enumerate(texts(6, 400))) + [(None, "a b"), (None, None), (7, "c d"), (7, "c d")]
    counts = Counter(w for i, t in rows if not held(i) for w in [*WORDS.findall(low(t)), None])
    total, distinct = sum(counts.values()), len(counts)
    got = scored(spark, rows)
    want = []
    for i, t in rows:
        words = [*WORDS.findall(low(t)), None]
        want.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), 5)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    for side in (True, False):
        own = [r for r in got if r.held_out == side and r.n_tokens < 1000]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
    again = {(r.doc_id, r.n_tokens): r.score for r in scored(spark, rows)}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score, rel=1e-6) for r in got)


def test_language_model_without_choice(spark):
    """Where every word occurs once there is one seating, and probabilities are those of the formula."""
    from millrace.llm import pitman_yor as py

    train, out = next(k for k in range(100) if not held(k)), next(k for k in range(100) if held(k))
    got = {r.doc_id: r for r in scored(spark, [(train, "a b c"), (out, "a b z")])}
    d, d0, n, v = 0.95, 0.95, 4, 4  # discounts of counts of which none is 2
    root = lambda c: ((1 - d0) * c + (py.THETA_ROOT + d0 * v) / (v + 1)) / (py.THETA_ROOT + n)
    p = lambda known, c: ((1 - d) * known + (py.THETA + d) * root(c)) / (py.THETA + 1)
    assert got[train].score == pytest.approx(4 * math.log10(p(1, 1)), rel=1e-5)
    assert got[out].score == pytest.approx(2 * math.log10(p(1, 1)) + math.log10(p(0, 0)) + math.log10(root(1)), rel=1e-5)


def test_language_model_of_nothing(spark):
    assert scored(spark, []) == []
    out = next(k for k in range(100) if held(k))
    (row,) = scored(spark, [(out, None)])
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (1, 0, 0, 0.0, 0.0)


def test_tables_are_drawn_by_their_weights():
    """Frequencies of drawn numbers of tables, against all seatings of few customers, exactly and by particles."""
    from millrace.llm import pitman_yor as py

    d, theta, c, others, parent = 0.6, 1.0, 7, 5, 0.2
    weights = np.zeros(c + 1)

    def seat(sizes, weight, customers):
        if not customers:
            weights[len(sizes)] += weight
            return
        for k in range(len(sizes)):
            seat(sizes[:k] + [sizes[k] + 1] + sizes[k + 1 :], weight * (sizes[k] - d), customers - 1)
        seat([*sizes, 1], weight * (theta + d * (others + len(sizes))) * parent, customers - 1)

    seat([], 1.0, c)
    want, n = weights[1:] / weights.sum(), 200_000
    rng = np.random.default_rng(8)
    draw = lambda: np.bincount(py.tables(np.full(n, c), np.full(n, others), np.full(n, parent), d, theta, rng), minlength=c + 1)[1:] / n
    assert np.abs(draw() - want).max() < 0.01
    exact, py.EXACT = py.EXACT, 2
    try:
        assert np.abs(draw() - want).max() < 0.05
    finally:
        py.EXACT = exact
    assert py.tables(np.array([1, 10**7]), np.array([0, 9]), np.array([0.5, 0.1]), d, theta, rng)[1] > 1


def test_packed_arrays():
    from millrace.llm.pitman_yor import _from48, _low48, packed, unpacked

    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 2**63, 1000, dtype=np.uint64), np.zeros(0, "<f4"), rng.random(10), np.arange(5, dtype="|u1")):
        assert (unpacked(packed(values)) == values).all() and unpacked(packed(values)).dtype == values.dtype
    names = rng.integers(0, 2**48, 99, dtype=np.uint64)
    assert (_from48(_low48(names)) == names).all()


# ------------------------------------------------------------------ cascading release


def replayed(rows):
    """One turn after the other."""
    by_conv = defaultdict(list)
    for conv, turn, text in rows:
        by_conv[conv].append((turn is None, turn or 0, zlib.crc32((text or "").encode()), turn))
    out = []
    for conv, turns in by_conv.items():
        done = []
        for p, (_, _, crc, turn) in enumerate(sorted(turns, key=lambda x: x[:3])):
            h = [zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode()) for k in range(9)]
            back = h[0] % 5
            parent = done[p - back] if back and back <= p else None
            if parent and parent["status"] != "delivered":
                done.append({"turn": turn, "status": "blocked", "attempts": 0, "first": None, "last": None, "crc": crc, "p": p})
                continue
            first = now = max(7 * p, parent["last"] if parent else 0)
            for a in range(1, 7):
                if not (h[1] % 101 < 50 and (now < 7 * p + h[2] % 101 or h[a + 2] % 3 == 0)):
                    status = "delivered"
                    break
                status = "dead"
                if a < 6:
                    now += 10 * 2 ** (a - 1)
            done.append({"turn": turn, "status": status, "attempts": a, "first": first, "last": now, "crc": crc, "p": p})
        state = 0
        released = sorted((x for x in done if x["status"] == "delivered"), key=lambda x: (x["last"], x["turn"] is None, x["turn"] or 0, x["p"]))
        for n, x in enumerate(released, 1):
            state += n * x["crc"]
            x["no"], x["state"] = n, (state + 2**63) % 2**64 - 2**63
        out += [(conv, x["turn"], x["status"], x["attempts"], x["first"], x["last"], x.get("no"), x.get("state")) for x in done]
    return sorted(out, key=repr)


def conversations(seed, hot):
    rng = random.Random(seed)
    rows = [(c, t, f"{c} {t} é") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(-5, 3 * t + 1, "x" * (t % 50)) for t in range(hot)]  # one conversation with most of all turns
    rows += [(1000, 0, None), (1000, 1, ""), (1000, 1, "again"), (1000, 1, "again"), (1000, None, "last"), (None, 0, "a"), (None, 1, "b"), (None, None, None), (1001, -4, "neg"), (1001, 2**40, "far")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("part", "fan"), [(50_000, 64), (40, 3), (7, 2)])
def test_replay(spark, monkeypatch, part, fan):
    """Whole conversations in a part, and conversations over many parts with several levels of parts above."""
    from millrace.llm import quarantine

    monkeypatch.setattr(quarantine, "PART", part)
    monkeypatch.setattr(quarantine, "FAN", fan)
    rows = conversations(part, 700)
    table = spark.createDataFrame([(c, t, x, 1, "y", b"z") for c, t, x in rows], "conv_id long, turn long, text string, part int, uid string, p binary").repartition(3)
    assert sorted((tuple(r) for r in quarantine.replay(table).collect()), key=repr) == replayed(rows)


def test_replay_of_nothing(spark):
    from millrace.llm.quarantine import replay

    assert replay(spark.createDataFrame([], "conv_id long, turn long, text string")).collect() == []


def test_composed_functions():
    """A path's prefixes by its tree are those of one function after the other, whatever comes in."""
    from millrace.llm import quarantine as q

    rng = random.Random(1)
    parent = [-3, 0, 1, 1, 2, 4, 3, 5, -1, 8, 7]
    made = [q.delivery(7 * v, rng.random() < 0.7, 7 * v + rng.randrange(101), tuple(rng.random() < 0.6 for _ in range(6))) for v in range(len(parent))]
    forest = q.Forest(parent, made.__getitem__)
    for x in [None, *range(0, 400, 3)]:
        want = []
        for v, p in enumerate(parent):
            own = q.START if p == -1 else x if p < -1 else q.at(made[p], want[p])
            want.append(own)
        assert forest.inputs([9, x, None, None]) == want
        for v in range(len(parent)):
            back, f = forest.climb(v)
            assert q.at(f, x if back else q.START) == q.at(made[v], want[v]) and back in (0, 2)
