"""The training-data operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from quire.llm import chat, common, decontam, html_text, jaccard, lines, lm, mixing, pq, quality, sharding
from quire.llm.chunks import MESSAGE, corpus_counts, messages, range_bits, spread
from quire.llm.common import Scratch, rolled, word_hashes
from quire.llm.components import connected_components, smallest_reachable


def words(text):
    return text.encode().lower().split() if text else []


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocabulary)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    out = [prose(rng, int(n)) for n in rng.integers(5, 120, 60)]
    base = prose(rng, 100).split()
    for k in range(25):  # near copies of one text
        copy = list(base)
        copy[int(rng.integers(100))] = f"x{k}"
        out.append(" ".join(copy))
    out += [out[0], out[0], out[1].upper(), "", None, "one two", "one  two", "\n\t ", " ".join(prose(rng, 30) for _ in range(400))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "s", 0), (5, texts[5], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string, n long").repartition(5)


def empty(docs):
    return docs.where("false")


# Shared pieces


def test_word_hashes_follow_words(texts):
    seen, back = {}, {}
    for t in [*texts, "É é A a", "x" * 300_000 + " b " + "x" * 300_000, "A\x0bB\x0cC\xa0D"]:
        tokens, hashes = words(t), word_hashes(t)
        assert len(tokens) == len(hashes)
        for w, h in zip(tokens, hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_rolled_hashes_tell_order():
    h = word_hashes("a b c a b d")
    r = rolled(h, 2)
    assert r[0] == r[3] and len(set(r.tolist())) == 4


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    for local in (10, 1000):  # by stars, within a task
        found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "cc", local=local)
        assert {r["node"]: r["component"] for r in found.collect()} == {x: find(x) for x in parent}
        assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "cc", local=local).count() == 0


def test_smallest_reachable_along_a_path():
    path = np.random.default_rng(0).permutation(20_000)
    nodes, low = smallest_reachable(path[:-1], path[1:])
    assert len(nodes) == 20_000 and (low == 0).all()


@pytest.mark.parametrize(("senders", "fan"), [(3, 8), (9, 4), (40, 4)])
def test_corpus_counts_through_blocks(spark, senders, fan):
    rng = np.random.default_rng(senders)
    own = {(k, s): Counter((rng.zipf(1.3, 200) % 10**6 * (0x9E3779B1 if k else 1) % (1 << 40)).tolist()) for k in range(2) for s in range(senders)}
    rows = []
    for (k, s), c in own.items():
        keys = np.array(sorted(c), dtype=np.uint64)
        rows += messages(k, s, keys, np.array([c[x] for x in sorted(c)]), 0, 0, range_bits(senders, fan), 40)
    assert len(rows) <= 2 * senders * fan  # a constant for each sender
    got = corpus_counts(spark.createDataFrame(rows, MESSAGE).repartition(5), senders, 40, Scratch(spark, "t"), "t", fan).collect()
    total = [sum((own[k, s] for s in range(senders)), Counter()) for k in range(2)]
    for (k, s), c in own.items():
        mine = sorted((r for r in got if (r["k"], r["sender"]) == (k, s)), key=lambda r: r["part"])
        assert np.concatenate([spread(r["counts"]) for r in mine]).tolist() == [total[k][x] for x in sorted(c)]
    for k in range(2):
        ends = [r for r in got if r["k"] == k and r["sender"] == -1]
        assert (sum(r["n"] for r in ends), sum(r["v"] for r in ends)) == (sum(total[k].values()), len(total[k]))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1000]"])
def test_no_machine_local_folder_on_a_cluster(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError):
        common.shared_dir(session)


def test_keys_must_be_whole_numbers(spark):
    named = spark.createDataFrame([("a", "b", [1.0])], "doc_id string, text string, x array<double>")
    for call in (jaccard.similar_groups, lines.removals):
        with pytest.raises(TypeError):
            call(named, Scratch(spark, "t"))
    with pytest.raises(TypeError):
        pq.near_groups(named, Scratch(spark, "t"), key="doc_id", column="x")


# 1


def near_vectors(rows):
    """(links, component) by comparing all pairs of vectors of one length."""
    usable = {}
    for i, x in rows:
        if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            x = np.array(x) / max(abs(v) for v in x)
            usable[i] = x / np.linalg.norm(x)
    links = {i: {j for j, y in usable.items() if j != i and len(y) == len(x) and x @ y >= 0.95} for i, x in usable.items()}
    out = {}
    for i, _ in rows:
        reached, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in links.get(todo.pop(), ()) if j not in reached])
            reached.update(new)
        out[i] = (len(links.get(i, ())), min(reached) if i is not None else None)
    return out


@pytest.mark.parametrize("sigmas", [3.0, math.inf])
def test_vectors_against_brute_force(spark, sigmas):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[100] + rng.normal(size=(60, 16)) * 0.15
    x[200:210] = x[200]
    x[210] = x[200] * 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, [1.0] * 3), (505, []), (None, rows[0][1])]
    rows += [(600, [1.0, 0.0, 0.0]), (601, [1.0, 1e-3, 0.0]), (602, [0.0, 1.0, 0.0]), (603, [1.0, 1.0])]  # other lengths have links too
    rows += [(700, [1e200] * 16), (701, [2e200] * 16), (702, [1e-200] * 15 + [1.1e-200]), (703, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", chat.F.lit("clash")).withColumn("list", chat.F.lit(1))
    got = {r["vec_id"]: r for r in pq.near_groups(frame, Scratch(spark, "t"), block=64, sigmas=sigmas).collect()}
    want = near_vectors(rows)
    assert want[600] == (1, 600) and want[702] == (2, 700) and want[703] == (0, 703)
    for i, (links, component) in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links, component, component == i and i is not None)
    assert pq.near_groups(spark.createDataFrame([], "vec_id long, embedding array<float>"), Scratch(spark, "t")).count() == 0
    none = pq.near_groups(spark.createDataFrame([(1, None), (1, [0.0])], "vec_id long, embedding array<float>"), Scratch(spark, "t"))
    assert [tuple(r) for r in none.collect()] == [(1, 0, 1, True)] * 2


def test_links_count_for_both_ends(spark):
    """With no slack a vector asks its own list alone; whoever of two finds the other, both count it."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 8))
    x = centres[rng.integers(0, 40, 400)] + rng.normal(size=(400, 8)) * 0.12
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    for sigmas in (0.5, 1.0):
        got = pq.near_groups(frame, Scratch(spark, "t"), sigmas=sigmas).toPandas().set_index("vec_id").sort_index()
        assert got["n_links"].sum() % 2 == 0 and (got["n_links"].to_numpy() <= near.sum(1)).all()
        assert got["n_links"].sum() >= 0.9 * near.sum()


def test_blocks_of_distances_are_those_of_all():
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(500, 6)), rng.normal(size=(37, 6))
    want = np.argmin(((x[:, None] - c[None]) ** 2).sum(2), axis=1)
    before, pq.TILE = pq.TILE, 100
    try:
        assert (pq._nearest(x, c) == want).all()
    finally:
        pq.TILE = before


# 2


def test_masks_see_every_pair_of_substitutions():
    window = decontam.WINDOW
    for pair in itertools.combinations(range(window), decontam.SUBSTITUTIONS):
        places = ((s, m) for m in decontam.MASKS for s in range(window - len(m) + 1))
        assert any(all(bit == "0" or s + k not in pair for k, bit in enumerate(m)) for s, m in places)


def leaks(doc, item):
    d, t = decontam.tokens(doc), decontam.tokens(item)
    if len(t) < decontam.LEAST:
        return 0
    w = min(decontam.WINDOW, len(t))
    best = 0
    for i in range(len(d) - w + 1):
        for j in range(len(t) - w + 1):
            best = max(best, sum(a == b for a, b in zip(d[i : i + w], t[j : j + w], strict=True)))
    return best if best >= (w - 2 if w == decontam.WINDOW else w) else 0


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(4)
    items = [prose(rng, 30, 5000) for _ in range(6)] + ["only four words here", "exactly these six words go whole", None, ""]
    rows = [(i, prose(rng, 60, 5000)) for i in range(12)]
    for k in range(12):
        passage = items[k % 6].split()
        for at in rng.choice(30, k // 2, replace=False):
            passage[at] = "changed"
        rows.append((100 + k, prose(rng, 20, 5000) + " " + " ".join(passage).upper() + ", " + prose(rng, 9, 5000)))
    rows += [(200, "so Exactly these, six words! go whole."), (201, "exactly these six other go whole"), (202, "only four words here"), (None, items[0]), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_same"] for r in decontam.overlaps(docs, tests, Scratch(spark, "t")).collect()}
    want = {(d, i): n for d, t in rows for i, item in enumerate(items) if (n := leaks(t or "", item or ""))}
    assert got == want and (200, 7) in got and (None, 0) in got
    kept = decontam.without_leaks(docs, tests, Scratch(spark, "t"))
    bad = {d for d, _ in want}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(d or -1 for d, _ in rows if d not in bad)
    assert decontam.overlaps(docs, tests.where("false"), Scratch(spark, "t")).count() == 0
    assert decontam.overlaps(docs.where("false"), tests, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_of_very_long_texts(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)  # 0: joined by a shuffle
    rng = np.random.default_rng(14)
    item = [f"i{int(k)}" for k in rng.integers(0, 10**9, 20_000)]
    passage = item[15_000:15_040]
    passage[5] = passage[11] = passage[30] = "other"
    long = [f"d{int(k)}" for k in rng.integers(0, 10**9, 60_000)]
    rows = [(1, " ".join([*long, *passage, *long[:9]]), "a"), (2, " ".join(long), "b"), (2, " ".join(item[7:19]), "b"), (3, " ".join(item[-13:]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_id string").withColumn("item", chat.F.lit("x"))
    tests = spark.createDataFrame([(7, " ".join(item), "t"), (8, "a b c d e", "t")], "doc_id long, text string, seed string")
    got = {(r["doc_id"], r["test_doc_id"]): tuple(r)[2:] for r in decontam.overlaps(docs, tests, Scratch(spark, "t"), test_key="doc_id").collect()}
    assert got == {(1, 7): (13, 13, 60_000, 60_041), (3, 7): (13, 13, 0, 13)}
    hashed = [h for h in Path(common.shared_dir(spark).removeprefix("file://")).glob("t-*/tests/*.parquet")]
    assert max(h.stat().st_size for h in hashed) < 20e6  # a seed carries the tokens around it, not its item
    kept = decontam.without_leaks(docs, tests.withColumnRenamed("doc_id", "item_id"), Scratch(spark, "t"))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2, 2]


# 3


@pytest.mark.parametrize(("order", "fan"), [(1, 256), (2, 2), (3, 256)])
def test_language_model_against_brute_force(spark, docs, texts, order, fan):
    s = 4.0
    rows = docs.selectExpr("doc_id", "text", "lang", "n", "coalesce(doc_id, 0) % 3 <> 1 AS learn")
    got = lm.score(rows, "learn", Scratch(spark, "t"), order=order, strength=s, chunk_bytes=4000, fan=fan).collect()
    assert len(got) == len(texts) + 2
    all_rows = [*enumerate(texts), (None, texts[3]), (5, texts[5])]
    grams = [Counter() for _ in range(order)]
    n_learnt = 0
    for i, t in all_rows:
        if (i or 0) % 3 != 1:
            n_learnt += 1
            full = ["<s>", *words(t), "</s>"]
            for k in range(order):
                for e in range(max(k, 1), len(full)):
                    grams[k][tuple(full[e - k : e + 1])] += 1
    total, size = sum(grams[0].values()), len(grams[0])

    def probability(full, e, k):
        if k == 0:
            return (grams[0][(full[e],)] + 0.5) / (total + 0.5 * (size + 1))
        if e - k < 0:
            return probability(full, e, k - 1)
        context = tuple(full[e - k : e])
        c = n_learnt if context == ("<s>",) else grams[k - 1][context]
        return (grams[k][tuple(full[e - k : e + 1])] + s * probability(full, e, k - 1)) / (c + s)

    by_text = defaultdict(list)
    for r in got:
        by_text[r["doc_id"]].append(r)
    for i, t in all_rows:
        full = ["<s>", *words(t), "</s>"]
        r = by_text[i][0]
        assert r["n_tokens"] == len(full) - 1 and r["train_tokens"] == total and r["lang"] == "en"
        assert r["n_known"] == sum(grams[0][(w,)] > 0 for w in full[1:])
        assert r["base_score"] == pytest.approx(sum(math.log10(probability(full, e, 0)) for e in range(1, len(full))))
        assert r["score"] == pytest.approx(sum(math.log10(probability(full, e, order - 1)) for e in range(1, len(full))))
    assert lm.score(empty(rows), "learn", Scratch(spark, "t")).count() == 0


# 4


def test_reply_trees_and_round_trip(spark):
    odd = '\\### Assistant: </turn> ok <turn role="x"> & &amp; &lt; "q"\n</turn>\n'
    rows = [
        ("t", 1, None, "user", "root", 1.0),
        ("t", 2, 1, "assistant", odd, 0.0),
        ("t", 3, 1, "assistant", "better", 5.0),
        ("t", 4, 3, "user", None, None),
        ("t", 5, 4, "assistant", "é end", 1.0),
        ("t", 6, 99, "system", "orphan", 0.0),
        ("t", 7, 8, "user", "cycle", 0.0),
        ("t", 8, 7, "user", "cycle", 0.0),
        ("t", 9, 8, "user", "below a cycle", 0.0),
        ("t", 10, 9, "user", "further below", 0.0),
        ("t", 11, 11, "user", "its own answer", 0.0),
        (None, 1, None, None, "no tree", None),
        ("l", 1, None, "user", "0", 0.0),
        *(("l", k, k - 1, "assistant", str(k), 0.0) for k in range(2, 12)),
    ]
    messages = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double").withColumn("rank", chat.F.lit(9))
    paths = defaultdict(list)
    for r in chat.reply_paths(messages, Scratch(spark, "t")).collect():
        paths[r["tree"], r["leaf"]].append((-r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {
        ("t", 2): [1, 2], ("t", 5): [1, 3, 4, 5], ("t", 6): [6], (None, 1): [1], ("l", 11): list(range(1, 12)),
    }
    best = chat.conversations(messages, Scratch(spark, "t")).select(
        "*", chat.read_back(chat.F.col("formatted")).alias("turns"), chat.under_mask(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")
    )
    got = {(r["tree"], r["root"]): r for r in best.collect()}
    assert [tuple(t) for t in got["t", 1]["turns"]] == [("user", "root"), ("assistant", "better"), ("user", ""), ("assistant", "é end")]
    assert got["t", 1]["loss"] == "betteré end"
    assert [tuple(t) for t in got[None, 1]["turns"]] == [("", "no tree")]
    both = chat.conversations(messages.where("tree = 't'"), Scratch(spark, "t"), top=2).where("root = 1 AND leaf = 2")
    r = both.select(chat.read_back(chat.F.col("formatted")).alias("turns"), chat.under_mask(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")).first()
    assert r["turns"][1]["text"] == odd and r["loss"] == odd
    assert chat.conversations(empty(messages), Scratch(spark, "t")).count() == 0


def test_branches_against_brute_force(spark):
    rng = np.random.default_rng(13)
    rows = []
    for tree in range(4):
        for node in range(60):
            parent = int(rng.integers(0, node)) if node > 2 and rng.random() < 0.95 else None
            rows.append((tree, node, 50 + int(rng.integers(0, 10)) if 50 <= node and tree % 2 else parent, "user" if node % 2 else "assistant", f"{tree}.{node}", float(rng.integers(0, 5))))
    parents, scores = {(t, n): p for t, n, p, *_ in rows}, {(t, n): s for t, n, *_, s in rows}
    want = {}
    for t, n, *_ in rows:
        if n not in {p for (u, _), p in parents.items() if u == t}:
            path, at = [n], n
            while parents[t, at] is not None and len(path) <= 60:
                at = parents[t, at]
                path.append(at)
            if len(path) <= 60:
                want[t, n] = path[::-1]
    messages = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, score double").repartition(3)
    paths = defaultdict(list)
    for r in chat.reply_paths(messages, Scratch(spark, "t")).collect():
        paths[r["tree"], r["leaf"]].append((-r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == want and len(want) < 4 * 60
    best = defaultdict(list)
    for (t, leaf), path in want.items():
        best[t, path[0]].append((-round(np.mean([scores[t, n] for n in path]), 9), -len(path), leaf))
    done = chat.conversations(messages, Scratch(spark, "t"), top=2).select("tree", "root", "leaf", "rank", chat.read_back(chat.F.col("formatted")).alias("turns"))
    got = {(r["tree"], r["root"], r["rank"]): (r["leaf"], [x["text"] for x in r["turns"]]) for r in done.collect()}
    chosen = {(*k, i + 1): (x[2], [f"{k[0]}.{n}" for n in want[k[0], x[2]]]) for k, v in best.items() for i, x in enumerate(sorted(v)[:2])}
    assert got == chosen


def test_flat_conversations_keep_repeated_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", None)]
    done = chat.conversations(chat.sequence_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), Scratch(spark, "t"))
    got = {r["tree"]: [tuple(t) for t in r["turns"]] for r in done.select("tree", chat.read_back(chat.F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("assistant", "b")], None: [("user", "")]}


# 5


def test_quality_learns_and_keeps_every_row(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        t = prose(rng, int(rng.integers(20, 80)))
        rows.append((i, t if good else t.replace(" ", "!! ").upper()))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    learnt = spark.createDataFrame(labels[:400] + labels[:10] + [(None, 1), (3, None)], "doc_id long, label int")
    scored, model = quality.classify(docs, learnt, Scratch(spark, "t"))
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels[400:]]) > 0.97
    clash = docs.withColumn("_stats", chat.F.lit("x")).withColumn("score", chat.F.lit("y")).withColumn("label", chat.F.lit(0))
    kept = quality.keep_good(clash, learnt, Scratch(spark, "t"))
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    passed = quality.classify(clash, learnt, Scratch(spark, "t"))[0]
    assert passed.columns == ["doc_id", "_stats", "label", "score"] and passed.where("score < 0 OR score > 1 OR _stats <> 'x'").count() == 0
    assert quality.keep_good(docs, learnt.where("false"), Scratch(spark, "t")).count() == len(rows)
    assert quality.keep_good(empty(docs), learnt, Scratch(spark, "t")).count() == 0
    none, _ = quality.classify(docs, learnt.where("false"), Scratch(spark, "t"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.classify(empty(docs), learnt, Scratch(spark, "t"))[0].count() == 0


def test_quality_against_the_closed_form(spark):
    """Weights, calibration and scores as from one matrix of all labelled texts in memory."""
    rng = np.random.default_rng(15)
    texts = [prose(rng, int(n)) if i % 4 else prose(rng, int(n)).replace(" ", "; ").upper() for i, n in enumerate(rng.integers(1, 60, 300))] + [prose(rng, 30_000), ""]
    labels = [(i, float(i % 4 > 0) if rng.random() < 0.9 else 0.0) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    marks = spark.createDataFrame(labels, "doc_id long, label double")
    scored, model = quality.classify(docs, marks, Scratch(spark, "t"))
    stats = np.stack([quality.statistics(t) for t in texts])
    y = np.array([v for _, v in labels])
    mean, scale = stats.mean(0), stats.std(0)
    scale[scale < 1e-9] = 1
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, atol=1e-6)
    z = np.clip((stats - mean) / scale, -6, 6)
    n_waves = len(model.phase)
    x = np.hstack([np.sqrt(2 / n_waves) * np.cos(z @ model.omega + model.phase), z / 10, np.ones((len(z), 1))])

    def ridge(rows):
        return np.linalg.solve(x[rows].T @ x[rows] + 1e-3 * rows.sum() / (x.shape[1] + 1) * np.eye(x.shape[1]), x[rows].T @ y[rows])

    weights = ridge(np.ones(len(y), dtype=bool))
    assert np.allclose(x @ model.weights, x @ weights, atol=1e-6)
    folds = docs.select("doc_id", chat.F.pmod(chat.F.xxhash64(chat.F.lit(5), "doc_id"), chat.F.lit(quality.FOLDS)).alias("fold")).toPandas().set_index("doc_id")["fold"].sort_index().to_numpy()
    others = np.zeros(len(y))
    for f in range(quality.FOLDS):
        others[folds == f] = x[folds == f] @ ridge(folds != f)
    at = np.clip((others - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    rates = {}
    for b in sorted(set(at)):  # the greatest lower mean over all runs of bins is the isotonic fit
        lows = [min(y[(at >= a) & (at <= c)].mean() for c in set(at) if c >= b) for a in set(at) if a <= b]
        rates[b] = max(lows)
    assert set(np.round(model.ys, 6)) == {round(float(r), 6) for r in rates.values()}
    got = scored.toPandas().set_index("doc_id")["score"].sort_index().to_numpy()
    assert np.allclose(got, np.interp(x @ weights, model.xs, model.ys), atol=1e-5)


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [0.0, 1.5, 3.0]


# 6


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("chunk_bytes", "fan"), [(1500, 2), (1500, 256), (8 << 20, 256)])
def test_similar_groups_against_brute_force(spark, docs, texts, chunk_bytes, fan):
    clash = docs.withColumn("sid", chat.F.lit("x")).withColumn("chunk", chat.F.lit("y"))
    got = [tuple(r) for r in jaccard.similar_groups(clash, Scratch(spark, "t"), chunk_bytes=chunk_bytes, fan=fan).collect()]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    want = [(i, len(s), find(i)) for i, s in enumerate(sets)] + [(None, len(sets[3]), None), (5, len(sets[5]), find(5))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({find(i) for i in range(60, 85)}) < 25
    if chunk_bytes > 2000:
        kept = [r["doc_id"] for r in jaccard.one_of_each(docs, Scratch(spark, "t")).collect()]
        assert sorted(-1 if k is None else k for k in kept) == sorted([-1, *(i for i in range(len(sets)) if find(i) == i)])
        assert jaccard.similar_groups(empty(docs), Scratch(spark, "t")).count() == 0


def test_a_null_key_does_not_hide_its_copy(spark):
    rng = np.random.default_rng(6)
    text = prose(rng, 80)
    rows = [(None, text), (1, text), (2, text + " more"), (None, prose(rng, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs, Scratch(spark, "t")).collect()}
    assert got == {None: None, 1: 1, 2: 1}


# 7


def test_line_dedup_finds_later_copies(spark):
    rng = np.random.default_rng(7)
    line = lambda n: prose(rng, n, 100_000)
    passage = [line(20), line(25), line(20)]
    short = line(10)
    a = "\n".join([line(9), *passage, line(9), short])
    b = "\n".join([short, line(9), "", *passage[:2], "", passage[2], line(8)])
    c = "\n".join([*passage, *passage, line(5)])
    rows = [(1, a), (2, b), (3, c), (4, a), (5, "tiny text"), (6, "tiny text"), (7, None), (8, ""), (None, a), (9, "\n".join([short, line(9)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", chat.F.lit(0))
    got = {r["doc_id"]: list(r["removed"]) for r in lines.removals(docs, Scratch(spark, "t")).collect()}
    assert got == {1: [], 2: [3, 4, 6], 3: [0, 1, 2, 3, 4, 5], 4: list(range(6)), 5: [], 6: [], 7: [], 8: [], None: list(range(6)), 9: []}
    cleaned = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs, Scratch(spark, "t")).collect()}
    assert cleaned[1] == a and cleaned[3] == c.split("\n")[6] and cleaned[4] == "" and cleaned[7] is None
    assert cleaned[2] == "\n".join(x for i, x in enumerate(b.split("\n")) if i not in (3, 4, 6))
    assert lines.removals(empty(docs), Scratch(spark, "t")).count() == 0


def test_line_dedup_of_very_long_texts(spark):
    rng = np.random.default_rng(17)
    body = [prose(rng, 12, 100_000) for _ in range(3000)]
    rows = [(1, "\n".join(body), "x"), (2, "\n".join([*body[500:2500], "own words"]), "y"), (3, " ".join(body), "z"), (3, " ".join(body), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string").withColumn("_quire_text", chat.F.lit("clash"))
    got = {(r["doc_id"], r["n_lines"]): list(r["removed"]) for r in lines.removals(docs, Scratch(spark, "t")).collect()}
    assert got == {(1, 3000): [], (2, 2001): list(range(2000)), (3, 1): []}
    cleaned = lines.without_repeats(docs, Scratch(spark, "t"))
    assert cleaned.columns == docs.columns and {r["doc_id"]: r["text"] for r in cleaned.collect()}[2] == "own words"


def repeated_lines(texts, min_words=50):
    """Places of lines in runs that occur before, by trying all runs; texts without blank lines, none twice."""
    runs, out = set(), []
    for t in texts:
        split = t.split("\n")
        gone = set()
        spans = [(i, j) for j in range(1, len(split) + 1) for i in range(j) if len(words(" ".join(split[i:j]))) >= min_words]
        for i, j in spans:  # by their ends, so an overlapping occurrence further up is known
            run = tuple(split[i:j])
            if run in runs:
                gone.update(range(i, j))
            runs.add(run)
        out.append(sorted(gone))
    return out


def test_line_dedup_follows_every_earlier_copy(spark):
    rng = np.random.default_rng(11)
    long, tail = prose(rng, 60), prose(rng, 10)
    texts = [f"{long}\n{prose(rng, 9)}", f"{long}\n{tail}", f"{long}\n{tail}\n{prose(rng, 3)}"]
    stock = [prose(rng, int(n)) for n in rng.integers(1, 30, 12)]
    for _ in range(40):
        parts = [stock[k : k + int(rng.integers(2, 7))] for k in rng.integers(0, 10, 4)]
        texts.append("\n".join(itertools.chain(*parts, [prose(rng, 4)])))
    want = dict(enumerate(repeated_lines(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["removed"]) for r in lines.removals(docs, Scratch(spark, "t")).collect()}
    assert want[2] == [0, 1]
    assert got == want


# 8


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(900):
        domain = ("good", "low", "toxic")[i % 3]
        rows.append((i, " ".join(f"{domain if rng.random() < 0.3 else 'any'}{int(k)}" for k in rng.integers(0, 9, 60)), f"s{i}"))
        labels.append((i, domain))
    rows += [(None, "any1 any2", "s"), (5000, None, "s"), (5001, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    marks = spark.createDataFrame([*labels[:600], labels[0], (None, "low"), (7, None)], "doc_id long, domain string")
    weights = {"good": 0.7, "low": 0.2, "toxic": 0.1, "unknown": 0.5}
    rated, model, _ = mixing.mix(docs, marks, weights, Scratch(spark, "t"))
    got = rated.toPandas()
    assert len(got) == len(rows) and (got["rate"] >= 0).all() and model.domains == ["good", "low", "toxic"]
    totals = [(got["rate"] * got["n_tokens"] * got[f"p{k}"]).sum() for k in range(3)]
    assert np.array(totals) / sum(totals) == pytest.approx([0.7, 0.2, 0.1], abs=1e-4)
    assert abs(got["copies"].sum() - got["rate"].sum()) < 5 * len(rows) ** 0.5
    held = got[(got["doc_id"] >= 600) & (got["doc_id"] < 900)]
    best = held[["p0", "p1", "p2"]].to_numpy().argmax(1)
    assert (best == held["doc_id"].to_numpy() % 3).mean() > 0.95
    taken = mixing.take(docs, marks, {"good": 0.98, "low": 0.01, "toxic": 0.01}, Scratch(spark, "t"), anchor="good")
    counts = Counter(r["doc_id"] for r in taken.collect())
    assert taken.columns == docs.columns and np.mean([counts[i] == 1 for i in range(0, 900, 3)]) > 0.95
    assert np.mean([counts[i] == 0 for i in range(2, 900, 3)]) > 0.8
    assert mixing.take(empty(docs), marks, weights, Scratch(spark, "t")).count() == 0
    assert mixing.mix(empty(docs), marks, weights, Scratch(spark, "t"))[0].count() == 0
    clash = docs.withColumns({"P0": chat.F.lit("x"), "_words": chat.F.lit("y"), "n_tokens": chat.F.lit(1), "domain": chat.F.lit("z")})
    again = mixing.take(clash, marks, {"good": 0.98, "low": 0.01, "toxic": 0.01}, Scratch(spark, "t"), anchor="good")
    assert again.columns == clash.columns and Counter(r["doc_id"] for r in again.collect()) == counts


def test_mixing_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([(9, "good"), (1, None), (None, "low")], "doc_id long, domain string")
    for labels in (none, none.where("false")):
        rated, model, moved = mixing.mix(docs, labels, {"good": 1.0}, Scratch(spark, "t"))
        assert (model.domains, moved) == ([], [])
        assert Counter(map(tuple, rated.collect())) == Counter({(1, 2, 1.0, 1): 2, (2, 0, 1.0, 1): 1, (None, 0, 1.0, 1): 1})
        assert mixing.take(docs, labels, {"good": 1.0}, Scratch(spark, "t")).count() == 4


@pytest.mark.parametrize(("weights", "passes"), [((0.7, 0.2, 0.1), 20), ((0.1, 0.1, 0.8), 20), ((0.98, 0.01, 0.01), 20), ((0.0, 0.5, 0.5), 12)])
def test_rates_against_a_slow_solver(spark, weights, passes):
    """Against tens of thousands of short steps in memory: the same rates, which are the nearest to 1 that meet the targets; targets that none meet are neared."""
    rng = np.random.default_rng(16)
    n = 400
    p = rng.dirichlet([0.6, 0.2, 0.1], n)
    t = rng.integers(1, 200, n).astype(float)
    rows = spark.createDataFrame([(i, int(x), *map(float, q)) for i, (x, q) in enumerate(zip(t, p, strict=True))], "i int, n_tokens long, p0 double, p1 double, p2 double").coalesce(2)
    moved = mixing.fit_rates(rows, ["a", "b", "c"], dict(zip("abc", weights, strict=True)), passes=passes)
    got = rows.select("i", mixing.rate(moved).alias("r")).toPandas().sort_values("i")["r"].to_numpy()
    target = np.array(weights) * t.sum()
    off = lambda r: np.linalg.norm((r * t) @ p - target) / t.sum()
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    direct, total = np.ones(n), np.zeros(3)
    for _ in range(30_000):
        direct = np.maximum(0, direct - step * p @ ((direct * t) @ p - target))
        total += step * ((np.maximum(0, 1 - p @ total) * t) @ p - target)
    assert (got >= 0).all()
    if weights[0]:
        slow = np.maximum(0, 1 - p @ total)
        assert off(got) < 1e-7 and np.abs(got - slow).max() < 1e-2 * max(1, slow.max())
        assert (t * (got - 1) ** 2).sum() <= (t * (direct - 1) ** 2).sum() * (1 + 1e-3) or off(direct) > 1e-4
    else:
        assert off(direct) > 0.01 and off(got) < off(np.ones(n)) / 2


# 9


def test_sharding_is_even_gapless_and_whole(spark, docs, texts):
    out = sharding.shard(docs, n_shards=4, bucket_bytes=3000)
    got = out.toPandas()
    assert len(got) == len(texts) + 2 and set(out.columns) == set(docs.columns) | {"slot"}
    sizes = got["shard"].value_counts()
    assert sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    again = sharding.shard(docs.repartition(2), n_shards=4, bucket_bytes=3000).toPandas()
    where = lambda p: sorted(zip(p["doc_id"].fillna(-1), p["text"].fillna(""), p["shard"], p["slot"], strict=True))
    assert where(got) == where(again)
    digest = sharding.digest(out).toPandas().set_index("slot")
    assert (digest["law"] == "rows").all() and digest["grown_shard"].isna().all()
    row = sharding.digest(out.where("text = 'one two'")).first()
    assert (row["size"], row["text_crc32"]) == (8, zlib.crc32(b"one two"))
    assert sharding.shard(empty(docs)).count() == 0


@pytest.mark.parametrize("share", [1, 9, 11, 60])
def test_sharding_with_a_hot_key_against_brute_force(spark, share):
    """One key, its rows all alike but for some, holds `share` % of the rows; the result hangs on the rows alone."""
    hot = share * 10
    rows = [(7, "same" if i % 5 else f"t{i}", None) for i in range(hot)] + [(i, f"x{i % 50}", "c") for i in range(1000 - hot - 3)] + [(None, None, None)] * 3
    wants = None
    for parts in (1, 3, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string, _bucket string").repartition(parts)
        got = sharding.shard(docs, n_shards=3, bucket_bytes=500).collect()
        assert Counter((r["doc_id"], r["text"], r["_bucket"]) for r in got) == Counter(rows)
        order = sorted((r["slot"] * 3 + r["shard"], r["doc_id"] or -1, r["text"] or "") for r in got)
        assert [g for g, *_ in order] == list(range(1000))
        wants = wants or order
        assert order == wants
    # hashed numbers of copies, not runs: rows that are alike are not next to each other more than by chance
    same = [x[2] == "same" for x in wants]
    met, by_chance = sum(a and b for a, b in itertools.pairwise(same)), sum(same) ** 2 / 1000
    assert met <= by_chance + 6 * max(1, by_chance) ** 0.5


def test_sharding_of_maps(spark):
    rows = spark.range(40).selectExpr("id % 4 AS doc_id", "'t' AS text", "map('a', id % 8) AS m")
    got = sharding.shard(rows, n_shards=2, bucket_bytes=20).toPandas()
    assert Counter((r.doc_id, r.m["a"]) for r in got.itertuples()) == Counter((i % 4, i % 8) for i in range(40))


def test_shards_are_written_in_order(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard(docs, n_shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


# 10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href="/a">A, b, c, d</a></li></ul></nav><div class="cookie-notice">We, use, cookies, a, lot, of, them</div>{body}
<div class="sidebar"><p>Side, text, with, many, commas, in, it</p></div><form><p>Sign, up, now</p></form>
<section id="comments"><p>Nice, post, I, think, so, yes, indeed, really</p></section><footer>&copy; me</footer><script>var a="</p>";</script></body></html>"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head &amp; shoulders</h1><p><b>One,\n two<br><p>Three</p><!-- no --><p>&nbsp;</p></article>", "Head & shoulders\nOne, two\nThree"),
        ("<div class='post'><h2>Title</h2><p>First, second, third and more words.</p><ul><li>x<li>y</ul><div class=ad>Buy, it</div></div>", "Title\nFirst, second, third and more words.\nx\ny"),
        ("<main><header><h1>T</h1><p>by me</p></header><table><tr><td>1<td>2<tr><td>3</table><p>End, of it</p></main>", "T\n1 2\n3\nEnd, of it"),
        ("<div><section><p>" + "aa, bb " * 30 + "</p></section><section><p>" + "cc, dd " * 30 + "</p></section></div>", ("aa, bb " * 30).strip() + "\n" + ("cc, dd " * 30).strip()),
    ],
)
def test_main_text(body, want):
    assert html_text.main_text(PAGE.format(body=body)) == want


def test_names_need_support_from_the_text():
    said = "We found this, as others did, and say so at some length here."
    links = "<a href=/x>One story, of many</a> <a href=/y>Another story, of many</a>"
    parts = f"<section id='discussion'><h2 id='search-strategy'>Search</h2><p>{said}</p></section><div class='related'>{links}</div><div class='ad'>Buy, it</div>"
    for around in ("article", "div"):
        got = html_text.main_text(PAGE.format(body=f"<{around}><h1>Head</h1><p>{'aa, bb ' * 30}</p>{parts}<p hidden>{said} {said}</p></{around}>"))
        assert got == f"Head\n{('aa, bb ' * 30).strip()}\nSearch\n{said}"
    plain = f"<body><div class='content has-sidebar'><h1>Head</h1><p>{said}</p></div></body>"
    assert html_text.main_text(plain) == f"Head\n{said}"


def slow_container(tree):
    """The best container by the rule as it is written: every element's points and link density from scratch, from nested lists (tag, children)."""
    blocks, parents, order = [], {}, []

    def visit(node, up):
        parents[id(node)] = up
        order.append(node)
        for c in node[1]:
            if isinstance(c, str):
                blocks.append((node, c))
            else:
                visit(c, node)

    visit(tree, None)

    def chain(node):
        return [] if node is None else [node, *chain(parents[id(node)])]

    def above(node):
        return chain(parents[id(node)] if node[0] == "p" else node)

    def points(text):
        return 1 + text.count(",") + min(len(text) // 100, 3)

    def score(n):
        total = 0.0
        for own, text in blocks:
            for level, up in enumerate(above(own)):
                if up is n:
                    total += points(text) * (1 if level == 0 else 1 / (2 * level))
        return total

    scores = [(score(n), -k) for k, n in enumerate(order) if any(any(u is n for u in above(own)) for own, _ in blocks)]
    best = order[-max(scores)[1]]
    out = []
    for own, text in blocks:
        up = chain(own)
        inside = any(u is best for u in up)
        sibling = None
        if not inside and parents[id(best)] is not None and best[0] != "body":
            for u, over in itertools.pairwise(up):
                if over is parents[id(best)]:
                    sibling = u
        if inside or sibling is not None and (sibling[0] == "p" or score(sibling) >= max(1.0, 0.2 * score(best))):
            out.append(text)
    return "\n".join(out)


def test_main_text_against_a_slow_scorer():
    rng = np.random.default_rng(18)

    def grow(depth):
        out = []
        for _ in range(int(rng.integers(1, 5))):
            if depth and rng.random() < 0.5:
                out.append(("div", grow(depth - 1)))
            else:
                out.append(("p", [" ".join(prose(rng, int(rng.integers(3, 40))).split()) + ", and" * int(rng.integers(0, 6))]))
        return out

    def markup(node):
        return f"<{node[0]}>" + "".join(c if isinstance(c, str) else markup(c) for c in node[1]) + f"</{node[0]}>"

    for _ in range(150):
        tree = ("html", [("body", grow(4))])
        assert html_text.main_text(markup(tree)[6:-7]) == slow_container(tree)


def test_main_text_of_odd_pages(spark):
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain", "<p>a<p>b", "x &lt;b&gt;\ty", "<script>if(a<b)", "<!-- open")] == ["", "", "", "plain", "a\nb", "x <b> y", "", ""]
    long = "<article>" + "".join(f"<p>Part {i}, of many, and some words more.</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999
    assert html_text.main_text("<noscript><div><p>first, of all</p><template><p>second, of all</p></div>") == "first, of all\nsecond, of all"
    deep = "<div>" * 3000 + "<p>in, here</p>"
    assert html_text.main_text(deep) == "in, here"
    pages = spark.createDataFrame([(1, "u", None, "old"), (2, "u", "<p>a, b</p>", "old"), (2, "u", "<p>a, b</p>", "old")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text"] and sorted(r["text"] for r in got.collect()) == ["", "a, b", "a, b"]
    assert html_text.extract(pages.where("false")).count() == 0


