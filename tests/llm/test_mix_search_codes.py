"""Mixing, lexical search and vector codes next to brute-force versions, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cartoload.llm import lexical, mixing, vectorcodes

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, size string, target int, TAKEN string, range int, start int"
LONG = "long words of one text " * 20_000
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "five words and no more", "b"), (5, "five words and no more", "b"), (5, "other words", "b"),
       (None, "no id at all", "é"), (None, "no id at all", "é"), (7, "one", None), (8, None, "only nulls")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, "x", 1, "x", 1, 1) for i, t, s in ODD], SCHEMA)


# ------------------------------------------------------------------------------------------- mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, want = set(), share * sum(sizes.values())
    while True:
        open_ones = [s for s in order if s not in full]
        level = (want - most * sum(sizes[s] for s in full)) / max(sum(weight[s] for s in open_ones), 1)
        above = {s for s in open_ones if level * weight[s] >= most * sizes[s]}
        if not above:
            return order, {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


def plain_seats(order, target, seats):
    held = Counter()
    for _ in range(seats):
        held[max((s for s in order if target[s] > 0), key=lambda s: (target[s] / (2 * held[s] + 1), -order.index(s)))] += 1
    return held


def test_mix(spark, odd):
    mixed, shards = mixing.mix(spark, odd, shard_blocks=1000)
    rows = mixed.collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ODD]
    assert sorted(map(str, ((r.doc_id, r.source, r.size) for r in rows))) == sorted(map(str, ((i, s, n) for (i, _, s), n in zip(ODD, words))))
    sizes = Counter()
    for (_, _, s), n in zip(ODD, words):
        sizes[s] += n
    order, target = plain_targets(sizes)
    held = plain_seats(order, target, int(1.5 * sum(sizes.values()) / 16 + 0.5))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == min(16 * held[s], 2 * sizes[s]) for s in order)
    # The shards up to any one are an apportionment of their seats.
    upto, seats = Counter(), 0
    by_shard = defaultdict(Counter)
    for q in shards.collect():
        by_shard[q.shard][q.source] += q.blocks
    for number in sorted(by_shard):
        upto, seats = upto + by_shard[number], seats + sum(by_shard[number].values())
        assert upto == +plain_seats(order, target, seats)
        assert seats == min(1000 * number, sum(held.values()))


def test_mix_pieces(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mixed, shards = mixing.mix(spark, docs, shard_blocks=50)
    quota = {(q.shard, q.source): (q.first * 16, (q.first + q.blocks) * 16) for q in shards.collect()}
    rows = mixed.collect()
    tape_end = {r.source: 2 * r.source_size for r in rows}
    by_doc, by_shard = Counter(), defaultdict(list)
    for p in mixing.pieces(mixed, shards).collect():
        by_doc[p.doc_id] += p.length
        by_shard[p.shard, p.source].append((p.at, p.at + p.length))
    assert by_doc == +Counter({r.doc_id: r.taken for r in rows})
    for key, (first, last) in quota.items():
        place = first
        for start, end in sorted(by_shard[key]):
            assert start == place
            place = end
        assert place == min(last, max(tape_end[key[1]], first))
    again = mixing.mix(spark, docs.repartition(7), shard_blocks=50)[0]
    assert sorted(r.taken for r in again.collect()) == sorted(r.taken for r in rows)
    assert {r.doc_id: r.taken for r in again.collect()} == {r.doc_id: r.taken for r in rows}


def test_mix_of_nothing(spark, odd):
    for rows in (odd.where("false"), odd.where("doc_id in (1, 2, 3)")):
        mixed, shards = mixing.mix(spark, rows)
        assert [(r.size, r.source_size, r.target, r.taken) for r in mixed.collect()] == [(0, 0, 0.0, 0)] * rows.count()
        assert shards.count() == 0 and mixing.pieces(mixed, shards).count() == 0


def test_mix_of_many_sources(spark):
    rows = [(k, "w " * (1 + k * k % 97), f"s{k % 61:02d}") for k in range(600)] + [(k, "w " * 50, "s00") for k in range(600, 900)]
    mixed, shards = mixing.mix(spark, spark.createDataFrame(rows, "doc_id int, text string, source string"), block=4, shard_blocks=37)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order, target = plain_targets(sizes)
    seats = int(1.5 * sum(sizes.values()) / 4 + 0.5)
    got = Counter()
    for q in shards.collect():
        got[q.source] += q.blocks
    assert got == +plain_seats(order, target, seats)
    assert all(abs(4 * got[s] - target[s]) <= 4 for s in order)


# ------------------------------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, top=20):
    cut = [(name, Counter(plain_terms(text))) for name, text in docs]
    cut = [(name, terms, sum(terms.values())) for name, terms in cut if terms]
    count, total = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, terms, _ in cut for t in terms)
    out = []
    for item, text in items:
        asked, scored = Counter(plain_terms(text)), []
        for name, terms, n in cut:
            m = 100 - 25 + 25 * n * count // total
            score = sum(c * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * terms[t] // (1000 * terms[t] + 12 * m)) for t, c in asked.items() if t in terms)
            if score > 0:
                scored.append((-score, name is None, name))
        out += [(item, rank, name, -score) for rank, (score, _, name) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def test_terms():
    import pyarrow as pa

    texts = ["Ab-c_9 Éß\x7fΣ`z", None, "", "  lead", "[\\]^", "漢字 a b", "x" * 100_000]
    for whole in (pa.array(texts), pa.array(["skipped", *texts])[1:]):
        terms, n = lexical.cut_terms(whole)
        assert terms.to_pylist() == [t for x in texts for t in plain_terms(x)] and n.tolist() == [len(plain_terms(x)) for x in texts]
    assert [[t.decode() for t in lexical.terms_of(x)] for x in texts] == [plain_terms(x) for x in texts]


@pytest.mark.parametrize("sizes", [{}, {"POSTINGS": 300, "MASK_BYTES": 400}])
def test_search(spark, odd, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    docs = odd.select("doc_id", "text", "start", "target").union(spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "text", "1", "1"))
    many = " ".join(sorted({t for r in docs.collect() for t in plain_terms(r.text)[:40]})[:150])
    items = [(1, "the WORDS of long words"), (2, None), (3, ""), (None, "five words"), (4, "nowhere-to-be-found"), (5, many), (1, "é one"), *[(k + 10, r.text) for k, r in enumerate(docs.limit(12).collect())]]
    asked = spark.createDataFrame([(i, t, "x", 9) for i, t in items], "item_id int, text string, rank string, score int")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], items)
    for batch_bytes in (lexical.BATCH_BYTES, 2_000):
        got = lexical.search(spark, docs, asked, batch_bytes=batch_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_nothing(spark, odd):
    items = spark.createDataFrame([(1, "words")], "item_id bigint, text string")
    assert lexical.search(spark, odd.where("false"), items).count() == 0
    assert lexical.search(spark, odd.where("doc_id < 3"), items).count() == 0
    assert lexical.search(spark, odd, items.where("false")).count() == 0


def test_search_of_copies(spark):
    """Ties over many equal documents go by id; most groups are never evaluated."""
    rows = [(k, "same words in every copy" if k % 3 else f"other words {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = lexical.search(spark, docs, spark.createDataFrame([(1, "same copy"), (2, "words")], "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, [(1, "same copy"), (2, "words")])


# ---------------------------------------------------------------------------------------- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(-(-max(len(v) for _, v, _ in kept) // parts), 1)
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [tuple(v[p * width:(p + 1) * width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    for turn in range(rounds + 1):
        coded = [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))] for _, v, _ in kept]
        if turn == rounds:
            break
        for p in range(parts):
            members = defaultdict(list)
            for (_, v, _), near in zip(kept, coded):
                members[near[p][1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if members[k] else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, label, "".join(f"{k:02x}" for _, k in near), sum(far for far, _ in near)) for (i, _, label), near in zip(kept, coded)], digest


def drawn_vectors(n, size, seed=7):
    draw = np.random.default_rng(seed)
    return [(k, draw.normal(scale=0.2, size=size).astype(np.float32).tolist(), k % 5 or None) for k in range(n)]


def test_vector_codes(spark):
    rows = drawn_vectors(300, 32)
    rows += [(300 + k, rows[k % 7][1], 9) for k in range(150)]  # one vector of seven, again and again
    rows += [(5, rows[3][1], 1), (None, rows[4][1], 1), (600, [0.0] * 32, 2), (601, [0.0, -0.0] * 16, 2), (602, None, 1), (603, rows[0][1][:-1] + [float("nan")], 1),
             (604, rows[0][1][:-1] + [None], 1), (605, [float("-inf")] * 32, None), (606, [0.5] * 5, 3), (607, [], 3), (608, [300.25, -4000.0] * 16, 3)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id int, embedding array<float>, label int, CODE string, far int").repartition(4)
    coded, books = vectorcodes.compress(spark, frame)
    want, digest = plain_codes(rows)
    assert books.sha256() == digest
    assert sorted(map(tuple, coded.collect()), key=str) == sorted(want, key=str)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    got = vectorcodes.with_label_errors(spark, coded).collect()
    assert len(got) == len(want) and all(r.label_error == sums[r.label] for r in got)


def test_few_vectors(spark):
    schema = "vec_id bigint, embedding array<double>, label string"
    for rows in ([(1, [0.1] * 16, "a")], [(k, [0.1 * k, 3.0], None) for k in range(5)]):
        coded, books = vectorcodes.compress(spark, spark.createDataFrame(rows, schema))
        want, digest = plain_codes(rows)
        assert sorted(map(tuple, coded.collect())) == sorted(want) and books.sha256() == digest
    for rows in ([], [(1, None, "a")]):
        coded, books = vectorcodes.compress(spark, spark.createDataFrame(rows, schema))
        assert books is None and vectorcodes.with_label_errors(spark, coded).count() == 0


def test_pivots_prune():
    draw = np.random.default_rng(1)
    x = draw.integers(-200, 200, size=(2000, 4))
    books = vectorcodes.Codebooks(x[:64], parts=1)
    entries, pivots = books.entries[0], books.pivots[0]
    entry, best, evaluated = vectorcodes.nearest(x, vectorcodes.pivot_distances(x[:, None], books.pivots)[:, 0], entries, pivots)
    all_far = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (entry == all_far.argmin(1)).all() and (best == all_far.min(1)).all()
    assert evaluated < 0.3 * all_far.size
