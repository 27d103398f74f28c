"""Manifest, run detection and decontamination against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from courierflow.llm import decontamination, merkle_manifest, periodic_runs

# ---- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        leaf = sha("".join(map(framed, row)))
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        low = row[4] and re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
        other = sha("".join(map(framed, (*row[:4], low)))) if changed else leaf
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf, other, row[0]))

    def climb(nodes, at, value):
        proof = ""
        while len(nodes) > 1:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            proof += "".join(x for k, x in enumerate(run) if k != at % 16)
            value = sha("".join(value if k == at % 16 else x for k, x in enumerate(run)))
            nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            at //= 16
        return nodes[0], proof, value

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots = [climb([r[2] for r in sorted(trees[s])], 0, "")[0] for s in names]
    out = []
    for k, name in enumerate(names):
        leaves = sorted(trees[name])
        for i, (_, _, leaf, other, doc_id) in enumerate(leaves):
            subroot, proof, value = climb([r[2] for r in leaves], i, other)
            root, above, folded = climb(subroots, k, value)
            out.append((doc_id, leaf, subroot, root, sha(proof + above), folded, folded == root))
    return sorted(out, key=str)


def documents_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("seed", range(3))
def test_manifest_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "", "a", "b", "é", "\U0001f600", *(f"s{i}" for i in range([0, 20, 300][seed]))]
    rows = []
    for source in sources:
        for _ in range(rnd.choice([1, 2, 16, 17, 40])):
            text = rnd.choice([None, "", "Words Ähm", "lower", "X" * 2000])
            rows.append((rnd.choice([None, *range(500)]), source, rnd.choice([None, "en"]), rnd.choice([None, 3]), text))
    rows += [(i, "hot", "en", 1, f"Text {i}") for i in range(300)] + rows[:5]
    docs = documents_of(spark, rows).withColumn("tree", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("size", F.lit(0))
    assert sorted(map(tuple, merkle_manifest.manifest(docs).collect()), key=str) == brute_manifest(rows)


def test_manifest_of_little(spark):
    assert merkle_manifest.manifest(documents_of(spark, [])).collect() == []
    for rows in ([(None,) * 5], [(0, "a", "en", 1, "A")], [(0, "a", "en", 1, "A"), (0, "a", "en", 1, "A")], [(0, "a", None, 1, "A"), (1, "b", None, 1, "A")]):
        assert sorted(map(tuple, merkle_manifest.manifest(documents_of(spark, rows)).collect()), key=str) == brute_manifest(rows)


def test_only_real_changes_are_noticed(spark):
    docs = documents_of(spark, [(i, "a", "en", 1, "small" if i % 2 else "Large") for i in range(100)])
    found = merkle_manifest.manifest(docs, tampered=F.lit(True)).collect()
    assert {r["doc_id"] for r in found if r["verified"]} == set(range(1, 100, 2))


# ---- runs


def brute_runs(words, shortest=12):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i - start + period >= max(shortest, 2 * period):
                found.setdefault((start, i + period), period)
            i += i == start
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), st.integers(1, 6)), max_size=4), min_size=1, max_size=4
    )
)
def test_runs_match_brute_force(parts):
    texts = [[w for words, times in text for w in words * times] for text in parts]
    found = periodic_runs.text_runs(texts)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(t) for t in texts]


def test_extensions_match_direct_comparison():
    rnd = random.Random(5)
    row = [rnd.randint(1, 2) for _ in range(400)]
    row = row[:300] + row[100:300] + [1] * 200 + row[:150] + [3]
    ahead = periodic_runs.Extensions(np.array(row, np.int64))
    pairs = [(i, j) for i in range(0, len(row), 3) for j in range(i + 1, len(row), 7)]
    i, j = np.array(pairs).T
    wanted = []
    for a, b in pairs:
        n = 0
        while b + n < len(row) and row[a + n] == row[b + n]:
            n += 1
        wanted.append(n)
    assert ahead.common(i, j).tolist() == wanted


def test_a_long_text_of_one_word():
    assert periodic_runs.text_runs([[b"x"] * 60000, [b"y"], []])[0].tolist() == [[0, 60000, 1]]


def test_more_open_places_than_are_held(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    words = [b"a", b"b"] * 300 + [b"c"] + [b"d"] * 40
    assert [tuple(r) for r in periodic_runs.text_runs([words, words])[1].tolist()] == brute_runs(words)


def test_find_runs(spark, documents, odd_rows):
    rows = odd_rows + [(100 + i, "one two three " * (i % 7) + "end " * i) for i in range(40)]
    found = periodic_runs.find_runs(documents(rows, clashing=True), rewrite=periodic_runs.planted_period)
    wanted = []
    for doc_id, text, *_ in rows:
        words = periodic_runs.planted_period(doc_id, (text or "").encode().split())
        runs = brute_runs(words) if len(words) < 5000 else periodic_runs.text_runs([words])[0].tolist()
        runs = [tuple(r) for r in runs]
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        wanted.append(
            (
                doc_id, len(runs), *(best[:1] + best[1:] if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
                sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
                hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
            )
        )
    assert sorted(map(tuple, periodic_runs.digests(found).collect()), key=str) == sorted(wanted, key=str)
    assert periodic_runs.find_runs(documents([])).collect() == []


# ---- decontamination

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = {}
    for item_id, text in items:
        words = item_words(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[i : i + n]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text, *_ in rows:
        words, hit, found = item_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (of := windows.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= of
        out.append((doc_id, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "Alpha beta, gamma; DELTA epsilon zeta eta theta iota kappa lambda mu nü-xi."),
    (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (2, "short Item"),
    (2, "another short item"),
    (3, "solo"),
    (None, "no id here"),
    (4, None),
    (5, " ... "),
    (6, " ".join(f"w{i}" for i in range(3000))),
]


def contaminated_rows(odd_rows):
    rnd = random.Random(3)
    rows = list(odd_rows) + [(50, "SOLO"), (51, "so-lo short\nITEM"), (52, ITEMS[0][1] * 2), (53, "x " + ITEMS[1][1] + " y"), (53, "other text")]
    pool = [w for _, t in ITEMS for w in (t or "").split()[:40]] + ["filler"] * 20
    for i in range(120):
        parts = [rnd.choice([rnd.choice(pool), " ".join((rnd.choice(ITEMS)[1] or "").split()[: rnd.randint(1, 60)])]) for _ in range(rnd.randint(0, 25))]
        rows.append((100 + i, rnd.choice([" ", ", ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("broadcast_bytes", [decontamination.BROADCAST_BYTES, 0])
def test_hits_match_brute_force(spark, documents, odd_rows, broadcast_bytes):
    rows = contaminated_rows(odd_rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("gram", F.lit("x"))
    docs = documents(rows, clashing=True).withColumn("items", F.lit("x")).withColumn("n_words", F.lit("x"))
    found = decontamination.find_hits(docs, items, broadcast_bytes=broadcast_bytes)
    assert sorted(map(tuple, decontamination.digests(found).collect()), key=str) == brute_hits(rows, ITEMS)
    assert decontamination.find_hits(documents([]), items, broadcast_bytes=broadcast_bytes).collect() == []
    clean = decontamination.find_hits(documents(rows), items.limit(0), broadcast_bytes=broadcast_bytes)
    assert not any(r["contaminated"] for r in decontamination.digests(clean).collect())


def test_equal_numbers_are_compared(spark, documents, monkeypatch):
    monkeypatch.setattr(decontamination.W, "mix", lambda x: x & np.uint64(0))  # all windows of a length collide
    one = decontamination.Words("one two three")
    assert len(set(one.windows(2).tolist())) == 1 and one.text(1, 2) == "two three"


def test_decontaminated_documents(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "Say Alpha, BETA gamma (delta) é now", "en", "a"), (2, "clean text", "en", "a"), (3, None, "en", "a"), (4, "alpha beta gamma delta", "en", "a")]
    docs = documents(rows, clashing=True)
    spans = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontamination.decontaminate(docs, items).collect()}
    assert spans == {1: ("Say  ) é now", 12), 2: ("clean text", 10), 3: (None, None), 4: (" ", 1)}
    whole = decontamination.decontaminate(docs, items, most_hit=0.0)
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 3] and whole.columns == docs.columns
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items, most_hit=0.9).collect()) == [1, 2, 3]
    again = decontamination.find_hits(decontamination.decontaminate(docs, items), items)
    assert not any(r["contaminated"] for r in decontamination.digests(again).collect())
