"""Near-duplicate groups and removed repeats against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import string

import corpus_pipeline
from courierflow.llm import jaccard_join, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and root[b] < root[a] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b]
                    changed = True
    return {(i, len(sets[i]), root[i]) for i in sets}


def near_copies(seed):
    """Copies of a few bases with zero to many words changed, chains, short texts and ties."""
    rnd = random.Random(seed)
    names = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 6))) for _ in range(400)]
    rows = []
    for _ in range(6):
        base = rnd.choices(names, k=rnd.choice([1, 2, 3, 4, 12, 40, 90, 200]))
        for _ in range(rnd.choice([1, 4, 14])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rnd.randrange(len(words))] = rnd.choice(names)
            if rnd.random() < 0.3:
                base = words  # the next one is changed from this one
            text = " ".join(words)
            rows.append(text.upper() if rnd.random() < 0.2 else text)
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_groups_match_brute_force(documents):
    for seed in range(3):
        rows = near_copies(seed)
        found = {tuple(r) for r in jaccard_join.jaccard_groups(documents(rows)).collect()}
        assert found == brute_groups(rows), seed


def test_groups_of_odd_rows(documents, odd_rows):
    found = jaccard_join.jaccard_groups(documents(odd_rows, clashing=True)).collect()
    assert len(found) == len(odd_rows)
    group = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert group == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert {r["n_shingles"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)


def test_one_of_each_group_stays(documents, odd_rows):
    docs = documents(odd_rows, clashing=True)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8]
    assert ids.count(None) == 2


def test_near_duplicate_stage_matches_brute_force(spark, documents):
    rnd = random.Random(11)
    names = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for size in (60, 100, 100, 100, 150, 400):
        base = rnd.choices(names, k=size)
        rows.append(" ".join(base))
        for changes in range(1, 8):
            words = list(base)
            for place in rnd.sample(range(size), changes):
                words[place] = "new" + rnd.choice(names)
            rows.append(" ".join(words))
    rows = list(enumerate(rows))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if b < a}
    assert any(0.8 <= x < 0.9 for x in pairs.values())
    root, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for (a, b), x in pairs.items():
            if x >= 0.8 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root.values()))
    # two words of a hundred changed far apart: 86 of 106 five-word shingles are shared
    words = rnd.sample(names, 100)
    copy = [*words[:30], "x", *words[31:60], "y", *words[61:]]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents([(1, " ".join(words)), (2, " ".join(copy))]), "").collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_texts_that_share_an_id_are_kept(spark, documents):
    rnd = random.Random(4)
    names = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(rnd.choices(names, k=60)) for _ in range(30)]
    a, b, c = texts[:3]
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (5, ""), (5, None), (5, "")]
    rows += [(rnd.randrange(10, 25), rnd.choice(texts[3:])) for _ in range(80)] + [(None, a), (None, a)]
    ids = {}
    for i, _ in set(r for r in rows if r[0] is not None):
        ids[i] = ids.get(i, 0) + 1
    wanted = {}
    for i, text in sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: (ids[r[0]] > 1, r[0], hashlib.md5(r[1].encode()).hexdigest())):
        wanted.setdefault(text if text else (i, text), i)
    kept = jaccard_join.keep_one(documents(rows, clashing=True), words=5, similarity=(4, 5)).collect()
    found = sorted(((r["text"] or (r["doc_id"], r["text"] or "")), r["doc_id"]) for r in kept if r["doc_id"] is not None and r["text"])
    assert found == sorted((t, i) for t, i in wanted.items() if isinstance(t, str))
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert sorted(str(r["text"]) for r in kept if r["doc_id"] == 5) == ["", "None"]


def test_empty_tables(documents):
    assert jaccard_join.jaccard_groups(documents([])).collect() == []
    assert jaccard_join.keep_one(documents([])).collect() == []
    assert suffix_dedup.remove_repeats(documents([])).collect() == []


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating(seed):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choices("abcdé ", k=rnd.choice([60, 99, 100, 101, 150, 400]))) for _ in range(6)]
    passages += ["ab" * 90, "z" * 300]
    rows = []
    for i in range(25):
        parts = [rnd.choice([rnd.choice(passages), "".join(rnd.choices("abcdé ", k=rnd.randint(0, 200)))]) for _ in range(rnd.randint(0, 6))]
        rows.append((i * 2, "".join(parts)))
    return rows


def test_repeats_match_brute_force(documents):
    for seed in range(3):
        rows = repeating(seed)
        found = suffix_dedup.remove_repeats(documents(rows)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute_repeats(rows), seed


def test_repeats_across_small_batches(spark, documents):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = repeating(7)
        found = suffix_dedup.remove_repeats(documents(rows)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute_repeats(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeats_of_odd_rows(documents, odd_rows):
    found = suffix_dedup.remove_repeats(documents(odd_rows, clashing=True)).collect()
    assert len(found) == len(odd_rows)
    gone = {r["doc_id"]: (r["n_removed"], r["n_bytes"]) for r in found if r["doc_id"] is not None}
    assert gone[6][0] == gone[6][1] > 0  # a copy of document 5
    assert gone[5][0] > 0 and gone[5][0] < gone[5][1]  # its own sentence again
    assert gone[8] == (49999, 50000)
    assert all(r["n_removed"] == 0 for r in found if r["doc_id"] is None)
