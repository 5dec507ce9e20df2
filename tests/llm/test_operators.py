import hashlib
import re
import zlib

import numpy as np
import pytest

from helpers import AWKWARD, documents, prose
from lociframe.llm import fingerprints, html, lm, minhash, mixing, packing, pii, quality, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def shingle_set(t, k):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def changed(text, every, seed):
    w = text.split(" ")
    for i in range(seed % every, len(w), every):
        w[i] = f"x{seed}{i}"
    return " ".join(w)


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD, extra=True)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


# Near-duplicates


def brute_components(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(s, n) for s, n in ((1, 120), (2, 300), (3, 12), (4, 60))]
    rows = [(i, b) for i, b in enumerate(base)]
    rows += [(10 + 40 * j + i, changed(b, 55 + 7 * (i % 6), i)) for j, b in enumerate(base) for i in range(40)]
    rows += [(500, ""), (501, None), (502, "a b"), (503, "A b"), (504, "a b c"), (505, base[0])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_of_awkward_tables(spark, awkward, nothing):
    got = minhash.near_duplicates(awkward, words=5).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(AWKWARD) and by[0] == 0 and by[1] == 1 and by[5] == 4 and by[8] == 3 and by[9] == 9
    assert minhash.near_duplicates(nothing).count() == 0


def test_large_band_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    base = prose(8, 147)
    rows = [(i, changed(changed(base, 37, i), 61, i + 13)) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4)


def test_null_and_repeated_ids(spark):
    text, other = prose(70, 90), prose(71, 90)
    rows = [(None, text), (None, text), (5, text), (6, text), (3, other), (3, text), (8, other), (9, prose(72, 90))]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = minhash.near_duplicates(df, words=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert len(got) == len(rows) and by[None] == {None} and by[6] == by[5] and by[9] == {9} and len(by[3]) == 1
    # Document 3 is one of its two texts, so it joins the copies of one of them.
    assert (by[3] == by[8] == {3}) != (by[3] == by[5] == {3})
    kept = minhash.without_near_duplicates(df, words=4)
    left = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
    assert kept.columns == df.columns and [i for i, _ in left].count(-1) == 2 and len([i for i, _ in left if i == 3]) == 1
    assert dict(left)[3] == min(text, other) and (9, prose(72, 90)) in left


def test_links_of_a_group_follow_its_size(spark, monkeypatch):
    links, share = [], []
    plain = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, sets: (lambda out: links.append(out.count()) or out)(plain(pairs, sets)))
    for n in (60, 240):
        links.clear()
        rows = [(i, changed(prose(9, 200), 90, i)) for i in range(n)]
        assert {r["component_id"] for r in minhash.near_duplicates(documents(spark, rows), words=4).collect()} == {0}
        share.append(sum(links) / n)
    assert share[1] <= 1.2 * share[0] and share[0] <= minhash.PHASES + 1


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    import numpy

    from lociframe.llm import ids

    rows = [(i, changed(prose(7 + i % 5, 120), 60, i)) for i in range(40)] + [(None, "x y z"), (3, "again")]
    df = documents(spark, rows)
    plain = sorted((str(r["doc_id"]), r["component_id"]) for r in minhash.near_duplicates(df).collect())
    kept = sorted((str(r["doc_id"]), r["text"]) for r in minhash.without_near_duplicates(df).collect())
    full = ids.IdFilter(numpy.full(ids.BITS // 8, 255, numpy.uint8))
    monkeypatch.setattr(ids, "id_filter", lambda x: full)
    monkeypatch.setattr(minhash, "id_filter", lambda x: full)
    assert plain == sorted((str(r["doc_id"]), r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert kept == sorted((str(r["doc_id"]), r["text"]) for r in minhash.without_near_duplicates(df).collect())


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    np.seterr(over="ignore")
    for n in (3, 40, 5000):
        for share in (0.5, 0.8, 0.95):
            both = max(1, int(2 * n * share / (1 + share)))
            errors = []
            for _ in range(12):
                x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
                a, b = np.unique(x[:n]), np.unique(x[n - both :])
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                est = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
                errors.append(est - true)
            assert abs(np.mean(errors)) < (0.12 if n == 3 else 0.03)


# Passages


def test_repeated_passages_are_found(spark):
    passage = prose(50, 64)
    rows = [(i, f"{prose(100 + i, 90)} {passage} {prose(200 + i, 90)}") for i in range(6)] + [(10 + i, prose(300 + i, 200)) for i in range(6)]
    rows += [(20, changed(passage, 40, 3)), (21, prose(400, 30) + " " + " ".join(passage.split()[:30]))]
    got = substrings.passages(documents(spark, rows)).collect()
    found = {r["doc_id"] for r in got}
    assert found >= {0, 1, 2, 3, 4, 5, 20} and not found & set(range(10, 16)) and 21 not in found
    for r in got:
        assert r["last_word"] - r["first_word"] + 1 >= 50 and r["leader_doc_id"] <= r["doc_id"]
    whole = {r["doc_id"] for r in got if r["first_word"] <= 90 and r["last_word"] >= 90 + 63}
    assert whole >= set(range(6))


def test_passages_whose_leader_holds_a_part_only(spark):
    rows = []
    for k in range(30):
        passage = prose(5000 + k, 60)
        rows.append((k, f"{prose(6000 + k, 40)} {' '.join(passage.split()[8:52])} {prose(7000 + k, 40)}"))
        rows += [(1000 * j + k, f"{prose(8000 * j + k, 70)} {passage} {prose(9000 * j + k, 70)}") for j in (1, 2)]
    got = substrings.passages(documents(spark, rows)).collect()
    pairs = {(r["leader_doc_id"], r["doc_id"]) for r in got if r["first_word"] <= 70 and r["last_word"] >= 129}
    assert pairs >= {(1000 + k, 2000 + k) for k in range(30)} and not {r["doc_id"] for r in got} & set(range(30))


def test_recall_of_near_passages_with_decoys(spark):
    """Pairs of documents that share a passage at a similarity of 0.8 or more; every third passage has a document of least id
    with a part of it, and a phrase common to all documents lies in every passage."""
    phrase, rows, want = prose(4000, 12), [], set()
    for k in range(60):
        passage = f"{prose(5000 + k, 34)} {phrase} {prose(5500 + k, 34)}"
        near = changed(passage, 80, 10 + k % 60) if k % 2 else passage
        assert len(shingle_set(passage, 5) & shingle_set(near, 5)) >= 0.8 * len(shingle_set(passage, 5) | shingle_set(near, 5))
        if k % 3 == 0:
            rows.append((k, f"{prose(6000 + k, 40)} {' '.join(passage.split()[20:62])} {prose(7000 + k, 40)}"))
        rows += [(1000 + k, f"{prose(8000 + k, 70)} {passage} {prose(8500 + k, 70)}"), (2000 + k, f"{prose(9000 + k, 50)} {near} {prose(9500 + k, 50)}")]
        want.add((1000 + k, 2000 + k))
    rows += [(3000 + k, f"{prose(10000 + k, 60)} {phrase} {prose(10500 + k, 60)}") for k in range(60)]
    got = substrings.passages(documents(spark, rows)).collect()
    pairs = {(r["leader_doc_id"], r["doc_id"]) for r in got} | {(r["doc_id"], r["leader_doc_id"]) for r in got}
    assert len(want & pairs) >= 0.95 * len(want)
    assert not {r["doc_id"] for r in got if r["doc_id"] < 1000 or r["doc_id"] >= 3000}


def test_copies_have_their_texts_passages(spark):
    passage = prose(50, 64)
    one, two = f"{prose(1, 90)} {passage}", f"{passage} {prose(2, 90)}"
    rows = [(3, one), (4, two), (5, one), (6, one.upper()), (7, two), (8, prose(3, 90)), (None, one)]
    got = substrings.passages(documents(spark, rows)).collect()
    whole = {(r["doc_id"], r["leader_doc_id"]) for r in got if r["first_word"] == 0 and r["last_word"] == 153}
    assert whole == {(3, 3), (5, 3), (6, 3), (4, 4), (7, 4)} and {r["doc_id"] for r in got} == {3, 4, 5, 6, 7}
    assert {(r["doc_id"], r["leader_doc_id"]) for r in got if r["first_word"] == 0 and r["last_word"] < 70} == {(4, 3)}


def test_narrowed_windows_hold_every_stretch_once():
    rng = np.random.default_rng(4)
    x, y = rng.permutation(60).astype(np.uint64), rng.permutation(60).astype(np.uint64)
    text, l, c, r = substrings.compact_windows(x, np.array([0, 60]), 7)
    windows = [(a, m, b, d) for l_, m, r_ in zip(l.tolist(), c.tolist(), r.tolist()) for a, b, d in substrings.narrowed(y, l_, m, r_, 7)]
    for i in range(60):
        for j in range(i + 6, 60):
            m, d = i + int(x[i : j + 1].argmin()), i + int(y[i : j + 1].argmin())
            assert [(e, n) for a, e, b, n in windows if a <= i <= min(e, n) and max(e, n) <= j <= b] == [(m, d)]


def test_compact_windows_hold_every_stretch_once():
    rng = np.random.default_rng(3)
    for h in (rng.permutation(90), rng.integers(0, 5, 90), np.zeros(90), np.arange(90), np.arange(90)[::-1]):
        h, offsets = h.astype(np.uint64), np.array([0, 60, 63, 90])
        text, l, c, r = substrings.compact_windows(h, offsets, 7)
        for t in range(3):
            for i in range(offsets[t], offsets[t + 1]):
                for j in range(i + 6, offsets[t + 1]):
                    m = i + int(h[i : j + 1].argmin())
                    assert ((text == t) & (l <= i) & (i <= c) & (c <= j) & (j <= r) & (c == m)).sum() == 1


def test_passages_in_repetitive_texts(spark):
    """Phrases said over and over give few windows, and passages beside and between them are still found."""
    passage, chant = prose(61, 56), "on and on we go " * 60
    rows = [(1, f"{chant} {passage} {chant}"), (2, f"{prose(62, 60)} {passage} {prose(63, 60)}"), (3, "la " * 3000 + passage), (4, f"{prose(64, 70)} go " + "la " * 80)]
    got = substrings.passages(documents(spark, rows)).collect()
    pairs = {(r["leader_doc_id"], r["doc_id"]) for r in got}
    assert pairs >= {(1, 2), (1, 3), (3, 4)} and len(got) < 20
    n = substrings.windows_of(documents(spark, rows[2:3]).selectExpr("doc_id AS id", "text AS t")).count()
    assert n < 4 * (3000 // (substrings.LEAST // 2) + 60)


def test_stretches_keep_48_bits():
    h = np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64)
    data = substrings.narrow(h)
    assert len(data) == 6000 and np.array_equal(substrings.widened(data), h >> np.uint64(16)) and len(substrings.widened(b"")) == 0


def test_stretches_of_candidates_go_to_their_leaders(spark):
    """A candidate's own hashes come with its leader's place, and a leader's stretch once; they meet in a single join."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60))) for i in (1, 2, 3)], "id long, t string")
    found = spark.createDataFrame([(2, 1, -3, 50, 0, 49), (3, 1, 0, 50, 0, 49), (3, 2, 0, 50, 0, 50)], "id long, leader long, l int, r int, ll int, lr int")
    got = {(r["id"], r["l"], r["r"], r["leader"], r["ll"], r["lr"]): substrings.widened(bytes(r["h"])) for r in substrings.stretches(docs, found).collect()}
    assert got.keys() == {(2, -3, 50, 1, 0, 49), (3, 0, 50, 1, 0, 49), (3, 0, 50, 2, 0, 50), (1, 0, 49, None, None, None), (2, 0, 50, None, None, None)}
    assert all(len(h) == k[2] + 1 - max(k[1], 0) and (h == got[2, 0, 50, None, None, None][: len(h)]).all() for k, h in got.items())


def test_windows_of_one_repeated_word_are_linear():
    import time

    h = np.zeros(300_000, np.uint64)
    began = time.time()
    assert len(substrings.compact_windows(h, np.array([0, len(h)]))[0]) == len(h) - substrings.LEAST + 1 and time.time() - began < 10
    assert len(substrings.narrowed(h, 0, 1000, len(h) - 1)) == 1


def test_passages_of_awkward_tables(spark, awkward, nothing):
    assert {r["doc_id"] for r in substrings.passages(awkward).collect()} == {4, 5}
    assert substrings.passages(nothing).count() == 0


# Fingerprints


def test_fingerprints(spark, awkward, nothing):
    rows = [(3 * i, prose(i, 30 + 20 * i)) for i in range(25)] + [(200, None), (201, "x"), (202, "")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in fingerprints.edit_with_next(docs).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert fingerprints.edit_with_next(awkward).count() == len(AWKWARD) and fingerprints.edit_with_next(nothing).count() == 0


def test_fingerprints_merge():
    import pyarrow as pa

    np.seterr(over="ignore")
    a, b = prose(1, 900), prose(2, 900)
    fa, fb, fab = fingerprints.scaled_sets(pa.array([a, b, a + " " + b]))
    assert set(fa) | set(fb) <= set(fab) and len(fab) - len(set(fa) | set(fb)) <= 4
    assert fingerprints.containment(fa, fab) == 1.0 and fingerprints.containment(fab, fa) < 0.7
    assert np.array_equal(fingerprints.decoded(fingerprints.encoded(fa)), fa)


def test_likeness_follows_similarity(spark):
    text = prose(33, 4000)
    rows = [(9, text), (8, changed(text, 50, 3)), (7, changed(text, 20, 4)), (6, prose(34, 300)), (5, text)]
    got = {r["doc_id"]: r for r in fingerprints.edit_with_next(documents(spark, rows)).collect()}
    sets = {i: shingle_set(t, 5) for i, t in rows}
    order = [i for i, _ in rows]
    for i, j in zip(order, order[1:] + order[:1]):
        true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs(got[i]["near_next"] - true) < 0.08
        a, b = (fingerprints.decoded(got[k]["fingerprint"]) for k in (i, j))
        assert got[i]["near_next"] == fingerprints.likeness(a, b)
        assert abs(len(a) * fingerprints.SCALE - len(sets[i])) < 6 * (len(sets[i]) * fingerprints.SCALE) ** 0.5
        assert got[i]["near_edited"] == fingerprints.likeness(a, fingerprints.decoded(got[i]["edited_fingerprint"]))
    assert got[9]["fingerprint"] == got[5]["fingerprint"] and got[5]["near_next"] == 1.0


# Personal data


def test_base_spans_and_added_ones(spark, awkward, nothing):
    texts = ["mail a.b@c.example.org, ip 10.0.0.1 and 999.1.1.1", "pay 4111 1111 1111 1111 or 4111111111111112", "call +1 (415) 555-2671 now", None, ""]
    got = {r["doc_id"]: r for r in pii.find_pii(documents(spark, list(enumerate(texts))), None, mask=True).collect()}
    assert [got[i][f"n_{k}"] for i, k in ((0, "email"), (0, "ip"), (1, "card"), (2, "phone"))] == [1, 1, 1, 1]
    assert got[0]["spans"] == "email:5:22,ip:27:35" and got[0]["masked"] == "mail [EMAIL], ip [IP] and 999.1.1.1"
    assert got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(awkward, pii.train()).count() == len(AWKWARD) and pii.find_pii(nothing, pii.train()).count() == 0
    kept = pii.without_pii(awkward, pii.train())
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)


def test_base_spans_equal_the_patterns():
    import random

    r = random.Random(8)
    for n in range(3000):
        text = "".join(r.choice(["1", "42", ".", ".", "@", "a", "b.", "-", "_", "+", " ", "(", ")", "4111111111111111", "é", "%", "..", "1.2.3.4", "x@y.z"]) for _ in range(r.randrange(1, 30)))
        want = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.PATTERNS[k], text) if pii._valid(k, m.group())]
        assert pii.base_spans(text) == want, text


def test_long_runs_take_linear_time():
    import time

    for text in ("1" * 5_000_000, "a" * 5_000_000 + " @", "1." * 2_500_000, "@" * 5_000_000, "a@" * 2_500_000, "+1" + "-" * 5_000_000, "1 " * 2_500_000):
        began = time.time()
        pii.base_spans(text)
        assert time.time() - began < 10, text[:10]


def test_field_finds_what_the_patterns_miss():
    import random

    field, r = pii.train(), random.Random(99)
    rows = [x.strip() for line in pii.LABELLED.strip().split("\n") for x in line.split(" | ")]
    found = wanted = false = 0
    for row in rows * 4:
        text, spans = pii.filled(row, r)
        base = pii.base_spans(text)
        got = pii.added_spans([text], [base], field)[0]
        missed = [x for x in spans if not any(a < x[2] and x[1] < b for _, a, b in base)]
        wanted += len(missed)
        found += len(set(missed) & set(got))
        false += len(set(got) - set(spans))
    assert wanted > 80 and found >= 0.9 * wanted and false <= 0.02 * wanted
    long = "1999 " * 200 + "(312) 555-0147 " + "7 " * 100
    assert [(k, long[s:e]) for k, s, e in pii.added_spans([long], [[]], field)[0]] == [("phone", "(312) 555-0147")]


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(5)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, len(pii.LABELS))), pii._allowed(rng.normal(size=(len(pii.LABELS),) * 2)), pii._allowed_start(rng.normal(size=len(pii.LABELS))))
    x = rng.normal(size=(4, 3, pii.N_FEATURES))
    score = x @ field.emit
    for n, y in enumerate(field.decode(x)):
        value = lambda p: field.start[p[0]] + sum(score[n, t, k] for t, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
        assert tuple(y) == max(itertools.product(range(len(pii.LABELS)), repeat=3), key=value)


# Quality


def test_host_rules_of_awkward_tables(spark, awkward, nothing):
    got = quality.host_rules(awkward).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(AWKWARD) and by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[4]["base_failed"]
    assert quality.host_rules(nothing).count() == 0


def test_a_bad_host_takes_its_documents_with_it(spark):
    rows = [(i, "junk junk junk " * 30, "bad.example") for i in range(60)] + [(100 + i, prose(i, 80), f"good{i % 4}.example") for i in range(80)] + [(300, prose(999, 80), "bad.example"), (301, prose(998, 80), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.host_rules(df).collect()}
    assert not kept[300] and kept[301] and all(kept[100 + i] for i in range(80)) and not kept[0]


def test_repeated_words(spark):
    rows = [(0, "a b c a b c d"), (1, "a a a a"), (2, "a b c d e"), (3, "x y z " * 5 + "q")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.text_counts(documents(spark, rows)).collect()}
    assert got == {0: 6, 1: 4, 2: 0, 3: 15}


# Pages

PAGE = (
    "<html><head><title>x</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class='ad'>buy now</div><article><h1>Head &amp; line</h1>"
    "<p><b>First paragraph of some length here.<br><p>Second  one\nwith <i>inline</i> text.</p><div class='comments'><p>reader comment</p></div></article><footer>&copy; foot</footer></body></html>"
)


def labelled(pages, text):
    import pyarrow as pa
    from lociframe.llm.text import chunks, shingles

    np.seterr(over="ignore")
    known = np.unique(np.concatenate([shingles(c.hashes, c.words, html.WORDS)[0] for c in chunks(pa.array(text))]))
    trees = [html.Tree().read(p) for p in pages]
    return trees, [html.labels_of(t, html.blocks_of(t), known) for t in trees]


def test_main_text(spark):
    text = "Head & line\nFirst paragraph of some length here.\nSecond one with inline text."
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>broken <b"), (5, "u", "no markup at all"), (5, "u", PAGE), (None, None, "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in pages], "page_id long, url string, html string, text string, _html string")
    texts = spark.createDataFrame([(text,), (None,)], "text string")
    for weights in (html.train(df, texts), html.prior(), html.fit(*labelled([PAGE] * 5, [text]))):
        rows = html.main_text(df, weights).collect()
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in rows if (r["page_id"], r["n_chars"]) != (5, 17)}
        assert got[1] == (text, len(text)) == got[5] and got[2] == ("", 0) == got[3] and len(rows) == len(pages)
    none = df.limit(0)
    assert html.main_text(none, html.train(none, texts)).count() == 0
    long = "<html><body><nav>" + "<a href=x>menu</a>" * 3000 + "</nav><article>" + f"<p>{prose(4, 60)}.</p>" * 3000 + "</article></body></html>"
    assert html.contents([long], html.prior())[0].count("\n") == 2999


def test_labels_teach_unknown_tags_and_classes():
    """A site whose tags and classes say nothing: what its labelled pages teach finds the text of its other pages."""
    def page(i):
        body = [f"{prose(10 * i + j, 40)}." for j in range(3)]
        menu = "".join(f"<x-1 class=k1>{prose(9000 + 50 * i + j, 3)}</x-1>" for j in range(5))
        return f"<html><body><x-1 class=k1>{menu}{prose(7000 + i, 30)}.</x-1><x-1 class=k2>" + "".join(f"<x-2 class=k3>{t}</x-2>" for t in body) + f"</x-1><x-1 class=k4>{prose(8000 + i, 30)}.</x-1></body></html>", body

    made = [page(i) for i in range(40)]
    weights = html.fit(*labelled([p for p, _ in made[:20]], [t for _, b in made[:20] for t in b]))

    def share(w):
        """Words rightly told apart on the other pages."""
        right = total = 0
        for (p, body), got in zip(made[20:], html.contents([p for p, _ in made[20:]], w)):
            want, has, every = set(" ".join(body).split()), set(got.split()), set(re.sub("<[^>]*>", " ", p).split())
            right += len(want & has) + len(every - want - has)
            total += len(every)
        return right / total

    assert share(weights) > 0.95 > 0.8 > share(html.prior())


def test_unknown_marked_sections_do_not_end_a_page():
    for token in ("<![foo bar]>", "<![]>", "<![ 1 [x]]>"):
        runs = html.Tree().read(f"<p>a</p>{token}<p>rest</p>").runs
        assert [t for _, _, t in runs][0] == "a" and runs[-1][2] == "rest"


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    parents = np.array([-1, 0, 0, 1, 1, 2])
    score, coupling = rng.normal(size=6), rng.normal(size=6)
    total, on, agree = 0.0, np.zeros(6), np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(score[i] * y[i] for i in range(6)) + sum(coupling[i] * (y[i] == y[parents[i]]) for i in range(1, 6)))
        total += w
        on += w * np.array(y)
        agree[1:] += [w * (y[i] == y[parents[i]]) for i in range(1, 6)]
    p, same = html.marginals(np.tile(score, 2), np.concatenate((parents, np.where(parents < 0, -1, parents + 6))), np.tile(coupling, 2))
    assert np.allclose(p[:6], p[6:]) and np.allclose(same[:6], same[6:])
    p, same = p[6:], same[6:]
    assert np.allclose(p, on / total) and np.allclose(same[1:], agree[1:] / total)


# Packing


def test_packing_round_trip(spark, awkward, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = AWKWARD[:-1] + [(20, "x" * 5000), (21, "tab\tand  two spaces\n\n\nlines \n end  "), (22, "it's we'll 1234 $$$   wide"), (23, "no stops " * 900)]
    got = packing.pack(documents(spark, rows, extra=True).repartition(3), path).toPandas()
    expected = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], np.uint32) for i, t in rows}
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        ids = expected[i]
        assert g["start"].iloc[0] == 0 and (g["start"] + g["length"]).iloc[-1] == len(ids) == g["doc_tokens"].iloc[0]
        assert ((g["start"] + g["length"]).iloc[:-1].to_numpy() == g["start"].iloc[1:].to_numpy()).all()
        for s, n, crc in zip(g["start"], g["length"], g["ids_crc32"]):
            assert zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) == crc
    assert set(got["doc_id"]) == set(expected)
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].iloc[0] == 0 and (g["offset"] + g["length"]).iloc[-1] <= 1024
        assert ((g["offset"] + g["length"]).iloc[:-1].to_numpy() == g["offset"].iloc[1:].to_numpy()).all()
    assert packing.pack(nothing, path).count() == 0


def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    import pyarrow as pa
    from lociframe.llm.text import chunks

    np.seterr(over="ignore")
    texts = ["a\nb", "\n", "x \n y", " ", "a  b\t\tc", "\r\nq", "é x\u00a0y", "won't 'tis", "a" * 100 + " b", "1234 5.6,\n\n7", "<|endoftext|> hi", "tab\tword   z", "\x1c a\x1db", "", "a\u2003b", *[prose(i, 40) for i in range(20)]]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):  # what is remembered is the same
        for c in chunks(pa.array(texts), lower=False):
            ids, lengths, _ = encoder.encode(c)
            ends = np.cumsum(lengths)
            for t, end, n in zip(texts[c.lo : c.hi], ends, lengths):
                assert ids[end - n : end].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], t


def test_best_cuts_are_optimal():
    import random

    r = random.Random(4)
    for _ in range(60):
        pos = [0, *sorted(r.sample(range(1, 60), 11))]
        if max(b - a for a, b in zip(pos, pos[1:])) > 16:
            continue
        cost = [0] + [r.randrange(9) for _ in pos[1:]]
        free = (4, 8)
        best = [0] + [10**9] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                d = pos[j] - pos[i]
                if d <= 16:
                    best[j] = min(best[j], best[i] + (0 if d in free else 16 - d) + cost[j] + packing.OPEN)
        cuts = packing.best_cuts(pos, cost, 16, free)
        spent = sum((0 if pos[b] - pos[a] in free else 16 - pos[b] + pos[a]) + cost[b] + packing.OPEN for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == len(pos) - 1 and spent == best[-1]


def stream_cost(docs, sizes, length):
    """Sequences, and what the stream's plan costs, if the documents come in portions of the given sizes."""
    import pyarrow as pa

    stream, out, at = packing.Stream(length, 0), [], 0
    soft_all = set()
    total = 0
    for n in sizes:
        part = docs[at : at + n]
        at += n
        lengths = np.array([k for k, _ in part], np.int64)
        begin = np.cumsum(lengths) - lengths
        soft = np.array(sorted(b + x for b, (_, s) in zip(begin.tolist(), part) for x in s), np.int64)
        soft_all |= set((soft + total).tolist())
        total += int(lengths.sum())
        stream.add(np.arange(lengths.sum(), dtype=np.uint32), pa.array(range(at - n, at)), lengths, soft)
        got = stream.take(at == len(docs))
        if got is not None:
            out += got.to_pylist()
    ends = set(np.cumsum([k for k, _ in docs]).tolist())
    cuts, cost, place = {}, 0, 0
    for r in out:
        cuts.setdefault(r["sequence_id"], []).append(r["length"])
    for x in cuts.values():
        place += sum(x)
        cost += (0 if sum(x) in packing.UNPADDED else length - sum(x)) + packing.OPEN + (0 if place in ends else packing.SENTENCE_CUT if place in soft_all else packing.INNER_CUT)
    assert place == total
    return len(cuts), cost


def test_plans_do_not_depend_on_chunks():
    import random

    r = random.Random(5)
    docs = [(k, sorted(r.sample(range(1, k), min(k - 1, k // 30)))) for k in (r.randrange(2, 700) for _ in range(300))]
    whole = stream_cost(docs, [300], 256)
    for sizes in ([1] * 300, [7] * 42 + [6], [150, 150]):
        assert stream_cost(docs, sizes, 256)[1] == whole[1]


def test_null_ids_are_packed_as_null(spark):
    import public_tokenizers

    df = spark.createDataFrame([(None, "a b c"), (-1, "d e"), (None, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()) == ["-1", "None", "None"]


# Toxicity


@pytest.fixture(scope="module")
def insults(spark):
    rows = [(i, prose(i, 60) + (" you idiot and moron" if i % 4 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    return documents(spark, rows), toxicity.train(documents(spark, rows), labels)


def test_disguised_words_are_restored_and_scored(spark, insults):
    _, model = insults
    assert model.chars.restore("1d10t") == "idiot" and model.chars.restore("i.d.i.o.t") == "idiot" and model.chars.restore("m0ron") == "moron" and model.chars.restore("idiooot") == "idiot"
    texts = [(0, prose(900, 60) + " 1d10t m0ron"), (1, prose(901, 60)), (2, "such an i d i o t moron"), (3, None), (4, ""), (5, "you idio+ and (moron!")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(documents(spark, texts), model).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_sentences_spelt_out_are_read_word_by_word(spark, insults):
    _, model = insults
    long = "alpha beta gamma delta idiot epsilon zeta moron theta".replace(" ", "")
    texts = [(0, " ".join(long)), (1, ".".join(long)), (2, "a l p h a  i d i o t  m o r o n"), (3, " ".join(long.replace("idiot", "sigma").replace("moron", "kappa")))]
    got = {r["doc_id"]: r["e2"] for r in toxicity.with_evidence(documents(spark, texts), model, ["doc_id"], "text").collect()}
    assert len(long) > 40 and got[0] >= 2 and got[1] >= 2 and got[2] >= 2 and got[3] == 0


def test_toxicity_of_awkward_tables(spark, insults, awkward, nothing):
    _, model = insults
    assert toxicity.scored(awkward, model).count() == len(AWKWARD)
    kept = toxicity.without_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.scored(awkward, toxicity.train(awkward, empty)).collect()} == {0.0}
    assert toxicity.scored(nothing, model).count() == 0


def test_decoder_is_the_best_path():
    import itertools

    model = toxicity.CharModel({a + b + c: 1 + (ord(a) * 7 + ord(b) * 5 + ord(c) * 3) % 11 for a in "^ilos" for b in "^ilos" for c in "ilos$"})
    word = "105l"
    def value(read):
        a, b, total = "^", "^", 0.0
        for x in read:
            total += model.log(a, b, x)
            a, b = b, x
        return total + model.log(a, b, "$")
    options = [toxicity.STANDS_FOR.get(c, c) for c in word]
    assert model.restore(word) == max(("".join(p) for p in itertools.product(*options)), key=value)


def test_decoder_drops_letters_and_separators_for_the_best_path():
    import itertools

    model = toxicity.CharModel({a + b + c: 1 + (ord(a) * 7 + ord(b) * 5 + ord(c) * 3) % 11 for a in "^ilos" for b in "^ilos" for c in "ilos$"})
    for word in ("llo", "sool", "l.o.1", "s-ll", "ii11"):
        apart = all(len(x) <= 1 for x in toxicity._split(word))
        options = []
        for i, ch in enumerate(word):
            if ch in toxicity.LETTERS:
                own = [(ch, 0.0)]
                if i and word[i - 1] == ch:
                    own.append(("", toxicity.DROP if i > 1 and word[i - 2] == ch else toxicity.DROP * 8))
            elif ch in toxicity.SEPARATORS and apart:
                own = [("", toxicity.JOIN)]
            elif ch in toxicity.STANDS_FOR:
                own = [(x, toxicity.READ) for x in toxicity.STANDS_FOR[ch]]
            else:
                own = [(ch, 0.0)]
            options.append(own)

        def value(choice):
            a, b, total = "^", "^", 0.0
            for x, cost in choice:
                total += cost
                if x and x in toxicity.LETTERS:
                    total += model.log(a, b, x)
                    a, b = b, x
                elif x:
                    total, a, b = total - 4.0, "^", "^"
            return total + model.log(a, b, "$")

        best = max(itertools.product(*options), key=value)
        got = model.restore(word)
        tied = {"".join(x for x, _ in c) for c in itertools.product(*options) if value(c) > value(best) - 1e-9}
        assert got in tied, word


# Mixing


def as_shares(spark, p, n):
    return spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(p, n)], "p array<double>, n double")


@pytest.mark.parametrize("wanted", [[0.3, 0.8, 0.9], [0.05, 1.0, 0.2], [1.0, 1.0, 0.0]])
def test_rates_are_those_of_least_squares(spark, wanted):
    """Totals against a long run of plain projected gradient on the dense matrix; where targets are out of reach, too."""
    rng = np.random.default_rng(8)
    p, n = rng.dirichlet((0.5, 0.5, 0.5), 60), rng.integers(5, 400, 60)
    a = p * n[:, None]
    targets = a.sum(0) * wanted

    def cost(r):
        return ((r @ a - targets) ** 2 / a.sum(0)).sum()

    r, step = np.ones(60), 1 / np.linalg.norm(a / np.sqrt(a.sum(0)), 2) ** 2
    for _ in range(100_000):
        r = np.clip(r - step * (a @ ((r @ a - targets) / a.sum(0))), 0, 1)
    got = mixing.rates_from(p, mixing.fit_rates(as_shares(spark, p, n), targets, tolerance=1e-4))[0]
    assert got.min() >= 0 and got.max() <= 1 and cost(got) <= cost(r) + 1e-5 * a.sum() and np.allclose(got @ a, r @ a, atol=2e-3 * a.sum(0).max())


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet((0.4, 0.4, 0.4), 500), rng.integers(20, 900, 500)
    a = p * n[:, None]
    targets = a.sum(0) * np.array([0.4, 0.7, 0.9])
    rates = mixing.rates_from(p, mixing.fit_rates(as_shares(spark, p, n), targets))[0]
    assert rates.min() >= 0 and rates.max() <= 1 and np.allclose((a * rates[:, None]).sum(0), targets, rtol=2e-3)


def test_targets_follow_weights():
    now, names = np.array([100.0, 40.0, 60.0]), ["a", "b", "c"]
    assert np.allclose(mixing.targets_of(now, names, {"a": 2, "b": 1, "c": 1}, fill=1.0), [80, 40, 40])
    assert np.allclose(mixing.targets_of(now, names, {"a": 1, "b": 0, "c": 1}, fill=0.5), [30, 0, 30])
    assert np.allclose(mixing.targets_of(now, names, {"a": 10, "b": 1, "c": 9}, whole="a"), [100, 10, 60])
    assert np.allclose(mixing.targets_of(np.array([0.0, 5.0]), ["a", "b"], {"a": 1, "b": 1}, fill=1.0), [0, 5]) and np.allclose(mixing.targets_of(now * 0, names, {"a": 1, "b": 1, "c": 1}), 0)
    for bad in ({"a": 1, "b": 1}, {"a": -1, "b": 1, "c": 1}, {"a": 0, "b": 0, "c": 0}):
        with pytest.raises(ValueError):
            mixing.targets_of(now, names, bad)


def test_a_few_long_documents_do_not_stop_the_fit(spark):
    rng = np.random.default_rng(6)
    low = np.concatenate((rng.beta(20, 1, 300), rng.beta(1, 60, 700), [0.5, 0.98, 0.02]))
    n = np.concatenate((rng.integers(50, 900, 1000), [1_000_000] * 3))
    p = np.stack((1 - low, low), 1)
    a = p * n[:, None]
    targets = a.sum(0) * [0.9, 0.5]
    rates = mixing.rates_from(p, mixing.fit_rates(as_shares(spark, p, n), targets))[0]
    assert np.allclose((a * rates[:, None]).sum(0), targets, rtol=2e-3)
    targets = a.sum(0) * [1.0, 0.5]  # out of reach: every document has a share of both
    rates = mixing.rates_from(p, mixing.fit_rates(as_shares(spark, p, n), targets))[0]
    got = (a * rates[:, None]).sum(0) / targets
    assert abs(got[1] - 1) < 0.02 and got[0] > 0.98
    with pytest.raises(RuntimeError):
        mixing.fit_rates(as_shares(spark, p, n), targets, max_steps=1)


def test_mixing_thins_low_quality(spark, awkward, nothing):
    rows = [(i, prose(i, 120) if i % 2 else "### $$$ %%% " * 40 + str(i)) for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = mixing.train(docs, labels, mixing.quality_domain())
    weights = mixing.weights_in(spark.createDataFrame([("good", 2.0), ("low", 1.0)], "domain string, weight double"))
    out = {r["doc_id"]: r for r in mixing.mixed(docs, model, weights, whole="good").collect()}
    kept = {r["doc_id"] for r in mixing.thinned(docs, model, weights, whole="good").collect()}
    assert kept == {i for i, r in out.items() if r["kept"]}
    low = [i for i in out if i % 2 == 0]
    assert 0.35 < np.mean([i in kept for i in low]) < 0.65 and np.mean([i in kept for i in out if i % 2]) > 0.98
    assert mixing.mixed(awkward, model, weights).count() == len(AWKWARD)
    assert mixing.mixed(nothing, model, weights).count() == 0
    assert mixing.train(docs, labels.filter("quality = 1"), mixing.quality_domain()) is None
    assert mixing.thinned(awkward, None, {}).count() == len(AWKWARD)


def test_languages_are_mixed_to_their_weights(spark):
    got = mixing.query(spark, "/root/testdata/sf0.01").toPandas()
    names = [c[2:] for c in got.columns if c.startswith("p_")]
    assert sorted(names) == sorted(mixing.WEIGHTS)
    n = got["n_tokens"].to_numpy()
    every, taken = ({d: float((got[f"p_{d}"] * n * r).sum()) for d in names} for r in (1.0, got["rate"]))
    for d in names:
        assert np.isclose(taken[d] / sum(taken.values()), mixing.WEIGHTS[d], rtol=0.01)
    thinner = [d for d in names if taken[d] < 0.9 * every[d]]
    assert len(thinner) >= 2 and len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


# Language model


def test_lm_equals_brute_force_base(spark, awkward):
    import collections
    import math
    from pyspark.sql import functions as F

    rows = [(i, prose(i % 50, 40 + i)) for i in range(120)] + [(500, None), (501, ""), (502, "UnSeen words only here")]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r["doc_id"]: r for r in lm.score_texts(documents(spark, rows, extra=True), held).collect()}
    count = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*words(t), None]
        r = got[i]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    fresh = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)
    assert lm.score_texts(awkward, F.lit(False)).count() == len(AWKWARD)


def test_lm_of_nothing(spark, nothing):
    from pyspark.sql import functions as F

    assert lm.score_texts(nothing, F.lit(False)).count() == 0


def lm_rows():
    return [(i, prose(i % 50, 40 + i) + " " + " ".join(WORD.findall(prose(7, 30))[: i % 30])) for i in range(150)] + [(500, None), (501, ""), (502, "UnSeen words only here")]


def test_lm_score_equals_brute_force(spark, monkeypatch):
    import collections
    import math
    from pyspark.sql import functions as F

    fitted = []
    plain = lm.interpolation_weights
    monkeypatch.setattr(lm, "interpolation_weights", lambda hist: fitted.append(plain(hist)) or fitted[-1])
    rows = lm_rows()
    got = {r["doc_id"]: r for r in lm.score_texts(documents(spark, rows), F.col("doc_id") % 4 == 0).collect()}
    one, two = collections.Counter(), collections.Counter()
    tokens = {i: ["<s>", *words(t), "</s>"] for i, t in rows}
    for i, t in tokens.items():
        if i % 4:
            one.update(t)
            two.update(zip(t, t[1:]))
    n, v = sum(k for w, k in one.items() if w != "<s>"), len(one) - 1
    for i, t in tokens.items():
        score = 0.0
        for a, b in zip(t, t[1:]):
            w = fitted[0][np.searchsorted(lm.CONTEXT_BUCKETS, one[a])]
            p = w[0] * (two[a, b] / one[a] if one[a] else 0) + w[1] * one[b] / n + w[2] * (one[b] > 0) / v + w[3] * (one[b] == 0)
            score += math.log10(p)
        assert abs(got[i]["score"] - score) < 1e-6 * max(1, abs(score))
    # A distribution over the known words, the end and the unknown word, after any context.
    for a in ("<s>", "alpha", "never"):
        w = fitted[0][np.searchsorted(lm.CONTEXT_BUCKETS, one[a])]
        known = [x for x in one if x != "<s>"]
        assert abs(sum(w[0] * (two[a, b] / one[a] if one[a] else 0) + w[1] * one[b] / n + w[2] / v for b in known) + w[3] - 1) < 1e-9


def test_lm_texts_not_learnt_from_change_no_other_score(spark):
    from pyspark.sql import functions as F

    rows = lm_rows()
    held = F.col("doc_id") % 4 == 0
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(documents(spark, rows), held).collect()}
    other = [(i, t if i % 4 else prose(3000 + i, 90)) for i, t in rows]
    again = {r["doc_id"]: r["score"] for r in lm.score_texts(documents(spark, other), held).collect()}
    assert all(abs(got[i] - again[i]) < 1e-9 for i in got if i % 4)
    turned = [(i, t if i % 4 else " ".join(reversed((t or "").split()))) for i, t in rows]
    turned = {r["doc_id"]: r["score"] for r in lm.score_texts(documents(spark, turned), held).collect()}
    assert sum(got[i] - turned[i] for i in got if i % 4 == 0 and i < 200) > 5


def test_lm_keeps_null_ids_and_large_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, "a b"), (-1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in lm.score_texts(df, F.lit(False)).collect()) == ["-1", "2", "None"]
    x = np.array([0, 1, 2**40 + 3, 255], np.int64)
    assert (lm.unpacked(lm.packed(x)) == x).all() and len(lm.packed(np.zeros(5, np.int64))) == 6
    assert {r["score"] for r in lm.score_texts(df, F.lit(True)).collect()} == {0.0}


def test_interpolation_weights_are_those_of_likelihood():
    hist = {(3, 0, 200): 40, (3, 260, 200): 50, (3, -1, -1): 9}
    w = lm.interpolation_weights(hist)[3]
    assert np.isclose(w.sum(), 1) and abs(w[3] - 9.5 / 100) < 1e-9
    r = 10.0 ** (lm.LOWEST + lm.CELL * np.array([259, 199]))
    value = lambda a, b: 40 * np.log(b * r[1] + (1 - a - b)) + 50 * np.log(a * r[0] + b * r[1] + (1 - a - b))
    grid = [(a, b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1, 101) if a + b < 1]
    assert value(*(w[:2] / (1 - w[3]))) >= max(value(a, b) for a, b in grid) - 0.05
