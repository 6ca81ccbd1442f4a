"""The operators with Python kernels against plain Python on small fixtures."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import common, decontamination, license_scan, near_dedup, perplexity, quality_rules, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, Score double"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefghijklmnoprstuvw") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, rng=R):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 7, 0.5) for k, t in rows], SCHEMA).repartition(3)


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# --- kernels --------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_words_and_grams(limit):
    texts = ["", "a", "Ab cé d", None, "  x\ty  ", " wide", "a b a b a b", "\n\n"]
    col = pa.array(texts).fill_null("")
    got, grams = [], []
    for lo, hi, buf, offsets in common.slices(col, limit):
        low = common.LOWER[buf]
        s, e, first = common.words(low, offsets, common.NOT_ALNUM)
        h = common.span_hash(common.prefix_hash(low), s, e)
        g, counts = common.grams(h, first, 2)
        at = 0
        for r in range(hi - lo):
            got.append([bytes(low[a:b]).decode() for a, b in zip(s[first[r] : first[r + 1]], e[first[r] : first[r + 1]], strict=True)])
            grams.append(len(set(g[at : at + counts[r]].tolist())))
            at += counts[r]
    assert got == [words(t) for t in texts]
    assert grams == [len({*zip(words(t), words(t)[1:], strict=False)}) for t in texts]


def test_equal_spans_hash_alike():
    buf = np.frombuffer(b"abcXabcYab", np.uint8)
    p = common.prefix_hash(buf)
    h = common.span_hash(p, np.array([0, 4, 8, 0]), np.array([3, 7, 10, 2]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


# --- near-dedup -----------------------------------------------------------------------------


def bag(t):
    w = words(t)
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)) if w)


def overlap(a, b):
    n = sum((a & b).values())
    return n / (sum((a | b).values()) or 1)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    wb[:60] = 0
    row = np.concatenate([np.zeros(300, int), np.ones(240, int)])
    sig = near_dedup.signatures(row, np.concatenate([x, x[60:]]), np.concatenate([wa, wb[60:]]), 2, 2048)
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.05
    one = near_dedup.signatures(row[:300], x, wa, 1, 2048)
    assert (one[0] == sig[0]).all()  # a bag's signature doesn't depend on its neighbours


def edited(t, n, rng):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def near_rows():
    rng = random.Random(9)
    base = [prose(120, rng) for _ in range(12)]
    rows = list(enumerate(base))
    for i in range(60):  # near copies of one text, which resemble it more than one another
        rows.append((100 + i, edited(base[0], 2, rng)))
    rows += [(200 + i, base[1]) for i in range(40)] + [(300, base[1].upper().replace(" ", "\n")), (301, base[2] + " tail"), (302, edited(base[3], 30, rng))]
    rows += [(400, ""), (401, None), (402, "one two"), (403, "One, two"), (404, "one three"), (405, "***"), (406, "***"), (None, base[4]), (3, base[3])]
    rows.append((500, " ".join(base[5].split() * 40)))
    rows.append((501, " ".join(base[5].split() * 40 + ["end"])))
    return rows


def test_near_dedup_groups(spark):
    rows = near_rows()
    got = near_dedup.groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = sorted({t or "" for _, t in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    bags = {t: bag(t) for t in texts}
    for a, b in combinations(texts, 2):
        same = words(a) == words(b) and (words(a) or a == b)
        if same or (bags[a] and bags[b] and overlap(bags[a], bags[b]) >= 0.8):
            root[find(a)] = find(b)
    want: dict = {}
    for k, t in rows:
        want.setdefault(find(t or ""), []).append(k)
    keys = lambda g: sorted((-1 if k is None else k) for k in g)
    found: dict = {}
    for r in got:
        found.setdefault(bytes(r["root"]), []).append(r["doc_id"])
        assert r["group_size"] >= 1
    assert sorted(map(keys, found.values())) == sorted(map(keys, want.values()))
    kept = near_dedup.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(want)
    assert near_dedup.groups(frame(spark, [])).count() == 0


# --- suffix dedup ---------------------------------------------------------------------------


def brute_repeats(rows, n):
    seen: Counter = Counter()
    raw = [(k, (t or "").encode()) for k, t in rows]
    for _, b in raw:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for k, b in raw:
        off = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                off[i : i + n] = True
        runs = int((off[1:] & ~off[:-1]).sum() + off[:1].sum())
        out.append((k, len(b), int(off.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~off])).hexdigest()))
    return Counter(out)


def repeat_rows():
    rng = random.Random(2)
    shared = prose(60, rng)
    rows = [(i, f"{prose(rng.randint(1, 30), rng)} {shared} {prose(rng.randint(1, 30), rng)}") for i in range(25)]
    rows += [(50 + i, prose(50, rng)) for i in range(10)] + [(70, rows[0][1]), (70, rows[0][1]), (None, rows[3][1]), (80, None), (81, ""), (82, "short")]
    rows += [(90, "ab" * 400), (91, "x" * 199), (92, "x" * 200), (93, "x" * 201), (94, "é☃" * 150), (95, shared[:210] + "\x00\x00"), (96, shared + shared)]
    return rows


@pytest.mark.parametrize(("bucket", "hot"), [(1 << 19, 12000), (3000, 12000), (1 << 19, 5), (2000, 1)])
def test_suffix_dedup(spark, bucket, hot):
    rows = repeat_rows()
    got = suffix_dedup.dedup(frame(spark, rows), bucket_bytes=bucket, hot_texts=hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(rows, 200)


def test_suffix_dedup_long_texts_and_names(spark):
    rng = random.Random(8)
    part, tail = prose(400, rng), prose(100, rng)
    texts = [f"{part} {prose(900, rng)} {tail}", f"{tail} {prose(300, rng)} {part}", part[:250]]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute_repeats(rows, 200)
    for piece in (1000, 331, 1 << 20):  # windows lie in one piece each, wherever pieces end
        found = []
        for k, t in rows:
            for _, skip, buf, offsets in suffix_dedup.long_slices(pa.array([t]), 200, piece):
                _, start, size, *_ = suffix_dedup.stretches(buf, offsets, 200, 64)
                found += [(k, a + skip + i) for a, n in zip(start.tolist(), size.tolist(), strict=True) for i in range(n - 199)]
        assert sorted(found) == [(k, i) for k, t in rows for i in range(len(t.encode()) - 199)]
    odd = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, N_bytes int, kept int")
    got = suffix_dedup.dedup(odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


def test_matching_statistics():
    texts = [b"banana", b"bandana", b"xyz", b"ana"]
    index = suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    ms = index.matching_statistics()
    starts = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]
    for t, i in starts:
        best = 0
        for u, j in starts:
            if (t, i) != (u, j):
                n = 0
                while i + n < len(texts[t]) and j + n < len(texts[u]) and texts[t][i + n] == texts[u][j + n]:
                    n += 1
                best = max(best, n)
        assert min(ms[index.begins[t] + i], len(texts[t]) - i) == best
    assert index.run_lengths.sum() == index.n and len(index.run_first) == len(index.run_last) == len(index.run_symbols)


# --- decontamination ------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, prose(30, rng)) for i in range(8)] + [(8, ""), (9, None), (10, "two words")]
    rows = [(i, prose(200, rng)) for i in range(20)]
    rows += [(100 + i, f"{prose(40, rng)} {items[i][1].upper()}. {prose(40, rng)}") for i in range(4)]
    rows += [(200, prose(20, rng) + " " + edited(items[4][1], 4, rng)), (201, items[5][1]), (201, items[5][1]), (None, items[6][1] + " end"), (202, None), (203, ""), (204, " ".join(items[7][1].split()[:8]))]
    rows += [(300 + i, items[0][1] + " " + prose(5, rng)) for i in range(200)]  # leaked often
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.scan(frame(spark, rows), bench).collect()
    want = Counter([(100 + i, i) for i in range(4)] + [(200, 4), (201, 5), (201, 5), (None, 6)] + [(300 + i, 0) for i in range(200)])
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == want
    exact = [r for r in got if r["doc_id"] == 101][0]
    assert exact["score"] == 1.0 and exact["end_word"] - exact["first_word"] == 30
    blocks = decontamination.scan(frame(spark, rows), bench, block_words=40).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in blocks) == want
    kept = decontamination.clean(frame(spark, rows), bench)
    assert kept.count() == len(rows) - sum(want.values()) and kept.columns == frame(spark, rows).columns
    by_blocks = decontamination.clean(frame(spark, rows), bench, block_words=40)
    assert Counter(by_blocks.collect()) == Counter(kept.collect()) and by_blocks.columns == kept.columns
    assert decontamination.clean(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontamination.scan(frame(spark, rows), bench.limit(0)).count() == 0 and decontamination.scan(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("copies", [1, 50])
def test_decontamination_at_every_edit_count(spark, copies):
    rng = random.Random(11)
    items = [(i, " ".join(f"{rng.choice(VOCAB)}{i}x{j}" for j in range(size))) for i, size in enumerate([30, 30, 24, 15, 12])]
    rows, texts = [], []
    for i, item in items:
        w = item.split()
        for edits in range(len(w) // 3 + 1):
            cut = list(w)
            for e in range(edits):  # evenly spread
                cut[(e + 1) * len(w) // (edits + 1)] = f"new{i}e{edits}x{e}"
            texts.append((i, f"{prose(30, rng)} {' '.join(cut)} {prose(30, rng)}"))
    # fragments of the items elsewhere, so that broken seeds are not the rarest
    rows += [(10_000 + i * 100 + j, f"{prose(5, rng)} {' '.join(item.split()[j : j + 3])} {prose(5, rng)}") for i, item in items for j in range(len(item.split()) - 2)]
    rows += [(100 * t + c, text) for t, (_, text) in enumerate(texts) for c in range(copies)]
    want = Counter()
    bench = dict(items)
    hashed = lambda t: np.array([hash(x) & (1 << 60) - 1 for x in words(t)], np.uint64)
    for k, t in rows:
        for i, item in bench.items():
            if decontamination.align(hashed(item), hashed(t))[0] / (2 * len(words(item))) >= 0.6:
                want[k, i] += 1
    got = decontamination.scan(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == want
    assert len(want) >= 30 * copies


def test_common_seeds_are_put_aside_safely():
    seeds = decontamination.Seeds([" ".join(f"w{i}" for i in range(30))], 3)
    seeds.keep_rare(np.arange(28) + 5000, 0.6)
    assert seeds.kept.sum() == 25  # 8 edits break at most 24
    seeds.keep_rare(np.arange(28), 0.6)
    assert seeds.kept.all()


def test_align():
    h = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert decontamination.align(h("abcdef"), h("xxabcdefyy")) == (12, 8)
    assert decontamination.align(h("abcdef"), h("xxabXdefyy"))[0] == 2 * 5 - 1
    assert decontamination.align(h("abcdef"), h("abcXdef"))[0] == 12 - 1
    assert decontamination.align(h("abc"), h(""))[0] == 0


# --- licenses -------------------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(1)
    rows = [(1, "Released under the MIT License. " + prose(20, rng)), (2, prose(30, rng)), (3, None), (4, ""), (None, "CC-BY NC under the mit license under the MIT license")]
    rows += [(5, prose(9, rng) + " it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"), (6, "licensed under the Apache License, Version 2.0"), (6, "licensed under the Apache License, Version 2.0")]
    got = license_scan.scan(frame(spark, rows)).collect()
    want = []
    for k, t in rows:
        w, at, labels = words(t), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want.append((k, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter(want)
    by = {r["doc_id"]: r for r in got}
    assert "gpl-3" in by[5]["labels"] and by[5]["score"] > 0.6 and by[2]["labels"] == "" and by[2]["score"] == 0.0 and by[6]["labels"] == "apache-2"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan(frame(spark, [])).count() == 0
    assert {r["labels"] for r in license_scan.scan(frame(spark, rows), max_template_grams=1).collect()} == {r["labels"] for r in got}


def test_license_families(spark):
    fsf = " as published by the Free Software Foundation"
    cases = [
        ("Our album was released under the new label.", ""),
        ("Released under the Apache License, Version 2.0.", "apache-2"),
        ("This work is licensed under the GNU General Public License, version 2", "gpl-2"),
        ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
        ("You can redistribute it under the terms of the GNU General Public License" + fsf + "; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
        ("under the terms of the GNU Lesser General Public License" + fsf + ", either version 3 of the License, or any later version", "lgpl"),
        ("under the terms of the GNU Affero General Public License" + fsf + ", either version 3 of the License, or any later version", "agpl-3"),
        ("This is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("This is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("This is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        ("Released under the MIT License", "mit"),
    ]
    cases += [(cases[1][0] + " " + cases[8][0], "apache-2,cc-by-nc")]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    for limit in (200_000, 60):
        got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows), max_template_grams=limit).collect()}
        assert [got[i]["labels"] for i, _ in rows] == [x for _, x in cases]
    assert got[0]["score"] == 0.0 and got[7]["score"] == 1.0


def test_license_templates_and_edits(spark):
    """Every notice gets its own label alone; so does a long one with a word lost, changed or added."""
    rng = random.Random(6)
    rows, want = [], {}
    for label, text in license_scan.TEMPLATES:
        w = text.split()
        edits = [w]
        if len(w) >= 18:
            at = len(w) // 2 if not {"version", "v."} & set(w) else 2
            edits += [w[:at] + w[at + 1 :], w[:at] + ["otherword"] + w[at + 1 :], w[:at] + ["additional"] + w[at:]]
        for x in edits:
            rows.append((len(rows), f"{prose(12, rng)}. {' '.join(x)}. {prose(12, rng)}"))
            base = {v for k, v in license_scan.PHRASES.items() if f" {k} " in f" {' '.join(words(rows[-1][1]))} "}
            want[len(rows) - 1] = ",".join(sorted({label} | base))  # fixed phrases always count
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == want


# --- quality --------------------------------------------------------------------------------


def test_rule_statistics(spark):
    rows = [(1, "a b c a b c x"), (2, "one\n two \none\n\none\n \n \n"), (3, "#$ %&| <>*"), (4, None), (5, ""), (6, "été x ☃"), (7, "a\x0bb\x0cc\rd"), (None, "z " * 500)]
    got = {r["doc_id"]: r for r in quality_rules.measure(frame(spark, rows)).collect()}
    for k, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(three)
        covered = {i + j for i, x in enumerate(three) if n[x] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert tuple(got[k][c] for c in quality_rules.COUNTS) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)), k


def test_forest_rejects_junk(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng.randint(60, 200), rng) + ".") for i in range(150)] + [(500 + i, " ".join(w + "***" for w in prose(80, rng).split())) for i in range(5)] + [(600, "few words"), (601, None), (None, prose(80, rng))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(500, 0, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["kept"] for i in range(150)) >= 147 and not any(got[500 + i]["kept"] for i in range(5))
    assert got[600]["base_failed"] and got[601]["base_failed"] and not got[601]["kept"]
    kept = quality_rules.keep(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r["kept"] for r in got.values())
    assert quality_rules.judge(frame(spark, []), labels.limit(0)).count() == 0
    assert quality_rules.judge(frame(spark, rows), labels.limit(0)).filter("kept").count() >= 150


def test_forest_against_brute_force():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 1)
    forest = quality_rules.Forest(x, 12, 64, 5, np.array([1.0, 2.0, 0.5]))

    def depth(t, point):
        node, n = 0, 0
        while forest.feature[t, node] >= 0:
            node = 2 * node + (2 if point[forest.feature[t, node]] >= forest.cut[t, node] else 1)
            n += 1
        return n, forest.length[t, node]

    for point, score in zip(x[:50], forest.score(x[:50]), strict=True):
        paths = [depth(t, point) for t in range(12)]
        assert all(a <= b for a, b in paths) and np.isclose(score, 2 ** (-np.mean([b for _, b in paths]) / quality_rules._path_norm(64)))
    assert forest.score(np.array([[50.0, 50.0, 50.0]]))[0] > forest.score(x).max() - 0.05


def test_separation_is_the_area_under_the_curve():
    rng = np.random.default_rng(4)
    x, bad = np.round(rng.normal(size=(80, 2)), 1), np.arange(80) < 20
    x[bad, 0] += 1
    for f in range(2):
        wins = np.mean([(a > b) + 0.5 * (a == b) for a in x[bad, f] for b in x[~bad, f]])
        assert np.isclose(quality_rules.separation(x, bad, 1.0, 0.0)[f], abs(2 * wins - 1))


def test_verdicts_on_labelled_documents(spark):
    """Bad documents go, good ones that pass the base rules stay; the forest sees nearly as many points as texts."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    points = quality_rules.measure(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    assert points.select("features").distinct().count() > 850
    got = quality_rules.query(spark, sf).join(labels, "doc_id").filter("not base_failed")
    rate = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[0] <= 0.02 and rate[1] >= 0.985


# --- perplexity -----------------------------------------------------------------------------


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, from its definition."""
    grams = Counter()
    for t in texts:
        b = b"\n" * (order - 1) + t.encode()
        grams.update(b[i : i + order] for i in range(len(b) - order + 1))
    tables = {order: grams}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    disc = {}
    for k, t in tables.items():
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        disc[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if y is not None and n[i] else 0.5 * i for i in (1, 2, 3)]

    def p(g, k):
        if k == 0:
            return 1 / 256
        t, ctx = tables[k], g[-k:-1]
        own = {x: c for x, c in t.items() if x[:-1] == ctx}
        if not own:
            return p(g, k - 1)
        total = sum(own.values())
        d = lambda c: disc[k][min(c, 3) - 1]
        c = own.get(g[-k:], 0)
        return (max(c - d(c), 0) / total if c else 0) + sum(map(d, own.values())) / total * p(g, k - 1)

    return p


def test_perplexity_matches_definition(spark):
    rng = random.Random(6)
    rows = [(i, prose(12, rng)) for i in range(30)] + [(100, "qqq zzz"), (101, ""), (102, None), (None, prose(5, rng)), (103, "été")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(25, 0, 0), (26, 1, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in perplexity.classify(df, labels, order=3).collect()}
    assert len(got) == len(rows)
    half = spark.createDataFrame([(i,) for i in range(20)], "k long").selectExpr("k", "pmod(xxhash64(3, 'half', k), 2L) as h").collect()
    train = [dict(rows)[r["k"]] for r in half if r["h"] == 0]
    p = brute_model(train, 3)
    for k in (0, 7, 100, 103, None):
        b = b"\n\n" + dict(rows)[k].encode()
        want = -np.mean([np.log2(p(b[i : i + 3], 3)) for i in range(len(b) - 2)])
        assert abs(got[k]["bits"] - want) < 1e-6, k
    assert got[101]["kept"] and got[101]["n_bytes"] == 0 and got[102]["bits"] == 0 and not got[100]["kept"]
    assert perplexity.classify(frame(spark, []), labels).count() == 0
    assert perplexity.classify(df, labels.limit(0)).filter("kept").count() == len(rows)


def test_perplexity_crossed_counts_every_trusted_document(spark):
    """Each half is scored by all trusted documents of the other, and its own ones set its threshold; ids may come in parts."""
    rng = random.Random(7)
    rows = [(i, prose(12, rng)) for i in range(30)] + [(100, "qqq zzz"), (101, ""), (102, None), (103, "été")]
    trusted = range(20)
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(25, 0, 0), (26, 1, 1)], "doc_id long, quality int, toxic int")
    half = {r["k"]: r["h"] for r in spark.createDataFrame([(k,) for k, _ in rows], "k long").selectExpr("k", "pmod(xxhash64(3, 'half', k), 2L) as h").collect()}
    assert {half[i] for i in trusted} == {0, 1}
    text = dict(rows)
    p = [brute_model([text[i] for i in trusted if half[i] != h], 3) for h in (0, 1)]
    want = {}
    for k, t in rows:
        if t:
            b = b"\n\n" + t.encode()
            want[k] = -np.mean([np.log2(p[half[k]](b[i : i + 3], 3)) for i in range(len(b) - 2)])
    got = {r["doc_id"]: r for r in perplexity.classify(frame(spark, rows), labels, order=3, crossed=True).collect()}
    assert len(got) == len(rows)
    for k, bits in want.items():
        cut = max(np.ceil(want[i] * 1000) / 1000 for i in trusted if half[i] == half[k]) * 1.02
        assert abs(got[k]["bits"] - bits) < 1e-6 and got[k]["threshold"] == pytest.approx(cut) and got[k]["kept"] == (bits <= cut), k
    assert got[101]["kept"] and got[102]["kept"] and not got[100]["kept"]
    parts = perplexity.classify(frame(spark, rows), labels, order=3, crossed=True, ids_at_once=6).collect()
    assert {r["doc_id"]: r for r in parts} == got


def test_perplexity_on_labelled_documents(spark):
    """Good documents stay, trusted or not; most bad ones go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = perplexity.query(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    rate = {r["quality"]: r["kept"] for r in got}
    assert rate[1] >= 0.98 and rate[0] <= 0.2
