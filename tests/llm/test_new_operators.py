"""Spelling variants, fill-in-the-middle and near vectors: odd tables against plain versions, and whole tables against their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.llm import fill_middle, licenses, packing, spelling, subspace
from ostinato.llm.queries import ORACLES, QUERIES, tokenizer_path
from ostinato.llm.wavelet import WaveletTree

from .test_contracts import corpus

TEXTS = "doc_id long, text string, lang string, source string, n_chars long, anchor long, fp int, marks string, size int, score string, row int, bucket int, key int, span int"


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(900, "Wordy " * 3 + "wordz " * 9 + "WORDS " * 40 + "swords ÀÉîwords àÉîwords " * 3, *[None] * 12), (901, ("x" * 5000 + " " + "x" * 4999 + "Y ") * 3, *[None] * 12), (902, "a<S>b", *[None] * 12), (903, "<M>", *[None] * 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, TEXTS).repartition(5)


def bag(found):
    return Counter(map(tuple, found))


@pytest.mark.parametrize("name", ["op6_license_scan", "op11_spelling_variants", "op12_fill_in_middle", "op13_near_vectors"])
def test_whole_tables_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    expected = con.sql(ORACLES[name])
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(expected.columns)
    assert bag(found.select(*expected.columns).collect()) == bag(expected.fetchall())


# 11. Spelling variants


def plain_variants(rows, least_n=3, ratio=2):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return plain_forms({w: n for w, n in counts.items() if n >= least_n}, ratio)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, ratio=2):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = Counter()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[(w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)] += 1
    return out


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 64, 100):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        left, low = rng.integers(0, n + 1, 60), rng.integers(0, n + 1, 60)
        right, high = np.minimum(n, left + rng.integers(0, 30, 60)), np.minimum(n, low + rng.integers(0, 30, 60))
        box, value = tree.report(left, right, low, high)
        expected = {(i, int(v)) for i in range(60) for v in values[left[i] : right[i]] if low[i] <= v < high[i]}
        assert set(zip(box.tolist(), value.tolist())) == expected and len(box) == len(expected)


def test_variants_of_odd_texts(docs, rows, spark):
    found = bag(spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert found == plain_variants(rows) and len(found) > 3
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert spelling.spelling_variants(docs.where("text is null or text = ''")).collect() == []


@pytest.mark.parametrize("block", [7, 60, 100_000])
def test_forms_whatever_the_blocks(spark, block):
    """Few letters, so that nearly all words have many near ones; common beginnings and ends, ties, very long words, chains."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 7))) for _ in range(300)}
    words |= {"prefix" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(60)} | {"".join(rng.choice("abc") for _ in range(4)) + "suffix" for _ in range(60)}
    long = "".join(rng.choice("abc") for _ in range(3000))
    words |= {long, long[:1500] + "z" + long[1501:], long[:2999], "z" + long, long[:10] + long[11:], "日本語", "日本", "日本人", "😀x", "😀y", "x"}
    counts = {w: rng.choice([1, 1, 2, 3, 4, 8, 16, 64]) for w in words}
    got = spelling.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), block=block)
    assert bag(got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == plain_forms(counts)


def test_splits_spread_a_hot_beginning():
    """Words that share a long beginning ask few blocks: their ends tell them apart."""
    words = sorted("commonbeginning" + format(i, "05b").replace("0", "q").replace("1", "z") + f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))
    words = sorted(set(words))
    forward = [(len(w), w) for w in words[::50]]
    reverse = sorted((len(w), w[::-1]) for w in words)[::50]
    asked = []
    for w in words[::37]:
        asked.append(min(sum(b - a + 1 for a, b in (spanned(w, forward, w[:m]), spanned(w, reverse, w[::-1][: len(w) - m]))) for m in spelling._splits(len(w))))
    assert max(asked) <= 8 < len(forward)


def spanned(w, starts, part):
    return spelling.spanned(starts, len(w), part)


# 12. Fill in the middle


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, text, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, text, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, text, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, rows):
    made = fill_middle.fill_in_middle(docs)
    found = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert bag(r[:7] for r in found) == Counter(plain_fill(r[0], r[1]) for r in rows)
    assert all(r["back"] == r["text"] for r in found) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_fill_cuts_at_every_kind_of_edge(spark):
    """Units over the edges of blocks, texts of letters alone and of none, code points beyond 16 bits, half markers at a cut."""
    texts = ["a" * 1000, "." * 1000, "😀" * 300 + "ab" * 200, ("word " * 51 + "x") * 9, "é" * 255 + "abc" + "é" * 255 + "abcdef", "<P" * 200, "<" * 300 + ">", "\n" * 257, "S><S" * 90]
    rows = [(i, t) for i, t in enumerate(t for t in texts for _ in range(12))]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    found = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert bag(r[:7] for r in found) == Counter(plain_fill(*r) for r in rows) and all(r["back"] == r["text"] for r in found)


def test_texts_are_dealt_once(docs):
    """One exchange of the texts: the others of the plan read it again."""
    plan = fill_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan()
    spark = docs.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fill_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("ReusedExchange") >= 2 and plan.count("Exchange hashpartitioning(key") - plan.count("ReusedExchange") <= 1


# 13. Near vectors


def plain_links(rows, least=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float) / np.abs(np.array(v, float)).max()
        return x / np.sqrt((x**2).sum())

    units = [unit(v) for _, v in rows]
    links = defaultdict(set)
    for i, a in enumerate(units):
        for j in range(i):
            if a is not None and units[j] is not None and len(a) == len(units[j]) and a @ units[j] >= least:
                links[i].add(j)
                links[j].add(i)
    out = Counter()
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least_id = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[(vec_id, len(links[i]), least_id, vec_id == least_id)] += 1
    return out


def vector_rows(dim=24, n=400):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    base[n // 2 :] = base[rng.integers(0, 6, n - n // 2)] + rng.standard_normal((n - n // 2, dim)).astype(np.float32) * rng.choice([0.05, 0.2, 0.3], (n - n // 2, 1)).astype(np.float32)
    chain = [np.r_[np.cos(t), np.sin(t), np.zeros(dim - 2)] for t in np.arange(0, 2, 0.3)]
    vectors = [v.tolist() for v in base] + [c.tolist() for c in chain] + [base[0].tolist()] * 40 + [(base[1] * 7).tolist(), (base[1] * 1e-30).tolist(), (-base[1]).tolist()]
    vectors += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0] * 3, [1.0, 1.0, 1.1], [1.0], [2.0], [-1.0], [1.0] * 3]
    return [(None if i % 97 == 5 else i - i % 2 if i % 61 == 0 else i, v) for i, v in enumerate(vectors)] + [(3, base[3].tolist()), (3, base[3].tolist()), (3, base[300].tolist())]


@pytest.mark.parametrize("box", [15, 60, 100_000])
def test_near_vectors(spark, box):
    rows = vector_rows()
    table = spark.createDataFrame([(i, v, 1, 2, "x", "y", 3) for i, v in rows], "vec_id long, embedding array<float>, class int, copies int, v string, root string, links int").repartition(3)
    found = bag(subspace.near_vectors(table, box=box).select("vec_id", "n_links", "component_id", "kept").collect())
    expected = plain_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert found == expected and sum(r[1] > 0 for r in found) > 150
    assert subspace.near_vectors(table.limit(0)).collect() == []
    assert all(r["n_links"] == 0 for r in subspace.near_vectors(table.where("embedding is null")).collect())


def test_shares_hold_every_near_pair():
    """The pigeonhole: a pair within the whole distance is within some block's share, and meets in one box of that block."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 64))
    y = x + rng.standard_normal((500, 64)) * 0.2
    a, b = subspace.rotated(x), subspace.rotated(y)
    near = (a * b).sum(1) >= 0.95
    edges = subspace.block_edges(64)
    apart = np.stack([((a - b)[:, s:e] ** 2).sum(1) <= 0.1 * (e - s) / 64 + 1e-12 for s, e in zip(edges, edges[1:])], axis=1)
    assert near.sum() > 50 and apart[near].any(1).all()
    for k, (s, e) in enumerate(zip(edges, edges[1:])):
        points = np.r_[a[:, s:e], b[:, s:e]]
        row, box, home = subspace.boxes_touched(subspace.median_tree(points[::3], 16), points, 0.1 * (e - s) / 64)
        own = dict(zip(row[home].tolist(), box[home].tolist()))
        assert len(own) == len(points) == home.sum()
        touched = set(zip(row.tolist(), box.tolist()))
        assert len(touched) == len(row)
        for i in np.flatnonzero(apart[:, k]):
            later = max(own[i], own[i + 500])
            assert (i, later) in touched and (i + 500, later) in touched


# 5. Packing, its tree


@pytest.mark.parametrize("windows", [9, 64, 70])
def test_tree_merges_like_best_fit_of_all_leaf_bins(spark, windows):
    """Two and three levels: nearly as many bins as one best-fit of all the windows' bins leaves, and no two left that would fit into one."""
    rng = np.random.default_rng(windows)
    rows = []
    for w in range(windows):
        _, _, fill = packing.best_fit(rng.integers(200, 1100, 14), 2048)
        rows += [(w, (w << 32) + i, int(f)) for i, f in enumerate(fill)]
    whole = packing.best_fit(np.array([r[2] for r in rows]), 2048)[2]
    bins = {b: f for _, b, f in rows}
    grp, groups = {b: g for g, b, _ in rows}, windows
    while groups > 1:
        groups = -(-groups // packing.FAN_IN)
        grp = {b: g // packing.FAN_IN for b, g in grp.items()}
        under = spark.createDataFrame([(grp[b], b, f) for b, f in bins.items() if f < 2048], "grp long, bin long, fill long")
        for r in sorted(packing._merge_round(under, 2048).collect(), key=lambda r: (r["into"], r["shift"])):
            assert r["shift"] == bins[r["into"]] and r["bin"] not in (r["into"],)
            bins[r["into"]] += bins.pop(r["bin"])
            assert bins[r["into"]] <= min(2048, r["fill"])
    assert sum(bins.values()) == sum(whole.tolist()) and len(bins) <= 1.01 * len(whole) + 1
    assert sum(sorted(bins.values())[:2]) > 2048


def test_tree_over_documents(spark):
    """Windows of ten pieces, so that the tree has levels: every sequence is whole, and there are few more than in one window."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = []
    for window in (10, 40_000):
        got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=window).select("sequence_id", "offset", "length").collect()
        ends = {}
        for r in sorted(got):
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(ends.values()) <= 2048
        counts.append(len(ends))
    assert counts[0] <= 1.05 * counts[1]  # bins of ten pieces are coarse items


def test_histogram_merge():
    moves = packing.merge_by_histogram([(1, 900), (2, 30), (3, 1000)], {1030: 1, 1040: 1, 1150: 2}, 2048)
    # 1000 goes to 1040, 900 to 1030, not to 1150 (2050), 30 to the fullest with room.
    assert {(m[0], m[1], m[3], m[4], m[2]) for m in moves} == {(3, None, 1040, 0, 1040), (1, None, 1150 if 1150 + 900 <= 2048 else 1030, 0, 1030), (2, None, 1030, 0, 1930)}
    assert packing.merge_by_histogram([(1, 500), (2, 600)], {}, 2048) == [(1, 2, 600, 0, 0, 1100)]
    assert packing.merge_by_histogram([], {100: 3}, 2048) == []


# 6. License scans, short forms


def test_titles_identifiers_and_close_calls(spark):
    texts = {
        "a.py": ("# SPDX-License-Identifier: MIT", "MIT"), "b.py": ("# MIT License", "MIT"), "c/LICENSE": ("MIT License", "MIT"), "d.c": ("GNU GPL v3", "GPL-3.0"), "e.c": ("License: BSD", "BSD"), "f/LICENSE": ("Mozilla Public License Version 2.0", "MPL-2.0"),
        "g.go": ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), "h/LICENSE": ("Eclipse Public License Version 2.0", "EPL-2.0"), "i/COPYING": ("GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3", "AGPL-3.0"), "j.py": ("code\n# SPDX-License-Identifier: GPL-2.0\nmore", "GPL-2.0"),
        "k.txt": ("people who want to modify the river are subject to conditions of their own", None), "l.txt": ("GNU General Public License", "GPL"),
    }
    for names in (list(texts), ["f/LICENSE"], ["a.py", "g.go"]):  # whatever other files there are
        rows = [(i, n, texts[n][0]) for i, n in enumerate(names)]
        got = {r["path"]: r["own_license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
        assert got == {n: texts[n][1] for n in names}


def plain_licenses(texts):
    """Every unit against every template, without any bound. The texts have no blank lines and aren't license files."""
    terms = lambda x: Counter(re.findall("[a-z0-9]+", x.lower()))
    telling, known = set(licenses.telling_terms()), set(licenses.template_terms(1))
    units = [{x.strip(" ") for x in (*t.split("\n"), t)} for t in texts]
    counts = lambda u: len(u.keys() & telling) >= 2 and 10 * len(u.keys() & known) >= len(u)
    counted = [terms(x) for own in units for x in own if counts(terms(x))] + [terms(b) for _, b in licenses.TEMPLATES]
    df = Counter(t for c in counted for t in c)
    weighed = lambda c: {t: n * (np.log((1 + len(counted)) / (1 + df[t])) + 1) for t, n in c.items()}
    length = lambda w: sum(x * x for x in w.values()) ** 0.5
    out = []
    for own in units:
        found = []
        for w in (weighed(terms(x)) for x in own):
            best = Counter()
            for name, v in ((a, weighed(terms(b))) for a, b in licenses.TEMPLATES):
                if w.keys() & v.keys() & telling:
                    best[name] = max(best[name], round(sum(w[t] * v[t] for t in w.keys() & v.keys()) / length(w) / length(v), 6))
            (one, name), (two, _) = sorted([*((c, n) for n, c in best.items()), (0, ""), (0, "")], reverse=True)[:2]
            if one >= 0.5 and round(one - two, 6) >= 0.01:
                found.append((-one, -len(name), name))
        out.append((min(found)[2], -min(found)[0]) if found else (None, None))
    return out


def test_every_unit_that_reaches_the_threshold(spark):
    """Also one telling term alone, and a notice that repeats among many other words."""
    rng = random.Random(5)
    short = ["MIT", "# Unlicense", "Apache", "GPL-3", "code\n// lgpl v3\nmore", "Mozilla", "mit " * 30 + " ".join(f"word{i}" for i in range(12)), "MIT License " * 40 + " ".join(f"x{i}" for i in range(60)), "nothing", ""]
    words = [*licenses.template_terms(1), *[f"other{i}" for i in range(20)]]
    texts = short + ["\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8]))) for _ in range(2)) for _ in range(150)]
    rows = [(i, f"{i}.txt", t) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    expected = plain_licenses(texts)
    got = {r["file_id"]: (r["own_license"], r["cosine"]) for r in licenses.scan_licenses(files).collect()}
    assert [got[i][0] for i in range(len(texts))] == [e[0] for e in expected]
    assert all(got[i][1] == pytest.approx(e[1], abs=2e-6) for i, e in enumerate(expected) if e[0])
    assert [got[i][0] for i in (0, 1, 2, 6, 7)] == ["MIT", "Unlicense", "Apache", "MIT", "MIT"]
    gated = {r["file_id"]: r["own_license"] for r in licenses.scan_licenses(files, only_counted=True).collect()}
    assert gated[0] is None and gated[6] is None and sum(x is not None for x in gated.values()) < sum(x[0] is not None for x in expected)


def test_whole_scan_against_sql(spark, sf_dir):
    """The tables hold prose that reaches the threshold without counting."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    expected = con.sql(ORACLES["license_scan_whole"])
    found = QUERIES["license_scan_whole"](spark, sf_dir)
    assert bag(found.select(*expected.columns).collect()) == bag(expected.fetchall())
    assert bag(found.collect()) != bag(QUERIES["op6_license_scan"](spark, sf_dir).collect())
