"""Each operator against a plain, quadratic or sequential version, on texts with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ostinato.llm import components, licenses, mixing, packing, preferences, simhash, substring, syncmers, token_files, tokens, topk, toxicity
from ostinato.llm.common import scratch_path
from ostinato.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor long, fp int, marks string, size int, score string, row int, bucket int, key int, span int"
EXTRA = (1, 2, "m", 3, "s", 4, 5, 6, 7)


def corpus():
    rng = random.Random(7)
    words = ["the", "of", "Über", "naïve", "x", "re", "音楽", "and", "idiot", "b.", "😀", "co-op"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = say(60), say(20_000)
    texts = [None, "", " \t\n", "one", "two words", "a b c", say(34), say(35), say(36), passage, say(20) + "\n" + passage + " " + say(30), passage + "\t" + passage, "la " * 300, long, long[: len(long) // 2], "tail\x1cx \x01 y z <|endoftext|> é İ", "x" * 5000, "A B C", "a  b\nc"]
    base = say(200).split(" ")
    for i in range(8):
        copy = list(base)
        copy[20 * i] = f"new{i}"
        texts.append(" ".join(copy))
    texts += [texts[9], texts[9], texts[13]] + [say(rng.randint(1, 400)) for _ in range(40)]
    rows = [(i, t, "en", ["b", "a", None, "c", "a"][i % 5], None, *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, passage, None, None, 1, *EXTRA), (None, None, None, "a", 1, *EXTRA), (10, "another text with the same id", None, "b", 1, *EXTRA)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(found):
    return Counter(map(tuple, found))


# 1. Fingerprints


def plain_syncmers(text, k=24, inner=8):
    """(place, k-mer) of the closed syncmers, one inner substring at a time: the least hash lies first or last, and where several are
    equally least one of them does. The inner hash is the module's, asked for one substring at a time."""
    chosen, least = [], [int(syncmers.inner_hashes(text[i : i + inner])[0]) for i in range(len(text) - inner + 1)]
    for i in range(len(text) - k + 1):
        order = least[i : i + k - inner + 1]
        if min(order) in (order[0], order[-1]):
            chosen.append((i, text[i : i + k]))
    return chosen


def test_syncmers_are_context_free(rows):
    for text in ["", "short", "x" * 40, rows[10][1][:400], rows[24][1][:300]]:
        places, hashes = syncmers.chosen_kmers(text)
        chosen = plain_syncmers(text)
        assert places.tolist() == [i for i, _ in chosen]
        # Equal k-mers have equal hashes, others don't, whatever stands around them.
        assert len(set(zip(hashes.tolist(), (kmer for _, kmer in chosen)))) == len({kmer for _, kmer in chosen}) == len(set(hashes.tolist()))
        for (_, kmer), value in list(zip(chosen, hashes.tolist()))[::7]:
            assert syncmers.chosen_kmers(kmer)[1].tolist() == [value]


def test_edit_likeness_from_the_definition(docs, rows):
    """Edited texts, their hashes and both likenesses by sets of k-mers, without the module's sketches."""
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = Counter()
    like = lambda a, b: round(len(a & b) / len(a | b), 9) if a | b else 1.0
    # A text without anchors has itself as its only one.
    anchors = lambda x: {kmer for _, kmer in plain_syncmers(x)} or ({x} if x else set())
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        if len(text) < 3000 and len(after) < 3000:
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            expected[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(anchors(text), anchors(edited)), like(anchors(text), anchors(after)))] += 1
    keys = {e[:3] for e in expected}
    found = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in syncmers.edit_likeness(docs).collect()]
    assert len(expected) > 40 and Counter(f for f in found if f[:3] in keys) == expected


def test_edit_likeness(docs, rows, empty):
    found = bag(r[:5] for r in syncmers.edit_likeness(docs).collect())
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = Counter()
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        edited = syncmers.edited_text(text, after)
        prints = [syncmers.as_string(syncmers.sketch(syncmers.closed_syncmers(x)[1])) for x in (text, edited)]
        expected[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints)] += 1
    assert found == expected
    assert syncmers.edit_likeness(empty).count() == 0


def test_likeness_follows_the_true_share(docs):
    got = {r["doc_id"]: r for r in syncmers.edit_likeness(docs).where("doc_id = 13").collect()}
    text_hashes = got[13]["fingerprint"]
    assert syncmers.likeness(syncmers.from_string(text_hashes), syncmers.from_string(text_hashes)) == 1.0
    assert 0.3 < got[13]["near_edited"] < 0.75 and got[13]["near_next"] < got[13]["near_edited"]


def test_likeness_is_that_of_all_anchors(docs, rows):
    """Of long texts too, whose sketch holds a small part of their anchors."""
    got = next(r for r in syncmers.edit_likeness(docs).where("doc_id = 13 and n_chars > 50000").collect())
    after = next(r[1] for r in rows if r[0] == 12)
    own, edited, following = (set(syncmers.closed_syncmers(x)[1].tolist()) for x in (rows[13][1], syncmers.edited_text(rows[13][1], after), after))
    assert len(own) > 10 * syncmers.BOTTOM and got["n_anchors"] == len(own)
    assert got["near_edited"] == len(own & edited) / len(own | edited) and got["near_next"] == len(own & following) / len(own | following)


def test_anchors_meet_where_texts_do(spark):
    shared = "a passage that both of these documents hold in the middle of their own words, word for word"
    two = spark.createDataFrame([(1, "first comes this " + shared), (2, "quite another beginning, much longer, " + shared + " end")], "doc_id long, text string")
    anchors = syncmers.syncmer_anchors(two)
    met = anchors.where("doc_id = 1").alias("a").join(anchors.where("doc_id = 2").alias("b"), "hash").selectExpr("b.place - a.place as d").distinct().collect()
    assert [r["d"] for r in met] == [len("quite another beginning, much longer, ") - len("first comes this ")]


# 2. Mixing


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [5, 2, 1] * 9))
    capped, whole = set(), sum(sizes.values())
    while True:
        level = (whole - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert dict(by_target) == {(sizes[s], round(target[s], 6)): int(target[s] + 0.5) for s in names}
    assert bag((r["doc_id"], r["size"]) for r in got) == bag((r[0], len((r[1] or "").encode().split())) for r in rows)
    assert bag(got) == bag(mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(empty).count() == 0


def test_mixed_documents(docs):
    wanted = sum(r["taken"] for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r["text"].encode().split()) for r in mixed.collect()) == wanted


# 3. Preferences


def test_preferences(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "why <|end|>"), (1, 3, "assistant", "so"), (2, 0, "user", "q"), (3, 0, None, None), (3, 0, None, None), (None, 0, "user", "lost"), (4, None, "user", "late"), (4, 1, "assistant", "x")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "why <|end|>"), (1, 3, "assistant", "no"), (2, 0, "user", "q"), (3, 0, None, None), (4, 1, "assistant", "y"), (5, 0, "user", "alone")]
    schema = "pair_id long, turn long, role string, text string"
    got = preferences.format_preferences(spark.createDataFrame(c, schema).selectExpr("*", "1 as part", "2 as _common"), spark.createDataFrame(r, schema)).collect()
    of = lambda pair: sorted((x["part"], x["turn"], x["trained"]) for x in got if x["pair_id"] == pair)
    assert of(1) == [("chosen", 3, True), ("prompt", 0, False), ("prompt", 1, False), ("prompt", 2, False), ("rejected", 3, True)]
    assert of(2) == [("prompt", 0, False)]
    assert of(3) == [("chosen", 0, False), ("chosen", 0, False), ("rejected", 0, False)]
    assert [x[:2] for x in of(4)] == [("chosen", 1), ("chosen", (1 << 62) - 1), ("rejected", 1)]
    assert of(5) == [("rejected", 0, False)] and not of(None)
    assert [x["rendered"] for x in got if x["pair_id"] == 1 and x["turn"] == 2] == ["<|user|>\nwhy < |end| ><|end|>\n"]
    nothing = spark.createDataFrame([], schema)
    assert preferences.format_preferences(nothing, nothing).count() == 0


def test_pairs_in_one_row(spark):
    schema = "pair_id long, turn long, role string, text string"
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "why"), (1, 3, "assistant", "so"), (2, 0, "user", "q"), (3, 0, "assistant", "long " * 50_000)]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "q")]
    rows = preferences.format_preferences(spark.createDataFrame(c, schema), spark.createDataFrame(r, schema))
    got = {x["pair_id"]: x for x in preferences.paired(rows).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[2]["prompt"] == "<|user|>\nq<|end|>\n" and got[2]["chosen"] == got[2]["rejected"] == ""
    trained = lambda x, side: [x[side][a:b] for a, b in x[side + "_spans"]]
    assert trained(got[1], "chosen") == ["yes<|end|>\n", "so<|end|>\n"] and trained(got[1], "rejected") == ["no<|end|>\n"]
    assert trained(got[2], "chosen") == [] and trained(got[3], "chosen") == ["long " * 50_000 + "<|end|>\n"]
    assert preferences.paired(rows.limit(0)).count() == 0


def test_replies_against_partner(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a2"), (2, 0, "user", "alone"), (4, 0, "user", "q"), (4, 1, "assistant", None), (6, None, "assistant", "x"), (7, 0, None, None), (None, 0, "assistant", "z")]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "conv_id long, turn long, role string, text string, pair_id int, _last int")
    chosen, rejected = (sorted(map(tuple, x.collect()), key=str) for x in preferences.replies_against_partner(frame))
    assert chosen == sorted([r for r in rows if r[0] is not None and r != (0, 2, "user", "more")], key=str)
    assert [x for x in rejected if x[0] in (0, 1, 4)] == sorted([(0, 0, "user", "q"), (0, 1, "assistant", "a2"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (4, 0, "user", "q"), (4, 1, "assistant", "")], key=str)
    assert [x for x in rejected if x[0] not in (0, 1, 4)] == [x for x in chosen if x[0] not in (0, 1, 4)]
    assert all(x.count() == 0 for x in preferences.replies_against_partner(frame.limit(0)))


# 4. Token files


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, rows):
    rng = random.Random(1)
    bits = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\xa0", "\x1c", "\x01", "é", "́", "'s", "'", ".", "!!", "1", "23", "<|endoftext|>", "中", "😀", " ", "ß", "İ", "Σ", "\r\n", "word", " the", "\x85", "​"]
    texts = [r[1] or "" for r in rows if r[0] != 13] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    own, plain = tokens.encoder(tokenizer_path(name)), library(name)
    for text in texts:
        assert np.frombuffer(own.ids(text), own.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs, rows, empty):
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write_tokens(docs, folder, tokenizer_path("byte_bpe_50k.json"))
    got = sorted(map(tuple, token_files.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    plain, start, expected = library("byte_bpe_50k.json"), 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert token_files.document_ids(folder, manifest, len(expected) - 1).tolist() == ids
        start += len(ids)
    assert got == expected
    assert token_files.round_trip(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


# 5. Packing


@pytest.mark.parametrize("window", [40_000, 20])
def test_packing(docs, rows, window):
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=512, with_ids=True, window=window)
    got = packed.collect()
    plain, expected = library("word_bpe_49k.json"), Counter()
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 512):
            part = np.array(ids[i : i + 512], "<u4").tobytes()
            expected[(r[0], i // 512, i, len(part) // 4, zlib.crc32(part))] += 1
    assert bag((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == expected
    held = defaultdict(list)
    for x in got:
        held[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 512
    least = -(-sum(x["length"] for x in got) // 512)
    assert len(held) <= least * 1.05 + 1
    assert sum(len(s["ids"]) for s in packing.sequences(packed).collect()) == sum(x["length"] for x in got)


def test_packing_nothing(empty):
    assert packing.pack(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fill = packing.best_fit(np.array([5, 4, 4, 3, 1]), 10)
    assert bins.tolist() == [0, 0, 1, 1, 0] and offsets.tolist() == [0, 5, 0, 4, 9] and fill.tolist() == [10, 7]


# 6. Licenses


def test_licenses(spark):
    files = [
        (1, "src/LICENSE", "Some head\nReleased under the MIT License.\n"),
        (2, "src/a/b.py", "print()"),
        (3, "src/a/c.py", "# Licensed under the Apache License, Version 2.0."),
        (4, "src/a/deep/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (5, "src/a/deep/er/x.py", None),
        (6, "other/y.py", ""),
        (7, None, "Licensed under CC BY-NC 4.0."),
        (8, "z.py", "he licenced nothing of the kind to anyone at all whatever they said"),
        (9, "src/LICENSE", "Released under the MIT License.\nReleased under the MIT License."),
        (2, "src/a/b.py", "print()"),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "1 as file_id", "2 as directory", "3 as line")).collect()
    assert sorted((r["file_id"], r["license"], r["inherited_from"]) for r in got if r["path"] and r["license"]) == [(1, "MIT", "src"), (2, "MIT", "src"), (2, "MIT", "src"), (3, "Apache-2.0", "src"), (4, "GPL-3.0", "src/a/deep"), (5, "GPL-3.0", "src/a/deep"), (9, "MIT", "src")]
    assert [(r["license"], r["inherited_license"]) for r in got if r["file_id"] == 7] == [("CC-BY-NC-4.0", None)]
    assert {r["file_id"] for r in got if not r["license"]} == {6, 8} and len(got) == len(files)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_whole_notices(spark):
    """License files and header blocks are found by their words, also wrapped, also without any word for license."""
    notice = {(a, len(b)): b for a, b in licenses.TEMPLATES}
    longest = {a: notice[a, max(n for x, n in notice if x == a)] for a, _ in notice}
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    code = "import nothing\n\nfor each in some_list:\n    print(each)\n"
    files = []
    for i, name in enumerate(sorted(longest)):
        files.append((3 * i, f"{i}/COPYING", "Copyright somebody\n\n" + longest[name] + "\n\nNo promises are made here.", name))
        files.append((3 * i + 1, f"other{i}/x.py", wrap(longest[name], "# ") + "\n\n" + code, name))
        files.append((3 * i + 2, f"{i}/deep/y.py", code, name))
    long = (9999, "long/z.txt", "word and other words in a very long line " * 30_000, None)
    rows = [*files, long]
    got = {r["file_id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")).collect()}
    assert got == {r[0]: r[3] for r in rows}


# 7. Toxicity


def labelled(spark, n=1200):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 10 == 0
        for _ in range(3 * bad):
            text[rng.randrange(60)] = rng.choice(["badword", "uglyphrase", "meanly"])
        rows.append((i, " ".join(text), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4), rows


def plain_terms(text):
    """Words and the beginnings of longer words, by hand."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        out[word] += 1
        for size in (4, 5, 6, 7):
            if len(word) > size:
                out[word[:size] + "~"] += 1
    return out


def plain_scores(texts, labels):
    """{id: (score before calibration, [(example, cosine)])} from dense vectors over every term of the corpus; labels: {id: label}."""
    counts = {i: plain_terms(t or "") for i, t in texts.items()}
    corpus = Counter()
    for c in counts.values():
        corpus.update(c)
    everything, taught = sum(corpus.values()), sorted(labels)
    rows = {y: [i for i in taught if labels[i] == y] for y in (0, 1)}
    log = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
    known = {t for i in taught for t in counts[i]}

    def factor(term):
        if term not in known:
            return math.sqrt(0.05)
        a, b, m, n = sum(term in counts[i] for i in rows[1]), sum(term in counts[i] for i in rows[0]), len(rows[1]), len(rows[0])
        both = (a + b) / (m + n)
        return math.sqrt(0.05 + max(0, 2 * (log(a, m, a / m) + log(b, n, b / n) - log(a, m, both) - log(b, n, both))))

    factors = {t: factor(t) for t in corpus}
    vectors = {}
    for i, c in counts.items():
        length, v = sum(c.values()), {}
        for t, tf in c.items():
            # A term that no labelled row has counts as one of this text alone.
            expected = length * (corpus[t] if t in known else tf) / everything
            v[t] = 2 * (tf * math.log(tf / expected) - (tf - expected)) * factors[t] if tf > expected else 0.0
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors[i] = {t: x / norm for t, x in v.items()}
    prior, out = len(rows[1]) / len(taught), {}
    for i, v in vectors.items():
        near = sorted(((sum(x * vectors[e].get(t, 0.0) for t, x in v.items()), e) for e in taught), reverse=True)
        near = [(e, c) for c, e in near if c > 0]
        weight = sum(c**4 for _, c in near[:15])
        out[i] = ((sum(c**4 * labels[e] for e, c in near[:15]) + prior * 0.02) / (weight + 0.02), near)
    return out


def test_scores_are_those_of_dense_vectors(spark):
    """Terms, weights, neighbours, cosines and votes, all computed again without the module."""
    docs, rows = labelled(spark, 160)
    odd = [(1000, None, 0), (1001, "", 0), (1002, "unseenword badword " * 9, 0), (1003, rows[0][1], 0), (1004, "word " * 3000, 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, toxic int"))
    index = toxicity.fit(docs.drop("toxic"), docs.where("doc_id % 4 <> 1 and doc_id < 1000").select("doc_id", "toxic"))
    index.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    texts = {i: t for i, t, _ in [*rows, *odd]}
    expected = plain_scores(texts, {i: y for i, _, y in rows if i % 4 != 1})
    for r in toxicity.score(docs.select("doc_id", "text"), index).collect():
        score, near = expected[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert [e["cosine"] for e in r["evidence"]] == pytest.approx([c for _, c in near[:3]], abs=1e-9)
        cosine_of = {str(i): c for i, c in near}
        assert all(cosine_of[e["example"]] == pytest.approx(e["cosine"], abs=1e-9) for e in r["evidence"])


def test_nearest_is_exact_over_many_blocks():
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(500, 40, replace=False)), rng.random(40) ** 6) for _ in range(1000)]
    rows[17] = rows[900] = rows[3]
    at, term, weight = np.repeat(np.arange(1000), 40), np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows])
    index, dense = toxicity.Postings(at, term, weight, 1000, 500), np.zeros((1000, 500))
    dense[at, term] = weight
    for terms, values in rows[:200]:
        cosines = dense[:, terms] @ values
        order = sorted(np.flatnonzero(cosines > 0).tolist(), key=lambda i: (-round(cosines[i], 9), i))[:7]
        found, near = index.nearest(terms, values, 7)
        assert found.tolist() == order and np.allclose(near, cosines[order])


def test_calibration_rises_and_trusts_many_rows():
    rng = np.random.default_rng(5)
    raw = rng.random(40_000)
    xs, ys = toxicity.rising(raw, (rng.random(40_000) < raw**2).astype(float), np.ones(40_000))
    at = np.linspace(0.1, 0.9, 9)
    off = np.abs(np.interp(at, xs, ys) - at**2)  # the curve goes up in steps
    assert (np.diff(ys) >= 0).all() and off.max() < 0.12 and off.mean() < 0.06
    few = toxicity.rising(raw[:3], np.array([1.0, 0.0, 1.0]), np.ones(3))
    assert np.allclose(np.interp(at, *few), at, atol=0.05)


def test_odd_toxicity_inputs(spark):
    """Repeated documents and labels, labels of no document, other values, clashing columns, and no documents at all."""
    docs, _ = labelled(spark, 120)
    labels = docs.select("doc_id", "toxic")
    odd = spark.createDataFrame([(5, None), (None, 1), (7, 3), (99_999, 1)], "doc_id long, toxic int")
    plain = toxicity.fit(docs.drop("toxic"), labels)
    index = toxicity.fit(docs.drop("toxic").selectExpr("*", "1 as terms", "2 as _id"), labels.unionByName(odd).unionByName(labels))
    text = docs.select("doc_id", "text")
    clash = text.selectExpr("*", "1 as score", "'x' as evidence", "2 as predicted", "3 as _scored", "4 as other")
    scored = toxicity.score(clash.unionByName(clash), index)
    assert scored.columns == ["doc_id", "text", "other", "score", "predicted", "evidence"]
    assert {(r["doc_id"], r["score"]) for r in scored.collect()} == {(r["doc_id"], r["score"]) for r in toxicity.score(text, plain).collect()}
    assert scored.count() == 240 and toxicity.score(text.limit(0), index).count() == 0
    nothing = toxicity.fit(text.limit(0), labels)
    assert {r["score"] for r in toxicity.score(text, nothing).collect()} == {0.0}
    twice = toxicity.fit(docs.drop("toxic").unionByName(docs.drop("toxic")), labels)
    assert len(twice.ids) == 240


def test_toxicity_on_held_out_rows(spark):
    docs, rows = labelled(spark)
    index = toxicity.fit(docs.drop("toxic"), docs.where("doc_id % 4 <> 1").select("doc_id", "toxic"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "badword " * 30_000), (-4, "badword " * 30_000)], "doc_id long, text string")
    scored = toxicity.score(docs.select("doc_id", "text").unionByName(odd).selectExpr("*", "5 as score"), index).collect()
    got = {r["doc_id"]: r for r in scored}
    assert all(got[i]["predicted"] == y for i, _, y in rows if i % 4 == 1)
    assert got[-1]["score"] == got[-2]["score"] < 0.3 <= got[-3]["score"] == got[-4]["score"] <= 1
    assert got[-3]["evidence"][0]["toxic"] == 1


def test_copies_of_examples_meet_at_cosine_one(spark):
    """Also where a text has no term that leans toxic: all examples are in the index, with all of their terms."""
    docs, _ = labelled(spark, 400)
    calm = "another calm line about bread and copper kettles on a shelf"
    odd = "nothing here is said of anyone but seldom words gather quietly around an unremarked harbour"
    copies = spark.createDataFrame([(1000, odd, 1), (1001, odd, None), (1002, calm, 0), (1003, calm, None)], "doc_id long, text string, toxic int")
    docs = docs.unionByName(copies)
    index = toxicity.fit(docs.drop("toxic"), docs.where("toxic is not null").select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id > 1000").select("doc_id", "text"), index).collect()}
    for copy, example, toxic in ((1001, "1000", 1), (1003, "1002", 0)):
        assert got[copy]["predicted"] == toxic and got[copy]["evidence"][0]["example"] == example
        assert got[copy]["evidence"][0]["cosine"] == pytest.approx(1)


def test_hashed_terms_are_the_terms(monkeypatch):
    """Terms counted by hash, texts together, are those that strings give for each text alone; scoring makes no strings."""
    rng = random.Random(8)
    words = ["river", "Rivers", "riverside", "ÜBER", "übermorgen", "K\u212aelvin", "a", "abcdefgh", "x9y", "don't", "ſtart", "İx", "ΣΑΣ", "\U0001d504bc", "\u4f60\u597d", "\ud800"]
    texts = ["", " .,\n", "river " * 5, *[" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)], "Word" * 3000, "abcd abcde abcdef", "word " * 300_000]
    terms = sorted({"river", "rive~", "über~", "abcde~", "abcd", "abcd~", "don", "kkel~", "σας", "\U0001d504bc"})
    number = {t: i for i, t in enumerate(terms)}
    counter = toxicity.TermCounter(terms)
    ordered = lambda number, tf: sorted(zip(number.tolist(), tf.tolist()))
    assert [ordered(*x) for x in counter.arrays(texts)] == [sorted((number.get(t, -1), n) for t, n in toxicity.text_counts(text).items()) for text in texts]
    assert list(counter.arrays([])) == [] and [ordered(*x) for x in toxicity.TermCounter([]).arrays(["a b b"])] == [[(-1, 1.0), (-1, 2.0)]]
    monkeypatch.setattr(toxicity, "text_counts", None)
    index = toxicity.build_index(toxicity.Examples([1], np.ones(1), np.ones(1), ["river"], np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1)), np.ones(1), 10, np.zeros(1), 0.5)
    assert [at.tolist() for _, at, _ in index.scores(["river", "x"])] == [[0], []]


def test_toxicity_without_labels(spark):
    docs, _ = labelled(spark, 20)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}


# 8. SimHash


def plain_fingerprint(text):
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values):
    roots = list(range(len(values)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                roots[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_simhash(spark, docs, rows, empty):
    got = simhash.simhash_components(docs).collect()
    prints = [plain_fingerprint(r[1] or "") for r in rows]
    roots = plain_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    assert bag((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == Counter((r[0], p, least.get(root)) for r, p, root in zip(rows, prints, roots))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_at_each_distance(spark):
    rng = random.Random(5)
    values = []
    for _ in range(60):
        value = rng.getrandbits(64)
        values.append(value)
        for distance in range(1, 6):
            values.append(value ^ sum(1 << b for b in rng.sample(range(64), distance)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {frozenset((r["u"], r["v"])) for r in simhash.near_links(spark.createDataFrame([(signed(v),) for v in set(values)], "fp long")).collect()}
    some = sorted(set(values))
    assert got == {frozenset((signed(a), signed(b))) for i, a in enumerate(some) for b in some[:i] if (a ^ b).bit_count() <= 3}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(70)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    nodes = sorted({x for e in edges for x in e if x is not None and e[0] != e[1] and None not in e})
    least = {n: n for n in nodes}
    for _ in nodes:
        changed = False
        for u, v in edges:
            if u is not None and v is not None and u != v and least[u] != least[v]:
                least[u] = least[v] = min(least[u], least[v])
                changed = True
        if not changed:
            break
    assert got == least


# 9. Substring dedup


def plain_removed(texts, length=35):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return words, out


@pytest.mark.parametrize("length,gram", [(35, 6), (5, 2), (9, 9)])
def test_substring(docs, rows, empty, length, gram):
    got = substring.removed_words(docs, length=length, gram=gram).collect()
    words, kept = plain_removed([r[1] for r in rows], length)
    assert bag(got) == Counter((r[0], len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for r, w, k in zip(rows, words, kept))
    if length == 35:
        left = substring.without_repeats(docs)
        assert left.columns == docs.columns
        assert Counter((r["doc_id"], b" ".join((r["text"] or "").encode().split())) for r in left.collect()) == Counter((r[0], b" ".join(k)) for r, k in zip(rows, kept))
        assert substring.removed_words(empty).count() == 0 and substring.without_repeats(empty).count() == 0


def test_substring_keeps_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a\n\nb  {passage}\nc\td"), (2, f"{passage}\ne"), (3, " as it was\n")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()} == {1: "a\n\nb c\td", 2: "e", 3: " as it was\n"}


# 10. Top k


def plain_top(rows, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for own, (i, q) in enumerate(good):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for row, (j, x) in enumerate(good) if row != own and len(x) == len(q))[:k]
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scores))
    return out


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(500, rows[5][1]), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (700, []), (701, []), (800, [3e7] * 12), (None, [1.0] * 12), (900, None), (901, [None] * 12), (1000, [float("nan")] * 12), (1100, [float("inf")] * 12), rows[7], rows[100], (200, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rounded = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = topk.top_k(frame.selectExpr("*", "1 as v", "2 as dim", "3 as score").repartition(3), F.col("vec_id") % 100 == 0)
    assert bag(got.collect()) == plain_top(rounded)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert bag(topk.top_k(frame, F.col("vec_id") % 100 == 0).collect()) == plain_top(rows)
