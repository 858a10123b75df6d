"""The pipeline's stages, each against a plain version on its own input, and the guard of the entry point."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from ostinato.llm.common import scratch_path
from tests.llm.test_contracts import plain_components, plain_fingerprint, plain_removed

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """What each stage was given, and what it gave."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = scratch_path(spark, "test")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns == pipeline.COLUMNS
        assert after.schema["n_chars"].dataType == before.schema["n_chars"].dataType


def test_toxic_documents_go(steps, spark, sf_dir):
    _, before, after = steps[0]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept, all_texts = texts(after), texts(before)
    assert all(all_texts[i] == t for i, t in kept.items())
    gone = set(all_texts) - set(kept)
    assert not [i for i in gone if toxic.get(i) == 0] and not [i for i in kept if toxic.get(i) == 1]


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    given = sorted(texts(before).items())
    roots = plain_components([plain_fingerprint(t or "") for _, t in given])
    first = {}
    for (doc_id, _), root in zip(given, roots):
        first.setdefault(root, doc_id)
    assert set(texts(after)) == set(first.values())


def test_repeated_passages_go(steps):
    _, before, after = steps[2]
    given = sorted(texts(before).items())
    _, kept = plain_removed([t for _, t in given])
    left = texts(after)
    assert [left[i].encode().split() for i, _ in given] == kept
    assert {r["doc_id"]: r["n_chars"] for r in after.collect()} == {i: len(t) for i, t in left.items()}


def test_mix_and_packing(steps):
    _, before, mixed = steps[3]
    sizes = {i: len((t or "").encode().split()) for i, t in texts(before).items()}
    times = Counter()
    for r in mixed.collect():
        times[r["doc_id"]] += len(r["text"].encode().split())
    assert all(n <= 3 * sizes[i] for i, n in times.items())
    packed = steps[4][2].collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and other columns; labels of some."""
    words = [f"word{i}" for i in range(400)]
    calm = [" ".join(words[(7 * i + j * j) % 400] for j in range(60)) for i in range(60)]
    rude = ["you " + word + " " + " ".join(words[(3 * i + j * j) % 400] for j in range(40)) + f" {word} {word}" for i, word in enumerate(["scoundrel"] * 8)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(calm + rude)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t", None, "c", 3), (None, calm[0] + " end", "en", None, None), (None, None, None, None, None), (203, "la " * 60_000, "en", "a", 1), rows[3], rows[3], (3, "the same id again", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 0.5, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, row string, fp double, key int").repartition(3)
    folder = str(tmp_path_factory.mktemp("odd"))
    labels = [(i, None, int(i >= 60)) for i in range(68)] + [(None, 1, 1), (5, None, None), (5, 0, 0), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, folder, rows


def test_stages_on_odd_tables(spark, odd):
    docs, folder, rows = odd
    got = {}
    for name, stage in pipeline.STAGES:
        got[name] = stage(spark, docs, folder).collect()
        assert stage(spark, docs.limit(0), folder).count() == 0
    toxic, near, passages, mix, packed = (got[name] for name, _ in pipeline.STAGES)
    rude = {r[0] for r in rows if r[1] and "scoundrel" in r[1]}
    assert Counter((r["doc_id"], r["text"]) for r in toxic) == Counter((r[0], r[1]) for r in rows if r[0] not in rude)
    roots = plain_components([plain_fingerprint(r[1] or "") for r in rows])
    assert len(near) == len(set(roots)) and all(list(r.asDict()) == pipeline.COLUMNS for r in near)
    _, kept = plain_removed([r[1] for r in rows])
    assert Counter((r["doc_id"], b" ".join((r["text"] or "").encode().split()), r["n_chars"] == len(r["text"] or "")) for r in passages) == Counter((r[0], b" ".join(k), True) for r, k in zip(rows, kept))
    assert sum(r["text"] is None for r in passages) == sum(r[1] is None for r in rows)
    assert all((r["text"] or "").split() for r in mix) and {r["source"] for r in mix} == {"a", "b", None}
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in rows)


def plain_budgets(sizes, weights=(5, 2, 1), most=3):
    """{source: words to take} for {source: words}, by capping one round after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, whole, level = set(), sum(sizes.values()), 0
    while len(capped) < len(names):
        level = (whole - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > most * sizes[s]}
        if not more:
            break
        capped |= more
    return {s: int((most * sizes[s] if s in capped else weight[s] * level) + 0.5) for s in names}


def test_mixing_stage_meets_its_budgets(steps):
    """Each source's words by the targets, and each document's text whole as often as it repeats, but for one part a source."""
    _, before, mixed = steps[3]
    given = {r["doc_id"]: r for r in before.collect()}
    sizes = Counter()
    for r in given.values():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    taken, parts = Counter(), Counter()
    for r in mixed.collect():
        own = given[r["doc_id"]]
        taken[r["source"]] += len(r["text"].encode().split())
        assert r["source"] == own["source"]
        if r["text"] != own["text"]:
            parts[r["source"]] += 1
            words = r["text"].encode().split()
            assert words == own["text"].encode().split()[: len(words)]
    assert {s: taken[s] for s in sizes} == plain_budgets(sizes) and max(parts.values()) <= 1


def test_packing_stage_is_whole_and_tight(steps):
    """Ids by the library, places gapless, and hardly more sequences than the tokens need."""
    from tokenizers import Tokenizer

    from ostinato.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = Counter()
    for r in steps[4][1].collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        expected.update((r["doc_id"], i // 2048, len(ids[i : i + 2048])) for i in range(0, len(ids), 2048))
    rows = steps[4][2].collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in rows) == expected
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:i]) for i, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 2048
    assert len(held) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_entry_point_without_the_subpackage(tmp_path):
    """The rest imports and has its queries when these folders and the pipeline are gone."""
    for name in ("__spark_entry__.py", "ostinato"):
        source = ROOT / name
        subprocess.run(["cp", "-r", str(source), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "ostinato/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
