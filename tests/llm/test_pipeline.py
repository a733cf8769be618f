"""The pipeline on small tables: every stage against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs.collect()))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in stages[1:]] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    assert all(list(rows[0].asDict()) == COLUMNS for _, rows in stages[:-1])
    assert list(stages[-1][1][0].asDict())[:5] == COLUMNS


def test_language_keeps_clean_documents(stages):
    assert len(stages[1][1]) >= 0.99 * len(stages[0][1])


def test_lines(stages):
    before, after = {r.doc_id: r for r in stages[1][1]}, {r.doc_id: r for r in stages[2][1]}
    assert before.keys() == after.keys()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    seen = {}
    for r in before.values():
        for k in {key(x) for x in r.text.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    for d, r in before.items():
        kept = [x for x in r.text.split("\n") if not key(x) or seen[key(x)] < 10]
        assert after[d].text == "\n".join(kept) and (after[d].n_chars == len(after[d].text) or after[d].text == r.text)


def test_near_copies(stages):
    """Exact copies leave one; what goes is like something of a smaller id that was there."""
    before, after = {r.doc_id: r.text for r in stages[2][1]}, {r.doc_id for r in stages[3][1]}
    grams = {}
    for d, t in before.items():
        w = brute.WORD.findall(t.translate(brute.LOWER))
        grams[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    first = {}
    for d in sorted(before):
        first.setdefault(frozenset(grams[d]), d)
    assert all(d not in after for d in before if first[frozenset(grams[d])] != d)
    for d in before.keys() - after:
        assert max((len(grams[d] & grams[o]) / len(grams[d] | grams[o]) for o in before if o != d), default=0) >= 0.6


def test_benchmark(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d[0] for d in brute.op8([(r.doc_id, r.text) for r in stages[3][1]], items) if not d[-1]}
    assert {r.doc_id for r in stages[4][1]} == clean


def test_mixture_takes_from_what_is_left(stages):
    left = {r.doc_id for r in stages[4][1]}
    assert {r.doc_id for r in stages[5][1]} <= left and all(r.copies > 0 for r in stages[5][1])


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", F.col("copies")).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in stages[-1][1])


AWKWARD = [
    (1, "one line\nand another line", "en", "s1", 5),
    (1, "one line\nand another line", "en", "s1", 5),
    (2, None, None, None, None),
    (None, "a text without an id at all", None, "s1", 1),
    (3, "", "en", "", 0),
    (4, "the quick brown fox " * 20_000, "en", "s2", None),
    (5, "Ein ganz anderer Text über große Häuser und Bäume.", "de", "s2", 1),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, name, stage):
    """Nulls, empty and long texts, repeats, clashing extra columns; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, score int, fp0 string, n_hit string, line_n int, block string"
    df = spark.createDataFrame([(*r, "c", 1, "f", "h", 2, "b") for r in AWKWARD], schema)
    got = stage(spark, df, SF)
    rows = got.collect()
    assert set(COLUMNS) <= set(got.columns) and 0 < len(rows) <= len(AWKWARD)
    if name != "source_mixing":
        assert got.columns == df.columns and all((r.n_hit, r.line_n, r.score) == ("h", 2, 1) for r in rows)
    if name == "language_id":
        assert all(r.text for r in rows) and len(rows) == 5
    if name == "simhash_near_dedup":
        assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 1 for r in rows) == 2
    assert stage(spark, df.limit(0), SF).count() == 0


def test_near_copies_keep_to_the_similarity(spark):
    """At 0.8 and above nearly all go, below none that nothing links; each against its own original."""
    import numpy as np

    from skylume.llm import simhash

    rng = np.random.default_rng(8)
    rows, similar = [], {}
    for k in range(400):
        base = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        copy = list(base)
        for i in range(0, 300, int(rng.integers(20, 90))):
            copy[i] = f"x{k}_{i}"
        a, b = ({tuple(t[i : i + 5]) for i in range(296)} for t in (base, copy))
        similar[2 * k + 1] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.one_of_each(df, shingle=5, similarity=0.8).collect()}
    assert all(2 * k in left for k in range(400))
    above, below = [d for d, s in similar.items() if s >= 0.8], [d for d, s in similar.items() if s < 0.8]
    assert len(above) > 50 < len(below) and all(d in left for d in below)
    assert sum(d not in left for d in above) >= 0.99 * len(above)


@pytest.mark.parametrize("size", [1024, 8])
def test_links_within_groups_join_what_brute_force_joins(spark, monkeypatch, size):
    """Texts around the threshold, in one chunk or in many; a repeated row, empty texts and joined roots."""
    import numpy as np

    from skylume.llm import simhash
    from skylume.llm.components import components

    monkeypatch.setattr(simhash, "GROUP", size)
    rng = np.random.default_rng(size)
    texts, group = {}, {}
    for g in range(3):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 120)]
        for k in range(20):
            words = list(base)
            for i in rng.integers(0, 120, int(rng.integers(0, 4))):
                words[i] = f"x{g}_{k}_{i}"
            texts[100 * g + k], group[100 * g + k] = " ".join(words), g
    texts |= {50: "", 51: "", 52: "three words only", 53: "three words only"}
    group |= dict.fromkeys((50, 51, 52, 53), 0)
    grams = {}
    for n, t in texts.items():
        w = brute.WORD.findall(t)
        grams[n] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {n: n for n in texts} | {1: 0}
    root = dict(label)
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and group[a] == group[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) and label[a] != label[b]:
                label = {n: label[a] if x == label[b] else x for n, x in label.items()}
    members = spark.createDataFrame([(n, group[n], root[n], [0] * 8) for n in texts], "node long, group long, root long, fps array<long>")
    df = spark.createDataFrame([*texts.items(), (100, texts[100])], "node long, text string")
    late = simhash.links_within(members, df, 5, 0.8, 512)
    known = spark.createDataFrame([(n, r) for n, r in root.items() if n != r], "a long, b long")
    got = {r.node: r.root for r in components(late.union(known)).collect()}
    classes = lambda of: {frozenset(m for m in texts if of(m) == of(n)) for n in texts}
    assert classes(lambda n: got.get(n, n)) == classes(label.get)
    assert simhash.links_within(members.limit(0), df, 5, 0.8, 512).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_thinned_links_join_the_same(spark, monkeypatch, size):
    import numpy as np

    from skylume.llm import simhash
    from skylume.llm.components import components

    monkeypatch.setattr(simhash, "LINKS", size)
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (600, 2)) * 10 + rng.integers(0, 8, (600, 1)) if a != b]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    got, want = ({r.node: r.root for r in components(x).collect()} for x in (simhash.thinned(df), df))
    assert got == want and simhash.thinned(df).count() <= df.count()
    assert simhash.thinned(df.limit(0)).count() == 0
