"""Each text operator against its brute-force version, and on awkward rows."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylume.llm import decontaminate, hmm, langid, line_dedup, mixing, pii, quality, simhash, suffix_array, suffix_dedup, warc
from skylume.llm import common as C
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, g string, t int, h1 long, k string, score string, copies string, fp0 int, n_words string, kept string, a int, b int, c int, spans string, block string"
EXTRA = (1, "g", 2, 3, "k", "s", "c", 4, "w", "kept", 5, 6, 7, "sp", "bl")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    long = "the quick brown fox jumps over it " * 4000 + "x" * 100_000
    rows = [
        (1, "one line\nand another line\n\none line", "en", "s1", 5),
        (1, "one line\nand another line\n\none line", "en", "s1", 5),
        (2, None, None, None, None),
        (None, "a text without an id at all", None, "s1", 1),
        (3, "", "en", "", 0),
        (4, " \t\n\r ", "de", "s2", 4),
        (5, long, "en", "s2", len(long)),
        (6, "ÄÖÜ ßß éé 漢字 🙂🙂 \u0000 �", "de", None, 9),
        (7, "1234", "fr", "s2", 4),
        (8, "one line\nand another line\n\none line", "en", "s3", 5),
    ]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over it the quick brown fox jumps"), (2, "another line"), (3, None), (None, "one line"), (4, "")], "item_id long, text string")


OPERATORS = {
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d, size=20, with_kept=True),
    "mixing": lambda s, d: mixing.mix(d),
    "lines": lambda s, d: line_dedup.drop_common_lines(d, 3),
    "pii": lambda s, d: pii.annotate(d, with_redacted=True),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "quality": lambda s, d: quality.judge(d),
    "decontaminate": lambda s, d: decontaminate.annotate(d, bench(s), keep_text=True),
    "hmm": lambda s, d: hmm.score_texts(d, langid.fold() != 1, F.coalesce(langid.fold() == 1, F.lit(False)), rounds=1),
    "langid": lambda s, d: langid.predict(d, langid.train(d, per_language=5)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_keep_their_number(spark, awkward, empty, name):
    assert len(OPERATORS[name](spark, awkward).collect()) == 10
    assert OPERATORS[name](spark, empty).collect() == []


# ------------------------------------------------------------------ 1 suffix arrays


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(t):
    assert suffix_array.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_of_periods_and_runs():
    for t in ([0] * 50, [1, 2] * 30, [2, 1, 1] * 20 + [2], list(range(40)), list(range(40))[::-1]):
        assert suffix_array.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("size,cell,hot", [(20, 4, 1 << 16), (7, 3, 1 << 16), (20, 4, 2), (40, 8, 1 << 16)])
def test_repeats_equal_brute_force(spark, size, cell, hot):
    rng = np.random.default_rng(size)
    base = "".join(rng.choice(list("abcd "), 1200))
    docs = [(1, base[:200]), (2, "x" * 70 + base[50:180] + "tail" * 20), (3, None), (4, ""), (5, "aaaa" * 30), (6, base[10:60]), (7, "é" * 30 + base[100:160])]
    docs += [(8, "ab" * 40 + base[:45]), (9, base[:200]), (11, base[500:900]), (12, base[500:700] + "ZZ" + base[702:900]), (13, base[480:640] + "q" + base[641:1000])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, size=size, cell=cell, hot=hot).drop("text")
    assert sorted(map(tuple, got.collect())) == sorted(brute.op1(docs, size))


def test_repeats_of_real_texts(spark, real):
    from skylume.llm.queries import op1_suffix_dedup

    assert sorted(map(tuple, op1_suffix_dedup(spark, SF).collect())) == sorted(brute.op1(docs_of(real), 400))


def test_contexts_of_a_gram_meet_in_one_task(spark, real):
    """The shuffle by gram is one of its own, which no choice of join at run time takes away."""
    texts = real.select("text").filter("octet_length(text) >= 400")
    grams = suffix_dedup.gram_table(texts, 400, 200)
    bits = spark.sparkContext.broadcast(suffix_dedup._filter_of(grams.filter("mixed").select("g")))
    verdicts = suffix_dedup.context_verdicts(texts, grams, bits, 400, 200, 8)
    assert "REPARTITION_BY_COL" in verdicts._jdf.queryExecution().executedPlan().toString()


# ----------------------------------------------------------------------- 2 mixing


def test_mixture_meets_entropy_and_limit(spark, real):
    out = mixing.mix(real, entropy_share=0.98, max_repeats=3.0, block_tokens=2000).collect()
    total = sum(r.n_tokens for r in out)
    weight = {r.source: r.weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-6
    h = -sum(w * np.log(w) for w in weight.values()) / np.log(len(weight))
    took, natural = {}, {}
    for r in out:
        took[r.source] = took.get(r.source, 0) + r.n_tokens * r.copies
        natural[r.source] = natural.get(r.source, 0) + r.n_tokens
    limited = max(total * weight[s] / natural[s] for s in weight)
    assert limited <= 3.0 + 1e-6 and (h >= 0.98 - 1e-6 or limited >= 3.0 - 1e-3)
    largest = max(r.n_tokens for r in out)
    assert all(total * weight[s] - largest - 1 <= took[s] <= total * weight[s] + 1 for s in weight)


def test_mixture_of_one_source_is_natural(spark):
    df = spark.createDataFrame([(i, "a b c", None) for i in range(5)], "doc_id long, text string, source string")
    assert [(r.weight, r.copies) for r in mixing.mix(df).collect()] == [(1.0, 1)] * 5


# ------------------------------------------------------------------------ 3 lines


def test_lines_case_ends_and_threshold(spark):
    docs = [(i, f" Shared\tLine \nown {i}\n\nshared\tline") for i in range(3)] + [(9, "shared\tline!")]
    out = {r.doc_id: r for r in line_dedup.drop_common_lines(spark.createDataFrame(docs, "doc_id long, text string"), 3).collect()}
    assert out[0].text == "own 0\n" and (out[0].line_n, out[0].line_dropped) == (4, 2) and out[9].text == "shared\tline!"


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_KEYS, 0])
def test_lines_of_awkward_rows_and_real_texts(spark, awkward, real, monkeypatch, limit):
    """Either way gives what a plain version gives; columns of any name keep their values."""
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
    for df, least in ((awkward.withColumns({"__n": F.lit("n"), "__a": F.lit("a"), "__extra": F.lit("e")}), 3), (real, 10)):
        got = line_dedup.drop_common_lines(df, least)
        assert got.columns == [*df.columns, "line_n", "line_dropped"]
        rows = df.collect()
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
        seen = {}
        for r in rows:
            for k in {key(x) for x in (r.text or "").split("\n")}:
                seen[k] = seen.get(k, 0) + 1
        want = []
        for r in rows:
            lines = (r.text or "").split("\n")
            kept = [x for x in lines if not key(x) or seen[key(x)] < least]
            gone = len(lines) - len(kept)
            want.append((*[("\n".join(kept) if gone else r.text) if c == "text" else r[c] for c in df.columns], len(lines), gone))
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


# -------------------------------------------------------------------------- 4 pii


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@-+ ()019é%_\n", max_size=60))
def test_pii_base_spans(text):
    assert sorted(pii.find(text)[0]) == sorted(brute.op4_base(text))


@pytest.mark.parametrize(
    "text,kind,source",
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("mail john at example dot org now", "email", "john at example dot org"),
        ("jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("call +１ (456) ５５５-2186 ok", "phone", "+１ (456) ５５５-2186"),
        ("card four two four two four two four two four two four two four two four two end", "card", "four two four two four two four two four two four two four two four two"),
        ("ip 10 dot 20 dot 30 dot 40 x", "ip", "10 dot 20 dot 30 dot 40"),
        ("+1 (269) 555-3296 4524132264652876 and", "phone", "+1 (269) 555-3296"),
    ],
)
def test_pii_disguises(text, kind, source):
    base, added = pii.find(text)
    assert (kind, source) in [(k, text[s:e]) for k, s, e in added] and not base


def test_pii_leaves_prose_alone():
    assert pii.find("We met at noon. One or two of us, three at most, sat at home.Then dot the i.") == ([], [])
    assert pii.redact("a x@y.zz b", pii.find("a x@y.zz b")[0]) == "a [EMAIL] b"


def test_pii_long_digit_and_word_runs_are_linear():
    assert pii.find("1" * 200_000 + " " + "a" * 200_000 + "@") == ([], [])


def test_pii_long_blanks_and_many_spans_are_linear():
    import time

    began = time.perf_counter()
    base, added = pii.find("a [at] b [dot] com" + " " * 200_000 + "x dot y at " + " " * 200_000)
    assert not base and len(added) == 1
    many = " ".join(f"a{i} [at] b{i} [dot] com" for i in range(200_000))
    base, added = pii.find(many)
    assert not base and len(added) == 200_000 and len(pii.find("1 " * 100_000)[1]) == 0
    assert time.perf_counter() - began < 60


def plain_added(text, base, more):
    """The rule of added spans, pair by pair."""
    order = ["email", "ip", "card", "phone"]
    added = []
    for kind, s, e in sorted(set(more), key=lambda x: (x[1], -x[2], order.index(x[0]))):
        if any(s < b and a < e for _, a, b in added):
            continue
        if all(s <= a and b <= e and (s, e) != (a, b) for _, a, b in base if s < b and a < e):
            added.append((kind, s, e))
    return added


def plain_normal(text):
    """Transducers one character at a time: (normal text, source span of every character)."""
    chars = [(c, i, i + 1) for i, c in enumerate(text)]
    if any(c in pii.GLYPHS for c in text):
        chars = [(pii.GLYPHS.get(c, c), a, b) for c, a, b in chars if pii.GLYPHS.get(c, c)]
    def edit(chars, edits):
        out, at = [], 0
        for s, e, new in edits:
            out += chars[at:s]
            if new:
                out.append((new, chars[s][1], chars[e - 1][2]))
            at = e
        return out + chars[at:]
    now = lambda: "".join(c for c, _, _ in chars)
    word = pii._SPELLED_THREE.search(now())
    hint = pii._AT_HINT.search(now())
    if word:
        chars = edit(chars, pii._spelled_edits(now()))
    if hint:
        chars = edit(chars, [(*m.span(), "@") for m in pii._AT.finditer(now())])
        chars = edit(chars, [(*m.span(), ".") for m in pii._DOT.finditer(now())])
    if word or hint:
        chars = edit(chars, [(*m.span(), "+") for m in pii._PLUS.finditer(now())])
    return now(), chars


def plain_pii(text):
    text = text or ""
    base, failed = brute.op4_base(text), []
    pii.detect(text, failed)
    more = list(pii._swallowed(text, failed))
    normal, chars = plain_normal(text)
    if normal != text:
        missed = []
        found = brute.op4_base(normal)
        pii.detect(normal, missed)
        found += list(pii._swallowed(normal, missed))
        more += [(k, chars[s][1], chars[e - 1][2]) for k, s, e in found]
    return base, plain_added(text, base, more)


def test_pii_query_equals_a_plain_version(spark, real):
    """Counts, digest and all spans of the whole query, with transducers run character by character."""
    from skylume.llm.queries import op4_pii

    texts = dict(docs_of(real))
    order = ["email", "ip", "card", "phone"]
    join = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(x, key=lambda x: (x[1], order.index(x[0]))))
    n_added = 0
    for r in op4_pii(spark, SF).collect():
        base, added = plain_pii(texts[r.doc_id])
        n_added += len(added)
        kinds = [k for k, _, _ in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in order)
        assert r.base_sha256 == brute.sha(join(base).encode()) and r.spans == join(base + added)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b@c.de", " at ", " dot ", "[at]", " ", "com", "one ", "two ", "+1 ", "456 789 0123", "\u043e", "\uff11", "4242 4242 4242 4242 ", "1.2.3.4", "plus "]), max_size=14))
def test_pii_spans_equal_a_plain_version(parts):
    text = "".join(parts)
    assert tuple(map(sorted, pii.find(text))) == tuple(map(sorted, plain_pii(text)))


# ------------------------------------------------------------------------ 5 simhash


@pytest.mark.parametrize(
    "text,whole",
    [
        ("mail j\u043ehn.doe@example.com now", "j\u043ehn.doe@example.com"),
        ("ask john dot doe@example.com now", "john dot doe@example.com"),
        ("ask john@mail.example dot com now", "john@mail.example dot com"),
    ],
)
def test_disguises_caught_in_part_are_found_whole(text, whole):
    base, added = pii.find(text)
    assert len(base) == 1 and [text[s:e] for _, s, e in added] == [whole]
    assert pii.redact(text, base + added) == text.replace(whole, "[EMAIL]")


def test_spans_across_the_border_of_a_base_span_stay_out():
    text = "reach me at john.doe@example.com"
    base, added = pii.find(text)
    assert [text[s:e] for _, s, e in base] == ["john.doe@example.com"] and added == []


def test_simhash_equals_brute_force(spark, awkward, real):
    for df in (awkward, real):
        got = simhash.near_duplicates(df, shingle=4, distance=4).collect()
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(((r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in got), key=key) == sorted(brute.op5(docs_of(df)), key=key)


@pytest.mark.parametrize("chunk", [4096, 8])
def test_links_join_all_pairs_in_reach(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    base = rng.integers(0, 1 << 63, 6)
    prints = {int(b) for b in base}
    for _ in range(250):
        x = int(rng.choice(list(base)))
        for bit in rng.integers(0, 63, rng.integers(0, 7)):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    from skylume.llm.components import components

    df = spark.createDataFrame([(p, p) for p in prints], "node long, fp0 long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:150], "changed", *words[151:]]
    docs = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (4, " ".join(f"v{i}" for i in range(300))), (None, " ".join(words))]
    got = simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 3, 4]


# ------------------------------------------------------------------------ 6 quality


def test_quality_base_rules(spark, awkward, real):
    for df in (awkward, real):
        got = quality.judge(df.select("doc_id", "text", "lang")).collect()
        assert all(tuple(r[3:8]) + (r.base_failed,) == brute.op6_base(r.text) for r in got)


def test_quality_divergence(spark):
    prose = [(i, " ".join(np.random.default_rng(i).choice("the of and to in house tree water small light".split(), 200)), "en") for i in range(40)]
    odd = [(100, " ".join("#$%& |>< **" for _ in range(200)), "en"), (101, " ".join(f"XQ{i}Z!!" for i in range(300)), None)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(prose + odd, "doc_id long, text string, lang string")).collect()}
    assert not out[100].kept and not out[101].kept
    assert all(r.class_distance < 0.3 for i, r in out.items() if i < 100)


# --------------------------------------------------------------------------- 7 warc


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200
    pages = [(4, "http://a/\r\nx", big), (2, "http://b/", big), (9, None, big), (7, "u", "short"), (8, "v", "short"), (None, "w", None), (2, "http://b/", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, shard int")
    folder = (tmp_path / "warc").as_uri()
    names = warc.write_archive(df, folder, file_bytes=600, shard_bytes=500)
    assert len(names) > 2
    got = warc.read_archive(spark, folder, with_payload=True).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, str(x))
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=key)
    n = len(big.encode())
    want = [(None, 0, "response", None), (2, n, "response", None), (2, n, "response", None), (4, n, "revisit", 2), (7, 5, "response", None), (8, 5, "response", None), (9, n, "revisit", 2)]
    assert rows == want
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.payload is not None)
    again = (tmp_path / "again").as_uri()
    warc.write_archive(df, again, file_bytes=600, shard_bytes=500)
    read = lambda d: {p.name: p.read_bytes() for p in (tmp_path / d).iterdir() if not p.name.endswith(".crc")}
    assert read("warc") == read("again")


def test_warc_damage_is_noticed():
    record = warc.encode_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "d")
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(record.replace(b"payload\r", b"paYload\r"))


def test_warc_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archive(df, tmp_path.as_uri() + "/w") == [] and warc.read_archive(spark, tmp_path.as_uri() + "/w").collect() == []


# ------------------------------------------------------------------ 8 decontamination


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination_equals_brute_force(spark, awkward, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    items = bench(spark)
    got = decontaminate.annotate(awkward.select("doc_id", "text"), items, keep_text=True).collect()
    want = brute.op8([(r.doc_id, r.text) for r in got], [(r.item_id, r.text) for r in items.collect()])
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.n_hit > 0) for r in got] == want
    one = next(r for r in got if r.doc_id == 8)
    assert one.kept_text == "one line\nand \n\none line"
    assert decontaminate.remove_documents(awkward, items).count() == sum(not w[-1] for w in want)


# -------------------------------------------------------------------------- 9 hmm


def plain_hmm(m, o):
    k, s = m.emit.shape
    a = [m.start * m.emit[:, o[0]]]
    total = np.log(a[0].sum())
    a[0] = a[0] / a[0].sum()
    for x in o[1:]:
        v = (a[-1] @ m.move) * m.emit[:, x]
        total += np.log(v.sum())
        a.append(v / v.sum())
    b = [np.ones(k)]
    for x in o[:0:-1]:
        v = m.move @ (m.emit[:, x] * b[0])
        b.insert(0, v / v.sum())
    g = [x * y / (x * y).sum() for x, y in zip(a, b, strict=True)]
    emit, move = np.zeros((k, s)), np.zeros((k, k))
    for t, x in enumerate(o):
        emit[:, x] += g[t]
        if t:
            xi = a[t - 1][:, None] * m.move * (m.emit[:, x] * b[t])[None]
            move += xi / xi.sum()
    return total, g[0], move, emit


def test_hmm_recursions():
    rng = np.random.default_rng(1)
    m = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3))
    length = [1, 5, 64, 65, 200, 128, 63, 3]
    seqs = [rng.integers(0, 7, n) for n in length]
    first = np.concatenate(([0], np.cumsum(length)))
    want = [plain_hmm(m, o) for o in seqs]
    np.testing.assert_allclose(hmm.log_likelihood(np.concatenate(seqs), first, m), [w[0] for w in want])
    got = hmm.expected_counts(np.concatenate(seqs), first, m)
    for k in range(3):
        np.testing.assert_allclose(got[k], sum(w[k + 1] for w in want))


@pytest.mark.parametrize("head", [hmm.HEAD, 50])
def test_hmm_base_scores(spark, real, head):
    from collections import Counter

    docs = docs_of(real)
    tokens = {d: brute.WORD.findall((t or "").translate(brute.LOWER)) + ["\0"] for d, t in docs}
    c = Counter(w for d, ws in tokens.items() if brute.held(d) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    got = hmm.score_texts(real, langid.fold() != 1, langid.fold() == 1, rounds=2, symbols=300, head=head).collect()
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, brute.held(r.doc_id) == 1)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("min_count", [1, 16])
def test_hmm_query_equals_a_plain_version(spark, real, min_count):
    """Scores of all documents: vocabulary, Baum-Welch and forward recursion, token by token."""
    from collections import Counter

    docs = docs_of(real.filter("doc_id < 60"))
    tokens = [[w.encode() for w in brute.WORD.findall((t or "").translate(brute.LOWER))] for _, t in docs]
    learnt = [x for (d, _), x in zip(docs, tokens, strict=True) if brute.held(d) != 1]
    c = Counter(w for x in learnt for w in x)
    cls = lambda w: (w[-1] * 31 + w[max(0, len(w) - 2)] * 17) % hmm.CLASSES
    hashes = {w: int(C.word_hashes(C.Words([w], C.SPACE))[0]) for x in tokens for w in x}
    own = sorted((w for w, n in c.items() if n >= min_count), key=hashes.get)
    place = {w: i for i, w in enumerate(own)}
    rare_n, rare_v = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in c.items():
        if w not in place:
            rare_n[cls(w)] += n
            rare_v[cls(w)] += 1
    unigram = np.concatenate(([c[w] for w in own], rare_n, [len(learnt)])) + 0.5
    unigram /= unigram.sum()
    seq = [np.array([place.get(w, len(own) + cls(w)) for w in x] + [len(own) + hmm.CLASSES]) for x in tokens]
    m = hmm.initial(unigram, 3)
    for _ in range(2):
        start, move, emit = np.ones(3), np.ones((3, 3)), np.zeros((3, len(unigram)))
        for (d, _), o in zip(docs, seq, strict=True):
            if brute.held(d) != 1:
                _, s, mv, e = plain_hmm(m, o)
                start, move, emit = start + s, move + mv, emit + e
        m = hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit + 50 * unigram) / (emit.sum(axis=1, keepdims=True) + 50))
    want = {}
    for (d, _), x, o in zip(docs, tokens, seq, strict=True):
        inner = sum(np.log10((c[w] + 0.5) / (rare_n[cls(w)] + 0.5 * (rare_v[cls(w)] + 1))) for w in x if w not in place)
        want[d] = plain_hmm(m, o)[0] / np.log(10) + inner
    got = hmm.score_texts(real.filter("doc_id < 60"), langid.fold() != 1, langid.fold() == 1, states=3, rounds=2, min_count=min_count, head=40).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-5)


def test_hmm_takes_ids_of_any_type(spark, real):
    some = real.filter("doc_id < 20").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = hmm.score_texts(some, F.lit(True), F.lit(False), rounds=1).collect()
    assert {r.doc_id for r in got} == {f"d{i}" for i in range(20)}


# ----------------------------------------------------------------------- 10 langid


def test_languages_of_held_out_documents(spark, real):
    from skylume.llm.queries import op10_langid

    truth = {r.doc_id: r.lang for r in real.collect()}
    got = op10_langid(spark, SF).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.9 * len(out) and all(0 <= r.score <= 1 for r in got)


def test_language_of_texts_without_letters(spark, awkward):
    got = {r.doc_id: r.lang_pred for r in langid.predict(awkward, langid.train(awkward, per_language=5)).collect()}
    assert got[2] == got[3] == got[4] == got[7] == "und" and got[5] == "en"
    nothing = langid.predict(awkward, langid.Model()).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_slices_cover_all_rows():
    import pyarrow as pa

    column = pa.array(["a" * 5, None, "", "b" * 30, "c"]).slice(1)
    parts = [(lo, t) for lo, t in C.text_slices(column, limit=8)]
    assert [x for _, t in parts for x in t] == [b"", b"", b"b" * 30, b"c"] and parts[0][0] == 0


def test_every_word_has_emissions_of_its_own(spark):
    """Two kinds of text over 6000 words: more words than 4096 symbols, all told apart by state."""
    rng = np.random.default_rng(6)
    kinds = [[f"k{j}w{i}x" for i in range(3000)] for j in range(2)]
    texts = [(k, " ".join(kinds[k % 2][i] for i in rng.permutation(3000))) for k in range(8)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    run = lambda **kw: sum(r.score for r in hmm.score_texts(df, F.lit(True), F.lit(False), states=2, rounds=4, min_count=1, **kw).collect())
    assert run() > run(symbols=4096) + 1000


def test_language_machines_learn_from_500_documents_in_300_rounds():
    import inspect

    assert inspect.signature(langid.train).parameters["per_language"].default == 500
    assert inspect.signature(langid.train_svm).parameters["rounds"].default == 300


def test_spread_join_equals_a_plain_join(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"))
    facts = spark.range(0, 2900, 7).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    found = {tuple(r) for r in C.spread_join(rows, "k", "doc_id", facts, 3000).select("doc_id", "k", "v").collect()}
    assert found == {tuple(r) for r in rows.join(facts, "k").select("doc_id", "k", "v").collect()}
    assert len(found) > 2000
    assert C.spread_join(rows.limit(0), "k", "doc_id", facts, 0).count() == 0
