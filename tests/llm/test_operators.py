"""The training-data operators: SQL parity, brute force, round trips, held-out quality, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, decontam, linededup, lm, media, mixing, neardup, pii, queries, tokenfile, toxicity, warc

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "one", "en", None), (5, "one two three four five six", "en", "a"), (5, "one two three four five six", "en", "a"),
    (None, "no id here at all today", "en", "a"), (6, "x" * 200_000, "en", "b"), (7, "word " * 30_000, "en", "b"), (8, "naïve 中文 \U0001f600 test@example.org +1 (555) 123-4567", "de", "b"), (9, "a\x00b\x85c d", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal rows, and columns whose names clash with what operators make."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in ("n_tokens", "score", "spans", "key", "prob", "kept", "rep", "label", "h", "salt", "h2", "drop")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def rows(df):
    return df.toPandas()


# --- pii


def test_pii_base_spans_by_plain_patterns():
    email, r = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("a1.@-+() é") for _ in range(r.randint(0, 24)))
        got = pii.base_spans(t)
        assert [s[:2] for s in got if s[2] == "email"] == [m.span() for m in email.finditer(t)]
        assert [s[:2] for s in got if s[2] == "phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    assert [s[2] for s in pii.base_spans("4111 1111 1111 1111, 4111 1111 1111 1112, 256.1.1.1, 10.0.0.1.7")] == ["card", "ip"]


def test_pii_ip_and_card_by_plain_patterns():
    r = random.Random(2)
    for k in range(40_000):
        t = "".join(r.choice("0125.." if k % 2 else "0149 -x") for _ in range(r.randint(0, 40)))
        got = pii.base_spans(t)
        ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        cards = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0]
        assert [s[:2] for s in got if s[2] == "ip"] == ips and [s[:2] for s in got if s[2] == "card"] == cards


def test_pii_query_by_plain_patterns(spark, docs):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = rows(queries.op1_pii(spark, DATA))
    assert len(got) == len(text)
    for r in got.itertuples():
        base = sorted(((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, text[r.doc_id]) if ok[kind](m.group())))
        own = [f"{kind}:{a}:{b}" for a, _, b, kind in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == kind for x in base) for kind in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest() and set(own) <= set(r.spans.split(",")) | {""}


def test_pii_long_texts_take_linear_time():
    import time

    model = pii.trained(pii.labelled(60))
    for text in ("7" * 200_000, "7." * 100_000, "a at b dot c " * 10_000, "x" * 200_000 + " at b dot c", "1 " * 30_000, "a@b.co " * 20_000):
        began = time.time()
        base = pii.base_spans(text)
        pii.merged(base, pii.decoded([text], model)[0])
        assert time.time() - began < 60


def test_pii_spans_cross_no_cut():
    model = pii.trained(pii.labelled())
    text = "4 " * 300 + "write to anna at example dot com " + "5 " * 300
    assert any(text[a:b] == "anna at example dot com" for a, b, k in pii.decoded([text], model)[0])
    base, more = [(0, 5, "ip"), (3, 9, "card"), (20, 30, "email")], [(9, 12, "id"), (8, 10, "id"), (30, 31, "id"), (12, 21, "id"), (15, 20, "id")]
    assert [s[:2] for s in pii.merged(base, more) if not s[3]] == [(9, 12), (15, 20), (30, 31)]


def test_pii_long_stretches_decode_in_parts(spark, monkeypatch):
    model, r = pii.trained(pii.labelled(100)), random.Random(5)
    text = " ".join(t for tokens, _ in pii.labelled(300, seed=3) for t in [*tokens, *(str(r.randint(0, 10**9)) for _ in range(5))])
    whole = pii.decoded([text], model)
    for n in (1, 7, 100):
        monkeypatch.setattr(pii, "LONG", n)
        assert [sorted(x) for x in pii.decoded([text], model)] == [sorted(x) for x in whole] and whole[0]
    table = spark.createDataFrame([(s, k, "x", "O") for s in range(3) for k in range(4)], "sentence long, position long, token string, tag string")
    assert [len(x) for x, _ in pii.sentences_of(table, 9)] == [4, 4] and [len(x) for x, _ in pii.sentences_of(table, 3)] == [3] and len(pii.sentences_of(table)) == 3


def test_pii_field_learns_and_decodes_exactly():
    model = pii.trained(pii.labelled())
    right = total = 0
    for tokens, tags in pii.labelled(200, seed=99):
        score = model[0][pii.feature_ids(tokens)].sum(1)[None]
        path = pii.viterbi(score, np.ones((1, len(tokens)), bool), model[1])[0]
        right += sum(pii.TAGS[a] == b for a, b in zip(path, tags, strict=True))
        total += len(tags)
    assert right / total > 0.97
    r = np.random.default_rng(0)
    for _ in range(20):  # against all paths
        s, m = r.normal(size=(4, 3)), r.normal(size=(3, 3))
        import itertools

        best = max(itertools.product(range(3), repeat=4), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) + sum(m[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(pii.viterbi(s[None], np.ones((1, 4), bool), m)[0]) == best
    text = "write to anna at example dot com or key=9f8e7d6c5b4a39281706f5e4d3c2b1a0 now"
    assert {k for _, _, k in pii.decoded([text], model)[0]} == {"email", "secret"}


def test_pii_odd(odd):
    got = rows(pii.find(odd)).set_index("doc_id", drop=False)
    assert len(got) == len(ODD)
    assert [s["kind"] for s in got.loc[8].spans] == ["email", "phone"] and len(got.loc[1].spans) == 0
    assert pii.find(odd.limit(0)).count() == 0 and pii.find(odd, pii.labelled_table(odd.sparkSession).limit(0)).count() == len(ODD)


# --- warc


def test_warc_round_trip(spark):
    big, small = "b" * 1500, "s" * 10
    pages = spark.createDataFrame([(1, "http://a/", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", "é" * 600), (None, "u", big), (2, "z", big)], "page_id long, url string, html string").withColumn("offset", F.lit("mine"))
    folder, index = warc.write(pages)
    got = warc.read(folder, index).toPandas()
    assert Counter(got.record_type) == {"response": 5, "revisit": 3}
    assert sorted(got[got.record_type == "revisit"].refers_to) == [2, 2, 2]
    assert {bytes(p).decode() for p in got.payload if p is not None} == {big, small, "", "é" * 600}
    some = warc.read(folder, index.filter("page_id = 6")).collect()
    assert len(some) == 1 and some[0].payload_bytes == 1200 and some[0].digest == hashlib.sha1(("é" * 600).encode()).hexdigest()
    assert warc.read(*warc.write(pages.limit(0))).count() == 0
    # as other readers see it: every archive member by member
    import zlib as z

    fs, place = common.filesystem(folder)
    records = []
    for f in {r.file for r in index.collect()}:
        data = fs.open_input_file(f"{place}/{f}").read()
        while data:
            member = z.decompressobj(31)
            raw = member.decompress(data)
            records.append(dict(x.split(": ", 1) for x in raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]))
            data = member.unused_data
    kinds = Counter(r["WARC-Type"] for r in records)
    assert kinds["warcinfo"] == len({r.file for r in index.collect()}) and (kinds["response"], kinds["revisit"]) == (5, 3)
    by_id = {r["WARC-Record-ID"]: r for r in records}
    assert len(by_id) == len(records)
    for r in records:
        if r["WARC-Type"] == "revisit":
            assert by_id[r["WARC-Refers-To"]]["WARC-Type"] == "response" and by_id[r["WARC-Refers-To"]]["WARC-Payload-Digest"] == r["WARC-Payload-Digest"]


def test_warc_ranges_join_neighbours():
    assert list(warc.ranges([("a", 0, 10), ("a", 20, 5), ("a", 10_000_000, 5), ("b", 0, 1)])) == [("a", 0, 25, [0, 1]), ("a", 10_000_000, 10_000_005, [2]), ("b", 0, 1, [3])]


# --- language model


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 10), (5_000, 6_000), (60_000, 60_100), (5_000, 1 << 40), (70_000, 1 << 63), (3, 1 << 63), (40, 1 << 63)):
        v = np.unique(r.integers(0, top, n).astype(np.uint64))
        ef = lm.EliasFano(*(lm.EliasFano.arrays(v, top)[k] for k in ("low", "high", "ones", "zeros", "n", "bits")))
        if len(v):
            assert (ef.get(np.arange(len(v))) == v).all() and (ef.find(v) == np.arange(len(v))).all()
        q = r.integers(0, top, 500).astype(np.uint64)
        assert ((ef.find(q) >= 0) == np.isin(q, v)).all()


def test_successors_lie_between_pointers():
    r = np.random.default_rng(3)
    lists = [np.unique(r.integers(0, 50, r.integers(0, 9))) for _ in range(300)]
    first = np.cumsum([0, *map(len, lists)])
    ends = [x[-1] if len(x) else 0 for x in lists]
    base = np.concatenate([[0], np.cumsum(ends)[:-1]])
    flat = np.concatenate([b + x for b, x in zip(base, lists)]).astype(np.uint64)
    ef = lm.EliasFano(*(lm.EliasFano.arrays(flat, int(flat[-1]) + 1)[k] for k in ("low", "high", "ones", "zeros", "n", "bits")))
    c, w = np.repeat(np.arange(300), 50), np.tile(np.arange(50), 300)
    got = ef.find((base[c] + w).astype(np.uint64), first[c], first[c + 1])
    want = [first[i] + np.searchsorted(lists[i], x) if x in lists[i] else -1 for i, x in zip(c.tolist(), w.tolist())]
    assert got.tolist() == want


def test_lm_opens_few_files(tmp_path):
    """Ten times as many shards as a process may have open."""
    import subprocess
    import sys

    code = f"""
import resource, sys, uuid
import numpy as np
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
from tallyspark.llm import lm
model = lm.Model("file://{tmp_path}", 12)
listed, words = [], []
for s in range(4096):
    h = np.array([(s << 51) + k for k in range(3)], np.uint64)
    lm.write_file(f"file://{tmp_path}/{{s}}.words", lm.packed({{**lm.named("hash", lm.EliasFano.arrays(h, 1 << 63)), "count": np.arange(3, dtype=np.uint8) + 1, "big": np.zeros(0, np.int64), "big_count": np.zeros(0, np.int64)}}))
    listed.append({{"shard": s, "file": f"{{s}}.words", "n_entries": 3, "n_tokens": 6, "hot": [], "hot_n": []}})
    words.append(h)
model.add(listed, 100)
opened = lm.Opened(model, 300)
for _ in range(2):
    ids, counts = opened.numbers(np.concatenate(words))
    assert (ids == np.arange(3 * 4096)).all() and (counts == np.tile([1, 2, 3], 4096)).all()
assert len(opened.held) == 300
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=str(__import__("pathlib").Path(lm.__file__).parents[2]))


def brute_lm(train, texts, order):
    tok = lambda t: [b"", *(t or "").encode("utf-8", "replace").lower().split(), b""]
    c, grams, kinds, total = Counter(), Counter(), Counter(), Counter()
    for t in train:
        w = tok(t)
        c.update(w[1:])
        for k in range(2, order + 1):
            grams.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for g, n in grams.items():
        kinds[g[:-1]] += 1
        total[g[:-1]] += n
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(g):
        if len(g) == 1:
            return p1(g[0])
        low, u = p(g[1:]), total[g[:-1]]
        return max(grams[g] - 0.75, 0) / u + 0.75 * kinds[g[:-1]] / u * low if u else low

    out = []
    for t in texts:
        w = tok(t)
        s = [p(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(1, len(w))]
        out.append((len(s), sum(c[x] > 0 for x in w[1:]), float(np.log10([p1(x) for x in w[1:]]).sum()), float(np.log10(s).sum())))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_by_brute_force(docs, monkeypatch, order):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 10_000)
    train = docs.filter(common.crc_mod("doc_id", 10) != 0)
    got = rows(lm.scored(docs, lm.trained(train, order))).sort_values("doc_id")
    own = docs.toPandas().sort_values("doc_id")
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in own.doc_id]
    want = brute_lm([t for t, h in zip(own.text, held, strict=True) if not h], own.text, order)
    for r, w in zip(got.itertuples(), want, strict=True):
        assert (r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2], rel=1e-9) and r.score == pytest.approx(w[3], rel=2e-3)
    assert got.score[held].sum() > got.base_score[held].sum()


def test_lm_odd(odd):
    got = rows(lm.scored(odd, lm.trained(odd)))
    assert len(got) == len(ODD) and got.set_index("doc_id").loc[1].n_tokens == 1
    none = rows(lm.scored(odd, lm.trained(odd.limit(0))))
    assert (none.n_known == 0).all() and (none.base_score == 0).all()


# --- toxicity


def toxic_rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice(["the", "re", "on", "an", "in", "tion", "er"]) for _ in range(r.randint(1, 3)))
    insults = ["idiot", "moron", "pathetic", "stupid"]
    out = []
    for i in range(400):
        words = [word() for _ in range(r.randint(5, 60))]
        if i % 5 == 0:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(insults))
        out.append((" ".join(words), int(i % 5 == 0)))
    return out


def test_toxicity_learns_and_bears_inserted_signs():
    own = toxic_rows()
    machine = toxicity.trained(own[:300])
    score = machine.scores([t for t, _ in own[300:]])
    assert ((score >= 0.5) == np.array([y for _, y in own[300:]], bool)).mean() > 0.97
    odd = machine.of_words(["id-iot", "i.diot", "mor-on", "pathxetic", "thereon", "anthe"])
    assert odd[:4].min() > odd[4:].max()
    assert toxicity.tokens("you i d i o t and a b") == ["you", "idiot", "and", "a", "b"]


def test_toxicity_takes_in_all_words():
    r, clean = random.Random(7), toxic_rows()
    clean = [t for t, y in clean if not y]
    mark = lambda: "achl" + r.choice(["ich", "ig", "eit"]) + r.choice(["en", "er", "au", "st", "tz", "be"])

    def text(marks):
        words = " ".join(r.sample(clean, 3)).split()[:100]
        for _ in range(marks):
            words.insert(r.randrange(len(words)), mark())
        return " ".join(words)

    own = [(text(6 if i % 4 == 0 else 2 * (i % 8 == 1)), int(i % 4 == 0)) for i in range(500)]
    machine = toxicity.trained(own[:400])
    score = machine.scores([t for t, _ in own[400:]])
    assert ((score >= 0.5) == np.array([y for _, y in own[400:]], bool)).mean() > 0.95
    # a toxic passage in a long text; the words round it change nothing
    long = [w for t in clean * 3 for w in t.split()][:20_000]
    hidden = " ".join([*long[:9_000], text(6), *long[9_000:]])
    assert machine.scores([" ".join(long), hidden]).round().tolist() == [0, 1]


def test_toxicity_evidence_by_brute_force():
    v = np.random.default_rng(2).uniform(toxicity.FLOOR, 2, 730)
    for n in (0, 1, 3, 200, 201, 300, 301, 730):
        parts = [v[:n]] + ([v[i : min(i + 200, n)] for i in range(0, n - 100, 100)] if n > 200 else [])
        got = toxicity.evidence(v[:n])
        assert len(got) == len(parts)
        for row, p in zip(got, parts, strict=True):
            over = sorted(np.minimum(p, toxicity.SURE) - toxicity.FLOOR, reverse=True)
            assert row == pytest.approx([*(over + [0] * 4)[:4], np.log1p(10 * sum(over) / (len(p) + 20)), np.log1p(len(p)) / 3])


def test_subsequence_kernel_by_brute_force():
    def phi(w):
        w, out = "\2" + w, Counter()
        for i in range(len(w)):
            for a in range(1, toxicity.SPAN):
                for b in range(1, toxicity.SPAN + 1 - a):
                    if i + a + b < len(w):
                        out[w[i], w[i + a], w[i + a + b]] += toxicity.DECAY ** (a + b - 2)
        return out

    words = ["idiot", "idxiot", "tttt", "ab", "z"]
    got = toxicity.kernel_to(words, words)
    for i, x in enumerate(map(phi, words)):
        for j, y in enumerate(map(phi, words)):
            n = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            assert got[i, j] == pytest.approx(sum(v * y[k] for k, v in x.items()) / n if n else 0, abs=1e-5)


def test_toxicity_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"  # smaller ones hold a handful of toxic labels
    got = rows(queries.op4_toxicity(spark, folder))
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.held_out.tolist() == held and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    labels = pd.read_parquet(f"{folder}/labels.parquet").dropna(subset=["toxic"])
    both = got[got.held_out].merge(labels, on="doc_id")
    caught, wrong = (both[both.toxic == k].predicted.mean() for k in (1, 0))
    assert len(both) > 500 and caught > 0.85 and wrong < 0.02
    # no label of a held-out row is learned from
    train = toxicity.training_rows(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").filter(common.crc_mod("doc_id", 5) != 0))
    held_texts = set(pd.read_parquet(f"{folder}/documents.parquet").merge(both[["doc_id"]], on="doc_id").text)
    assert len(train) > 50 and sum(t in held_texts for t, _ in train) <= 0.1 * len(held_texts)


def test_toxicity_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 20, "x" * 100) for i in range(60)] + [(i, f"text {i}") for i in range(100, 130)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(140)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels)) == 90 and len(toxicity.training_rows(docs, labels, max_docs=7)) <= 7
    assert sum(len(t) for t, _ in toxicity.training_rows(docs, labels, max_bytes=500)) <= 500


def test_toxicity_odd(spark, odd):
    machine = toxicity.trained(toxic_rows())
    got = rows(toxicity.scored(odd, machine))
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    kept = toxicity.clean(odd, machine)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert toxicity.trained([]).scores(["x", None]).tolist() == pytest.approx([0, 0], abs=1e-6)
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(odd, labels)) == 2


# --- decontamination


def contained(docs, items, threshold=0.8):
    def sh(t):
        w = decontam.words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    out = set()
    for d, t in docs:
        w = decontam.words(t)
        for i, x in items:
            s = sh(x)
            k = min(5, len(decontam.words(x)))
            own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
            if s and len(s & own) / len(s) >= threshold - 1e-12:
                out.add((d, i))
    return out


def test_decontamination_by_brute_force(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.pairs(docs, items).collect()}
    assert got == contained([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert len(got) > 0


def test_decontamination_gapped_many_and_odd(spark, odd, monkeypatch):
    r = random.Random(2)
    word = lambda: "w%d" % r.randrange(500)
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(60)] + [(90, None), (91, ""), (92, "one two three four five six")]
    texts = []
    for d in range(80):
        parts = [word() for _ in range(50)]
        for _ in range(r.choice([0, 1, 2, 30])):
            own = r.choice(items[:60])[1].split()
            cut = r.randrange(len(own))
            parts += [*own[:cut], *([word()] if r.random() < 0.5 else []), *own[cut:]]
        texts.append((d, " ".join(parts)))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("n_item", F.lit("mine"))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = contained(texts, items)
    assert {(x.doc_id, x.item_id) for x in decontam.pairs(df, it).collect()} == want
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert {(x.doc_id, x.item_id) for x in decontam.pairs(df, it).collect()} == want
    assert {x.doc_id for x in decontam.pairs(odd, it).filter("item_id = 92").collect()} == {5}
    copies = spark.createDataFrame([(1, "one two three four five six")] * 30, "item_id long, text string")
    assert len(decontam.blocks(copies, 0.8)) == 5 and decontam.pairs(odd, copies).count() == 60
    left = decontam.clean(odd, it)
    assert left.columns == odd.columns and left.count() == len(ODD) - 2
    assert decontam.pairs(odd, it.limit(0)).count() == 0


# --- token files


def test_token_files_round_trip(spark, odd, docs):
    path = queries.tokenizer()
    plain = tokenfile.encoder(path).tokenizer
    for df in (odd, docs):
        folder, files = tokenfile.write(df, path)
        got = tokenfile.read(folder, files, keep_ids=True).toPandas().sort_values("start")
        assert len(got) == df.count()
        assert got.start.tolist() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]]).tolist()
        known = got[got.doc_id.notna()]
        assert known.doc_id.is_monotonic_increasing
        text = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        for r in known.itertuples():
            ids = [*plain.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert tokenfile.read(*tokenfile.write(odd.limit(0), path)).count() == 0
    f = files.first()
    assert tokenfile.document(folder, f.file, 0)[-1] == 2


def test_encoder_equals_library():
    e, r = tokenfile.Encoder(queries.tokenizer()), random.Random(3)
    texts = ["".join(r.choice("ab 'sdtre\n\t\r\x0b 1²٣,.!<|>é中\U0001f600\xa0\x85\x1f_-") for _ in range(r.randint(0, 40))) for _ in range(5_000)] + ["a<|endoftext|>b", "don't I'll 've", "  x  \n y"]
    assert [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n, a="a", b="b"):
    """Two unlike words of n letters whose sums of bytes by powers agree for many bases."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 4096])
def test_no_hash_decides_ids_or_words(n):
    e, pair = tokenfile.Encoder(queries.tokenizer()), thue_morse(n)
    texts = [*pair, " ".join(pair), pair[0][:-1], pair[0] + "a", "x" + pair[1], "\n" * 9 + pair[0] + "é" * 9]
    assert [np.frombuffer(b, e.kind).tolist() for b in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    h, first = common.word_hashes(pa.array([*pair, *(p.upper() for p in pair), f"{pair[0]} {pair[1]}", "é" * n, "e" * n]))
    assert len({*h.tolist()}) == 4 and first.tolist() == [0, 1, 2, 3, 4, 6, 7, 8]
    assert h[0] == h[2] == h[4] and h[1] == h[3] == h[5]


# --- media


def test_media_round_trip(odd):
    import pyarrow as pa

    assert media.extracted(media.store(odd.limit(0)))[1].count() == 0
    folder, found = media.extracted(media.store(odd))
    got = found.toPandas().set_index("doc_id", drop=False)
    text = {r[0]: r[1] for r in ODD}
    for d, t in text.items():
        if d is None or d == 5:
            continue
        data = media.payload(t)
        r = got.loc[d]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.n_bytes) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len((t or "").encode()))
        assert media.from_wav(media.to_wav(data)) == (media.RATE, data)
    assert got.loc[5].tensors_sha256.nunique() == 1
    fs, place = common.filesystem(folder)
    import pyarrow.fs as pafs

    n = 0
    for f in fs.get_file_info(pafs.FileSelector(place)):
        t = pa.ipc.open_file(fs.open_input_file(f.path)).read_all()
        assert t.schema.field("mel").type == media.TENSOR
        n += t.num_rows
    assert n == sum(map(len, got.spans))


def test_media_features():
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        y, delay = media.resampled(x, up, down), (media.TAPS * max(up, down) - 1) / 2 / (16_000 * up)
        want = np.sin(2 * np.pi * 440 * (np.arange(len(y)) * down / up / 16_000 - delay))
        assert np.abs(y - want)[400:-400].max() < 0.02
    quiet = np.full(8_000, -60.0)
    mel = np.full((40, media.MELS), -60.0)
    mel[10:20] = 0
    assert media.segments(mel) == [(10, 20)] and len(quiet)


def test_log_mel_by_plain_transform():
    x = np.random.default_rng(1).normal(size=1_000).astype(np.float32)
    got, n = media.log_mel(x, 10_666), media.FRAME
    padded = np.pad(x, (0, -(len(x) - n) % media.HOP)).astype(float)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    dft = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    to_mel, to_hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = to_hz(np.linspace(0, to_mel(10_666 / 2), media.MELS + 2))
    f = np.arange(n // 2 + 1) * 10_666 / n
    for k in range(len(got)):
        power = np.abs(dft @ (padded[k * media.HOP : k * media.HOP + n] * hann)) ** 2
        want = [10 * np.log10(sum(p * max(0, min((v - lo) / (mid - lo), (hi - v) / (hi - mid))) for p, v in zip(power, f, strict=True)) + 1e-8) for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False)]
        assert got[k] == pytest.approx(want, abs=0.05)


def test_media_query_columns(spark, docs):
    got = rows(queries.op7_audio_features(spark, DATA)).set_index("doc_id")
    feature = {}
    for r in docs.collect():
        data = (r.text or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        x, wav = got.loc[r.doc_id], media.to_wav(padded)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest()) and feature.setdefault(r.text, x.feature) == x.feature
    assert len(set(feature.values())) == len(feature)


def test_media_short_texts_and_tails():
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh ij") for _ in range(n)) for n in (*range(5, 64, 4), 64, 64, 200, 500, 700, 767, 800, 1000)]
    found = [media.features(media.to_wav(media.payload(t))) for t in texts]
    assert all(spans for _, spans in found)
    assert len({mel.tobytes() for mel, _ in found}) == len(texts)
    for n in (1, 200, 257, 300, 400, 1000):
        x = np.zeros(n, np.float32)
        x[-1] = 1
        mel = media.log_mel(x, 8_000)
        assert len(mel) == 1 + -(-max(0, n - media.FRAME) // media.HOP)
        assert n < media.FRAME or mel[-1].max() > -60
    # the last byte of a payload without padding counts
    a, b = ("word " * 400)[:1920], ("word " * 400)[:1919] + "#"
    assert media.features(media.to_wav(a.encode()))[0].tobytes() != media.features(media.to_wav(b.encode()))[0].tobytes()
    assert media.features(media.to_wav(media.payload("")))[1] == []


# --- mixing


def test_mixing_meets_all_marginals(docs):
    got = rows(mixing.mixed(docs))
    mass = got.n_tokens * got.prob
    cells = got.groupby(["source", "lang", "topic"]).prob.nunique()
    assert (cells == 1).all() and got.prob.between(0, 1).all() and got.prob.max() == pytest.approx(1)
    for d in mixing.DIMS:
        natural = got.groupby(d).n_tokens.sum()
        natural = natural[natural > 0]
        want = natural ** mixing.TEMPER[d] / (natural ** mixing.TEMPER[d]).sum()
        share = (mass.groupby(got[d]).sum() / mass.sum())[want.index]
        assert (share - want).abs().max() < 1e-8
    plain = got.merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    assert (plain.n_tokens == [len(re.findall("[^ \t\n\x0b\f\r]+", t or "")) for t in plain.text]).all()


def test_mixing_meets_stated_targets(spark):
    own = [(i, "word " * (40 + i) + "7" * (20 * (i % 3 == 0)), "en" if i % 5 else "de", "a" if i % 7 > 1 else "b") for i in range(60)]
    docs = spark.createDataFrame(own, SCHEMA).coalesce(1)
    targets = {"lang": {"en": 1, "de": 1}, "source": {"a": 3, "b": 1}}
    got = rows(mixing.mixed(docs, targets=targets, tolerance=1e-3))
    mass = got.n_tokens * got.prob
    assert got.prob.between(0, 1).all() and got.prob.max() == pytest.approx(1)
    for d, want in targets.items():
        share = (mass.groupby(got[d]).sum() / mass.sum())[list(want)]
        assert np.abs(share - np.array(list(want.values())) / sum(want.values())).max() < 2e-3
    with pytest.raises(ValueError, match="no tokens"):
        mixing.mixed(docs, targets={"lang": {"none such": 1}})


def test_mixing_odd(odd):
    got = rows(mixing.mixed(odd))
    assert len(got) == len(ODD) and set(got[got.n_tokens == 0].topic) <= {"empty", "lines", "prose"} and (got[got.topic == "empty"].prob == 1).all()
    kept = mixing.mixed_documents(odd)
    assert kept.columns == odd.columns and kept.count() == got.kept.sum()
    assert mixing.mixed(odd.limit(0)).count() == 0


# --- line dedup


def test_bloom_filters_miss_nothing():
    r = np.random.default_rng(2)
    h = r.integers(-(1 << 62), 1 << 62, 50_000)
    twice = np.concatenate([h, h[:1_000]])
    batches = np.array_split(twice[r.permutation(len(twice))], 20)
    twice = linededup.twice_seen(((b, np.zeros(len(b), bool)) for b in batches), 1 << 20)
    assert twice.has(h[:1_000].view(np.uint64)).all() and twice.has(h[1_000:].view(np.uint64)).sum() < 500


@pytest.mark.parametrize("rows", [0, linededup.BROADCAST_ROWS])
def test_line_dedup_with_few_and_many_suspects(same, monkeypatch, rows):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    same(queries.QUERIES["op9_line_dedup"], queries.ORACLES["op9_line_dedup"])


def test_line_dedup_odd(spark):
    line = "This very line is long enough to be a key, is it not?"
    data = [(i, f"{line}\nown {i}\n  {line.upper()}\t") for i in range(6)] + [(6, None), (7, ""), (5, line), (None, line), (8, "a\n\n" + line)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"key": F.lit(1), "h": F.lit(2), "drop": F.lit(3)})
    got = rows(linededup.deduped(df))
    assert len(got) == len(data)
    by = defaultdict(list)
    for r in got.itertuples():
        by[None if pd.isna(r.doc_id) else r.doc_id].append((r.n_lines, r.n_dropped, r.kept))
    assert by[0] == [(3, 2, "own 0")] and by[8] == [(3, 0, "a\n\n" + line)] and by[6] == [(1, 0, "")] and by[None] == [(1, 1, "")]
    assert sorted(by[5]) == [(1, 1, ""), (3, 2, "own 5")]
    assert linededup.deduped(df.limit(0)).count() == 0


def test_line_dedup_of_many_dropped_lines_is_linear(spark):
    import time

    text = "\n".join(f"line number {i} of a text that others repeat, every one" for i in range(40_000))
    df = spark.createDataFrame([(i, text + f"\n{i}") for i in range(6)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.kept)) for r in linededup.deduped(df).collect()}
    assert time.time() - began < 60
    assert got == {i: (40_001, 0 if i == 5 else 40_000, len(text) + 2 if i == 5 else 1) for i in range(6)}


# --- near-duplicates


def brute_classes(docs):
    sh = {d: Counter(zip(*(common.words_of(t)[i:] for i in range(5)), strict=False)) or Counter([tuple(common.words_of(t))]) for d, t in docs if common.words_of(t)}
    n, df = len(docs), Counter(s for v in sh.values() for s in v)
    idf = lambda s: 1 + np.log(n / df[s])
    w = {d: {s: k * idf(s) for s, k in v.items()} for d, v in sh.items()}
    at = {d: d for d, _ in docs}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    inside = defaultdict(list)
    for d, v in w.items():
        for s in v:
            inside[s].append(d)
    done = set()
    for own in inside.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    least = sum(min(x, w[b][s]) for s, x in w[a].items() if s in w[b])
                    if least / (sum(w[a].values()) + sum(w[b].values()) - least) >= 0.8 - 1e-9:
                        at[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in docs}


def copies(seed=6, n=60):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3_000)
    passage = [word() for _ in range(40)]
    out = []
    for i in range(n):
        t = [word() for _ in range(r.randint(1, 200))]
        if i % 3 == 0:
            t += passage
        out.append(t)
        for _ in range(r.choice([0, 0, 1, 4])):
            c = list(t)
            for _ in range(r.randrange(4)):
                c[r.randrange(len(c))] = word()
            out.append(c)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_near_duplicates_by_brute_force(spark):
    docs = copies()
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_classes(docs)
    assert got == want and len(set(want.values())) < len(want)


def test_near_duplicate_recall(spark):
    """Every id divisible by 50 against all rows: pairs of different texts at 0.8 or more, and whether they are of one class."""
    folder = "/root/testdata/sf0.1"
    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    words = [common.words_of(t) for t in docs.text]
    shingles = [np.unique(np.array([hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))] if w else [], np.int64), return_counts=True) for w in words]
    flat, owner = np.concatenate([s for s, _ in shingles]), np.repeat(np.arange(len(docs)), [len(s) for s, _ in shingles])
    order = np.argsort(flat, kind="stable")
    flat, owner, count = flat[order], owner[order], np.concatenate([n for _, n in shingles])[order]
    _, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    weight = count * (1 + np.log(len(docs) / df[at]))
    total = np.bincount(owner, weight, len(docs))
    label = rows(neardup.classes(spark.read.parquet(f"{folder}/documents.parquet"))).set_index("doc_id").class_id
    found = missed = 0
    for q in np.flatnonzero(docs.doc_id % 50 == 0):
        s, n = shingles[q]
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
        least = np.zeros(len(docs))
        for a, b, k in zip(lo, hi, n, strict=True):
            least[owner[a:b]] += np.minimum(weight[a:b], weight[a:b] / count[a:b] * k)
        for j in np.flatnonzero(least >= 0.8 * (total[q] + total - least)):
            if j != q and words[j] != words[q]:
                same = label[docs.doc_id[q]] == label[docs.doc_id[j]]
                found, missed = found + same, missed + (not same)
    print("near-duplicate pairs found and missed:", found, missed)
    assert found + missed > 0 and found >= 0.9 * (found + missed)


def test_consistent_sampling_estimates_weighted_jaccard():
    r = np.random.default_rng(3)
    got, want = [], []
    for i in range(150):
        s = r.integers(0, 1 << 56, 60).astype(np.uint64)
        a, b = r.gamma(2, 1, 60) + 0.01, r.gamma(2, 1, 60) + 0.01
        got.append((neardup.samples(s[:50], a[:50]) == neardup.samples(s[10 * (i % 2) :], b[10 * (i % 2) :])).mean())
        x, y = np.where(np.arange(60) < 50, a, 0), np.where(np.arange(60) >= 10 * (i % 2), b, 0)
        want.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    # 9,600 draws in all: under 0.005 standard error
    assert abs(np.mean(got) - np.mean(want)) < 0.015


def test_keys_survive_gap_coding():
    r = np.random.default_rng(4)
    for n, top in ((1, 5), (2, 1 << 56), (5_000, 6_000), (5_000, 1 << 56)):
        keys = np.unique(r.integers(0, top, n).astype(np.uint64))
        assert (neardup.ungapped(neardup.gaps(keys)) == keys).all()


def test_blocks_of_members_by_brute_force():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.int64) for _ in range(30)]
    idf = r.random(60) + 0.1
    weights = [idf[s] * r.integers(1, 4, len(s)) for s in sets]
    got = neardup.shared_weights(sets, weights, step=7)
    for i in range(30):
        for j in range(30):
            if i != j:
                a, b = dict(zip(sets[i], weights[i], strict=True)), dict(zip(sets[j], weights[j], strict=True))
                assert got[i, j] == pytest.approx(sum(min(v, b[k]) for k, v in a.items() if k in b))


def test_near_duplicates_odd(spark, odd):
    got = rows(neardup.classes(odd))
    assert len(got) == len(ODD)
    by = {r.doc_id: r.class_id for r in got.dropna().itertuples()}
    assert all(by[d] == d for d in by)
    # of the two rows that are equal one stays
    assert neardup.deduplicated(odd).count() == len(ODD) - 1
    assert neardup.classes(odd.limit(0)).count() == 0 and neardup.deduplicated(odd.limit(0)).count() == 0
    same = odd.unionByName(odd.filter("doc_id = 8").withColumn("doc_id", F.lit(80).cast("long")))
    left = neardup.deduplicated(same)
    assert left.columns == odd.columns and left.filter("doc_id = 80").count() == 0 and left.count() == len(ODD) - 1
    # a repeated id with another text, and copies without an id: a class belongs to a text
    mixed = spark.createDataFrame([(1, "a b c d e f g"), (1, "other words are here now"), (None, "a b c d e f g"), (None, "lone text"), (3, "other words are here now")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(mixed).collect()) == [("1", "1"), ("1", "1"), ("3", "1"), ("None", "1"), ("None", "None")]
    assert sorted(r.text for r in neardup.deduplicated(mixed).collect()) == ["a b c d e f g", "lone text", "other words are here now"]


# --- pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    own, seen = docs, []
    for name, stage in p.STAGES:
        out = common.stored(stage(spark, own, DATA), "test-" + name)
        if name != "token_files":
            assert out.columns == docs.columns
            assert out.select("doc_id").subtract(own.select("doc_id")).count() == 0
        seen.append(out)
        own = out
    toxic, near, clean, mixed, tokens = seen
    assert toxic.count() > 0.7 * docs.count()
    texts = [tuple(r) for r in toxic.select("doc_id", "text").collect()]
    want = brute_classes(texts)
    assert {r[0] for r in near.select("doc_id").collect()} == {d for d, c in want.items() if d == c}
    leaks = {d for d, _ in contained([tuple(r) for r in near.select("doc_id", "text").collect()], bench)}
    assert {r[0] for r in near.select("doc_id").collect()} - {r[0] for r in clean.select("doc_id").collect()} == leaks
    assert {r[0] for r in mixed.select("doc_id").collect()} == {r[0] for r in mixing.mixed(clean).filter("kept").select("doc_id").collect()}
    assert 0 < mixed.count() < clean.count()
    assert sorted(r[0] for r in tokens.select("doc_id").collect()) == sorted(r[0] for r in mixed.select("doc_id").collect())


def test_pipeline_odd(spark, odd, tmp_path):
    import corpus_pipeline as p

    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    leaks = items.select(F.col("item_id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("a").alias("source"))
    for name, df in (("odd", odd), ("none", odd.limit(0)), ("leaks", leaks)):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        got = p.run(spark, folder)
        assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        # every leak goes, and what follows bears the empty corpus
        assert 0 < got.count() < len(ODD) if name == "odd" else got.count() == 0


def test_broadcasts_are_bounded_by_rows_in_the_driver(spark):
    """Sorted numbers are next to nothing in their files, but not in the driver's hash table."""
    few = common.stored(spark.range(0, 900_000, 1, 1).select(F.col("id").alias("row"), F.lit(7).alias("label")), "few")
    assert common.bytes_of(few) <= common.BROADCAST_BYTES and few.count() <= common.BROADCAST_ROWS and not common.small(few)
    many = spark.range(2_000).select((F.col("id") * 1_000).alias("row"))
    assert common.joined(many, few, "row", "left").filter("label = 7").count() == 900
    assert "strategy=broadcast" not in common.joined(many, few, "row")._jdf.queryExecution().optimizedPlan().toString()
    assert common.small(few.limit(0)) and common.small(common.stored(few.filter("row < 100000"), "few"))


def test_sides_that_are_not_small_are_never_broadcast(spark):
    """By the bytes of its files, which its copies for each salt don't count in, Spark would broadcast this side 16 times over."""
    few = common.stored(spark.range(0, 900_000, 1, 1).select(F.col("id").alias("row"), F.lit(7).alias("label")), "few")
    many = spark.range(0, 40_000_000, 1, 4).select((F.col("id") % 900_000).alias("row"), F.lit(1).alias("n"))
    assert not common.small(few)
    for how in ("inner", "left"):
        plan = common.joined(many, few, "row", how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_leave_no_broadcast_to_spark(spark, monkeypatch):
    """Where no table is small all joins are shuffled, but those with the under 1000 heavy keys, and the classes are the same."""
    plans, store = [], common.stored

    def seen(df, name, *more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name, *more)

    for module in (common, neardup):
        monkeypatch.setattr(module, "small", lambda few: False)
    monkeypatch.setattr(neardup, "stored", seen)
    docs = copies()
    left = neardup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(brute_classes(docs).values()))
    plans.append(("left", left._jdf.queryExecution().executedPlan().toString()))
    assert all("BroadcastHashJoin" not in plan for name, plan in plans if name != "links")
    assert all("SortMergeJoin" in plan for name, plan in plans if name == "links" and "Join" in plan)
