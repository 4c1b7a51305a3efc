"""Near-duplicates, fingerprints, languages, licenses, search and the pipeline: against brute force on small tables."""

import hashlib
import random
import re
from itertools import combinations
from zlib import crc32

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from nodeweave.llm import components, fingerprint, language_id, license_scan, minhash_dedup, topk_search
from nodeweave.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string"
WIDE = "doc_id long, text string, id string, hash string, n int, v string, a int, b int, label string, body string, row int, words string"


def wide(rows):
    return [(d, t, "i", "h", 1, "v", 2, 3, "l", "b", 4, "w") for d, t in rows]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_sets(docs, width):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        n = min(width, len(w))
        out[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    return out


def brute_components(sets, percent=80):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations([d for d in sets if sets[d]], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def copies(seed, groups=3, of=70, words=90, edits=12, passage=40):
    """Groups of edited copies, texts that share a passage, exact copies, and awkward texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(1500)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(of):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    common = [r.choice(vocabulary) for _ in range(50)]
    out += [" ".join([r.choice(vocabulary) for _ in range(60)] + common) for _ in range(passage)]
    out += ["the same"] * 40 + ["One", "one", "ONE two", "one\ttwo", "", None, " \n", "é É", "É é", "a b c d e f g h i j", "a b c d e f g h i j k", "x " * 3000]
    r.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, tables, seed):
    docs = copies(seed)
    sets = shingle_sets(docs, 2)
    want = brute_components(sets)
    got = {r.doc_id: r for r in QUERIES["op2_minhash_near_dedup"](spark, tables(documents=(wide(docs), WIDE))).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


def test_near_duplicates_odd_rows(spark):
    docs = [(None, "some words here to compare"), (5, "some words here to compare"), (5, "some words here to compare"), (None, "nothing like it"), (9, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, DOCS), width=2).collect()), key=repr)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (9, 9, True)], key=repr)
    kept = minhash_dedup.keep_one(spark.createDataFrame(docs, DOCS), width=2)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(5, "some words here to compare"), (None, "nothing like it"), (9, None)], key=repr)


def test_least_shared():
    assert minhash_dedup.least_shared(48, 80) < 0.8 * 48 and minhash_dedup.least_shared(4, 80) == 1


def test_components_in_parts(spark, monkeypatch):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(links, "a long, b long")
    one = sorted(map(tuple, components.components(df).collect()))
    monkeypatch.setattr(components, "PART", 40)
    assert sorted(map(tuple, components.components(df).collect())) == one
    assert dict(one)[460] == 400


def test_block_links():
    sets = [np.array(x, np.int64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [7, 8], [7, 8])]
    block = [np.arange(4), np.array([0, 1, 2, 3]), np.array([len(s) for s in sets]), np.cumsum([len(s) for s in sets]), np.concatenate(sets)]
    a, b = minhash_dedup.block_links(block, block, 80)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) <= {(2, 3), (3, 2)} and len(a) == 1


# --- fingerprints


def test_fingerprint_query(spark, tables):
    docs = [(d, t) for d, t in copies(3, groups=1, of=8, passage=5) if d % 2] + [(900, "a" * 500), (901, "🙂" * 7), (902, "x")]
    docs = [(d, t) for d, t in docs if t is not None] + [(1000, None)]
    order = sorted(docs, key=lambda x: -x[0])
    got = {r.doc_id: r for r in QUERIES["op6_document_fingerprint"](spark, tables(documents=(wide(docs), WIDE))).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if t == nxt:
            assert r.near_next == 1
        if len(t) > 200 and t != nxt:
            assert r.near_edited > 0.2


def spark_hash(*values):
    """xxhash64 as Spark chains it: the hash of one value is the seed of the next."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text):
    """(hash, first unit) of every closed syncmer, from its definition."""
    unit, k, s = fingerprint.UNIT, fingerprint.K, fingerprint.S
    units = []
    for run in re.findall(r"\S+", text, re.ASCII):
        units += [run] if len(run) <= unit else [run[i : i + unit] for i in range(len(run) - unit + 1)]
    u = [(spark_hash(x), 8) for x in units]
    out = []
    for i in range(len(u) - k + 1):
        mers = [spark_hash(*u[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(mers) in (mers[0], mers[-1]):
            parts = [*mers[: k - s + 1 : s], mers[-1]]
            out.append((spark_hash(*((m, 8) for m in parts)) >> 32, i))
    return out or ([(spark_hash(text) >> 32, 0)] if text else [])


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    link = lambda x: {(p[0], q[0], q[1] - p[1]) for p, q in zip(x, x[1:])} if len(x) > 1 else {x[0][0]}
    a, b = link(a), link(b)
    return 2 * len(a & b) / (len(a) + len(b))


def test_fingerprints_by_brute_force(spark, tables):
    docs = [(i, t or "") for i, (_, t) in enumerate(copies(4, groups=1, of=6, passage=4))] + [(900, "中文" * 30 + " a b"), (901, "kurz"), (902, "a\u00a0b c\x0bd e f g h i j"), (903, "x" * 40)]
    got = {r.doc_id: r for r in QUERIES["op6_document_fingerprint"](spark, tables(documents=(docs, DOCS))).collect()}
    order = sorted(docs, key=lambda x: -x[0])
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        own, edited, following = (brute_anchors(x) for x in (t, t[: len(t) - half] + after[:half], after))
        told = lambda x: "".join(f"{h & 0xFFFFFFFF:08x}" for h, _ in x)
        r = got[d]
        assert (r.fingerprint, r.edited_fingerprint, r.fingerprint_at) == (told(own), told(edited), [at for _, at in own])
        assert (round(r.near_edited, 9), round(r.near_next, 9)) == (round(brute_likeness(own, edited), 9), round(brute_likeness(own, following), 9))


def test_syncmers_choose_half(spark):
    r = random.Random(10)
    text = " ".join(str(r.randrange(10**6)) for _ in range(8000))
    (row,) = fingerprint.with_anchors(spark.createDataFrame([(1, text)], DOCS), "text", "x").collect()
    assert 0.46 < len(row.x) / 8000 < 0.54


def test_anchors_are_context_free(spark):
    r = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    shared = " ".join(r.choice(words) for _ in range(120))
    texts = [shared, " ".join(r.choice(words) for _ in range(120)) + " " + shared, " ".join(r.choice(words) for _ in range(120))]
    df = fingerprint.with_anchors(spark.createDataFrame(list(enumerate(texts)), DOCS), "text", "x", anchors=10_000)
    a, b, c = (set(x.x) for x in df.orderBy("doc_id").collect())
    assert len(a & b) >= len(a) - 1 and len(a & c) < 0.1 * len(a)


def test_passage_in_long_texts(spark):
    r = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, parts = some(50), [some(400) for _ in range(4)]
    texts = [some(6000) + " " + shared + " " + some(6000), some(900) + " " + shared + " " + some(9000), shared, " ".join(parts), " ".join(parts[::-1])]
    df = fingerprint.with_anchors(spark.createDataFrame(list(enumerate(texts)), DOCS), "text", "x").orderBy("doc_id")
    a, b, c, *_ = rows = df.collect()
    assert len(set(c.x)) > 20 and set(c.x) <= set(a.x) & set(b.x)
    assert all(len(x.x) == len(x.x_at) and list(x.x_at) == sorted(set(x.x_at)) for x in rows)
    first, own = dict(zip(a.x, a.x_at)), dict(zip(c.x, c.x_at))
    assert {first[h] - own[h] for h in own} == {6000}
    y = df.select(F.col("doc_id").alias("d"), F.col("x").alias("y"), F.col("x_at").alias("y_at"))
    of = lambda i, j: df.filter(f"doc_id = {i}").crossJoin(y.filter(f"d = {j}")).select(fingerprint.likeness(fingerprint.links("x"), fingerprint.links("y"))).first()[0]
    assert 0 < of(0, 1) < 0.05 and of(3, 4) > 0.95


def test_units_of_text_without_white_space(spark):
    r = random.Random(8)
    run = "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(2000))
    coded = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(3000))
    faces = "".join(chr(r.randrange(0x1F600, 0x1F640)) for _ in range(900))
    pairs = [(x, x[:10] + "x" + x[10:]) for x in (run, coded, faces)] + [(x, x[len(x) // 2 + 5 :] + x[: len(x) // 2 + 5]) for x in (run, coded, faces)]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprint.with_anchors(fingerprint.with_anchors(df, "a", "x"), "b", "y")
    assert all(x[0] > 0.95 for x in df.select(fingerprint.likeness(fingerprint.links("x"), fingerprint.links("y"))).collect())
    texts = ["ab cdefghijklmn, " + "k" * 12 + " " + "m" * 14 + "\n🙂" * 2, ""]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(F.regexp_extract_all("t", F.lit(fingerprint.units(12)), F.lit(1)).alias("u")).collect()
    assert [x.u for x in got] == [["ab", "cdefghijklmn", "defghijklmn,", "k" * 12, *["m" * 12] * 3, "🙂", "🙂"], []]


def test_fingerprint_is_native(spark, tables):
    for name in ("op6_document_fingerprint", "op9_license_scan"):
        plan = QUERIES[name](spark, tables(documents=([(1, "a b c"), (2, "mit license")], DOCS)) if name.startswith("op6") else "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- licenses


def test_license_query(spark, tables):
    mit = license_scan.NOTICES["mit-text"]
    texts = ["Released under the MIT License. mit-license MIT\nLICENSE", "mit licence", "GNU General Public License general public license", "Apache License apache LICENSE", None, "", "Kmit license maKe mit license", "éMIT license", mit, mit.replace("free of charge", "gratis and free of any charge"), " ".join(mit.split()[:12]), "word " * 2000 + "mit license", "MIT İLICENSE", "x " + license_scan.NOTICES["bsd-text"] + " CC BY-NC " + license_scan.NOTICES["lgpl-notice"][30:], "CC BY"]
    docs = [*enumerate(texts), (None, "mit license"), (0, texts[0])]
    got = QUERIES["op9_license_scan"](spark, tables(documents=(wide(docs), WIDE))).collect()
    want = []
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = [(i, k) for k, p in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    brute = {r: brute_licenses(t or "") for r, t in enumerate(t for _, t in docs)}
    assert sorted(((r.doc_id, r.labels, round(r.score, 9)) for r in got), key=repr) == sorted(((d, *brute[i]) for i, (d, _) in enumerate(docs)), key=repr)
    labels = {r.doc_id: r.labels.split(",") for r in got}
    assert "mit-text" in labels[8] and "mit-text" in labels[9] and labels[10] == [""]
    assert {"bsd-text", "lgpl-notice", "cc-by-nc"} <= set(labels[13]) and labels[14] == ["cc-by"]


def brute_licenses(text):
    """Labels and best score: whole phrases, and notices by runs of diagonals of their verified k-grams."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    found = [(k, 1.0) for k, p in {**license_scan.PHRASES, **license_scan.NAMES}.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))]
    for label, notice in license_scan.NOTICES.items():
        own, hits = license_scan.template_words(notice), {}
        for t in range(len(own) - 4):
            for i in range(len(words) - 4):
                if words[i : i + 5] == own[t : t + 5]:
                    hits.setdefault(i - t, set()).update(range(t, t + 5))
        last, covered, best = None, set(), 0.0
        for d in sorted(hits):
            covered = covered | hits[d] if last is not None and d - last <= license_scan.GAP else set(hits[d])
            last, best = d, max(best, len(covered) / len(own))
        if best >= license_scan.COVER:
            found.append((label, best))
    return ",".join(sorted({k for k, _ in found})), round(max((s for _, s in found), default=0.0), 9)


def test_many_licenses_in_one_text(spark):
    text = "Released under the MIT License. " * 30_000 + license_scan.NOTICES["isc-text"] * 3
    (row,) = license_scan.scan(spark.createDataFrame([(1, text)], DOCS)).collect()
    assert sum(s.label == "mit" for s in row.found) == 30_000 and sum(s.label == "isc-text" and s.score == 1 for s in row.found) == 3


# --- languages


def test_language(spark, tables):
    r = random.Random(5)
    words = {"en": "the of and to in is that with this from have not they".split(), "de": "der die und das nicht eine mit sich auch werden über für".split(), "fr": "les des une dans pour est que avec sur ne vous été très".split()}
    docs = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(3, 60))), k if i % 9 else None, "s", 1) for i, k in ((i, ("en", "de", "fr")[i % 3]) for i in range(400))]
    docs += [(1000, None, "en", "s", 0), (1001, "123 !!", "de", "s", 0), (1002, "", None, None, None), (None, "the of and", None, None, None)]
    signs = ["½ ²³ 12", "①", "Ⅷ", "٣ ७", "_", "☃ 🙂", " \n"]
    docs += [(2000 + i, t, "fr", "s", 0) for i, t in enumerate(signs)]
    sf = tables(documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {x.doc_id: x for x in QUERIES["op8_language_id"](spark, sf).collect()}
    assert all(got[d].held_out == (crc32(str(d).encode()) % 4 == 2) for d in got if d is not None)
    assert [got[d].lang_pred for d in (1000, 1001, 1002, *(2000 + i for i in range(len(signs))))] == ["und"] * (3 + len(signs))
    right = [got[i].lang_pred == ("en", "de", "fr")[i % 3] for i in range(400)]
    assert sum(right) / 400 > 0.97 and all(0 <= x.score <= 1 for x in got.values())
    # nothing but the text decides
    other = spark.createDataFrame([(d, t, "xx", "yy", 9) for d, t, *_ in docs], "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet").filter(~language_id.held_out()))
    again = {x.doc_id: x.lang_pred for x in language_id.identify(other, model).collect()}
    assert again == {d: x.lang_pred for d, x in got.items()}


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(df, language_id.fit(df)).collect()[0].lang_pred == "und"


def test_language_sample_counts_texts_not_copies(spark):
    rows = [(i, "one and the same text", "en") for i in range(3000)] + [(i, f"{i}", "de") for i in range(3000)] + [(9000 + i, f"der die das {'abcdefghijkl'[i]}", "de") for i in range(12)]
    seen = []
    train = language_id.train
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_id, "train", lambda rows, languages, *a: seen.extend(languages[y] for *_, y in rows) or train(rows, languages, *a))
        model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5)
    assert model.languages == ["de", "en"] and (seen.count("de"), seen.count("en")) == (5, 1)


def test_every_language_is_learned(spark):
    r = random.Random(12)
    words = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for _ in range(70)]
    rows = [(i, " ".join(r.choice(words[i % 70]) for _ in range(12)), f"l{i % 70}") for i in range(70 * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, bits=12)
    assert model.languages == sorted({x for *_, x in rows})
    assert sum(x.lang == x.lang_pred for x in language_id.identify(df, model).collect()) > 0.9 * len(rows)
    with pytest.raises(ValueError, match="bits"):
        language_id.fit(df, bits=20)
    assert len(language_id.fit(df, bits=12, most_rows=10).languages) == 70


def test_training_is_ftrl():
    """One pass against the update rule written out by coordinate."""
    r, k, size = random.Random(13), 3, 8
    idf = np.ones(size)
    rows = [(np.array(sorted(r.sample(range(size), 3))), np.array([r.random() for _ in range(3)]), r.randrange(k)) for _ in range(40)]
    order = np.random.default_rng(11).permutation(len(rows))[len(rows) // 5 :]
    z, n = ([[0.0] * k for _ in range(size + 1)] for _ in range(2))

    def weight(i, c):
        if abs(z[i][c]) <= language_id.L1:
            return 0.0
        sign = 1 if z[i][c] > 0 else -1
        return -(z[i][c] - sign * language_id.L1) / ((language_id.BETA + n[i][c] ** 0.5) / language_id.ALPHA + language_id.L2)

    for row in np.random.default_rng(11).permutation(order):
        at, x, y = rows[row]
        pairs = [*zip(at.tolist(), x.tolist(), strict=True), (size, 0.1)]
        w = {(i, c): weight(i, c) for i, _ in pairs for c in range(k)}
        e = [np.exp(sum(v * w[i, c] for i, v in pairs)) for c in range(k)]
        for c in range(k):
            error = e[c] / sum(e) - (c == y)
            for i, v in pairs:
                g = v * error
                sigma = ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / language_id.ALPHA
                z[i][c] += g - sigma * w[i, c]
                n[i][c] += g * g
    model = language_id.train(rows, ["a", "b", "c"], idf, epochs=1)
    assert np.allclose(model.weights, [[weight(i, c) for c in range(k)] for i in range(size)], atol=1e-6)
    assert np.allclose(model.bias, [0.1 * weight(size, c) for c in range(k)])


def test_windows_of_long_texts(monkeypatch):
    text = "Größe und ñandú, " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "WINDOW", 37)
    assert (language_id.counts(text) == whole).all()


# --- search


def vectors(seed=1, n=220, dim=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim)).astype(np.float32)
    base[: n // 3] = base[0]  # one vector fills a third
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    return rows + [(1000, None, 0), (1050, [1.0] * (dim - 1) + [float("nan")], 0), (1100, [None] * dim, 0), (1150, [float("inf")] * dim, 0), (None, [1.0] * dim, 0)]


def test_topk_query(spark, tables):
    sf = tables(embeddings=(vectors(), "vec_id long, embedding array<float>, label int"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet' WHERE vec_id IS NOT NULL")
    assert sorted(map(tuple, QUERIES["op10_exact_topk"](spark, sf).collect())) == sorted(con.sql(ORACLE_SQL["op10_exact_topk"]).fetchall())


@pytest.mark.parametrize(("k", "segments", "block"), [(1, 1, 16), (3, 4, 7), (10, 2, 1000)])
def test_topk_in_blocks(spark, k, segments, block):
    rows = [x for x in vectors(2, 60) if x[0] is not None and x[0] < 1000]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 7 == 0, k=k, segments=segments, block=block, query_block=3).collect()))
    q = np.floor(256 * np.array([v for _, v, _ in rows], np.float32).astype(float)).astype(int)
    want = []
    for i in range(0, 60, 7):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(60) if j != i)[:k]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_phases_save_work():
    r = np.random.default_rng(4)
    q, v = np.floor(256 * r.normal(size=(30, 64))).astype(np.int64), np.floor(256 * r.normal(size=(4000, 64))).astype(np.int64)
    lists, full = topk_search.Lists(q, v, 2), q @ v.T
    at = lists.leaders(6)
    cutoff = np.sort(lists.scores(at).reshape(30, -1), axis=1)[:, -6]
    seen = []
    lists.resolved = lambda s, at: seen.append(len(at[0])) or topk_search.Lists.resolved(lists, s, at)
    rows, cols, scores = lists.sufficient(cutoff)
    assert max(seen) < 0.15 * full.size and (scores == full[rows, cols]).all()
    assert set(zip(rows.tolist(), cols.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(full >= cutoff[:, None])), strict=True))
    lists.partial = lambda s: pytest.fail("a list that can't reach the cutoff was looked through")
    assert not len(lists.sufficient(np.full(30, 1 << 60))[0])
    asks, ids, best = topk_search.first_of(np.array([2, 1, 2, 2, 1]), np.array([5, 9, 4, 8, 3]), np.array([7, 1, 7, 9, 1]), 2)
    assert (asks.tolist(), ids.tolist(), best.tolist()) == ([1, 1, 2, 2], [3, 9, 8, 4], [1, 1, 9, 7])


def test_topk_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROUND", 1)
    test_topk_in_blocks(spark, 3, 4, 16)


def test_topk_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 0.0]), (50, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 3, 256 * 256)]


# --- pipeline


def test_pipeline(spark, tables):
    r = random.Random(9)
    words = {"en": "the of and to in is that with this from have not they were been".split(), "de": "der die und das nicht eine mit sich auch werden über für ist ein".split()}
    docs = [(i, " ".join(r.choice(words[k]) + str(r.randrange(50)) * (r.random() < 0.5) for _ in range(80)), k, "s", 0) for i, k in ((i, ("en", "de")[i % 2]) for i in range(60))]
    docs += [(100, docs[0][1], "en", "s", 0), (101, docs[1][1] + " more", "de", "s", 0), (102, "12345 !!", "en", "s", 8), (103, docs[2][1] + " token = 'abcdefgh12345678'", "en", "s", 0), (104, None, None, None, None)]
    docs = [(*x[:4], len(x[1] or "")) for x in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = tables(documents=(docs, schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "packing"]
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == [x.split()[0] for x in schema.split(", ")]
    left = {x.doc_id: x.text for x in kept.collect()}
    want = brute_components(shingle_sets([x[:2] for x in docs if x[0] not in (102, 104)], 5))
    assert set(left) == {d for d, c in want.items() if d == c}
    assert not any("abcdefgh" in (x or "") for x in left.values())
    pieces = corpus_pipeline.run(spark, sf)
    assert {x.doc_id for x in pieces.select("doc_id").distinct().collect()} == set(left)


def test_pipeline_on_odd_rows(spark, tables):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, hash string, label string, a int, __nw_x int"
    rows = [(None, "some words of a text without an id", None, "s", 1, "i", "h", "l", 2, 3), (None, "some words of a text without an id", None, "s", 1, "i", "h", "l", 2, 3), (7, "seven " * 40, None, None, None, None, None, None, None, None), (8, None, "en", "s", 0, "i", "h", "l", 2, 3), (9, "½ 12", "en", "s", 0, "i", "h", "l", 2, 3), (7, "seven " * 40, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [f.name for f in spark.createDataFrame(rows, schema).schema]
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, rows[0][1]), (7, rows[2][1])]  # nothing to learn from: all with a letter stay
    empty = tables(documents=([], "doc_id long, text string, lang string, source string, n_chars long"))
    assert corpus_pipeline.run(spark, empty).count() == 0
