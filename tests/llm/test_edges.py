"""Ids at both ends of long, long repetitive words, hot columns, and plain versions of what is learned."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import decontaminate, lang_id, license_scan, lz_fingerprint, merkle, mixing, ngram_join, pii, quality_knn, tokens
from tests.llm.test_llm import DOCS, _components, _feistel, docs

ENDS = [-(2**63), -1, 0, 2**53 + 1, 2**62 + 5, 2**62 + 9, 2**63 - 1]
PAGES = "page_id long, url string, html string"


def _thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_thue_morse_words_are_different(spark):
    a, b = _thue_morse(2048)
    raw, starts, ends = tokens.text_spans(pa.array([a, b, a]))
    hashes, _ = tokens.word_hashes(raw, starts, ends, tokens.NOT_SPACE)
    assert hashes[0] == hashes[2] != hashes[1]
    out = ngram_join.ngram_jaccard_components(docs(spark, [a, b])).collect()
    assert {r["component_id"] for r in out} == {0, 1}
    bench = spark.createDataFrame([("x", a)], "item_id string, text string")
    assert [r["n_hit"] for r in decontaminate.contamination(docs(spark, [a, b]), bench).orderBy("doc_id").collect()] == [1, 0]


def test_spans_equal_wherever_they_stand():
    text = b"abcdefghijklmnopqrstuvwxyz" * 3
    data = np.frombuffer(text, np.uint8)
    for size in (1, 7, 8, 9, 16, 26):
        begin = np.array([0, 26, 52])
        assert len(set(tokens.span_hashes(data, begin, begin + size).tolist())) == 1
        assert tokens.span_hashes(data, begin[:1], begin[:1] + size)[0] != tokens.span_hashes(data, begin[:1], begin[:1] + size, 1)[0]


# 1. Merkle audit.


def test_audit_of_ids_at_both_ends(spark):
    rows = [(i, "u", f"h{i}") for i in ENDS]
    changed = [(i, "u", "other" if i in (ENDS[0], ENDS[-1]) else h) for i, _, h in rows if i != 2**62 + 5]
    out = merkle.audit(spark.createDataFrame(rows, PAGES), spark.createDataFrame(changed, PAGES)).collect()
    assert {(r["page_id"], r["status"]) for r in out} == {(ENDS[0], "changed"), (ENDS[-1], "changed"), (2**62 + 5, "missing")}


def test_audit_splits_hot_ids_and_reads_differing_ranges_only(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPLIT_AT", 16)
    monkeypatch.setattr(merkle, "RANGE", 1000)
    rows = [(None, "u", str(i)) for i in range(60)] + [(7, "u", str(i)) for i in range(60)] + [(i, "u", "h" * 200) for i in range(300)] + [(None, "same", "same")] * 40
    other = [r for r in rows if r not in [(None, "u", "3"), (7, "u", "9")]][:-3] + [(5000, "n", "n")]
    other = [(i, u, "x" if i == 123 else h) for i, u, h in other]
    a, b = spark.createDataFrame(rows, PAGES), spark.createDataFrame(other, PAGES)
    got = Counter((r["page_id"], r["copy"], r["status"]) for r in merkle.audit(a, b).collect())
    assert got == Counter([(None, 1, "missing"), (7, 1, "missing"), (5000, 1, "extra"), (123, 1, "changed"), *((None, k, "missing") for k in (38, 39, 40))])
    x, y = (merkle._entries(t, "page_id", "url", "html") for t in (a, b))
    layout = merkle._layout(x, y)
    placed = merkle.catalogue(x, layout)
    assert placed.groupBy("slot", "sub").count().agg(F.max("count")).first()[0] <= 4 * 16 + 300
    own = merkle.ranged(y, layout, merkle.range_bounds(placed))
    top = merkle._highest(placed, own)
    bad = merkle.differing_ranges(merkle.tree(placed, top), merkle.tree(own, top))
    compared = placed.join(bad, ["slot", "sub", "number"], "left_semi")
    total, read = placed.count(), compared.count()
    assert 0 < read < total / 4
    # Ranges whose digests agree hold no record that is compared.
    same = placed.join(bad, ["slot", "sub", "number"], "left_anti").select("id", "leaf", "c")
    assert same.exceptAll(own.select("id", "leaf", "c")).count() == 0 and merkle.differing_ranges(merkle.tree(placed, top), merkle.tree(placed, top)) is None


# 2. Pseudonyms.


def test_mail_with_thousands_of_labels(spark):
    out = pii.pseudonymize(docs(spark, ["me@" + "ab." * 5000 + "com and you@x.org"]), "k").first()
    assert out["text"].endswith("@x.org") and "you@" not in out["text"]


def test_other_kinds_equal_a_plain_feistel(spark):
    values = ["+1 (826) 555-4081", "123-45-6789", "2024-02-29", "31/12/1999"]
    got = [r["text"] for r in pii.pseudonymize(docs(spark, values), "k").orderBy("doc_id").collect()]
    h, low = _feistel(82655, 54081, 10**5, 10**5, "phone10", "k")
    digits = f"{h:05d}{low:05d}"
    assert got[0] == f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"
    h, low = _feistel(122, 44 * 9999 + 6788, 898, 99 * 9999, "ssn", "k")
    assert got[1] == f"{h + (2 if h >= 665 else 1):03d}-{low // 9999 + 1:02d}-{low % 9999 + 1:04d}"
    day = lambda y, m, d: (np.datetime64(f"{y}-{m:02d}-{d:02d}") - np.datetime64("1800-01-01")).astype(int)
    for text, n in ((got[2], day(2024, 2, 29)), (got[3], day(1999, 12, 31))):
        h, low = _feistel(int(n) // 773, int(n) % 773, 189, 773, "date", "k")
        want = str(np.datetime64("1800-01-01") + h * 773 + low)
        assert text == want or text == "/".join(reversed(want.split("-")))


def test_pseudonyms_of_repeated_rows_empty_tables_and_clashing_names(spark):
    table = spark.createDataFrame([(1, "a@x.org +1 (826) 555-4081", 5)] * 2 + [(None, None, 6)], f"{DOCS}, n_email long")
    out = pii.pseudonymize(table, "k")
    rows = out.collect()
    assert sorted(out.columns) == sorted({*table.columns, *(f"n_{k}" for k in pii.KINDS)}) and len(rows) == 3
    assert rows[0] == rows[1] and rows[0]["n_email"] == 1 and rows[2]["n_email"] == 0
    assert pii.pseudonymize(table.limit(0), "k").count() == 0


# 3. N-gram join.


def test_components_of_ids_at_both_ends(spark):
    table = spark.createDataFrame([(i, f"own words of document {k // 2} stand right here") for k, i in enumerate(ENDS)] + [(None, "nobody else has written this text")], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(table).collect()}
    assert got == {i: ENDS[k // 2 * 2] for k, i in enumerate(ENDS)} | {None: None}


def test_sets_of_one_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "KEY_BITS", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") for _ in range(12)) for _ in range(40)]
    texts += texts[:5]
    got = [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == _components(texts)


def test_few_candidates_among_short_documents_around_one_passage(spark, monkeypatch):
    """2,000 documents of one common passage and words of their own, none linked with another."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([f"a{rng.randrange(10**9)}" for _ in range(9)] + passage + [f"z{rng.randrange(10**9)}" for _ in range(9)]) for _ in range(2000)]
    counts = {}
    kept = ngram_join.staged

    def counted(df, name):
        out = kept(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    monkeypatch.setattr(ngram_join, "COLUMN_LOAD", 300)
    out = ngram_join.ngram_jaccard_components(docs(spark, texts))
    assert out.filter("doc_id = component_id").count() == 2000
    assert counts["ngram-stars"] + counts["ngram-pairs"] < 10_000


def test_blocks_of_a_column_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMN_LOAD", 4)
    rng = random.Random(31)
    texts = []
    for g in range(4):
        words = [f"g{g}w{k}" for k in range(40)]
        for _ in range(25):
            kept = list(words)
            for _ in range(rng.choice([1, 2, 3, 5])):
                kept[rng.randrange(40)] = f"x{rng.randrange(50)}"
            texts.append(" ".join(kept))
    got = [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs(spark, texts), size=1).orderBy("doc_id").collect()]
    assert got == _components(texts, size=1)


def test_bitmaps_differ_by_no_more_than_sets():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (300, 50))
    sets = [a, np.sort(np.concatenate([a[10:], b])), b, b[:0]]
    at = np.cumsum([0, *map(len, sets)])
    maps = ngram_join._bitmaps(np.concatenate(sets), at)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            bits = sum(int(v).bit_count() for v in (maps[i] ^ maps[j]).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y)) and (bits == 0) == (i == j)


# 4. Licences.


@pytest.fixture(scope="module")
def licence_model():
    background = ["The mill stood by the river and the miller slept.", "Prices of grain rose in the spring.", "She read the letter twice and put it away."] * 40
    return license_scan.train(background)


def test_licence_scores_equal_a_plain_sum(licence_model):
    texts = ["Released under the MIT License.", "The mill stood.", "", "License under MIT the Released"]
    hashed = lambda words: [int(tokens.word_hashes(*tokens.text_spans(pa.array([w], pa.large_string())), tokens.ALNUM)[0][0]) for w in words]
    spread = lambda x: int(tokens.mix(np.array([x % 2**64], np.uint64))[0])
    for text in texts:
        h = hashed(re.findall(r"[a-z0-9]+", text.lower()))
        terms = [x % license_scan.FEATURES for x in h] + [spread(a * 0x9E3779B97F4A7C15 + b) % license_scan.FEATURES for a, b in zip(h, h[1:], strict=False)]
        z = (sum((licence_model.weights[t] for t in terms), np.zeros(len(license_scan.FAMILIES) + 1)) / max(1, len(terms)) ** 0.5 + licence_model.bias) / licence_model.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert licence_model.probabilities(*license_scan._encoded([text]), 1)[0] == pytest.approx(want)


def test_denied_licences_are_not_found(licence_model):
    denied = ["We never released it under the MIT License.", "It was not licensed under the Apache License, Version 2.0.", "This is no work licensed under the GNU General Public License, version 3."]
    stated = ["Released under the MIT License, with no warranty.", license_scan.TEMPLATES["apache-2.0"][1]]
    templates = license_scan._template_words()
    found = [[f for _, f, _ in x] for _, x in license_scan.scan_batch(licence_model, templates, pa.array(denied + stated))]
    assert found == [[], [], [], ["mit"], ["apache-2.0"]]
    assert license_scan.confirmed("We released it under the MIT License. It was never sold.", "mit", templates)


# 5. Language.


def _plain_forward(net, window):
    """One window through the network, filter by filter."""
    x = net.embed[window]
    pooled = []
    for k in range(net.filters.shape[1]):
        w = net.filters[:, k].reshape(max(lang_id.WIDTHS), lang_id.EMBED)
        best = max(float((x[p : p + len(w)] * w).sum()) for p in range(len(x) - len(w) + 1))
        pooled.append(max(0.0, best + float(net.bias[k])))
    z = np.array(pooled) @ net.dense + net.dense_bias
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_language_equals_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    windows = rng.integers(97, 123, (60, lang_id.WINDOW)).astype(np.uint8)
    net = lang_id.train(windows, ["a", "b", "c"] * 20, epochs=1)
    texts = ["abc", "word " * 100, "é" * 200]
    classes, scores = lang_id.predict_batch(net, pa.array(texts))
    for k, text in enumerate(texts):
        data, total = text.encode(), np.zeros(3)
        for i in range(0, len(data), lang_id.WINDOW):
            part = np.frombuffer(data[i : i + lang_id.WINDOW], np.uint8)
            total += _plain_forward(net, np.pad(part, (0, lang_id.WINDOW - len(part)))) * len(part)
        assert classes[k] == total.argmax() and scores[k] == pytest.approx(total.max() / len(data), abs=1e-4)


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(lang_id, "LEAST_DOCS", 20)
    rng = random.Random(6)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zxq", "qqz", "xxz", "zzq"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(["aa"] * 3000 + ["bb"] * 30)]
    table = spark.createDataFrame(rows, f"{DOCS}, lang string")
    assert lang_id.learn(table).langs == ["aa", "bb"]
    out = lang_id.language_id(table).join(table.select("doc_id", "lang"), "doc_id").filter("lang = 'bb' and held_out").collect()
    assert out and all(r["lang_pred"] == "bb" for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_a_language_of_few_ids_and_many_rows_is_learned(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for one in (i for i in range(2, 6) if not held(i)):
        rows = [(one, "zxq qqz xxz zzq " * 8, "xx")] * 6000 + [(i, "lorem ipsum dolor amet " * 8, "en") for i in range(100, 130)]
        table = spark.createDataFrame(rows, f"{DOCS}, lang string")
        assert lang_id.learn(table).langs == ["en", "xx"]


# 7. Quality.


def test_quality_tells_documents_apart_by_their_words(spark):
    rng = random.Random(7)
    words = {1: ["river", "bridge", "valley", "meadow", "forest"], 0: ["bargain", "coupon", "winner", "casino", "jackpot"]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = quality_knn.quality_votes(spark.createDataFrame(rows, DOCS), labels).filter("held_out").collect()
    assert len(out) > 50 and all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_equally_near_neighbours_count_from_the_first():
    space = quality_knn.LabelledSpace(np.eye(quality_knn.TERMS, 4, dtype=np.float32), np.tile(np.array([[1, 0, 0, 0]], np.float32), (60, 1)), np.array([1.0] * 25 + [0.0] * 35))
    counts = np.zeros((1, quality_knn.TERMS), np.float32)
    counts[0, 0] = 1
    assert space.vote(counts) == pytest.approx([1.0])


# 8. Fingerprints.


def test_hot_ids_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "RANGE_BYTES", 300)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(12))
    rows = [(None if i % 3 else i, text()) for i in range(300)] + [(7, text()) for _ in range(60)]
    table = spark.createDataFrame(rows, DOCS)
    got = lz_fingerprint.lz_fingerprints(table).collect()
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in table.select("*", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r]))
    after = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    want = Counter()
    for (i, t), nxt in after.items():
        half = len(t) // 2
        want[(i, __import__("hashlib").sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


# 9. Mixing.


def test_mix_of_sizes_with_gaps_meets_targets(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 4] * 6 + [9, 17, 40, 90])), rng.choice("aaab")) for i in range(1500)]
    out = mixing.entropy_mix(spark.createDataFrame(rows, f"{DOCS}, source string")).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["taken"] == r["copies"] * r["size"]
    assert {s: round(taken[s] - target[s], 2) for s in target if abs(taken[s] - target[s]) > 1} == {}


def test_mix_of_many_sizes_is_rounded_exactly(spark):
    """Over 4096 different sizes in one source, one document each, against a plain rounding of the rates."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', int(IF(id < 5000, id + 1, 50 + id % 3))) AS text", "IF(id < 5000, 'a', 'b') AS source")
    out = [r for r in mixing.entropy_mix(rows, (1.0, 1.0)).collect() if r["size"]]
    for source in "ab":
        own = [r for r in out if r["source"] == source]
        by_size = {}
        for r in own:
            by_size.setdefault(r["size"], []).append(r)
        carry = 0.0
        for size in sorted(by_size, reverse=True):
            same = by_size[size]
            wanted = sum(r["rate"] for r in same) * size + carry
            low = len(same) * min(3, int(same[0]["rate"]))
            copies = low + (min(max(int(np.floor(wanted / size - low + 0.5)), 0), len(same)) if same[0]["rate"] < 3 else 0)
            carry = wanted - copies * size
            assert sum(r["copies"] for r in same) == copies
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(by_size) / 2 + 1e-6 * own[0]["target"]
    # What "everything once" is tilted to: the logarithm of a rate below the cap is proportional to the size.
    tilt = [np.log(r["rate"]) / r["size"] for r in out if r["source"] == "a" and r["rate"] < 2.999]
    assert len(tilt) > 4096 and max(tilt) - min(tilt) < 1e-9


def test_mix_says_when_rates_do_not_settle(spark):
    rows = [(i, "w " * (i % 30 + 1), "ab"[i % 7 > 4]) for i in range(200)]
    with pytest.raises(RuntimeError, match="not settled"):
        mixing.entropy_mix(spark.createDataFrame(rows, f"{DOCS}, source string"), steps=1, tolerance=1e-12).collect()


# The pipeline.


def test_run_equals_a_plain_pipeline(spark):
    """run() over the smallest tables: the first stage is the network's own, the others are plain here."""
    import corpus_pipeline
    from tests.llm.test_llm import SF, _contamination, _targets

    first = lang_id.keep_identified(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "text", "source").collect()
    rows, seen = [], set()
    for r in sorted(first, key=lambda r: r["doc_id"]):
        lines, gone = (r["text"] or "").split("\n"), set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if window in seen else set()
            seen.add(window)
        rows.append((r["doc_id"], "\n".join(x for k, x in enumerate(lines) if k not in gone), r["source"]))
    components = _components([t for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if components[k][1] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, c in zip(rows, _contamination([t for _, t, _ in rows], items), strict=True) if not c[-1]]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    sources = Counter()
    for i, _, s in rows:
        sources[s] += size[i]
    want = _targets(dict(sources))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["size"] for r in out} == size
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sources[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in sources)
